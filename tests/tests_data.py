from conftest import DATA

__all__ = ["DATA"]
