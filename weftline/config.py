"""Configurations: how texts become tokens, and how documents are reduced and compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TextConfig:
    """The ten switches of a run, each named by its two-letter code in file names.

    ``single_document_terms`` (DO) acts only together with ``single_terms`` (MU).
    """

    all_comments: bool = False  # AC
    source_code: bool = False  # SC: remove code, traces and form text
    stemming: bool = False  # SM
    stop_words: bool = False  # SR
    double_title: bool = False  # DW
    bigrams: bool = False  # BG
    spelling: bool = False  # SY
    lower: bool = False  # LO
    single_terms: bool = False  # MU: drop terms that occur once
    single_document_terms: bool = False  # DO: drop terms of one document
    corrections: Mapping[str, str] = field(default_factory=dict, hash=False)
    stop_list: Sequence[str] | None = field(default=None, hash=False)  # None: the usual English list
    extra_stop_list: Sequence[str] = field(default=(), hash=False)  # only used when SY is on too

    _CODES = (
        ("all_comments", "AC"), ("source_code", "SC"), ("stemming", "SM"), ("stop_words", "SR"), ("double_title", "DW"),
        ("bigrams", "BG"), ("spelling", "SY"), ("lower", "LO"), ("single_terms", "MU"), ("single_document_terms", "DO"),
    )

    def suffix(self) -> str:
        """The part of a file name that tells the configuration, such as ``_AC_SC_LO``."""
        return "".join(f"_{code}" for name, code in self._CODES if getattr(self, name))

    @classmethod
    def from_codes(cls, codes: str | Sequence[str], **more) -> "TextConfig":
        """A configuration from codes, as a list or in the form of ``suffix``."""
        wanted = [c for c in (codes.split("_") if isinstance(codes, str) else codes) if c]
        known = {code: name for name, code in cls._CODES}
        return cls(**{known[c]: True for c in wanted}, **more)

    @classmethod
    def from_switches(cls, switches: Mapping[str, str | bool], **more) -> "TextConfig":
        """A configuration from ``{code: "On" | "Off" | bool}``."""
        on = [c for c, v in switches.items() if v is True or str(v).strip().lower() == "on"]
        return cls.from_codes(on, **more)


#: The six switches of the best published runs.
ALL_SIX = TextConfig(all_comments=True, double_title=True, source_code=True, spelling=True, stemming=True, lower=True)


@dataclass(frozen=True)
class LsaConfig:
    """How many singular values stay: a ratio to the largest one, or a number.

    ``k`` empty or 0 keeps values of at least ``ratio`` times the largest; ``k`` >= 1 keeps k, or k + 1
    with ``one_more`` (the counting of the published runs). A negative ``k`` keeps all. ``largest`` is how many values are
    asked for first where their number isn't known beforehand; it bounds nothing.
    """

    k: int | str | None = None
    ratio: float = 0.04
    one_more: bool = True
    largest: int = 300

    def kept(self, values: Sequence[float]) -> int:
        k = int(self.k or 0)
        if not len(values):
            return 0
        if k >= 1:
            return min(len(values), k + int(self.one_more))
        if k < 0:
            return len(values)
        return sum(1 for v in values if v / values[0] >= self.ratio)

    def asked(self) -> int:
        """How many values to compute, or to begin with."""
        k = int(self.k or 0)
        return k + int(self.one_more) if k >= 1 else self.largest

    def enough(self, values: Sequence[float]) -> bool:
        """Whether no value beyond ``values`` can be one to keep."""
        k = int(self.k or 0)
        return k >= 1 or (k == 0 and len(values) > 0 and values[-1] / values[0] < self.ratio)


TRACKERS = {"Bugzilla": 0, "Tigris": 1}
