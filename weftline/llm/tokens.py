"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import ship

DEFAULT_TOKENIZERS = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabularies", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = (Path(folder) / vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text_column: str, folder: str = DEFAULT_TOKENIZERS, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Replaces the text by ``n_tokens``, its number of tokens; null and empty texts have none.

    Whole texts are encoded, in batches. Special tokens' strings in a text are ordinary text.
    A column called ``n_tokens`` is replaced; all others stay. ``folder`` must be readable on
    every executor.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_column, "n_tokens")]
    flat = docs.select(*keep, F.col(text_column).alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(folder, vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index("n_tokens")
            texts = batch.column(at).to_pylist()
            n = [len(x) for x in encoding.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]
            columns = list(batch.columns)
            columns[at] = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = flat.withColumn("n_tokens", F.lit(0).cast("long")).schema
    return flat.mapInArrow(run, schema)
