"""Token counts under a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmill.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("driftmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(path: str, text: str | None) -> int:
    """Tokens of a text; null and empty texts have none. Lone surrogates count as the replacement character."""
    if not text:
        return 0
    return len(encoder(path).encode_ordinary(text))


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` plus n_tokens (long), the tokens of the whole text."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((count(vocabulary, t) for t in b.column("_text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(n)], names=[*keep, "n_tokens"])

    return spread(df.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, f"{kinds}, n_tokens bigint")
