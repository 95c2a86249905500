"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank file lies; any byte-level BPE rank file serves.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a rank file; read once in every Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, keys: list[str], text: str, path: str = TOKENIZER, size: str = "n_tokens") -> DataFrame:
    """``keys`` and the number of tokens of the whole ``text``. Rows with a null text are left out; an empty text has 0 tokens.

    Repeated rows stay; columns other than the keys aren't read.
    """
    fields = [f for f in df.schema.fields if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{size}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(sizes, pa.int32())], names=[*(f.name for f in fields), size])

    return df.where(F.col(text).isNotNull()).select(*(F.col(f.name) for f in fields), F.col(text).alias("text")).mapInArrow(run, schema)
