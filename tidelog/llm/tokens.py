"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Rank file of the tokenizer; a parameter of everything that counts tokens. Nothing of it is copied.
DEFAULT_RANKS = os.environ.get("TIDELOG_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(r"(?<=\S)(?=\s)")
_PIECE = 1 << 20


@lru_cache(None)
def encoding(ranks_path: str):
    """The tokenizer, loaded once a worker process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, ranks_path: str = DEFAULT_RANKS) -> int:
    """Tokens of the whole text; 0 for null.

    Very long texts are cut where white space follows something else: there the
    pattern always begins a new word, so the parts' tokens are the text's tokens.
    """
    if not text:
        return 0
    enc = encoding(ranks_path)
    if len(text) <= _PIECE:
        return len(enc.encode_ordinary(text))
    total, start = 0, 0
    while start < len(text):
        m = _CUT.search(text, start + _PIECE)
        end = m.start() if m else len(text)
        total += len(enc.encode_ordinary(text[start:end]))
        start = end
    return total


def with_sizes(documents: DataFrame, keep: list[str], ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(*keep, n_tokens, k1, k2): sizes and a 128-bit identity of each text. The texts themselves don't leave the scan's stage."""
    from tidelog.functions.hashing import hash128

    rows = documents.select(*(F.col(f"`{c}`") for c in keep), *hash128(documents, ["text"]), "text")
    schema = rows.drop("text").schema.add("n_tokens", T.IntegerType())

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            sizes = pa.array([count(x, ranks_path) for x in batch.column(at).to_pylist()], pa.int32())
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), sizes], names=[*names, "n_tokens"])

    return rows.mapInArrow(sized, schema)
