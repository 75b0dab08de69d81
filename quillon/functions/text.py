"""Tokens: lower-case runs of letters and digits of any script."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"


def pieces(text: Column | str) -> Column:
    """The tokens, and empty texts before and after them where the text begins or ends with something else."""
    return F.split(F.lower(text), _BREAK)


def tokenize(text: Column | str) -> Column:
    return F.filter(pieces(text), lambda t: t != "")


def token_count(text: Column | str) -> Column:
    return F.size(tokenize(text))


def fnv1a_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FNV-1a of 64 bits of each text of a string buffer, one byte position of all texts at a time."""
    h = np.full(len(offsets) - 1, 0xCBF29CE484222325, np.uint64)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    longest = size[order]
    for i in range(int(longest[0]) if len(longest) else 0):
        rows = order[: np.searchsorted(-longest, -i, side="left")]
        h[rows] = (h[rows] ^ data[offsets[rows] + i].astype(np.uint64)) * np.uint64(0x100000001B3)
    return h


def fnv1a(text: Column | str) -> Column:
    """The hash in decimal digits."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        _, where, data = texts.buffers()
        offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        h = fnv1a_bytes(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets)
        return pa.array([str(x) if ok else None for x, ok in zip(h.tolist(), texts.is_valid().to_pylist())], pa.string())

    return run(text)
