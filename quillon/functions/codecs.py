"""Scalar codecs of vectors: int8, int4, half precision, and the residual that remains after a coarser one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = {"int8": 127, "int4": 7}


def scale(v: Column | str) -> Column:
    return F.greatest(F.array_max(F.transform(v, F.abs)), F.lit(1e-9))


def encode(v: Column | str, kind: str = "int8") -> Column:
    """struct<scale, codes>: codes are rounded half away from zero and clamped."""
    levels, s = LEVELS[kind], scale(v)
    codes = F.transform(v, lambda x: F.greatest(F.lit(-levels), F.least(F.lit(levels), F.round(x / s * levels).cast("int"))).cast("tinyint"))
    return F.struct(s.alias("scale"), codes.alias("codes"))


def decode(coded: Column, kind: str = "int8") -> Column:
    return F.transform(coded["codes"], lambda c: c.cast("double") * coded["scale"] / LEVELS[kind])


def pack_int4(codes: Column) -> Column:
    """Two codes in a byte, the even position in the low half."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(codes) / 2).cast("int") - 1), lambda i: ((F.get(codes, 2 * i) + 8) + F.coalesce(F.get(codes, 2 * i + 1) + 8, F.lit(0)) * 16).cast("smallint"))


def unpack_int4(packed: Column, size: Column | int) -> Column:
    both = F.flatten(F.transform(packed, lambda b: F.array((b.cast("int") % 16 - 8).cast("tinyint"), (F.floor(b / 16).cast("int") - 8).cast("tinyint"))))
    return F.slice(both, 1, size)


def residual(v: Column, approximation: Column) -> Column:
    return F.zip_with(v, approximation, lambda x, y: x - y)


def _flat(v: Column | str, change) -> Column:
    """Applies a numpy function to the elements of all vectors of a batch at once."""

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        own = pa.array(change(vectors.flatten().to_numpy(zero_copy_only=False)), pa.float64())
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), own)
        return out if not vectors.null_count else pc.if_else(vectors.is_valid(), out, None)

    return run(v)


def half(v: Column | str) -> Column:
    """Vectors as half precision keeps them."""
    return _flat(v, lambda x: x.astype(np.float16).astype(float))


def to_brain(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of single precision, halves to even."""
    bits = x.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype(np.uint16)


def from_brain(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(float)


def brain(v: Column | str) -> Column:
    """Vectors as bfloat16 keeps them."""
    return _flat(v, lambda x: from_brain(to_brain(x)))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = x.astype(np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def ordered_key(x: Column | str) -> Column:
    """Doubles as eight bytes, big end first, in the same order."""

    @F.arrow_udf("binary")
    def key(values: pa.Array) -> pa.Array:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        raw = ordered_bits(values.to_numpy(zero_copy_only=False)).astype(">u8").tobytes()
        return pa.array([raw[8 * i : 8 * i + 8] if ok else None for i, ok in enumerate(valid)], pa.binary())

    return key(x)
