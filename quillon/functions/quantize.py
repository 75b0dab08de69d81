"""Random rotation and Lloyd-Max scalar quantisation of unit vectors, with sign sketches of the residual.

Constants (rotation, codebook) are made on the driver and are small: dimension squared. Bulk encoding
and scoring run on Arrow batches with matrix products; the same code as Column expressions serves
small dimensions and the oracle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinate_density(x: np.ndarray, d: int) -> np.ndarray:
    """Density of one coordinate of a random unit vector in d dimensions."""
    log_c = math.lgamma(d / 2) - math.lgamma((d - 1) / 2) - 0.5 * math.log(math.pi)
    inside = np.clip(1 - x * x, 1e-300, None)
    return np.where(np.abs(x) < 1, np.exp(log_c + (d - 3) / 2 * np.log(inside)), 0.0)


@lru_cache(maxsize=64)
def codebook(bits: int, d: int, points: int = 8001, rounds: int = 1000) -> tuple[float, ...]:
    """Centroids of least mean squared error for a coordinate of a unit vector."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be between 1 and 8")
    x = np.linspace(-1, 1, points)
    w = coordinate_density(x, max(d, 2))
    x, w = x[w > 1e-12], w[w > 1e-12]
    reach = min(0.99, 3 / math.sqrt(d))
    c = (np.arange(1 << bits) + 0.5) / (1 << bits) * 2 * reach - reach
    for _ in range(rounds):
        cell = np.searchsorted((c[1:] + c[:-1]) / 2, x, side="left")
        mass = np.bincount(cell, w, len(c))
        new = np.where(mass > 0, np.bincount(cell, w * x, len(c)) / np.where(mass > 0, mass, 1), c)
        done = np.abs(new - c).max() < 1e-9
        c = new
        if done:
            break
    return tuple(float(v) for v in c)


def expected_error(centroids: tuple[float, ...], d: int, points: int = 8001) -> float:
    """Expected squared error of a whole unit vector."""
    x = np.linspace(-1, 1, points)
    c = np.asarray(centroids)
    near = c[np.abs(x[:, None] - c[None]).argmin(axis=1)]
    return float((((x - near) ** 2) * coordinate_density(x, d)).sum() * (x[1] - x[0]) * d)


def midpoints(centroids: tuple[float, ...]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centroids[:-1], centroids[1:])]


def haar_rotation(d: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal transform of the rows of x; their length is a power of two."""
    x, n, h = np.array(x, float), x.shape[-1], 1
    if n & (n - 1):
        raise ValueError("length must be a power of two")
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(*x.shape)
        h *= 2
    return x / math.sqrt(n)


def hadamard_rotation(d: int, seed: int = 42) -> np.ndarray:
    """Random signs, then the transform, as a matrix; d is padded to a power of two (rows of the result)."""
    n = 1 << max(0, math.ceil(math.log2(d)))
    signs = np.where(np.random.default_rng(seed).random(n) < 0.5, -1.0, 1.0)
    return walsh_hadamard(np.diag(signs))[:, :d] if n == d else walsh_hadamard(np.diag(signs)).T[:, :d]


@dataclass(frozen=True)
class Quantizer:
    d: int
    bits: int
    rotation: np.ndarray  # rows: output coordinates
    centroids: tuple[float, ...]
    sketch: np.ndarray | None = None  # rows: projections for the sign sketch of the residual

    @staticmethod
    def make(d: int, bits: int = 4, seed: int = 42, kind: str = "dense", sketch: bool = False) -> Quantizer:
        rotation = haar_rotation(d, seed) if kind == "dense" else hadamard_rotation(d, seed)
        s = np.random.default_rng(seed + 1).standard_normal((rotation.shape[0], rotation.shape[0])) if sketch else None
        return Quantizer(d, bits, rotation, codebook(bits, rotation.shape[0]), s)

    @staticmethod
    @lru_cache(maxsize=16)
    def cached(d: int, bits: int = 4, seed: int = 42, kind: str = "dense") -> Quantizer:
        return Quantizer.make(d, bits, seed, kind)

    # numpy, for batches
    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms): codes of the rotated unit vectors; ties go to the lower centroid."""
        n = np.linalg.norm(v, axis=1)
        y = (v / np.maximum(n, 1e-12)[:, None]) @ self.rotation.T
        return np.searchsorted(midpoints(self.centroids), y, side="left").astype(np.uint8), n

    def decode(self, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (np.asarray(self.centroids)[codes] @ self.rotation) * norms[:, None]

    def signs(self, v: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed sign bits, residual norm) of what the codes leave of the rotated unit vector."""
        y = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]) @ self.rotation.T
        r = y - np.asarray(self.centroids)[codes]
        return np.packbits(r @ self.sketch.T >= 0, axis=1, bitorder="little"), np.linalg.norm(r, axis=1)

    def residual_dot(self, q: np.ndarray, bits: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Unbiased estimate of q with each residual from its sign sketch; q: one query."""
        m = self.sketch.shape[0]
        plus = np.unpackbits(bits, axis=1, count=m, bitorder="little") * 2.0 - 1
        return gamma * math.sqrt(math.pi / 2) / m * (plus @ (self.sketch @ (self.rotation @ q)))

    # expressions, for small dimensions and the oracle
    def code_column(self, v: Column | str) -> Column:
        """Codes of a unit vector column."""
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in self.rotation])
        cuts = F.array(*[F.lit(x) for x in midpoints(self.centroids)])
        v = F.col(v) if isinstance(v, str) else v
        return F.transform(rows, lambda r: F.size(F.filter(cuts, lambda b: b < F.aggregate(F.zip_with(r, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))

    def approx_dot(self, codes: Column, rotated_query: Column) -> Column:
        table = F.array(*[F.lit(x) for x in self.centroids])
        return F.aggregate(F.zip_with(codes, rotated_query, lambda c, y: F.element_at(table, c + 1) * y), F.lit(0.0), lambda s, x: s + x)


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of ``bits`` bits each, lowest bit first, rows padded to whole bytes."""
    planes = (codes[..., None] >> np.arange(bits)) & 1
    return np.packbits(planes.reshape(len(codes), codes.shape[1] * bits).astype(np.uint8), axis=1, bitorder="little")


def unpack(packed: np.ndarray, bits: int, d: int) -> np.ndarray:
    planes = np.unpackbits(packed, axis=1, count=bits * d, bitorder="little").reshape(len(packed), d, bits)
    return (planes << np.arange(bits, dtype=np.uint8)).sum(axis=2).astype(np.uint8)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers each as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def with_codes(df: DataFrame, quantizer: Quantizer, vector_col: str = "vector") -> DataFrame:
    """df with ``code`` (packed) and ``norm`` of its vectors; null where there is no vector."""
    shared = df.sparkSession.sparkContext.broadcast(quantizer)

    @F.arrow_udf("code binary, norm double")
    def coded(vectors: pa.Array) -> pa.Array:
        z = shared.value
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        codes, norms = z.encode(matrix(vectors.drop_null(), z.d))
        packed = iter(pack(codes, z.bits))
        size = iter(norms)
        out = [pa.array([next(packed).tobytes() if ok else None for ok in valid], pa.binary()), pa.array([float(next(size)) if ok else None for ok in valid], pa.float64())]
        return pa.StructArray.from_arrays(out, ["code", "norm"])

    return df.withColumn("c_", coded(vector_col)).select(*df.columns, "c_.code", "c_.norm")


def encode_frame(df: DataFrame, quantizer: Quantizer, id_col: str, vector_col: str) -> DataFrame:
    """(id, codes binary, norm[, signs binary, gamma]) by matrix products on Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(quantizer)
    sketch = quantizer.sketch is not None
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, codes binary, norm double" + (", signs binary, gamma double" if sketch else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf[vector_col].to_numpy()).astype(float)
            codes, norms = q.encode(v)
            out = pd.DataFrame({id_col: pdf[id_col].to_numpy(), "codes": [x.tobytes() for x in pack(codes, q.bits)], "norm": norms})
            if sketch:
                signs, gamma = q.signs(v, codes)
                out["signs"], out["gamma"] = [x.tobytes() for x in signs], gamma
            yield out

    return df.select(id_col, vector_col).mapInPandas(run, schema)


def decode_frame(coded: DataFrame, quantizer: Quantizer, id_col: str, vector_col: str = "vector") -> DataFrame:
    """(id, vector): reconstructions of what encode_frame wrote."""
    shared = coded.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            packed = np.stack([np.frombuffer(x, np.uint8) for x in pdf["codes"]])
            v = q.decode(unpack(packed, q.bits, q.rotation.shape[0]), pdf["norm"].to_numpy())
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), vector_col: list(v)})

    return coded.select(id_col, "codes", "norm").mapInPandas(run, f"{id_col} {coded.schema[id_col].dataType.simpleString()}, {vector_col} array<double>")


def sign_words(v: Column | str) -> Column:
    """The signs of a vector (bit set where >= 0) as an array of 32-bit words in longs."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1),
        lambda w: F.aggregate(F.slice(v, w * 32 + 1, 32), F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("p")), lambda a, x: F.struct((a["s"] + F.when(x >= 0, a["p"]).otherwise(F.lit(0).cast("long"))).alias("s"), (a["p"] * 2).alias("p")), lambda a: a["s"]),
    )


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_similarity(a: Column, b: Column, bits: int) -> Column:
    """The share of bits that agree."""
    return 1 - hamming(a, b) / F.lit(bits)
