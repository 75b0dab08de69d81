"""Inverted-file index: k-means by largest inner product, cluster-partitioned storage, probing of the best clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.quantize import matrix


#: Query rows that one group scores against one cluster's part.
GROUP = 4096
#: Rows of a cluster that one task holds; larger clusters are cut by the hash of the id.
CLUSTER_ROWS = 100_000


def train(df: DataFrame, k: int, vector_col: str = "vector", id_col: str = "id", rounds: int = 20, seed_order: Column | None = None) -> np.ndarray:
    """Centroids after at most ``rounds`` rounds over all vectors; a round is one job that returns k sums, not vectors.
    Seeds are the vectors of the k smallest hashes of their ids (or first by ``seed_order``); an empty cluster keeps its centroid."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    seeds = vectors.orderBy(F.xxhash64(id_col) if seed_order is None else seed_order, id_col).limit(k).select("v").collect()
    c = np.array([r[0] for r in seeds])
    if not len(c):
        raise ValueError("no vectors")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for pdf in batches:
                if len(pdf):
                    v = np.stack(pdf["v"].to_numpy())
                    at = (v @ c.T).argmax(axis=1)
                    np.add.at(total, at, v)
                    count += np.bincount(at, minlength=len(c))
            used = np.flatnonzero(count)
            if len(used):  # a partition may be empty, and an empty frame has no lists to tell its type by
                yield pd.DataFrame({"c": used, "n": count[used], "s": list(total[used])})

        new = c.copy()
        parts = vectors.select("v").mapInPandas(sums, "c long, n long, s array<double>")
        merged = parts.select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in merged.collect():
            new[r["c"], r["i"]] = r["x"] / r["n"]
        done = np.abs(new - c).max() < 1e-9
        c = new
        if done:
            break
    return c


@dataclass(frozen=True)
class Ivf:
    centroids: np.ndarray
    assigned: DataFrame  # the table with cluster_id
    id_col: str
    vector_col: str

    @staticmethod
    def build(df: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", rounds: int = 20) -> Ivf:
        c = train(df, k, vector_col, id_col, rounds)
        return Ivf(c, assign(df, c, vector_col), id_col, vector_col)

    def write(self, path: str) -> None:
        """Partitioned by cluster, so a probe reads its clusters only."""
        self.assigned.write.mode("overwrite").partitionBy("cluster_id").parquet(path)

    def search(self, queries: DataFrame, k: int, nprobe: int = 4, metric: str = "ip", query_id: str = "query_id", query_vector: str = "query_vector", digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank) from the ``nprobe`` clusters of largest inner product; l2 searches all. A cluster's
        vectors and the queries that probe it meet in one group and are scored by a matrix product; the k best leave it."""
        from quillon.operators.topk import block_best, rank_by, search_blocks

        if metric == "l2":
            return search_blocks(self.assigned, queries, k, metric, self.id_col, self.vector_col, query_id, query_vector, digits=digits)
        id_name = self.id_col
        id_type, query_type = self.assigned.schema[self.id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
        probed = probes(queries, self.centroids, nprobe, query_id, query_vector)
        own = self.assigned.select(F.col(self.id_col).alias("i"), F.col(self.vector_col).cast("array<double>").alias("v"), "cluster_id").where("v is not null")
        if len(self.centroids) > nprobe:  # only clusters that some query probes are read
            own = own.join(F.broadcast(probed.select("cluster_id").distinct()), "cluster_id", "left_semi")
        sizes = own.groupBy("cluster_id").agg(F.ceil(F.count("*") / CLUSTER_ROWS).cast("int").alias("parts"))
        sizes = F.broadcast(sizes.join(probed.groupBy("cluster_id").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "cluster_id"))
        left = own.join(sizes, "cluster_id").select("cluster_id", F.pmod(F.xxhash64("i"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "i", "v")
        right = probed.join(sizes, "cluster_id").select(F.col("cluster_id").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.pmod(F.xxhash64("q"), "groups").cast("int").alias("h"), "q", "w")

        def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
            names = [query_id, id_name, "score"]
            if not rows.num_rows or not asked.num_rows:
                return pa.table([pa.array([], t) for t in (asked.schema.field("q").type, rows.schema.field("i").type, pa.float64())], names)
            width = len(rows["v"][0])
            r, c, s = block_best(metric, matrix(rows["v"], width), rows["i"], matrix(asked["w"], width), k, digits)
            return pa.table([asked["q"].take(pa.array(r)), c, pa.array(s)], names)

        met = left.groupBy("cluster_id", "part", "g").cogroup(right.groupBy("c", "p", "h")).applyInArrow(score, f"{query_id} {query_type}, {self.id_col} {id_type}, score double")
        return rank_by(met, F.col("score"), V.ascending(metric), self.id_col, [query_id]).where(F.col("rank") <= k)


def assign(df: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """df with ``cluster_id``, the centroid of largest inner product (the first of equals); null without a vector."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(vectors), np.int32)
        out[valid] = (matrix(vectors.drop_null(), shared.value.shape[1]) @ shared.value.T).argmax(axis=1)
        return pa.array(out, mask=~valid)

    return df.withColumn("cluster_id", nearest(vector_col))


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(q, w, cluster_id): every query with its vector and the clusters that it probes; nprobe is clamped to 1..k."""
    n, shared = max(1, min(nprobe, len(centroids))), queries.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def best(vectors: pa.Array) -> pa.Array:
        at = np.argsort(-(matrix(vectors, shared.value.shape[1]) @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(at.ravel()))

    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("w")).where("w is not null")
    return q.select("q", "w", F.explode(best("w")).alias("cluster_id"))


def probes_needed(index: Ivf, df: DataFrame, k: int = 10, sample: int = 64, recall: float = 0.95, metric: str = "ip") -> int:
    """The least number of probes that finds a share ``recall`` of the k best of ``sample`` vectors (those of smallest hash), by measurement."""
    from quillon.operators.topk import search_blocks

    q = df.select(F.col(index.id_col).alias("query_id"), F.col(index.vector_col).alias("query_vector")).orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    truth = search_blocks(df, q, k, metric, index.id_col, index.vector_col)
    where = index.assigned.select(index.id_col, "cluster_id")
    found = truth.join(where, index.id_col).join(probes(q, index.centroids, len(index.centroids)).groupBy("q").agg(F.collect_list("cluster_id").alias("order")), F.col("query_id") == F.col("q"))
    depth = np.sort([r[0] for r in found.select(F.array_position("order", F.col("cluster_id"))).collect()])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) if len(depth) else 1
