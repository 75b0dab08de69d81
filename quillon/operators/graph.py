"""A proximity graph as an edge table: built by neighbour descent, searched by expanding frontiers for all queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.quantize import matrix
from quillon.operators.topk import dealt, directed, gathered, rank_by, unshelved
from quillon.sources.scratch import cut


#: Bytes of vectors and neighbours that a task holds at once, rows that it works on at once, and pairs scored at once.
BLOCK_BYTES, ROWS, PAIRS = 96 << 20, 4096, 1 << 15
#: Graphs of up to so many nodes are sent to every task in blocks; larger ones are joined.
BLOCK_NODES = 4_000_000


def _numbered(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """((idx, node, v), number of nodes): idx 0, 1, ... in the order of the ids, so that ties by idx are ties by id."""
    v = df.select(F.col(id_col).alias("node"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    placed = cut(v.repartitionByRange("node").sortWithinPartitions("node").withColumn("m", F.monotonically_increasing_id()), "vectors").withColumn("part", F.shiftright("m", 33))
    before, rows = 0, []
    for part, size in sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect()):
        rows.append((part, before))
        before += size
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "part long, before long"))
    return cut(placed.join(offsets, "part").select((F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("idx"), "node", "v"), "nodes"), before


def _lists(pairs: DataFrame, name: str) -> DataFrame:
    """(idx, name): the distinct neighbours of each node of pairs (node, neighbor)."""
    return pairs.groupBy(F.col("node").alias("idx")).agg(F.collect_set("neighbor").alias(name))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("node", "neighbor").unionByName(edges.select(F.col("neighbor").alias("node"), F.col("node").alias("neighbor")))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists; a null is an empty list."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class Nodes:
    """Nodes (idx, v, near) broadcast in blocks of consecutive idx. A task goes over the blocks one at a time."""

    def __init__(self, nodes: DataFrame, n: int, width: int, metric: str, near: int):
        spark, self.n, self.width, self.metric = nodes.sparkSession, n, width, metric
        step = max(1, BLOCK_BYTES // (8 * (width + near)))
        self.blocks = [spark.sparkContext.broadcast(nodes.where((F.col("idx") >= lo) & (F.col("idx") < lo + step)).select("idx", "v", "near").toArrow().sort_by("idx")) for lo in range(0, n, step)]
        self.held = None

    def __getstate__(self):
        return self.__dict__ | {"held": None}

    def _each(self):
        def prepared(rows: pa.Table):
            return rows["idx"][0].as_py(), directed(self.metric, matrix(rows["v"], self.width)), *_flat(rows["near"])

        if len(self.blocks) == 1:
            self.held = self.held or [prepared(self.blocks[0].value)]
        return self.held or unshelved(self.blocks, prepared)

    def around(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Keys (row * n + node) of the neighbours of the nodes c, each of a row r; distinct."""
        out = []
        for lo, v, offsets, near in self._each():
            own = (c >= lo) & (c < lo + len(v))
            at, rows = c[own] - lo, r[own]
            for x in range(0, len(at), PAIRS):
                sizes = offsets[at[x : x + PAIRS] + 1] - offsets[at[x : x + PAIRS]]
                places = np.repeat(offsets[at[x : x + PAIRS]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                out.append(np.unique(np.repeat(rows[x : x + PAIRS], sizes) * self.n + near[places]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def scores(self, q: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Scores of rows of q, as ``directed`` has them, with nodes."""
        r, c = np.divmod(keys, self.n)
        s = np.empty(len(keys))
        for lo, v, _, _ in self._each():
            own = np.flatnonzero((c >= lo) & (c < lo + len(v)))
            for x in range(0, len(own), PAIRS):
                some = own[x : x + PAIRS]
                a, b = q[r[some]], v[c[some] - lo]
                if self.metric == "l2":
                    a -= b
                    s[some] = np.sqrt(np.einsum("ij,ij->i", a, a))
                else:
                    s[some] = np.einsum("ij,ij->i", a, b)
        return s

    def best(self, keys: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
        """Indices of the k best nodes of each row, in order."""
        r, c = np.divmod(keys, self.n)
        order = np.lexsort((c, s if V.ascending(self.metric) else -s, r))
        r = r[order]
        return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def build(df: DataFrame, degree: int = 16, rounds: int = 5, metric: str = "ip", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(node, neighbor, score): about ``degree`` good neighbours of every node. Starts from ring neighbours in hash
    order; a round looks at all neighbours of neighbours and keeps the best. All draws are seeded, so builds repeat."""
    v, n = _numbered(df, id_col, vector_col)
    ring = Window.partitionBy("part").orderBy(F.xxhash64("node"), "node")
    placed = v.select("idx", "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, n // 4096)))).withColumn("i", F.row_number().over(ring)).drop("node")
    size = placed.groupBy("part").agg(F.max("i").alias("n"))
    starts = placed.join(size, "part").select("part", F.col("idx").alias("node"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda s: (F.col("i") + s * s - 1) % F.col("n") + 1)).alias("i"))
    pairs = starts.join(placed.select("part", "i", F.col("idx").alias("neighbor")), ["part", "i"]).select("node", "neighbor")
    first = v.select(F.size("v").alias("d")).first()
    width = first["d"] if first else 1
    blocked = n <= BLOCK_NODES
    best = Window.partitionBy("node").orderBy(F.col("score").asc() if V.ascending(metric) else F.col("score").desc(), "neighbor")

    def joined(pairs: DataFrame) -> DataFrame:
        full = pairs.where("node != neighbor").distinct().join(v.select(F.col("idx").alias("node"), "v"), "node").join(v.select(F.col("idx").alias("neighbor"), F.col("v").alias("w")), "neighbor")
        ranked = full.select("node", "neighbor", V.score(metric, F.col("v"), F.col("w")).alias("score")).withColumn("r", F.row_number().over(best))
        return ranked.where(F.col("r") <= degree).drop("r")

    def scored(links: DataFrame, edges: DataFrame | None) -> DataFrame:
        """The best of each node's links and of the edges of these."""
        if not blocked:
            second = None if edges is None else links.alias("a").join(edges.alias("b"), F.col("a.neighbor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.neighbor").alias("neighbor"))
            return joined(links if second is None else links.unionByName(second))
        near = v.withColumn("near", F.lit(None).cast("array<long>")) if edges is None else v.join(_lists(edges, "near"), "idx", "left")
        nodes, alone = Nodes(near, n, width, metric, degree), edges is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in gathered(batches, ROWS):
                own, q = rows["idx"].to_numpy(), directed(metric, matrix(rows["v"], width))
                offsets, c = _flat(rows["links"])
                r = np.repeat(np.arange(len(own)), np.diff(offsets))
                keys = np.unique(r * n + c) if alone else np.unique(np.concatenate([r * n + c, nodes.around(r, c)]))
                keys = keys[keys % n != own[keys // n]]
                s = nodes.scores(q, keys)
                top = nodes.best(keys, s, degree)
                yield pa.RecordBatch.from_arrays([pa.array(own[keys[top] // n]), pa.array(keys[top] % n), pa.array(s[top])], ["node", "neighbor", "score"])

        return dealt(v.join(_lists(links, "links"), "idx").select("idx", "v", "links"), "idx", n * 1000).mapInArrow(run, "node long, neighbor long, score double")

    edges = cut(scored(pairs, None), "edges")
    for _ in range(rounds):
        edges = cut(scored(_both(edges).distinct(), edges), "edges")
    names = v.select("idx", "node")
    ends = names.select(F.col("idx").alias("b"), F.col("node").alias("neighbor"))
    return edges.select(F.col("node").alias("a"), F.col("neighbor").alias("b"), "score").join(names.withColumnRenamed("idx", "a"), "a").join(ends, "b").select("node", "neighbor", "score")


def search(df: DataFrame, edges: DataFrame, queries: DataFrame, k: int, beam: int = 64, hops: int = 6, entries: int = 8, metric: str = "ip", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): a beam of the best nodes seen, widened by their neighbours hop by hop. ``allowed``
    (ids) restricts the result, not the walk. Of many queries each task walks its own, over nodes broadcast in blocks."""
    m = queries.count()
    n = df.where(F.col(vector_col).isNotNull()).count()
    if n > min(BLOCK_NODES, 4 * m):
        return _search_joined(df, edges, queries, k, beam, hops, entries, metric, id_col, vector_col, query_id, query_vector, allowed, digits)
    v, n = _numbered(df, id_col, vector_col)
    if not n:
        return _search_joined(df, edges, queries, k, beam, hops, entries, metric, id_col, vector_col, query_id, query_vector, allowed, digits)
    width = v.select(F.size("v").alias("d")).first()["d"]
    names = v.select("idx", "node")
    both = _both(edges).join(names.withColumnRenamed("idx", "a"), "node").join(names.select(F.col("idx").alias("b"), F.col("node").alias("neighbor")), "neighbor")
    near = cut(v.join(_lists(both.select(F.col("a").alias("node"), F.col("b").alias("neighbor")), "near"), "idx", "left").select("idx", "v", "near"), "graph")
    size = near.agg(F.avg(F.size("near"))).first()[0]
    nodes = Nodes(near, n, width, metric, max(1, round(size)))
    first = np.array([r["idx"] for r in names.orderBy(F.xxhash64("node"), "node").limit(entries).collect()], np.int64)
    q = queries.select(F.col(query_id).alias("q_"), F.col(query_vector).cast("array<double>").alias("w_")).where("w_ is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, ROWS):
            w = directed(metric, matrix(rows["w_"], width))
            seen = np.sort((np.arange(len(w))[:, None] * n + first).ravel())
            s, done, keep = np.round(nodes.scores(w, seen), digits), np.zeros(0, np.int64), 4 * beam
            for _ in range(hops):
                # Neighbours of nodes widened before are known: they were kept, or others were better and still are.
                front = seen[nodes.best(seen, s, beam)]
                front = np.setdiff1d(front, done, assume_unique=True)
                if not len(front):
                    break
                done = np.union1d(done, front)
                fresh = np.setdiff1d(nodes.around(front // n, front % n), seen, assume_unique=True)
                seen, s = np.concatenate([seen, fresh]), np.concatenate([s, np.round(nodes.scores(w, fresh), digits)])
                top = nodes.best(seen, s, keep)
                seen, s = seen[top], s[top]
            yield pa.RecordBatch.from_arrays([rows["q_"].combine_chunks().take(pa.array(seen // n)), pa.array(seen % n), pa.array(s + 0.0)], ["q_", "idx", "score"])

    seen = dealt(q, "q_", m * 20_000).mapInArrow(run, f"q_ {q.schema['q_'].dataType.simpleString()}, idx long, score double").join(names, "idx")
    if allowed is not None:
        seen = seen.join(allowed.select(F.col(id_col).alias("node")), "node", "left_semi")
    out = rank_by(seen, F.col("score"), V.ascending(metric), "node", ["q_"]).where(F.col("rank") <= k)
    return out.select(F.col("q_").alias(query_id), F.col("node").alias(id_col), "score", "rank")


def _search_joined(df: DataFrame, edges: DataFrame, queries: DataFrame, k: int, beam: int = 64, hops: int = 6, entries: int = 8, metric: str = "ip", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """search by joins, a hop of all queries at a time: for few queries, or more nodes than go to every task."""
    v = df.select(F.col(id_col).alias("node"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    q = queries.select(F.col(query_id).alias("__qid"), F.col(query_vector).cast("array<double>").alias("__q"))
    both = edges.select("node", "neighbor").unionByName(edges.select(F.col("neighbor").alias("node"), F.col("node").alias("neighbor"))).distinct()

    def ranked(pairs: DataFrame) -> DataFrame:
        s = pairs.join(v, "node").join(q, "__qid").select("__qid", "node", F.round(V.score(metric, F.col("v"), F.col("__q")), digits).alias("score"))
        return rank_by(s, F.col("score"), V.ascending(metric), "node", ["__qid"])

    first = v.select("node").orderBy(F.xxhash64("node"), "node").limit(entries)
    seen = cut(ranked(q.select("__qid").crossJoin(first)), "beam")
    for _ in range(hops):
        wider = seen.where(F.col("rank") <= beam).select("__qid", "node").join(both, "node").select("__qid", F.col("neighbor").alias("node"))
        seen = cut(ranked(seen.select("__qid", "node").unionByName(wider).distinct()).where(F.col("rank") <= 4 * beam), "beam")
    if allowed is not None:
        seen = seen.join(allowed.select(F.col(id_col).alias("node")), "node", "left_semi")
    out = rank_by(seen.drop("rank"), F.col("score"), V.ascending(metric), "node", ["__qid"]).where(F.col("rank") <= k)
    return out.select(F.col("__qid").alias(query_id), F.col("node").alias(id_col), "score", "rank")


def extend(df: DataFrame, edges: DataFrame, new: DataFrame, degree: int = 16, metric: str = "ip", id_col: str = "id", vector_col: str = "vector", beam: int = 32, hops: int = 6) -> DataFrame:
    """The graph of ``edges`` over ``df`` with the rows ``new`` added: each finds its neighbours by searching the graph as it
    is and is linked with them, and among the new ones in a graph of their own. Nothing else is built again."""
    q = new.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vector"))
    found = search(df, edges, q, degree, beam, hops, metric=metric, id_col=id_col, vector_col=vector_col)
    links = found.select(F.col("query_id").alias("node"), F.col(id_col).alias("neighbor"), "score")
    own = build(new, degree, 3, metric, id_col, vector_col)
    fresh = cut(links.unionByName(own), "extended")
    both = edges.unionByName(fresh).unionByName(fresh.select(F.col("neighbor").alias("node"), F.col("node").alias("neighbor"), "score")).distinct()
    best = Window.partitionBy("node").orderBy(F.col("score").asc() if V.ascending(metric) else F.col("score").desc(), "neighbor")
    return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= degree).drop("r")
