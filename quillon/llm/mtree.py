"""Operator 4, exact top-k search in an M-tree.

Vectors are stored in a paged metric tree under the Euclidean distance: two levels of routing objects, then leaf
nodes of pages. Inner nodes, leaf nodes and pages hold their covering radius, and routing objects, pages and
vectors the distance to their parent routing object. A vector descends to the nearest routing object of each level.
A query first searches its own leaf, which bounds the distance of its k-th neighbour. It then goes, in rounds, to those
leaves whose ball the bound reaches, the most promising first, and each round lowers the bound for the next.
In a leaf, pages are visited best first (by the lower bound of their distance). On every level
|d(q, parent) - d(x, parent)| from the stored parent distances spares computing d(q, x) wherever it exceeds the
bound: for routing objects, pages and vectors. The result is exact.

The routing objects are broadcast. There are at most MAX_LEAVES, and no more than fit in ROUTING_BYTES; beyond that, and
wherever vectors crowd, a leaf consists of several parts (by the hash of the id), so no row of the tree grows with the table.
Routing objects come from a sample of that size (by the hash of the id); every vector is indexed.

Distances are compared after rounding to six decimals, equal ones by id. Defined results: rows with a
null id, a null or empty vector, a null or non-finite element, or other than the most common dimension, are neither
queries nor results; of rows that repeat an id the smallest vector counts; a query with fewer than k
others gets those; an empty table gives an empty result; columns other than id and vector don't count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.scratch import written

K = 10
#: Vectors of a leaf and of a page.
NODE, PAGE = 16384, 256
MAX_LEAVES, ROUTING_BYTES = 65536, 64 << 20
#: Queries that meet a part of a leaf in one group, and leaves that a query visits in its second round.
QUERIES, SECOND = 8192, 8
_EPS = 1e-6
_OUT = "query_id long, neighbor_id long, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    d = np.sqrt(np.maximum(d, 0))
    # Where vectors nearly coincide the expansion loses digits; these are computed directly.
    x, y = np.nonzero(d < 1e-4)
    if len(x):
        d[x, y] = np.sqrt(((a[x] - b[y]) ** 2).sum(axis=1))
    return d


def build_node(ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, page: int = PAGE) -> dict:
    """A node: its routing object and radius, and leaf pages with radius, parent distance and entries."""
    n = max(1, -(-len(ids) // page))
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    pivots = np.unique(vectors[np.linspace(0, len(ids) - 1, n).astype(int)], axis=0)
    d = distances(vectors, pivots)
    of = d.argmin(axis=1)
    pages = []
    for p in range(len(pivots)):
        rows = np.flatnonzero(of == p)
        if not len(rows):
            continue
        near = rows[np.lexsort((ids[rows], d[rows, p]))]
        pages.append({"ids": ids[near], "vectors": vectors[near], "parent": d[near, p], "radius": float(d[near, p].max()), "pivot": pivots[p]})
    routing = np.stack([p["pivot"] for p in pages])
    to_node = distances(routing, pivot[None])[:, 0]
    for p, x in zip(pages, to_node):
        p["to_node"] = float(x)
    return {"pivot": pivot, "radius": float(distances(vectors, pivot[None]).max()), "routing": routing, "to_node": to_node, "radii": np.array([p["radius"] for p in pages]), "pages": pages}


class Best:
    """The k nearest so far of a block of queries, by (rounded distance, id)."""

    def __init__(self, q: int, k: int):
        self.d, self.ids = np.full((q, k), np.inf), np.full((q, k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        return self.d[:, -1] + _EPS

    def add(self, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, d: np.ndarray, limit: np.ndarray) -> None:
        """Takes in distances d (rows x ids) within each row's limit, leaving out a query's own id."""
        k = self.d.shape[1]
        r, c = np.nonzero(d <= limit[:, None])
        other = ids[c] != own[r]
        r, c = r[other], c[other]
        if not len(r):
            return
        u, at = np.unique(r, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(u)), k), at])
        all_d = np.concatenate([self.d[rows[u]].ravel(), np.round(d[r, c], 6)])
        all_i = np.concatenate([self.ids[rows[u]].ravel(), ids[c]])
        order = np.lexsort((all_i, all_d, row))
        size = np.bincount(row)
        first = np.cumsum(size) - size
        keep = order[(np.arange(len(order)) - np.repeat(first, size)) < k]
        self.d[rows[u]], self.ids[rows[u]] = all_d[keep].reshape(-1, k), all_i[keep].reshape(-1, k)


def search_node(node: dict, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, block: int = 128) -> tuple[Best, int]:
    """The k nearest of each query among the node's vectors (others than itself) within its bound, and how many distances were computed."""
    out, computed = Best(len(ids), k), 0
    to_pivot = distances(queries, node["pivot"][None])[:, 0]
    order = np.argsort(distances(queries, node["routing"][:1])[:, 0], kind="stable")
    for lo in range(0, len(ids), block):
        rows = order[lo : lo + block]
        q, b = queries[rows], Best(len(rows), k)
        reach = bound[rows] + _EPS
        # Pages that the stored distance to the node rules out never have their distance computed.
        lower = np.maximum(0, np.abs(to_pivot[rows][:, None] - node["to_node"][None]) - node["radii"][None])
        ask = np.flatnonzero((lower <= reach[:, None]).any(axis=0))
        if not len(ask):
            continue
        d = distances(q, node["routing"][ask])
        computed += d.size
        lower = np.maximum(lower[:, ask], d - node["radii"][ask][None])
        for j in np.argsort(lower.min(axis=0), kind="stable"):
            limit = np.minimum(reach, b.bound())
            go = np.flatnonzero(lower[:, j] <= limit)
            if not len(go):
                continue
            page = node["pages"][ask[j]]
            near = (np.abs(d[go, j][:, None] - page["parent"][None]) <= limit[go][:, None]).any(axis=0)
            if not near.any():
                continue
            found = distances(q[go], page["vectors"][near])
            computed += found.size
            b.add(go, ids[rows[go]], page["ids"][near], found, limit[go])
        out.d[rows], out.ids[rows] = b.d, b.ids
    return out, computed


class Routing:
    """Two levels of routing objects: leaf j belongs to the inner node ``top[j]``, at distance ``to_top[j]``."""

    def __init__(self, vectors: np.ndarray):
        count = len(vectors)
        self.inner = vectors[: max(1, int(np.sqrt(count)) if count > 4 else 1)]
        self.top = distances(vectors, self.inner).argmin(axis=1)
        order = np.argsort(self.top, kind="stable")
        self.leaves, self.top = vectors[order], self.top[order]
        self.to_top = np.array([distances(x[None], self.inner[[t]])[0, 0] for x, t in zip(self.leaves, self.top)])
        self.at = np.searchsorted(self.top, np.arange(len(self.inner) + 1))
        self.inner_radius, self.radius = np.full(len(self.inner), -np.inf), np.full(count, -np.inf)

    def descend(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to it, distance to its inner node) of each vector."""
        to_inner = distances(v, self.inner)
        top = to_inner.argmin(axis=1)
        leaf, d = np.zeros(len(v), np.int64), np.zeros(len(v))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            of = distances(v[rows], self.leaves[self.at[t] : self.at[t + 1]])
            leaf[rows] = self.at[t] + of.argmin(axis=1)
            d[rows] = of.min(axis=1)
        return leaf, d, to_inner[np.arange(len(v)), top]

    def reached(self, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, lower bound of the distance to its vectors) of the leaves that may hold a vector within the bound."""
        to_inner = distances(v, self.inner)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for t in range(len(self.inner)):
            go = np.flatnonzero(to_inner[:, t] - self.inner_radius[t] <= bound + _EPS)
            if not len(go) or self.at[t] == self.at[t + 1]:
                continue
            own = np.arange(self.at[t], self.at[t + 1])
            lower = np.abs(to_inner[go, t][:, None] - self.to_top[own][None]) - self.radius[own][None]
            ask = np.flatnonzero((lower <= bound[go][:, None] + _EPS).any(axis=0))
            if not len(ask):
                continue
            lower = np.maximum(lower[:, ask], distances(v[go], self.leaves[own[ask]]) - self.radius[own[ask]][None])
            r, c = np.nonzero(lower <= bound[go][:, None] + _EPS)
            out.append((go[r], own[ask[c]], np.maximum(lower[r, c], 0)))
        q, leaf, low = (np.concatenate(x) for x in zip(*out))
        return q, leaf, low


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return v.groupBy("id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, k: int = K, node_size: int = NODE, id_col: str = "vec_id", vector_col: str = "embedding", asked: Column | None = None, max_leaves: int = MAX_LEAVES, group: int = QUERIES, second: int = SECOND) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other vectors of every vector, or of those whose ``id`` fulfils ``asked``."""
    spark = vectors.sparkSession
    v = written(_clean(vectors, id_col, vector_col), "mtree-vectors")
    common = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance double")
    dimension, count = common["d"], common["n"]
    v = v.where(F.size("v") == dimension)
    leaves = max(1, min(max_leaves, ROUTING_BYTES // (8 * dimension), -(-count // node_size)))
    # A hash threshold keeps all but about four times the sample out of the sort.
    share = min(1.0, 4 * leaves / count + 64 / count)
    sample = v.where((F.xxhash64("id") / F.lit(float(1 << 64)) + 0.5) <= share).orderBy(F.xxhash64("id"), "id").limit(leaves).select("v").toArrow()
    if not sample.num_rows:
        sample = v.orderBy("id").limit(leaves).select("v").toArrow()
    distinct = np.unique(_matrix(sample["v"]), axis=0)
    routing = Routing(distinct[np.random.default_rng(0).permutation(len(distinct))])
    shared = spark.sparkContext.broadcast(routing)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, d, to_inner = shared.value.descend(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf.astype(np.int32)), pa.array(d), pa.array(to_inner)], ["id", "v", "leaf", "d", "to_inner"])

    placed = written(v.mapInArrow(assign, "id long, v array<double>, leaf int, d double, to_inner double"), "mtree-placed")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.max("to_inner").alias("inner")).collect()
    for r in sizes:
        routing.radius[r["leaf"]] = r["r"]
        t = routing.top[r["leaf"]]
        routing.inner_radius[t] = max(routing.inner_radius[t], r["inner"])
    parts = spark.createDataFrame([(r["leaf"], -(-r["n"] // (2 * node_size))) for r in sizes], "leaf int, parts int")
    bounds = spark.sparkContext.broadcast(routing)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        at, part = (x.as_py() for x in key)
        node = build_node(rows["id"].to_numpy(), _matrix(rows["v"]), bounds.value.leaves[at])
        return pa.table({"leaf": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "tree": pa.array([pickle.dumps(node)], pa.binary())})

    part = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(F.broadcast(parts), "leaf").select("leaf", part, "id", "v")
    tree = written(dealt.groupBy("leaf", "part").applyInArrow(build, "leaf int, part int, tree binary"), "mtree-nodes")

    def search(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            best, ids = Best(0, k), np.zeros(0, np.int64)
        else:
            ids = q["id"].to_numpy()
            best, _ = search_node(pickle.loads(t["tree"][0].as_py()), ids, _matrix(q["v"]), q["bound"].to_numpy(), k)
        r, c = np.nonzero(np.isfinite(best.d))
        return pa.table({"query_id": pa.array(ids[r], pa.int64()), "neighbor_id": pa.array(best.ids[r, c], pa.int64()), "distance": pa.array(best.d[r, c], pa.float64())})

    def visited(q: DataFrame) -> DataFrame:
        """The k nearest of queries (id, v, leaf, bound) in the leaf named. Those of a leaf meet each of its parts in groups of bounded size."""
        q = q.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        groups = q.select(F.col("leaf").alias("of"), F.col("salt").alias("s")).distinct()
        trees = tree.join(groups, F.col("leaf") == F.col("of")).select(F.col("leaf").alias("t_leaf"), F.col("part").alias("t_part"), F.col("s").alias("t_salt"), "tree")
        q = q.join(F.broadcast(parts), "leaf").select("id", "v", "leaf", "salt", "bound", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return q.groupBy("leaf", "part", "salt").cogroup(trees.groupBy("t_leaf", "t_part", "t_salt")).applyInArrow(search, _OUT)

    def salted(q: DataFrame) -> DataFrame:
        q = written(q, "mtree-asked")
        many = q.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", F.expr(f"cast(ceil(n / {group}) as int)").alias("salts"))
        return q.join(F.broadcast(many), "leaf")

    def nearest(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    queries = placed if asked is None else placed.where(asked)
    queries = written(queries.select("id", "v", "leaf"), "mtree-queries")
    infinite = F.lit(float("inf"))
    found = written(nearest(visited(salted(queries.withColumn("bound", infinite)))).drop("rank"), "mtree-found")
    seen = 1
    while seen < len(sizes):
        limit = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(infinite).alias("bound"))
        most = second if seen == 1 and len(sizes) > 1 + second else len(sizes)

        def reach(batches: Iterator[pa.RecordBatch], done: int = seen, most: int = most) -> Iterator[pa.RecordBatch]:
            """The leaves that each query visits now: of those that its bound reaches the ``most`` nearest, without the ``done`` visited."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, own, first = _matrix(batch.column("v")), batch.column("leaf").to_numpy(), batch.column("before").to_numpy()
                bound = batch.column("bound").to_numpy()
                step = max(1, min(512, (1 << 23) // (len(bounds.value.leaves) * v.shape[1])))
                for lo in range(0, len(v), step):
                    s = slice(lo, lo + step)
                    # The order of the second round is made with the bound of that time, so that this round knows what was visited.
                    r, c, low = bounds.value.reached(v[s], first[s])
                    other = c != own[s][r]
                    r, c, low = r[other], c[other], low[other]
                    order = np.lexsort((c, low, r))
                    r, c, low = r[order], c[order], low[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    use = (rank >= done - 1) & (rank < done - 1 + most) & (low <= bound[s][r] + _EPS)
                    r, c = r[use], c[use]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, step).take(pa.array(r)), _lists(v[s][r]), pa.array(c.astype(np.int32)), pa.array(bound[s][r])], ["id", "v", "leaf", "bound"])

        now = queries.join(limit, "id", "left").withColumn("bound", F.coalesce("bound", infinite))
        if seen == 1:
            queries = now = written(now.withColumn("before", F.col("bound")), "mtree-bounded")
            queries = queries.drop("bound")
        asks = now.select("id", "v", "leaf", "before", "bound").mapInArrow(reach, "id long, v array<double>, leaf int, bound double")
        found = written(nearest(found.unionByName(visited(salted(asks)))).drop("rank"), "mtree-found")
        seen += most
    return nearest(found).select("query_id", "rank", "neighbor_id", "distance")


def oracle(k: int = K, embeddings: str = "embeddings", asked: str = "true") -> str:
    return f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM {embeddings}),
p AS (SELECT a.id AS query_id, b.id AS neighbor_id, round(list_distance(a.v, b.v), 6) AS distance FROM v a JOIN v b ON a.id != b.id WHERE a.{asked}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= {k}
"""
