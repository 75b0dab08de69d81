"""Chooses the plan of a search: exact, quantised with rerank, inverted file, graph, or hybrid."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.functions.quantize import Quantizer, matrix, unpack, with_codes
from quillon.functions.text import tokenize
from quillon.operators import bm25, filters, fusion, graph, ivf, topk
from quillon.sources.store import Collection

#: An index is used from this many rows on, while at most this share was written after it was built.
INDEX_ROWS, INDEX_DELTA = 10_000, 0.2
#: A filter that leaves fewer than one row in so many is searched exactly.
SELECTIVE = 20


#: Postings are dealt to so many folders by the hash of the token; a search reads those of its tokens.
TOKEN_BUCKETS = 64
#: Documents whose share of a bucket one task writes, and documents that one task splits.
BUCKET_DOCUMENTS, TASK_DOCUMENTS = 50_000, 5_000


class Searcher:
    """Searches over one collection. Indexes are tables beside it: vectors by cluster, a neighbour graph, postings. Each
    serves for the rows it was built from while they live; rows written since are searched as well."""

    def __init__(self, collection: Collection):
        self.collection, self.spark = collection, collection.spark
        self._index: tuple[str, ivf.Ivf] | None = None

    # indexes

    def _path(self) -> str:
        return f"{self.collection.path}/index/{uuid.uuid4().hex}"

    def _keep(self, kind: str, meta: dict) -> None:
        c = self.collection
        c._commit(c.manifest["parts"], c.manifest["next_seq"], **{kind: meta | {"next_seq": c.manifest["next_seq"]}})

    def create_index(self, clusters: int | None = None, rounds: int = 20, recall: float = 0.95) -> None:
        """Clusters the vectors; ``clusters`` defaults to the square root of the number of rows. Searches probe as many as
        a sample of the vectors needs for a share ``recall`` of their neighbours."""
        c = self.collection
        n, rows = c.count(), c.rows().select("id", "vector", "seq")
        centroids = ivf.train(rows, max(1, min(n, clusters or round(n**0.5))), rounds=rounds)
        path = self._path()
        ivf.assign(rows, centroids).write.partitionBy("cluster_id").parquet(f"{path}/rows")
        self.spark.createDataFrame(list(enumerate(centroids.tolist())), "i int, c array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = ivf.Ivf(centroids, self.spark.read.parquet(f"{path}/rows"), "id", "vector")
        self._keep("index", {"path": path, "rows": n, "nprobe": ivf.probes_needed(index, rows, recall=recall, metric="ip" if c.metric == "l2" else c.metric)})

    update_index = create_index

    def index(self) -> ivf.Ivf | None:
        meta = self.collection.manifest["index"]
        if meta is None:
            return None
        if self._index is None or self._index[0] != meta["path"]:
            centroids = [r["c"] for r in self.spark.read.parquet(f"{meta['path']}/centroids").orderBy("i").collect()]
            self._index = (meta["path"], ivf.Ivf(np.array(centroids), self.spark.read.parquet(f"{meta['path']}/rows"), "id", "vector"))
        return self._index[1]

    def create_graph(self, degree: int = 16, rounds: int = 5) -> None:
        c, path = self.collection, self._path()
        rows = c.rows().select("id", "vector", "seq")
        graph.build(rows, degree, rounds, c.metric).write.parquet(f"{path}/edges")
        rows.select("id", "seq").write.parquet(f"{path}/nodes")
        self._keep("graph", {"path": path, "degree": degree})

    def update_graph(self) -> None:
        """Adds the rows written since; nodes that are gone leave with their edges."""
        c, meta = self.collection, self.collection.manifest.get("graph")
        if meta is None:
            return self.create_graph()
        rows, path = c.rows().select("id", "vector", "seq"), self._path()
        nodes = self.spark.read.parquet(f"{meta['path']}/nodes").join(rows.select("id", "seq"), ["id", "seq"], "left_semi")
        old, new = rows.join(nodes.select("id"), "id", "left_semi"), rows.join(nodes.select("id"), "id", "left_anti")
        edges = self._edges(nodes)
        graph.extend(old, edges, new, meta["degree"], c.metric).write.parquet(f"{path}/edges")
        rows.select("id", "seq").write.parquet(f"{path}/nodes")
        self._keep("graph", {"path": path, "degree": meta["degree"]})

    def _edges(self, nodes: DataFrame) -> DataFrame:
        edges = self.spark.read.parquet(f"{self.collection.manifest['graph']['path']}/edges")
        return edges.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").join(nodes.select(F.col("id").alias("neighbor")), "neighbor", "left_semi").select("node", "neighbor", "score")

    def create_text_index(self) -> None:
        """Stores the postings and lengths of all documents; later writes are added at search until the next build."""
        rows, path = self.collection.rows().select("id", "seq", "document"), self._path()
        own = bm25.postings(self._dealt(rows, n := rows.count()), "id", "document", "seq").withColumn("bucket", self._bucket("token"))
        # A task writes the share of a bucket of at most so many documents, a bucket in several files if there are more.
        shares = -(-n // BUCKET_DOCUMENTS)
        dealt = own.repartition("bucket") if shares <= 1 else own.repartition(TOKEN_BUCKETS * shares, "bucket", F.pmod(F.xxhash64("id"), F.lit(shares)))
        dealt.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
        bm25.tokenized(rows, "document", "id", "seq").select("id", "seq", F.size("ts").alias("dl")).write.parquet(f"{path}/lengths")
        self._keep("text", {"path": path})

    @staticmethod
    def _dealt(rows: DataFrame, n: int) -> DataFrame:
        """n documents by the hash of the id, so few a task that their tokens are counted in memory, without another shuffle."""
        return rows if n <= TASK_DOCUMENTS else rows.repartition(-(-n // TASK_DOCUMENTS), "id")

    @staticmethod
    def _bucket(token: str):
        return F.pmod(F.xxhash64(token), F.lit(TOKEN_BUCKETS)).cast("int")

    def text_index(self, tokens: Sequence[str] | None = None) -> bm25.Bm25:
        """Postings and statistics of the live documents, of the given tokens only if they are named."""
        c, meta = self.collection, self.collection.manifest.get("text")
        if meta is None:
            return bm25.Bm25.build(c.rows(), "id", "document")
        own, lengths = self.spark.read.parquet(f"{meta['path']}/postings"), self.spark.read.parquet(f"{meta['path']}/lengths")
        if tokens is not None:
            names = self.spark.createDataFrame([(t,) for t in tokens], "token string")
            buckets = [r[0] for r in names.select(self._bucket("token")).distinct().collect()]
            own = own.where(F.col("bucket").isin(buckets) & F.col("token").isin(list(tokens)))
        if c.manifest["next_seq"] != meta["next_seq"]:
            rows = c.rows().select("id", "seq", "document")
            live, since = rows.select("id", "seq").where(F.col("seq") < meta["next_seq"]), rows.where(F.col("seq") >= meta["next_seq"])
            own = own.join(live, ["id", "seq"], "left_semi").select("token", "id", "dl", "tf").unionByName(bm25.postings(self._dealt(since, since.count()), "id", "document"))
            lengths = lengths.join(live, ["id", "seq"], "left_semi").select("dl").unionByName(bm25.tokenized(since, "document").select(F.size("ts").alias("dl")))
        return bm25.Bm25(own.select("token", "id", "dl", "tf"), bm25.statistics(lengths), "id")

    def text_search(self, queries: DataFrame, k: int, filt: dict | None = None, digits: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) by keywords; queries: (query_id, query_text)."""
        tokens = None
        if self.collection.manifest.get("text"):
            tokens = [r[0] for r in queries.select(F.explode(tokenize(F.col("query_text"))).alias("t")).distinct().collect()]
        # The filter restricts what is ranked, so k rows come back whenever k match; statistics are of all documents.
        allowed = self.collection._filtered(filt).select("id") if filt else None
        return self.text_index(tokens).search_many(queries, k, allowed=allowed, digits=digits)

    # planning

    def strategy(self, filt: dict | None, nprobe: int | None, use_ann: bool | None, hybrid: dict | None, quantised: bool | None = None, beam: int | None = None) -> str:
        if hybrid is not None:
            return "hybrid"
        if beam is not None and self.collection.manifest.get("graph"):
            return "graph"
        if quantised or (quantised is None and self.collection.manifest["rerank"]):
            return "quantised"
        meta = self.collection.manifest["index"]
        if meta is None or use_ann is False or self.collection.metric == "l2":
            return "exact"
        if nprobe is not None or use_ann:
            return "ivf"
        live = self.collection.count()
        after = self.collection.rows().where(F.col("seq") >= meta["next_seq"]).count()
        if live < INDEX_ROWS or after > INDEX_DELTA * live:
            return "exact"
        if filt and self.collection.count(filt) * SELECTIVE < live:
            return "exact"
        return "ivf"

    def _queries(self, queries: Sequence[Sequence[float]]) -> DataFrame:
        d = self.collection.dimension
        rows = []
        for i, q in enumerate(queries):
            q = [float(x) for x in q]
            if len(q) != d:
                raise ValueError(f"query must have {d} elements")
            if not np.isfinite(q).all():
                raise ValueError("query must be finite")
            rows.append((i, q))
        return self.spark.createDataFrame(rows, "query_id long, query_vector array<double>")

    def dense(self, queries: DataFrame, k: int, filt: dict | None = None, offset: int = 0, strategy: str = "exact", nprobe: int | None = None, factor: int | None = None, beam: int | None = None, prefilter: bool = False) -> DataFrame:
        """(query_id, id, score, rank)."""
        c, metric, need = self.collection, self.collection.metric, k + offset
        if strategy == "quantised":
            # Only codes and norms are read for the candidates, and vectors of these alone for the rerank.
            coded = c._filtered(filt, codes=True).select("id", "code", "norm")
            out = coded_search(coded, queries, need * factor if factor else need, c.quantizer, metric, prefilter=prefilter)
            if factor:
                out = topk.rerank(out, c.rows().select("id", "vector"), queries, need, metric)
            return self._page(out, offset, need)
        rows = c._filtered(filt).select("id", "vector", "seq")
        if strategy in ("ivf", "graph"):
            meta = c.manifest["index" if strategy == "ivf" else "graph"]
            # Rows of the index that are still live as they were, and rows written since, scored exactly.
            live = rows.where(F.col("seq") < meta["next_seq"])
            if strategy == "ivf":
                index = self.index()
                assigned = index.assigned if c.manifest["next_seq"] == meta["next_seq"] and not filt else index.assigned.join(live.select("id", "seq"), ["id", "seq"], "left_semi")
                old = ivf.Ivf(index.centroids, assigned, "id", "vector").search(queries, need, nprobe or meta["nprobe"], metric)
            else:
                everything = c.rows().where(F.col("seq") < meta["next_seq"]).select("id", "vector")
                old = graph.search(everything, self._edges(everything), queries, need, beam or 64, metric=metric, allowed=live.select("id") if filt else None)
            fresh = topk.search_blocks(rows.where(F.col("seq") >= meta["next_seq"]), queries, need, metric)
            out = topk.rank_by(old.unionByName(fresh).drop("rank"), F.col("score"), V.ascending(metric), "id", ["query_id"])
        else:
            out = topk.search_blocks(rows, queries, need, metric)
        return self._page(out, offset, need)

    @staticmethod
    def _page(found: DataFrame, offset: int, need: int) -> DataFrame:
        return found.where((F.col("rank") > offset) & (F.col("rank") <= need)).select("query_id", "id", "score", (F.col("rank") - offset).alias("rank"))

    def search(self, query: Sequence[float] | None, k: int = 10, filt: dict | None = None, include: Sequence[str] | None = None, offset: int = 0, nprobe: int | None = None, use_ann: bool | None = None, rerank_factor: int | None = None, hybrid: dict | None = None, quantised: bool | None = None, beam: int | None = None, prefilter: bool = False) -> DataFrame:
        """The k best rows for one query, best first, with the included columns."""
        return self.search_batch([query], k, filt, include, offset, nprobe, use_ann, rerank_factor, hybrid, quantised, beam, prefilter).orderBy("rank").drop("query_id", "rank")

    def search_batch(self, queries: Sequence[Sequence[float]], k: int = 10, filt: dict | None = None, include: Sequence[str] | None = None, offset: int = 0, nprobe: int | None = None, use_ann: bool | None = None, rerank_factor: int | None = None, hybrid: dict | None = None, quantised: bool | None = None, beam: int | None = None, prefilter: bool = False) -> DataFrame:
        """(query_id, rank, ...) for several queries in one plan. ``hybrid`` has text (or texts, one a query), weight, rrf_k, oversample.
        ``quantised`` (the default of collections with rerank) scores codes and reranks ``rerank_factor`` times k candidates
        (0: none, the codes' scores are the result); ``prefilter`` first drops those whose signs agree least; ``beam`` walks the graph."""
        if k <= 0:
            raise ValueError("k must be positive")
        if rerank_factor is not None and not 0 <= rerank_factor <= 100 or rerank_factor == 0 and not quantised:
            raise ValueError("rerank_factor must be 1 to 100, or 0 for scores by codes alone")
        wanted = topk.included(include)
        if filt:
            filters.validate(filt)
        strategy = self.strategy(filt, nprobe, use_ann, hybrid, quantised, beam)
        factor = topk.rerank_factor(self.collection.dimension) if rerank_factor is None else rerank_factor
        q = self._queries(queries)
        texts = None
        if strategy == "hybrid":
            options = dict(hybrid)
            texts = options.pop("texts", None)
            if texts is not None:
                if len(texts) != len(queries):
                    raise ValueError("texts must be one a query")
                options["text"] = texts[0] if texts else ""
            h = fusion.Hybrid.parse(options)
            texts = texts if texts is not None else [h.text] * len(queries)
            if not any(texts):
                strategy = "exact"
        if strategy == "hybrid":
            n = k * h.oversample
            dense = self.dense(q, n, filt)
            asked = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
            # The filter restricts both lists before fusion, so k rows come back whenever k match.
            sparse = self.text_search(asked, n, filt)
            hits = fusion.fuse(dense, sparse, k + offset, h.weight, h.rrf_k, ("query_id", "id"))
            hits = hits.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)
        else:
            hits = self.dense(q, k, filt, offset, strategy, nprobe, factor, beam, prefilter)
        payload = [x for x in ("metadata", "document") if x in wanted]
        if payload:
            hits = topk.with_payload(hits, self.collection.rows(), payload)
        return hits.select("query_id", "rank", *wanted)


def coded_search(coded: DataFrame, queries: DataFrame, k: int, quantizer: Quantizer, metric: str = "ip", id_col: str = "id", query_id: str = "query_id", query_vector: str = "query_vector", digits: int = 6, lite: bool = False, prefilter: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k best by the inner product with quantised vectors; coded: (id, code, norm). ``lite``
    replaces the query by its own code, too. ``prefilter`` scores, of each batch, the sixteenth (ten times k at least)
    whose signs agree most with the query's."""
    asked = queries.select(F.col(query_id).alias("q_"), F.col(query_vector).cast("array<double>").alias("w_")).where("w_ is not null")
    own = coded.select(F.col(id_col).alias("i_"), "code", "norm").where("code is not null")
    if prefilter:
        found = _prefiltered(own, asked, k, quantizer, metric, (query_id, id_col), digits)
    else:
        found = _coded(own, asked, k, quantizer, metric, (query_id, id_col), digits, lite)
    return topk.rank_by(found, F.col("score"), V.ascending(metric), id_col, [query_id]).where(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def _coded(own: DataFrame, asked: DataFrame, k: int, quantizer: Quantizer, metric: str, names: tuple[str, str], digits: int, lite: bool = False) -> DataFrame:
    """(query, id, score), not ranked. With vectors (v_) beside the codes ``second`` is the inner product with these."""
    shared, exact = own.sparkSession.sparkContext.broadcast(quantizer), "v_" in own.columns

    def read_own(rows: pa.Table) -> tuple:
        z, norms = shared.value, rows["norm"].to_numpy()
        packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        v = np.asarray(z.centroids)[unpack(packed, z.bits, z.rotation.shape[0])] * (norms if metric != "cosine" else norms > 0)[:, None]
        return rows["i_"], {"v": v, "squares": norms**2 if metric == "l2" else None, "second": matrix(rows["v_"], z.d) if exact else None}

    def read_asked(rows: pa.Table) -> tuple:
        z = shared.value
        q = matrix(rows["w_"], z.d)
        y, size = q @ z.rotation.T, np.linalg.norm(q, axis=1)
        if lite:
            y = np.asarray(z.centroids)[z.encode(q)[0]] * size[:, None]
        if metric == "cosine":
            y = y / np.maximum(size, 1e-12)[:, None]
        return rows["q_"], {"q": y, "squares": size**2 if metric == "l2" else None, "second": q if exact else None}

    return topk.nearest(own, asked, k, metric, quantizer.rotation.shape[0] * (2 if exact else 1), read_own, read_asked, names, digits, second=exact)


def _prefiltered(own: DataFrame, asked: DataFrame, k: int, quantizer: Quantizer, metric: str, names: tuple[str, str], digits: int) -> DataFrame:
    """(query, id, score), not ranked; queries are broadcast in blocks and scored a tile at a time."""
    id_type, query_type = own.schema["i_"].dataType.simpleString(), asked.schema["q_"].dataType.simpleString()
    shared, out = own.sparkSession.sparkContext.broadcast(quantizer), None
    for block in topk.shelve(asked, F.col("q_"), max(1, -(-asked.count() * quantizer.d * 16 // topk.BROADCAST_BYTES))):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            z, rows = shared.value, block.value
            centroids, ids, q = np.asarray(z.centroids), rows["q_"].combine_chunks(), matrix(rows["w_"], z.d)
            for batch in batches:
                if not batch.num_rows:
                    continue
                packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                codes, norms, place = unpack(packed, z.bits, z.rotation.shape[0]), batch.column("norm").to_numpy(), topk.place_of(batch.column("i_"))
                high = np.where(codes >= 1 << (z.bits - 1), 1.0, -1.0).T
                for lo in range(0, len(q), topk.TILE):
                    y, size = q[lo : lo + topk.TILE] @ z.rotation.T, np.linalg.norm(q[lo : lo + topk.TILE], axis=1)
                    s = y @ centroids[codes].T
                    s = s * norms[None] if metric == "ip" else s / np.maximum(size, 1e-12)[:, None] if metric == "cosine" else np.sqrt(np.maximum(size[:, None] ** 2 + norms[None] ** 2 - 2 * s * norms[None], 0))
                    sign = 1 if metric == "l2" else -1
                    s = np.where(norms[None] > 0, np.round(s, digits), np.round(size[:, None], digits) if metric == "l2" else 0.0)
                    most = max(len(codes) // 16, 10 * k)
                    if most < len(codes):
                        agree = np.where(y >= 0, 1.0, -1.0) @ high
                        left = np.argpartition(-agree, most - 1, axis=1)[:, most:]
                        np.put_along_axis(s, left, np.inf * sign, axis=1)
                    order = np.lexsort((np.broadcast_to(place, s.shape), sign * s), axis=1)[:, :k]
                    r, c = np.repeat(np.arange(len(s)), order.shape[1]), order.ravel()
                    r, c = r[np.isfinite(s[r, c])], c[np.isfinite(s[r, c])]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + r)), batch.column("i_").take(pa.array(c)), pa.array(s[r, c])], [*names, "score"])

        found = own.mapInArrow(run, f"`{names[0]}` {query_type}, `{names[1]}` {id_type}, score double")
        out = found if out is None else out.unionByName(found)
    return own.sparkSession.createDataFrame([], f"`{names[0]}` {query_type}, `{names[1]}` {id_type}, score double") if out is None else out


def quantized_search(df: DataFrame, queries: DataFrame, k: int, quantizer: Quantizer, factor: int | None = None, metric: str = "ip", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) over vectors without stored codes: coded on the way, and reranked exactly if ``factor`` is given."""
    coded = with_codes(df.select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col)), quantizer, vector_col)
    if not factor or metric != "ip":
        found = coded_search(coded, queries, k * factor if factor else k, quantizer, metric, id_col, query_id, query_vector, digits)
        return topk.rerank(found, df, queries, k, metric, id_col, vector_col, query_id, query_vector, digits) if factor else found
    # The vectors are at hand where the codes are scored, so candidates bring their exact score and no join is needed.
    own = coded.select(F.col(id_col).alias("i_"), "code", "norm", F.col(vector_col).alias("v_")).where("code is not null")
    asked = queries.select(F.col(query_id).alias("q_"), F.col(query_vector).cast("array<double>").alias("w_")).where("w_ is not null")
    found = _coded(own, asked, k * factor, quantizer, metric, (query_id, id_col), digits)
    near = topk.rank_by(found, F.col("score"), False, id_col, [query_id]).where(F.col("rank") <= k * factor)
    exact = near.select(query_id, id_col, F.round("second", digits).alias("score"))
    return topk.rank_by(exact, F.col("score"), False, id_col, [query_id]).where(F.col("rank") <= k)
