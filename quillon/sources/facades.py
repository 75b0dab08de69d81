"""Four ways to use collections: a client with named document collections, a connection with tables and a search
builder, a text store with an embedding function, and an asynchronous wrapper. All are thin layers over Collection
and Searcher; results are Python values where their callers expect them, DataFrames elsewhere."""

from __future__ import annotations

import asyncio
import json
import os
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import filters, maxsim
from quillon.plans.planner import Searcher
from quillon.sources.importers import adapt
from quillon.sources.store import Catalog, Collection

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def scalars(meta: dict | None) -> dict:
    """Metadata with values other than scalars turned to text."""
    return {k: v if v is None or isinstance(v, (str, int, float, bool)) else str(v) for k, v in (meta or {}).items()}


# Named document collections


class Client:
    def __init__(self, spark: SparkSession, path: str):
        self.catalog = Catalog(spark, path)

    def create_collection(self, name: str, metadata: dict | None = None, embedding_function: Embed | None = None, dimension: int | None = None, get_or_create: bool = False) -> DocumentCollection:
        """The metric is metadata["space"] (default ip); the dimension may be left to the first write."""
        if self.catalog.exists(name) and not get_or_create:
            raise ValueError(f"collection {name!r} exists")
        return DocumentCollection(self.catalog, name, (metadata or {}).get("space", "ip"), embedding_function, dimension)

    def get_or_create_collection(self, name: str, **options) -> DocumentCollection:
        return self.create_collection(name, get_or_create=True, **options)

    def get_collection(self, name: str, embedding_function: Embed | None = None) -> DocumentCollection:
        return DocumentCollection(self.catalog, name, self.catalog.get(name).metric, embedding_function, None)

    def delete_collection(self, name: str) -> None:
        if not self.catalog.delete(name):
            raise ValueError(f"no collection {name!r}")

    def list_collections(self) -> list[str]:
        return self.catalog.list()

    def count_collections(self) -> int:
        return len(self.catalog.list())

    def reset(self) -> None:
        for name in self.catalog.list():
            self.catalog.delete(name)

    @staticmethod
    def heartbeat() -> int:
        import time

        return time.time_ns()


class DocumentCollection:
    def __init__(self, catalog: Catalog, name: str, metric: str, embed: Embed | None, dimension: int | None):
        self.catalog, self.name, self.metric, self.embed = catalog, name, metric, embed
        self._collection = catalog.get(name) if catalog.exists(name) else catalog.create(name, dimension, metric=metric) if dimension else None

    def _of(self, vectors: Sequence[Sequence[float]]) -> Collection:
        if self._collection is None:
            self._collection = self.catalog.create(self.name, len(vectors[0]), metric=self.metric)
        return self._collection

    def _embedded(self, embeddings, documents):
        if embeddings is None:
            if documents is None or self.embed is None:
                raise ValueError("give embeddings, or documents and an embedding function")
            embeddings = self.embed(documents)
        return [list(map(float, e)) for e in embeddings]

    def _write(self, mode: str, ids, embeddings, metadatas, documents) -> None:
        v = self._embedded(embeddings, documents)
        c = self._of(v)
        c.write(c.frame(ids, v, [scalars(m) for m in metadatas] if metadatas else None, documents), mode)

    def add(self, ids, embeddings=None, metadatas=None, documents=None) -> None:
        self._write("insert", ids, embeddings, metadatas, documents)

    def upsert(self, ids, embeddings=None, metadatas=None, documents=None) -> None:
        self._write("upsert", ids, embeddings, metadatas, documents)

    def update(self, ids, embeddings=None, metadatas=None, documents=None) -> None:
        """With embeddings whole rows are replaced, else metadata and documents only."""
        if embeddings is not None:
            return self._write("update", ids, embeddings, metadatas, documents)
        for i, x in enumerate(ids):
            self._collection.update_metadata(x, scalars(metadatas[i]) if metadatas else None, documents[i] if documents else None)

    def modify(self, name: str) -> None:
        if self.catalog.exists(name):
            raise ValueError(f"collection {name!r} exists")
        if self._collection is not None:
            old = self._collection
            old.snapshot(self.catalog._path(name))
            self.catalog.delete(self.name)
            self._collection = self.catalog.get(name)
        self.name = name

    def delete(self, ids: Sequence[str] | None = None, where: dict | None = None) -> int:
        return 0 if self._collection is None else self._collection.delete(ids, where)

    def count(self) -> int:
        return 0 if self._collection is None else self._collection.count()

    def get(self, ids: Sequence[str] | None = None, where: dict | None = None, limit: int | None = None, offset: int = 0, include: Sequence[str] = ("metadatas", "documents")) -> dict:
        """An empty list of ids means nothing, None means all; ids and where are both applied."""
        out: dict[str, Any] = {"ids": []} | {k: [] for k in include}
        if self._collection is None or (ids is not None and not ids):
            return out
        rows = self._collection._filtered(where)
        if ids is not None:
            asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
            rows = asked.join(rows, "id").orderBy("pos")
        else:
            rows = rows.orderBy("seq")
        rows = rows.offset(offset) if offset else rows
        rows = rows if limit is None else rows.limit(limit)
        for r in rows.select("id", *[c for c, k in (("vector", "embeddings"), ("metadata", "metadatas"), ("document", "documents")) if k in include]).collect():
            out["ids"].append(r["id"])
            if "metadatas" in include:
                out["metadatas"].append(json.loads(r["metadata"] or "{}"))
            if "documents" in include:
                out["documents"].append(r["document"])
            if "embeddings" in include:
                out["embeddings"].append(list(r["vector"]))
        return out

    def peek(self, limit: int = 10) -> dict:
        return self.get(limit=limit)

    def query(self, query_embeddings=None, query_texts: Sequence[str] | None = None, n_results: int = 10, where: dict | None = None, where_document: dict | None = None, include: Sequence[str] = ("metadatas", "documents", "distances")) -> dict:
        if where_document is not None:
            raise NotImplementedError("where_document is not supported")
        q = self._embedded(query_embeddings, query_texts)
        out: dict[str, Any] = {"ids": [[] for _ in q]} | {k: [[] for _ in q] for k in include}
        if self._collection is None:
            return out
        for r in Searcher(self._collection).search_batch(q, n_results, where).orderBy("query_id", "rank").collect():
            i = r["query_id"]
            out["ids"][i].append(r["id"])
            for k, v in (("distances", r["score"]), ("metadatas", json.loads(r["metadata"] or "{}")), ("documents", r["document"])):
                if k in include:
                    out[k][i].append(v)
        return out


# Tables with a search builder


class Connection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.catalog = spark, Catalog(spark, path)

    def create_table(self, name: str, data: DataFrame | Sequence[dict] | None = None, dimension: int | None = None, mode: str = "create", metric: str = "ip") -> Table:
        if mode not in ("create", "overwrite"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "overwrite":
            self.catalog.delete(name)
        rows = None if data is None else Table.rows_of(self.spark, data)
        if dimension is None:
            first = None if rows is None else rows.where("vector is not null").select(F.size("vector")).first()
            if first is None:
                raise ValueError("give data or a dimension")
            dimension = first[0]
        t = Table(self.catalog.create(name, dimension, metric=metric))
        if rows is not None:
            t.collection.write(rows, "insert")
        return t

    def open_table(self, name: str) -> Table:
        return Table(self.catalog.get(name))

    def drop_table(self, name: str) -> None:
        self.catalog.delete(name)

    def table_names(self) -> list[str]:
        return self.catalog.list()


class Table:
    def __init__(self, collection: Collection):
        self.collection, self.spark = collection, collection.spark

    @staticmethod
    def rows_of(spark: SparkSession, data: DataFrame | Sequence[dict], offset: int = 0) -> DataFrame:
        """A frame, an Arrow table, or dicts, with columns detected as by the importer; ids default to the row's number."""
        if isinstance(data, DataFrame):
            return adapt(data)
        if hasattr(data, "to_pylist"):
            data = data.to_pylist()
        rows = []
        for i, r in enumerate(data):
            r = dict(r)
            vector, ident = r.pop("vector"), str(r.pop("id", offset + i))
            text = next((r.pop(n) for n in ("text", "document", "content") if n in r), None)
            rows.append((i, ident, [float(x) for x in vector], json.dumps({k: v for k, v in r.items() if v is not None}, default=str), text))
        return spark.createDataFrame(rows, "pos long, id string, vector array<float>, metadata string, document string")

    def add(self, data, mode: str = "append") -> None:
        if mode == "overwrite":
            self.collection.delete(self.collection.rows().select("id"))
        elif mode != "append":
            raise ValueError(f"unknown mode {mode!r}")
        self.collection.write(self.rows_of(self.spark, data, self.collection.count()), "insert")

    def merge_insert(self, data) -> int:
        """Always an upsert by id."""
        return self.collection.write(self.rows_of(self.spark, data), "upsert")

    def _where(self, where: str | None) -> DataFrame:
        rows = self.collection.rows()
        if not where:
            return rows
        f = filters.parse_where(where)
        return rows.where(filters.compile_filter(f, "metadata", promoted={"id": "id"}))

    def delete(self, where: str) -> int:
        return self.collection.delete(self._where(where).select("id"))

    def update(self, where: str | None, values: dict) -> int:
        """Replaces vector and document, and sets metadata fields, of the matching rows."""
        values = dict(values)
        rows = self._where(where)
        if (v := values.pop("vector", None)) is not None:
            rows = rows.withColumn("vector", F.array(*[F.lit(float(x)) for x in v]).cast("array<float>"))
        for n in ("text", "document", "content"):
            if n in values:
                rows = rows.withColumn("document", F.lit(values.pop(n)))
        if values:
            # Both objects are read as maps of JSON values, so that all other fields stay as they are.
            own = F.from_json("metadata", "map<string,variant>")
            new = F.from_json(F.lit(json.dumps(values)), "map<string,variant>")
            kept = F.map_filter(own, lambda k, _: ~k.isin(list(values)))
            rows = rows.withColumn("metadata", F.to_json(F.map_concat(kept, new)))
        return self.collection.write(rows.select(F.col("seq").alias("pos"), "id", "vector", "metadata", "document"), "update")

    def count_rows(self, where: str | None = None) -> int:
        return self._where(where).count()

    def head(self, n: int = 5) -> DataFrame:
        return self.collection.rows().orderBy("seq").limit(n)

    def to_arrow(self):
        return self.collection.rows().drop("seq").toArrow()

    def to_pandas(self):
        return self.collection.rows().drop("seq").toPandas()

    @property
    def schema(self):
        return self.collection.rows().drop("seq").schema

    def create_index(self, *_, num_partitions: int | None = None, **__) -> None:
        Searcher(self.collection).create_index(num_partitions)

    def optimize(self) -> None:
        self.collection.compact()

    def search(self, query: Sequence[float] | None = None) -> Search:
        return Search(self, query)


class Search:
    """limit, where, select, metric, nprobes and refine_factor, then to_df, to_list, to_pandas or to_arrow."""

    def __init__(self, table: Table, query: Sequence[float] | None):
        self.table, self.query, self._limit, self._where, self._columns, self._nprobes = table, query, 10, None, None, None

    def limit(self, n: int) -> Search:
        self._limit = n
        return self

    def where(self, clause: str) -> Search:
        filters.parse_where(clause)
        self._where = clause
        return self

    def select(self, columns: Sequence[str]) -> Search:
        self._columns = list(columns)
        return self

    def metric(self, name: str) -> Search:
        if name != self.table.collection.metric:
            import warnings

            warnings.warn(f"the table's metric is {self.table.collection.metric}", stacklevel=2)
        return self

    def nprobes(self, n: int) -> Search:
        self._nprobes = n
        return self

    def refine_factor(self, _: int) -> Search:
        return self

    def to_df(self) -> DataFrame:
        rows = self.table._where(self._where)
        if self.query is None:
            out = rows.orderBy("seq").limit(self._limit)
        else:
            c = self.table.collection
            s = Searcher(c)
            q = s._queries([self.query])
            from quillon.operators import topk

            hits = topk.search_blocks(rows, q, self._limit, c.metric) if self._nprobes is None or self._where else s.dense(q, self._limit, None, 0, "ivf", self._nprobes)
            out = hits.join(c.rows(), "id").orderBy("rank").withColumn("_distance", F.col("score"))
        keep = self._columns or [x for x in out.columns if x not in ("seq", "query_id", "rank", "score")]
        return out.select(*keep)

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_df().collect()]

    def to_pandas(self):
        return self.to_df().toPandas()

    def to_arrow(self):
        return self.to_df().toArrow()


# Texts with an embedding function


class TextStore:
    """Texts, their metadata and embeddings; the base of retrieval chains."""

    def __init__(self, collection: Collection, embed: Embed | None = None):
        self.collection, self.embed, self.searcher = collection, embed, Searcher(collection)

    @staticmethod
    def from_texts(spark: SparkSession, path: str, texts: Sequence[str], embed: Embed, metadatas: Sequence[dict] | None = None, ids: Sequence[str] | None = None, metric: str = "cosine") -> TextStore:
        vectors = embed(list(texts))
        out = TextStore(Collection.open(spark, path, len(vectors[0]), metric), embed)
        out.add_texts(texts, metadatas, ids, vectors)
        return out

    def add_texts(self, texts: Sequence[str], metadatas: Sequence[dict] | None = None, ids: Sequence[str] | None = None, vectors=None) -> list[str]:
        ids = list(ids) if ids is not None else [f"doc_{uuid.uuid4().hex}" for _ in texts]
        self.collection.upsert(ids, vectors if vectors is not None else self.embed(list(texts)), metadatas, list(texts))
        return ids

    def add_documents(self, documents: Sequence[Any], ids: Sequence[str] | None = None) -> list[str]:
        """Documents are objects with page_content (or text) and metadata."""
        text = lambda d: getattr(d, "page_content", None) or getattr(d, "text", "")
        return self.add_texts([text(d) for d in documents], [getattr(d, "metadata", {}) or {} for d in documents], ids)

    def delete(self, ids: Sequence[str]) -> int:
        return self.collection.delete(ids)

    def clear(self) -> None:
        self.collection.delete(self.collection.rows().select("id"))

    def get_by_ids(self, ids: Sequence[str]) -> list[dict]:
        return [{"id": r["id"], "text": r["document"], "metadata": json.loads(r["metadata"] or "{}")} for r in self.collection.get_many(ids).collect() if r["found"]]

    def search(self, query: str | None = None, k: int = 4, filter: Any = None, vector: Sequence[float] | None = None, hybrid: dict | None = None) -> list[dict]:
        """The k best texts with score and relevance in [0, 1]. Without an embedding function texts that contain the query are returned."""
        f = filter if isinstance(filter, dict) or filter is None else filters.from_clauses(filter)
        if vector is None and self.embed is None:
            found = self.collection._filtered(f).where(F.lower("document").contains((query or "").lower())).orderBy("seq").limit(k)
            return [{"id": r["id"], "text": r["document"], "metadata": json.loads(r["metadata"] or "{}"), "score": None, "relevance": None} for r in found.collect()]
        v = vector if vector is not None else self.embed([query])[0]
        hits = self.searcher.search_batch([v], k, f, hybrid=hybrid).orderBy("rank").withColumn("relevance", V.relevance(self.collection.metric, F.col("score")))
        return [{"id": r["id"], "text": r["document"], "metadata": json.loads(r["metadata"] or "{}"), "score": r["score"], "relevance": r["relevance"]} for r in hits.collect()]

    def query_batch(self, queries: Sequence[str], k: int = 4, filter: dict | None = None) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in queries]
        for r in self.searcher.search_batch(self.embed(list(queries)), k, filter).orderBy("query_id", "rank").collect():
            out[r["query_id"]].append({"id": r["id"], "text": r["document"], "score": r["score"]})
        return out

    def as_retriever(self, k: int = 4, filter: dict | None = None) -> Callable[[str], list[dict]]:
        return lambda query: self.search(query, k, filter)


# Multi-vector documents


class MultiVectorStore:
    """Documents of many vectors, searched by late interaction; token rows carry their document in the metadata."""

    def __init__(self, collection: Collection):
        self.collection = collection

    def _tokens(self) -> DataFrame:
        r = self.collection.rows()
        return r.select(F.col("id").alias("token_id"), F.get_json_object("metadata", "$._doc").alias("doc_id"), "vector", "metadata", "document")

    def insert(self, doc_id: str, vectors, metadata: dict | None = None, document: str | None = None) -> int:
        """Replaces the document if it exists."""
        self.delete(doc_id)
        n = len(vectors)
        return self.collection.insert([f"{doc_id}\x1f{i}" for i in range(n)], vectors, [{**(metadata or {}), "_doc": doc_id}] * n, [document] * n)

    def delete(self, doc_id: str) -> int:
        return self.collection.delete(filt={"_doc": doc_id})

    def get(self, doc_id: str) -> dict | None:
        rows = self._tokens().where(F.col("doc_id") == doc_id).collect()
        if not rows:
            return None
        meta = json.loads(rows[0]["metadata"])
        meta.pop("_doc")
        return {"id": doc_id, "vectors": len(rows), "metadata": meta, "document": rows[0]["document"]}

    def ids(self) -> list[str]:
        return sorted(r[0] for r in self._tokens().select("doc_id").distinct().collect())

    def search(self, query_vectors, k: int = 10, oversample: int | None = None) -> list[tuple[str, float]]:
        q = self.collection.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(query_vectors)], "token_idx int, query_vector array<double>")
        out = maxsim.maxsim(self._tokens(), q, k, oversample=oversample, token_id="token_id").orderBy("rank")
        return [(r["doc_id"], r["score"]) for r in out.collect()]


# Asynchronous use


class Async:
    """Any of the above with awaitable methods; Spark's scheduler takes jobs from several threads."""

    def __init__(self, wrapped: Any, workers: int | None = None):
        self._wrapped, self._pool = wrapped, ThreadPoolExecutor(workers or min(32, (os.cpu_count() or 1) + 4))

    def __getattr__(self, name: str):
        method = getattr(self._wrapped, name)
        if not callable(method):
            return method

        async def call(*args, **kwargs):
            return await asyncio.get_running_loop().run_in_executor(self._pool, lambda: method(*args, **kwargs))

        return call

    async def __aenter__(self):
        return self

    async def __aexit__(self, *_) -> None:
        self._pool.shutdown()
