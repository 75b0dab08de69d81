"""Collections of (id, vector, metadata, document) rows: versioned Parquet with a manifest as commit point.

Every change writes one delta (rows and tombstones, with a rising sequence number) or a new base, and
then a new manifest version; readers see the newest complete version, so a write that fails half-way
leaves nothing visible. The live state of an id is its row of highest sequence number. ``compact``
folds deltas in a new base. Files of unreferenced versions are orphans that ``vacuum`` removes.
Every row is written with the quantised code of its vector, so a quantised search reads codes, not vectors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import vectors as V
from quillon.functions.quantize import Quantizer, with_codes
from quillon.operators import filters

ROW = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType()),
    T.StructField("document", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType()),
    T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()),
])
MODES = ("insert", "update", "upsert")
MAX_ID_BYTES = 65_535
AUTO_COMPACT = 64
#: Batches up to so many rows are numbered by one task; larger ones by range partitions.
NUMBER_ROWS = 100_000


class Files:
    """The few file operations a store needs, through Hadoop, so that any file system Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a new file; fails if it exists, so that of two writers of one version one loses."""
        fs, p = self._at(path)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        a, p = self._at(source)
        b, q = self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, self.conf)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Collection:
    """``open`` creates or reopens; all reads are DataFrames, all writes return counts."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.files, self.manifest = spark, path, Files(spark), manifest

    # opening and versions

    @staticmethod
    def open(spark: SparkSession, path: str, dimension: int | None = None, metric: str = "ip", bits: int = 4, seed: int = 42, normalize: bool = False, rerank: bool = False, fast_mode: bool = True, rerank_precision: str | None = None, quantizer_type: str | None = None, collection: str | None = None, tenant: str | None = None, database: str | None = None) -> Collection:
        """Reopening checks dimension, bits and metric against the manifest; a new collection needs a dimension."""
        path = "/".join(x for x in (path.rstrip("/"), tenant, database, collection) if x)
        files = Files(spark)
        newest = Collection._newest(files, path)
        if newest is not None:
            for name, given in (("dimension", dimension), ("metric", metric), ("bits", bits)):
                if given is not None and given != newest[name] and not (name != "dimension" and given == {"metric": "ip", "bits": 4}[name]):
                    raise ValueError(f"{name} is {newest[name]} in the collection, not {given}")
            return Collection(spark, path, newest)
        if dimension is None or dimension < 1:
            raise ValueError("a new collection needs a dimension of at least 1")
        if metric not in V.METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        if not 1 <= bits <= 8 or (bits < 2 and not fast_mode):
            raise ValueError("bits must be 1 to 8, and at least 2 without fast_mode")
        out = Collection(spark, path, {"version": -1, "dimension": dimension, "metric": metric, "bits": bits, "seed": seed, "normalize": normalize, "rerank": rerank, "fast_mode": fast_mode, "rerank_precision": rerank_precision, "quantizer_type": quantizer_type, "parts": [], "next_seq": 0, "index": None})
        out._commit([], 0)
        return out

    @staticmethod
    def _newest(files: Files, path: str) -> dict | None:
        names = [n for n in files.list(f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        for name in reversed(names):
            try:
                return json.loads(files.read(f"{path}/manifests/{name}"))
            except ValueError:
                continue  # a manifest cut short by a crash was never committed
        return None

    def _commit(self, parts: list[str], next_seq: int, **changed: Any) -> None:
        new = self.manifest | {"version": self.manifest["version"] + 1, "parts": parts, "next_seq": next_seq} | changed
        self.files.create(f"{self.path}/manifests/{new['version']:012d}.json", json.dumps(new))
        self.manifest = new

    def refresh(self) -> Collection:
        self.manifest = self._newest(self.files, self.path)
        return self

    # reading

    @property
    def dimension(self) -> int:
        return self.manifest["dimension"]

    @property
    def metric(self) -> str:
        return self.manifest["metric"]

    def log(self) -> DataFrame:
        """All rows and tombstones of the current version's parts."""
        parts = [f"{self.path}/data/{p}" for p in self.manifest["parts"]]
        return self.spark.read.schema(ROW).parquet(*parts) if parts else self.spark.createDataFrame([], ROW)

    def rows(self, codes: bool = False) -> DataFrame:
        """(id, vector, metadata, document, seq) of the live rows, with ``codes`` code and norm, too. One part needs no
        resolution and no shuffle; of several the columns that are not used are pruned before the rows are resolved."""
        log, extra = self.log(), ["code", "norm"] if codes else []
        if len(self.manifest["parts"]) > 1:
            last = log.groupBy("id").agg(F.max_by(F.struct("vector", "metadata", "document", "deleted", "seq", *extra), "seq").alias("r"))
            log = last.select("id", "r.*")
        return log.where(~F.col("deleted")).select("id", "vector", "metadata", "document", "seq", *extra)

    @property
    def quantizer(self) -> Quantizer:
        m = self.manifest
        return Quantizer.cached(m["dimension"], m["bits"], m["seed"], "hadamard" if m["quantizer_type"] in ("srht", "hadamard") else "dense")

    def _filtered(self, filt: dict | None, codes: bool = False) -> DataFrame:
        rows = self.rows(codes)
        return filters.matching(rows, filt, "metadata")

    def get(self, id: str) -> dict | None:
        found = self.rows().where(F.col("id") == id).select("id", "metadata", "document").first()
        return None if found is None else self._shown(found)

    @staticmethod
    def _shown(row) -> dict:
        return {"id": row["id"], "metadata": json.loads(row["metadata"]) if row["metadata"] is not None else {}, "document": row["document"]}

    def get_many(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        """(pos, id, found, metadata, document) in the order asked, repeats and misses included."""
        if isinstance(ids, DataFrame):
            asked = ids.select("pos", "id")
        else:
            asked = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
        rows = self.rows().select("id", "metadata", "document", F.lit(True).alias("found"))
        return asked.join(rows, "id", "left").select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"), "metadata", "document").orderBy("pos")

    def contains(self, id: str) -> bool:
        return not self.rows().where(F.col("id") == id).isEmpty()

    def count(self, filt: dict | None = None) -> int:
        return self._filtered(filt).count()

    def __len__(self) -> int:
        return self.count()

    def list_ids(self, filt: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Ids in the order of insertion."""
        if offset < 0 or (limit is not None and limit < 0):
            raise ValueError("limit and offset can't be negative")
        out = self._filtered(filt).orderBy("seq").select("id")
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def list_all(self) -> DataFrame:
        return self.list_ids()

    def facet(self, field: str, filt: dict | None = None) -> DataFrame:
        """(value, count) of a field; other values than strings as JSON text, missing ones left out."""
        return filters.facet(self._filtered(filt), field)

    def stats(self) -> dict:
        live = self.count()
        return {"vector_count": live, "dimension": self.dimension, "metric": self.metric, "bits": self.manifest["bits"], "version": self.manifest["version"], "parts": len(self.manifest["parts"]), "bytes": self.files.size(f"{self.path}/data"), "has_index": self.manifest["index"] is not None, "has_text_index": bool(self.manifest.get("text")), "has_graph": bool(self.manifest.get("graph")), "next_seq": self.manifest["next_seq"]}

    # writing

    def frame(self, ids: Sequence[str], vectors: Iterable, metadatas: Sequence[dict | None] | None = None, documents: Sequence[str | None] | None = None) -> DataFrame:
        """A batch from Python values; ``pos`` keeps their order."""
        ids, vectors = list(ids), [[float(x) for x in v] for v in vectors]
        metadatas, documents = metadatas or [None] * len(ids), documents or [None] * len(ids)
        if not len(ids) == len(vectors) == len(metadatas) == len(documents):
            raise ValueError("ids, vectors, metadatas and documents differ in length")
        rows = [(i, str(a), v, json.dumps(m if m is not None else {}, default=lambda _: None), d) for i, (a, v, m, d) in enumerate(zip(ids, vectors, metadatas, documents))]
        return self.spark.createDataFrame(rows, "pos long, id string, vector array<float>, metadata string, document string")

    def _problems(self, batch: DataFrame) -> DataFrame:
        """The batch with the reason a row can't be written, or null."""
        bad = F.when(F.col("id").isNull() | (F.octet_length("id") > MAX_ID_BYTES), "invalid id")
        bad = bad.when(F.col("vector").isNull() | (F.size("vector") != self.dimension), f"vector must have {self.dimension} elements")
        bad = bad.when(~V.is_finite("vector"), "vector must be finite")
        if self.manifest["normalize"]:
            bad = bad.when(V.norm(F.col("vector").cast("array<double>")) <= 1e-10, "vector has no length")
        return batch.withColumn("error", bad)

    def write(self, batch: DataFrame, mode: str = "upsert", report: bool = False) -> int | DataFrame:
        """Writes a batch (id, vector[, metadata, document, pos]). The whole batch is checked before anything is written.
        ``pos``, of any type with an order, says which of equal ids is the last; all rows of a batch come after those written before.

        insert: ids must be new and unique in the batch; update: ids must exist; upsert: the last of equal ids counts.
        With ``report`` good rows are written and (pos, id, error) of the others is returned; else any error raises.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
        for name, kind in (("metadata", "string"), ("document", "string")):
            if name not in batch.columns:
                batch = batch.withColumn(name, F.lit(None).cast(kind))
        if "pos" not in batch.columns:
            batch = batch.withColumn("pos", F.monotonically_increasing_id())
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        checked = self._problems(batch.select("pos", "id", F.col("vector").cast("array<float>").alias("vector"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "document"))
        known = self.rows().select("id", F.lit(True).alias("known"))
        same = Window.partitionBy("id")
        checked = checked.join(known, "id", "left").withColumn("nth", F.row_number().over(same.orderBy("pos"))).withColumn("later", F.count("*").over(same) - F.col("nth"))
        clash = {"insert": F.when(F.col("known") | (F.col("nth") > 1), "id exists"), "update": F.when(F.col("known").isNull(), "id doesn't exist"), "upsert": F.lit(None)}[mode]
        checked.withColumn("error", F.coalesce("error", clash)).drop("known", "nth").write.parquet(staged)
        try:
            rows = self.spark.read.parquet(staged)
            errors = rows.where("error is not null").select("pos", "id", "error")
            if not report and (first := errors.orderBy("pos").first()) is not None:
                raise ValueError(f"row {first['pos']} ({first['id']!r}): {first['error']}")
            good = rows.where("error is null")
            good = good.where("later = 0") if mode != "insert" else good
            vector = F.col("vector")
            if self.manifest["normalize"]:
                vector = V.normalized(vector.cast("array<double>")).cast("array<float>")
            good = self._numbered(good, rows.count(), f"{staged}-numbered")
            written = self._append(good.select("id", vector.alias("vector"), "metadata", "document", (F.lit(self.manifest["next_seq"]) + F.col("n")).alias("seq"), F.lit(False).alias("deleted")))
            if report:
                kept = f"{self.path}/reports/{uuid.uuid4().hex}"
                errors.write.parquet(kept)
                return self.spark.read.schema(errors.schema).parquet(kept)
            return written
        finally:
            self.files.delete(staged)
            self.files.delete(f"{staged}-numbered")

    def _numbered(self, rows: DataFrame, count: int, path: str) -> DataFrame:
        """rows with ``n``, 0, 1, ... in the order of pos, whatever pos is. Only pos and id are put in order; vectors and
        documents are joined by id, which is unique among the rows that are written."""
        keys = rows.select("pos", "id")
        if count <= NUMBER_ROWS:
            numbered = keys.withColumn("n", (F.row_number().over(Window.orderBy("pos", "id")) - 1).cast("long")).select("id", "n")
            return rows.join(numbered, "id")
        # Range partitions in order; a row's number is its place in the partition and the rows of those before.
        keys.repartitionByRange("pos", "id").sortWithinPartitions("pos", "id").withColumn("m", F.monotonically_increasing_id()).write.parquet(path)
        placed = self.spark.read.parquet(path).withColumn("part", F.shiftright("m", 33))
        sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
        before, offsets = 0, []
        for part, size in sizes:
            offsets.append((part, before))
            before += size
        offsets = F.broadcast(self.spark.createDataFrame(offsets, "part long, before long"))
        numbered = placed.join(offsets, "part").select("id", (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("n"))
        return rows.join(numbered, "id")

    def _append(self, rows: DataFrame) -> int:
        name = uuid.uuid4().hex
        with_codes(rows, self.quantizer).select(*ROW.names).write.parquet(f"{self.path}/data/{name}")
        found = self.spark.read.schema(ROW).parquet(f"{self.path}/data/{name}").agg(F.count("*").alias("n"), F.max("seq").alias("m")).first()
        if found["n"] == 0:
            self.files.delete(f"{self.path}/data/{name}")
            return 0
        self._commit([*self.manifest["parts"], name], found["m"] + 1)
        if len(self.manifest["parts"]) > AUTO_COMPACT:
            self.compact()
        return found["n"]

    def insert(self, ids, vectors, metadatas=None, documents=None) -> int:
        return self.write(self.frame(ids, vectors, metadatas, documents), "insert")

    def upsert(self, ids, vectors, metadatas=None, documents=None) -> int:
        return self.write(self.frame(ids, vectors, metadatas, documents), "upsert")

    def update(self, ids, vectors, metadatas=None, documents=None) -> int:
        return self.write(self.frame(ids, vectors, metadatas, documents), "update")

    def update_metadata(self, id: str, metadata: dict | None = None, document: str | None = None) -> None:
        """A non-empty dict replaces the metadata, a document the document; an unknown id raises."""
        row = self.rows().where(F.col("id") == id)
        if row.isEmpty():
            raise KeyError(id)
        seq = self.manifest["next_seq"]
        changed = row.withColumn("metadata", F.lit(json.dumps(metadata)) if metadata else F.col("metadata")).withColumn("document", F.lit(document) if document is not None else F.col("document"))
        self._append(changed.select("id", "vector", "metadata", "document", F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("deleted")))

    def _bury(self, ids: DataFrame) -> int:
        seq = self.manifest["next_seq"]
        dead = ids.select("id").distinct().select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("document"), F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("deleted"))
        return self._append(dead)

    def delete(self, ids: Sequence[str] | DataFrame | None = None, filt: dict | None = None) -> int:
        """Deletes ids (unknown ones are skipped) and rows that match the filter; how many there were."""
        dead = None
        if ids is not None:
            asked = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "id string")
            dead = self.rows().select("id").join(asked.select("id"), "id", "left_semi")
        if filt is not None:
            matched = self._filtered(filt).select("id")
            dead = matched if dead is None else dead.unionByName(matched)
        return 0 if dead is None else self._bury(dead)

    def delete_where(self, filt: dict) -> int:
        return self.delete(filt=filt)

    # maintenance

    def compact(self) -> None:
        """All live rows in one new part; the order of insertion stays."""
        name = uuid.uuid4().hex
        self.rows(codes=True).withColumn("deleted", F.lit(False)).select(*ROW.names).write.parquet(f"{self.path}/data/{name}")
        self._commit([name], self.manifest["next_seq"])

    flush = checkpoint = compact

    def vacuum(self) -> int:
        """Removes parts, reports, indexes and manifests that the newest version doesn't use; how many parts."""
        used = [m["path"].rsplit("/", 1)[-1] for m in (self.manifest["index"], self.manifest.get("text"), self.manifest.get("graph")) if m]
        for kind in ("index", "reports", "staged"):
            for p in self.files.list(f"{self.path}/{kind}"):
                if p not in used:
                    self.files.delete(f"{self.path}/{kind}/{p}")
        dead = [p for p in self.files.list(f"{self.path}/data") if p not in self.manifest["parts"]]
        for p in dead:
            self.files.delete(f"{self.path}/data/{p}")
        for m in self.files.list(f"{self.path}/manifests")[:-1]:
            self.files.delete(f"{self.path}/manifests/{m}")
        return len(dead)

    def snapshot(self, target: str) -> None:
        """A copy of the newest version; its manifest, written last, makes it valid."""
        for p in self.manifest["parts"]:
            self.files.copy(f"{self.path}/data/{p}", f"{target}/data/{p}")
        self.files.create(f"{target}/manifests/{self.manifest['version']:012d}.json", json.dumps(self.manifest))

    def restore(self, source: str) -> None:
        """Takes over a snapshot's rows as a further version; until its manifest is written the old version stands."""
        manifest = self._newest(self.files, source)
        if manifest is None:
            raise FileNotFoundError(source)
        names = []
        for p in manifest["parts"]:
            names.append(name := uuid.uuid4().hex)
            self.files.copy(f"{source}/data/{p}", f"{self.path}/data/{name}")
        self._commit(names, max(manifest["next_seq"], self.manifest["next_seq"]), dimension=manifest["dimension"], metric=manifest["metric"], index=None, text=None, graph=None)


class Catalog:
    """Collections below a root, optionally by tenant and database."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _path(self, name: str, tenant: str | None = None, database: str | None = None) -> str:
        for part in (name, tenant, database):
            if part is not None and (not part or "/" in part or part in (".", "..")):
                raise ValueError(f"invalid name {part!r}")
        return "/".join(x for x in (self.root, tenant, database, name) if x)

    def exists(self, name: str, **scope) -> bool:
        return bool(self.files.list(self._path(name, **scope) + "/manifests"))

    def create(self, name: str, dimension: int, exist_ok: bool = False, tenant: str | None = None, database: str | None = None, **options) -> Collection:
        path = self._path(name, tenant, database)
        if not exist_ok and self.files.list(path + "/manifests"):
            raise ValueError(f"collection {name!r} exists")
        return Collection.open(self.spark, path, dimension, **options)

    def get(self, name: str, **scope) -> Collection:
        if not self.exists(name, **scope):
            raise KeyError(name)
        return Collection.open(self.spark, self._path(name, **scope))

    def delete(self, name: str, **scope) -> bool:
        return self.exists(name, **scope) and self.files.delete(self._path(name, **scope))

    def list(self, tenant: str | None = None, database: str | None = None) -> list[str]:
        base = "/".join(x for x in (self.root, tenant, database) if x)
        return [n for n in self.files.list(base) if self.files.list(f"{base}/{n}/manifests")]
