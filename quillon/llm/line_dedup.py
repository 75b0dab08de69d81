"""Operator 9, line dedup: sharded cuckoo filters backed by exact reference tables.

A line's key is its text, without white space around it and in lower case; lines without text are left
alone, all others compared. The store keeps

* ``references``: one row for every live occurrence of a key (batch, document, text, line number), under a
  128-bit hash. A key's reference count is the number of its rows, hence exact;
* ``filters``: for every shard of the hash space a cuckoo filter of the keys whose count is not zero;
* ``lost``: the occurrences that don't own their key.

The first live occurrence (by batch, document, text, line) of a key owns it, and every other one is
removed from its document. Inserting a batch probes the filters: a key that they don't hold is certainly
new, and only the others are sought in the reference table. A batch never changes what earlier ones lose,
so its own losses are added and no earlier document is read again. Deleting documents removes their
references, passes the keys that they owned on, and takes the keys whose count fell to zero out of the
filters, so that a store after insertion and deletion equals one that never saw the documents. The number
of shards grows with the number of keys, so a filter and the keys of a shard stay of bounded size.

Defined results: rows with a null id pass unchanged and own no line; a null text stays null, an
empty one empty; repeated rows (one id, one text) keep or lose the same lines; rows of one id with other
texts are documents of their own, in the order of a hash of the text; ties are broken by document and
line number. A document all of whose lines go keeps an empty text. A store never changes: insert and
delete return a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bytetext import U
from quillon.llm.cuckoo import Cuckoo
from quillon.llm.scratch import fresh, written

#: Keys that a shard is meant to hold; with twice as many on average the filters are dealt anew.
KEYS_PER_SHARD = 500_000
SPACE = " \t\r\v\f"
_PLACE = ("batch", "doc_id", "row", "line_no")
_REFS = "h1 long, h2 long, batch int, doc_id long, row long, line_no int"
_FILTERS = "shard int, held long, table binary"


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return F.lower(F.btrim(line, F.lit(SPACE)))


def occurrences(docs: DataFrame, batch: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col).cast("string")
    # The outer transform binds the text's hash: it is made once for a text, and no line carries the text along.
    each = F.transform(F.array(F.struct(F.xxhash64(text).alias("h"), _lines(text).alias("ls"))), lambda b: F.transform(b["ls"], lambda x, i: F.struct(b["h"].alias("row"), i.alias("line_no"), x.alias("line"))))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.get(each, F.lit(0))).alias("l"))
    keyed = lines.select("doc_id", "l.row", "l.line_no", _key(F.col("l.line")).alias("k")).where("k != ''")
    return keyed.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), F.lit(batch).alias("batch"), "doc_id", "row", "line_no")


def _not_owning(references: DataFrame) -> DataFrame:
    """The rows of ``references`` that don't own their key among them."""
    place = F.struct(*_PLACE)
    owners = references.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(place).alias("owner")).where("refs > 1").select("h1", "h2", "owner")
    return references.join(owners, ["h1", "h2"]).where(place != F.col("owner")).select(references.columns)


@dataclass(frozen=True)
class LineStore:
    spark: SparkSession
    references: DataFrame
    filters: DataFrame
    lost: DataFrame
    shards: int
    batches: int
    keys_per_shard: int = KEYS_PER_SHARD

    @staticmethod
    def empty(spark: SparkSession, keys_per_shard: int = KEYS_PER_SHARD) -> LineStore:
        none = spark.createDataFrame([], _REFS)
        return LineStore(spark, none, spark.createDataFrame([], _FILTERS), none, 0, 0, keys_per_shard)

    def _shard(self, df: DataFrame, shards: int) -> DataFrame:
        return df.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def _probed(self, keys: DataFrame) -> DataFrame:
        """keys with ``maybe``: false where the filters prove the key new."""

        def probe(k: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
            seen = Cuckoo.from_bytes(f["table"].iloc[0]).contains(k["h2"].to_numpy(np.int64).view(U)) if len(f) else np.zeros(len(k), bool)
            return k[["shard", "h1", "h2"]].assign(maybe=seen)

        return keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "shard int, h1 long, h2 long, maybe boolean")

    def _changed(self, keys: DataFrame, add: bool) -> DataFrame:
        """The filters with keys added or taken out; a shard that is too full comes back with no table."""

        def change(k: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
            h = k["h2"].to_numpy(np.int64).view(U)
            shard = int((k if len(k) else f)["shard"].iloc[0])
            filt = Cuckoo.from_bytes(f["table"].iloc[0]) if len(f) else Cuckoo.sized(len(h))
            ok = True
            if add:
                ok = filt.held + len(h) <= 0.9 * filt.table.size and filt.insert(h)
            else:
                filt.delete(h)
            return pd.DataFrame({"shard": [shard], "held": [filt.held], "table": [filt.to_bytes() if ok else None]})

        return keys.select("shard", "h2").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, _FILTERS)

    def _built(self, keys: DataFrame) -> DataFrame:
        """Filters of (shard, h2), distinct."""

        def build(k: pd.DataFrame) -> pd.DataFrame:
            h, room = k["h2"].to_numpy(np.int64).view(U), 0.5
            while not (filt := Cuckoo.sized(len(h), room)).insert(h):
                room /= 2
            return pd.DataFrame({"shard": [int(k["shard"].iloc[0])], "held": [filt.held], "table": [filt.to_bytes()]})

        return keys.groupBy("shard").applyInPandas(build, _FILTERS)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """The store with a further batch of documents."""
        added = written(occurrences(docs, self.batches, id_col, text_col), "line-references")
        place = F.struct(*_PLACE)
        keys = written(added.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(place).alias("owner")), "line-keys")
        repeated = keys.where("refs > 1").select("h1", "h2", F.col("owner").alias("first"))
        if not self.shards:
            new, references = keys.select("h1", "h2"), added
            lost = added.join(repeated, ["h1", "h2"]).where(place != F.col("first")).select(added.columns)
        else:
            probed = written(self._probed(self._shard(keys.select("h1", "h2"), self.shards)), "line-probed")
            maybe = probed.where("maybe").select("h1", "h2")
            known = written(self.references.select("h1", "h2").join(maybe, ["h1", "h2"], "left_semi").distinct(), "line-known")
            new = probed.where("not maybe").select("h1", "h2").unionByName(maybe.join(known, ["h1", "h2"], "left_anti"))
            references = self.references.unionByName(added)
            # All occurrences of a known key go; of a new one all but the first.
            first = repeated.join(known, ["h1", "h2"], "left_anti").unionByName(known.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType)))
            lost = added.join(first, ["h1", "h2"]).where(F.col("first").isNull() | (place != F.col("first"))).select(added.columns)
        lost = written(lost, "line-lost")
        held = int(self.filters.agg(F.sum("held")).first()[0] or 0) + new.count()
        if held > 2 * self.keys_per_shard * self.shards:
            shards = -(-held // self.keys_per_shard)
            filters = written(self._built(self._shard(references.select("h1", "h2").distinct() if self.shards else new, shards)), "line-filters")
        else:
            shards = self.shards
            filters = written(self._changed(self._shard(new, shards), True), "line-filters") if shards else self.filters
            full = filters.where("table is null").select("shard")
            if shards and not full.isEmpty():
                again = self._shard(references.select("h1", "h2").distinct(), shards).join(F.broadcast(full), "shard", "left_semi")
                filters = written(filters.where("table is not null").unionByName(self._built(again)), "line-filters")
        return replace(self, references=references, filters=filters, lost=self.lost.unionByName(lost) if self.batches else lost, shards=shards, batches=self.batches + 1)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineStore:
        """The store without the documents of these ids."""
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        references = written(self.references.join(gone, "doc_id", "left_anti").select(*self.references.columns), "line-references")
        touched = written(self.references.join(gone, "doc_id", "left_semi").select("h1", "h2").distinct(), "line-touched")
        left = written(references.join(touched, ["h1", "h2"], "left_semi").select(*references.columns), "line-left")
        lost = self.lost.join(gone, "doc_id", "left_anti").join(touched, ["h1", "h2"], "left_anti").select(*references.columns).unionByName(_not_owning(left))
        dead = touched.join(left.select("h1", "h2"), ["h1", "h2"], "left_anti")
        filters = written(self._changed(self._shard(dead, self.shards), False), "line-filters") if self.shards else self.filters
        return replace(self, references=references, filters=filters, lost=written(lost, "line-lost"))

    def counts(self) -> DataFrame:
        """(h1, h2, refs): the exact reference counts."""
        return self.references.groupBy("h1", "h2").agg(F.count("*").alias("refs"))

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed") -> DataFrame:
        """docs with the text without the lines owned elsewhere, and the number of lines removed in ``removed_col``
        (with underscores added if docs has a column of that name)."""
        count, lost_id, lost_row, lines_lost = fresh(docs.columns, removed_col, "lost_id", "lost_row", "lost_lines")
        lost = self.lost.groupBy(F.col("doc_id").alias(lost_id), F.col("row").alias(lost_row)).agg(F.collect_set("line_no").alias(lines_lost))
        text = F.col(text_col).cast("string")
        both = docs.join(lost, (F.col(id_col).cast("long") == F.col(lost_id)) & (F.xxhash64(text) == F.col(lost_row)), "left")
        at = F.col(lines_lost)
        # The outer transform binds the lines, so that a text is split once; the rest is linear in their number.
        left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: F.get(lines, i))
        kept = F.get(F.transform(F.array(_lines(text)), lambda lines: F.array_join(left(lines), "\n")), F.lit(0))
        new = F.when(at.isNull(), F.col(text_col)).otherwise(kept)
        return both.withColumn(count, F.coalesce(F.size(at), F.lit(0)).cast("long")).withColumn(text_col, new).drop(lost_id, lost_row, lines_lost)


def oracle(batches: str = "0", deleted: str = "false") -> str:
    """DuckDB SQL for dedup() after inserting documents in batches (an expression over doc_id) and deleting some."""
    space = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
WITH l AS (SELECT doc_id, {batches} AS batch, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE NOT ({deleted})),
k AS (SELECT *, lower(trim(line, {space})) AS k FROM l),
o AS (SELECT *, k != '' AND row_number() OVER (PARTITION BY k ORDER BY batch, doc_id, i) > 1 AS gone FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone)::BIGINT AS removed FROM o GROUP BY doc_id
"""
