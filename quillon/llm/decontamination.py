"""Operator 6, benchmark decontamination by template canonicalisation.

A text becomes a template: every word (see bytetext) is kept in lower case or replaced by a typed
placeholder: NUM for a run of digits, UNIT for a unit of measure right after a number, NAME for a
capitalised word that doesn't open a sentence (none of . ! ? : ; or a line feed lies before it). Windows of
``window`` template words are hash-joined between corpus and benchmark. Matching windows of one
document and item at one offset are an alignment; its placeholders must be filled consistently, that
is, each value of the item by one value of the document and the reverse. So both verbatim copies and
questions with other numbers, names or units are found, but not texts that share a mere pattern.

Items that these templates don't find in a document are sought in two other ways, each with windows and
alignments of its own: by the words themselves in lower case, so that a copy's case and place don't matter;
and by templates in which a word that opens a sentence may be a NAME, too, and capitalised words in a row
or digits with , or . are one slot. There, no value may differ that the texts have more often in lower case than
capitalised within a sentence.

A document holds an item if a consistent alignment has at least ``min_windows`` windows (13 words in
a row, by default), or all of the item's of that kind if it has fewer. Windows with fewer literal words than half
their length are used verbatim only, so every item has windows. Items shorter than the window are compared as one window of their length;
those of fewer than MIN_WORDS words, which within a sentence can't be told from chance, are found where they are whole
lines (or the whole text) of the document, in any case.

Defined results: rows with a null id or text are in no result; repeated rows count once; rows of one id with other
texts are documents or items of their own, reported under that id by the best of them; where an item
aligns at several offsets, the one with most windows is reported, then the smallest. Items without words are in no document. Texts of any
length are read whole; an empty corpus or benchmark gives an empty result; columns other than id and text don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bytetext import Hasher, U, buffers, fold, hash_text, mix, slices, words
from quillon.llm.scratch import fresh, written

WINDOW, MIN_WINDOWS, MIN_WORDS = 8, 6, 5
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "kmh", "mph", "miles", "mile", "feet", "foot", "inches", "inch", "pounds", "pound", "dollars", "dollar", "euros", "euro", "cents", "cent", "percent", "degrees", "degree", "meters", "metres", "meter", "metre", "liters", "litres", "grams", "gram", "kilograms", "watts", "volts", "joules", "newtons")
_UNITS = np.unique(np.array([hash_text(u) for u in UNITS], U))
NUM, UNIT, NAME = U(0x1D872B41), U(0x2C1B3C6D), U(0x3F4A7C15)
_BITS = 1 << 22
_ENDS = np.zeros(256, bool)
_ENDS[[46, 33, 63, 58, 59, 10]] = True
_SCHEMA = "id long, row long, kind int, pos int, length int, h long, slots array<long>"
#: Kinds of windows, each with alignments of its own; an item found by several is reported by the first of them.
TEMPLATE, LITERAL, NAMES, WHOLE = 0, 1, 2, 3
_SALT = U(0x5A17C0DE)


@dataclass
class Words:
    """The words of a slice."""

    hasher: Hasher
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    value: np.ndarray  # hash of the folded word
    number: np.ndarray
    capital: np.ndarray
    opens: np.ndarray  # a sentence
    fresh: np.ndarray  # whether the word is the first of a line
    between: np.ndarray  # the byte before the word if it alone parts it from the word before, else 0

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        folded = fold(data)
        starts, ends, doc = words(folded, offsets)
        hasher = Hasher(folded)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        first = data[starts]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        stops, feeds = np.concatenate([[0], np.cumsum(_ENDS[data])]), np.concatenate([[0], np.cumsum(data == 10)])
        opens, fresh, between = np.ones(len(starts), bool), np.ones(len(starts), bool), np.zeros(len(starts), np.uint8)
        fresh[1:] = (doc[1:] != doc[:-1]) | (feeds[starts[1:]] > feeds[ends[:-1]])
        opens[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
        between[1:] = np.where((doc[1:] == doc[:-1]) & (starts[1:] == ends[:-1] + 1), data[starts[1:] - 1], 0)
        return Words(hasher, starts, ends, doc, hasher.spans(starts, ends), digits[ends] - digits[starts] == ends - starts, capital, opens, fresh, between)

    def joined(self) -> Words:
        """Digits with , or . and capitalised words with one space between them as one word each."""
        on = np.zeros(len(self.start), bool)
        name = self.capital & ~self.number
        on[1:] = (self.number[1:] & self.number[:-1] & ((self.between[1:] == 44) | (self.between[1:] == 46))) | (name[1:] & name[:-1] & (self.between[1:] == 32))
        head = np.flatnonzero(~on)
        end = self.end[np.concatenate([head[1:], [len(on)]]) - 1] if len(on) else self.end
        return Words(self.hasher, self.start[head], end, self.doc[head], self.hasher.spans(self.start[head], end), self.number[head], self.capital[head], self.opens[head], self.fresh[head], self.between[head])

    def templates(self, everywhere: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(template hash, is a slot) of each word; with ``everywhere`` capitalised words that open a sentence are NAME, too."""
        after = np.zeros(len(self.start), bool)
        after[1:] = self.number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = after & np.isin(self.value, _UNITS)
        name = self.capital & (everywhere | ~self.opens) & ~self.number & ~unit
        template = self.value.copy()
        template[self.number], template[unit], template[name] = NUM, UNIT, NAME
        return template, self.number | unit | name


def _windows(lengths: list[int], wanted: np.ndarray | None, whole: bool):
    """Windows of the given lengths; of a benchmark (whole) those of its short items and of the longest length."""
    longest = max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, _ = buffers(batch.column("text"))
            ids, rows = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "row"))
            for lo, hi, data, own in slices(raw, offsets):
                plain = Words.of(data, own)
                joined = plain.joined()
                template, slot = plain.templates()
                for kind, w, t, s in ((TEMPLATE, plain, template, slot), (LITERAL, plain, plain.value, slot), (NAMES, joined, *joined.templates(True)), (WHOLE, plain, plain.value, slot)):
                    count = np.bincount(w.doc, minlength=hi - lo)
                    first = np.concatenate([[0], np.cumsum(count)])
                    slots = np.concatenate([[0], np.cumsum(s)])
                    for n in lengths:
                        if len(t) < n or (kind == WHOLE) != (n < MIN_WORDS):
                            continue
                        m = len(t) - n + 1
                        g = t[:m] + U(kind) * _SALT
                        for j in range(1, n):
                            g = mix(g * U(0x9E3779B97F4A7C15) + t[j : m + j])
                        ok = w.doc[:m] == w.doc[n - 1 :]
                        if kind == WHOLE and not whole:
                            ok &= w.fresh[:m] & np.append(w.fresh, True)[n : n + m]
                        if kind in (TEMPLATE, NAMES):
                            ok &= 2 * (slots[n : n + m] - slots[:m]) <= n
                        if whole and n < longest:
                            ok &= count[w.doc[:m]] == n
                        if wanted is not None:
                            bit = (g & U(_BITS - 1)).astype(np.int64)
                            ok &= ((wanted.value[bit >> 6] >> (bit & 63).astype(U)) & U(1)).astype(bool)
                        at = np.flatnonzero(ok)
                        if len(at):
                            held = [w.value[a : a + n][s[a : a + n]].view(np.int64) for a in at] if kind in (TEMPLATE, NAMES) else [np.zeros(0, np.int64)] * len(at)
                            ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[lo + w.doc[at]].astype(np.int64)), pa.array(rows[lo + w.doc[at]].astype(np.int64)), pa.array(np.full(len(at), kind, np.int32)), pa.array((at - first[w.doc[at]]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(g[at].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held)))],
                                ["id", "row", "kind", "pos", "length", "h", "slots"],
                            )

    return run


def _common(texts: DataFrame, asked: np.ndarray) -> np.ndarray:
    """Those of the word hashes ``asked`` (sorted) that ``texts`` have more often in lower case than capitalised within a sentence."""
    shared = texts.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            raw, offsets, _ = buffers(batch.column("text"))
            for _, _, data, own in slices(raw, offsets):
                w = Words.of(data, own)
                place = np.minimum(np.searchsorted(asked, w.value), len(asked) - 1)
                use = (asked[place] == w.value) & ~w.number & ~(w.capital & w.opens)
                total += np.bincount(place[use & ~w.capital], minlength=len(asked)) - np.bincount(place[use & w.capital], minlength=len(asked))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = texts.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).where("n > 0").collect()
    return asked[sorted(r["i"] for r in rows)]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_windows: int = MIN_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, coverage, changed): coverage of the item's windows of the kind that found it, and how many placeholders hold another value."""
    spark = docs.sparkSession
    texts = lambda df, i, t: df.select(F.col(i).cast("long").alias("id"), F.col(t).cast("string").alias("text")).where("id is not null and text is not null").select("id", F.xxhash64("id", "text").alias("row"), "text")
    own, theirs = texts(docs, id_col, text_col), texts(benchmark, item_col, item_text_col).distinct()
    items = theirs.mapInArrow(_windows(list(range(1, window + 1)), None, True), _SCHEMA)
    items = written(items, "leak-items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [window]
    bits = np.zeros(_BITS // 64, U)
    bit = F.col("h").bitwiseAND(_BITS - 1)
    for w, v in items.select(bit.alias("bit")).groupBy(F.expr("bit div 64")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")).collect():
        bits[w] = U(v & 0xFFFFFFFFFFFFFFFF)
    found = own.mapInArrow(_windows(lengths, spark.sparkContext.broadcast(bits), False), _SCHEMA)
    item = items.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "kind", F.col("pos").alias("item_pos"), "h", "length", F.col("slots").alias("item_slots"))
    hits = found.select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), "kind", "pos", "h", "length", "slots").join(item, ["kind", "h", "length"])
    hits = hits.withColumn("fill", F.expr("transform(arrays_zip(item_slots, slots), x -> struct(x.item_slots as i, x.slots as d))"))
    lined = hits.groupBy("doc_id", "item_id", "doc_row", "item_row", "kind", (F.col("pos") - F.col("item_pos")).alias("delta")).agg(F.countDistinct("item_pos", "length").alias("windows"), F.array_distinct(F.flatten(F.collect_set("fill"))).alias("fills"))
    lined = lined.where("size(fills) = size(array_distinct(fills.i)) and size(fills) = size(array_distinct(fills.d))")
    totals = items.groupBy(F.col("row").alias("item_row"), "kind").agg(F.countDistinct("pos", "length").alias("total"))
    lined = written(lined.join(totals, ["item_row", "kind"]).where(F.col("windows") >= F.least("total", F.lit(min_windows))), "leak-lined")
    # Of the slots that hold another value, those at the start of a sentence may be any word; only names may differ.
    other = F.expr("filter(fills, x -> x.i != x.d)")
    known = lined.where(F.col("kind") != NAMES).select("doc_id", "item_id").distinct()
    unsure = lined.where(F.col("kind") == NAMES).join(known, ["doc_id", "item_id"], "left_anti")
    asked = unsure.select(F.explode(F.expr("concat(transform(filter(fills, x -> x.i != x.d), x -> x.i), transform(filter(fills, x -> x.i != x.d), x -> x.d))")).alias("v")).distinct().toArrow()["v"].to_numpy().view(U)
    asked = np.setdiff1d(asked, _UNITS)
    if len(asked):
        common = _common(own.unionByName(theirs), asked)
        common = spark.createDataFrame(pa.table({"v": pa.array(common.view(np.int64))}))
        at = ["doc_row", "item_row", "kind", "delta"]
        bad = unsure.select(*at, F.explode(other).alias("f")).select(*at, F.explode(F.array("f.i", "f.d")).alias("v")).join(common, "v", "left_semi")
        lined = lined.join(bad.select(*at).distinct(), at, "left_anti")
    best = Window.partitionBy("doc_id", "item_id").orderBy("kind", F.desc("windows"), "delta", "doc_row", "item_row")
    out = lined.withColumn("r", F.row_number().over(best)).where("r = 1")
    return out.select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), F.round(F.col("windows") / F.col("total"), 6).alias("coverage"), F.expr("cast(size(filter(fills, x -> x.i != x.d)) as long)").alias("changed"))


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those in ``found``; rows with a null id stay."""
    (name,) = fresh(docs.columns, "gone")
    gone = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


def oracle(window: int = WINDOW, min_windows: int = MIN_WINDOWS, documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for leaks() with windows of one length; shorter items are none of the driver's."""
    w = "[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"
    s = "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]*"
    units = ", ".join(f"'{u}'" for u in UNITS)

    def side(name: str, source: str, key: str) -> str:
        over = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)"
        return f"""
{name}1 AS (SELECT DISTINCT {key} AS id, regexp_extract_all(text, '{s}{w}') AS t FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL),
{name}2 AS (SELECT id, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM {name}1),
{name}3 AS (SELECT id, pos, regexp_extract(t, '{w}$') AS v, pos = 1 OR regexp_matches(regexp_extract(t, '^{s}'), '[.!?:;\\n]') AS opens FROM {name}2),
{name}4 AS (SELECT *, regexp_full_match(v, '[0-9]+') AS num, coalesce(lag(regexp_full_match(v, '[0-9]+')) OVER (PARTITION BY id ORDER BY pos), false) AS after FROM {name}3),
{name}5 AS (SELECT id, pos, lower(v) AS v, CASE WHEN num THEN '<num>' WHEN after AND lower(v) IN ({units}) THEN '<unit>' WHEN NOT opens AND regexp_matches(v, '^[A-ZÀ-ÖØ-Þ]') THEN '<name>' ELSE lower(v) END AS x FROM {name}4),
{name}6 AS (SELECT id, pos, string_agg(x, ' ') {over} AS h, count(*) {over} AS n, list(CASE WHEN x LIKE '<%' THEN v END) {over} AS raw FROM {name}5),
{name} AS (SELECT id, pos, h, list_filter(raw, lambda z: z IS NOT NULL) AS slots FROM {name}6 WHERE n = {window} AND 2 * len(list_filter(raw, lambda z: z IS NOT NULL)) <= {window})"""

    return f"""
WITH {side("d", documents, "doc_id")}, {side("b", benchmark, "item_id")},
hits AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS delta, b.pos AS ipos, list_zip(b.slots, d.slots) AS fill FROM d JOIN b USING (h)),
lined AS (SELECT doc_id, item_id, delta, count(DISTINCT ipos) AS windows, list_distinct(flatten(list(fill))) AS fills FROM hits GROUP BY ALL),
ok AS (SELECT * FROM lined WHERE len(fills) = len(list_distinct(list_transform(fills, lambda f: f[1]))) AND len(fills) = len(list_distinct(list_transform(fills, lambda f: f[2])))),
total AS (SELECT id AS item_id, count(*) AS total FROM b GROUP BY id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY windows DESC, delta) AS r FROM ok JOIN total USING (item_id) WHERE windows >= least(total, {min_windows}))
SELECT doc_id, item_id, windows::BIGINT AS windows, round(windows / total, 6) AS coverage, len(list_filter(fills, lambda f: f[1] != f[2]))::BIGINT AS changed FROM best WHERE r = 1
"""
