"""Operator 1, URL filters: a trie over reversed host labels and path segments.

A URL is the sequence of its host labels from the top level down, then "/", then its path segments;
scheme, user, port, query and fragment don't count, hosts are compared in lower case. An entry such
as ``example.com`` covers the host and all hosts below it, one such as ``example.com/en`` that path
of exactly that host. Of all entries that are prefixes of a URL the longest decides; where an entry
is listed for both, block wins. URLs that no entry covers have the verdict "none" and are kept.

The trie is broadcast while there are at most ``max_entries`` entries; a longer list is joined by
the prefixes of each distinct URL instead, with equal results.

Defined results: a null or unparsable URL (no host) has verdict "none" and a null host; repeated
entries and rows do no harm; null entries and those without a host are ignored; empty labels (two dots in a row)
are labels like others; extra columns don't count and are not returned.
"""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 1_000_000
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)"
_REST = r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)(?::[0-9]*)?([^?#]*)"
_SQL_URL = _SCHEME + _REST
_URL, _ENTRY = re.compile(_SQL_URL), re.compile(f"(?:{_SCHEME}|^//|^){_REST}")


def key(url: str | None, entry: bool = False) -> tuple[str, ...]:
    """The labels, then "/" and the segments; empty if there is no host. An entry needs no scheme."""
    m = (_ENTRY if entry else _URL).match((url or "").strip(" "))
    if not m or not m.group(1).strip("."):
        return ()
    host = m.group(1).lower().rstrip(".")
    labels = [host] if host.startswith("[") or re.fullmatch(r"[0-9.]+", host) else host.split(".")[::-1]
    segments = [s for s in m.group(2).split("/") if s]
    return (*labels, "/", *segments) if segments or not entry else tuple(labels)


def build(entries: list[tuple[str, str]]) -> dict:
    """A trie of (action, entry). A node's None holds its verdict: labels may be empty texts, but not None."""
    root: dict = {}
    for action, entry in entries:
        k = key(entry, True)
        if not k or action not in ("allow", "block"):
            continue
        node = root
        for part in k:
            node = node.setdefault(part, {})
        held = node.get(None)
        if held is None or (action != "block", entry) < (held[0] != "block", held[1]):
            node[None] = (action, entry)
    return root


def look_up(root: dict, k: tuple[str, ...]) -> tuple[str, str | None]:
    node, found = root, ("none", None)
    for part in k:
        node = node.get(part)
        if node is None:
            break
        found = node.get(None, found)
    return found


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(page_id, url, verdict, entry, keep) of every row; rules has (action, entry)."""
    rules = rules.select("action", "entry").where("action in ('allow', 'block') and entry is not null").distinct()
    listed = rules.limit(max_entries + 1).collect()
    if len(listed) > max_entries:
        return _joined(pages, rules, id_col, url_col)
    trie = pages.sparkSession.sparkContext.broadcast(pickle.dumps(build([tuple(r) for r in listed])))
    cache: list[dict] = []

    @F.arrow_udf("verdict string, entry string")
    def decide(urls: pa.Array) -> pa.Array:
        if not cache:
            cache.append(pickle.loads(trie.value))
        found = [look_up(cache[0], key(u)) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["verdict", "entry"])

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), decide(F.col(url_col)).alias("v"))
    return out.select("page_id", "url", "v.verdict", "v.entry", (F.col("v.verdict") != "block").alias("keep"))


def _prefix_keys(k: tuple[str, ...]) -> list[str]:
    """A text for each prefix; parts carry their length, so no two sequences have the same text."""
    out, text = [], ""
    for part in k:
        text += f"{len(part)}:{part}"
        out.append(text)
    return out


def _joined(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str) -> DataFrame:
    @F.arrow_udf("array<string>")
    def prefixes(urls: pa.Array) -> pa.Array:
        return pa.array([_prefix_keys(key(u)) for u in urls.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def entry_key(entries: pa.Array) -> pa.Array:
        return pa.array([(_prefix_keys(key(e, True)) or [""])[-1] for e in entries.to_pylist()], pa.string())

    best = F.min(F.struct((F.col("action") != "block").alias("o"), "entry", "action")).alias("b")
    keyed = rules.select("action", "entry", entry_key("entry").alias("k")).where("k != ''").groupBy("k").agg(best).select("k", "b.action", "b.entry")
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    hits = urls.select("url", F.posexplode(prefixes("url")).alias("depth", "k")).join(keyed, "k").groupBy("url").agg(F.max(F.struct("depth", "action", "entry")).alias("m"))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).join(hits, "url", "left")
    verdict = F.coalesce("m.action", F.lit("none"))
    return out.select("page_id", "url", verdict.alias("verdict"), F.col("m.entry").alias("entry"), (verdict != "block").alias("keep"))


#: The list that the registered query applies.
RULES = [
    ("block", "spam-farm.example.org"), ("block", "cheap-pills.example.com"), ("allow", "www.cheap-pills.example.com/en"), ("block", "blog.example.net"),
    ("block", "therea.example.net"), ("allow", "blog.therea.example.net"), ("block", "example.org/en/1"), ("block", "m.therou.example.com/en"), ("allow", "m.therou.example.com/en/474.html"),
    ("block", "theres.example.com"), ("allow", "blog.theres.example.com/de"), ("block", "blog.theres.example.com"), ("allow", "example.com"), ("block", "www.therti.example.org/en"),
]

_K = "array_to_string(list_reverse(string_split(rtrim(lower({h}), '.'), '.')), '.') || '.'"
ORACLE = f"""
WITH r(action, entry) AS (VALUES {", ".join(f"('{a}', '{e}')" for a, e in RULES)}),
rk AS (SELECT action, entry, {_K.format(h="split_part(entry, '/', 1)")} || CASE WHEN contains(entry, '/') THEN '/' || substr(entry, strpos(entry, '/') + 1) || '/' ELSE '' END AS k FROM r),
u AS (SELECT page_id, url, regexp_extract(url, '{_SQL_URL}', 1) AS h, regexp_extract(url, '{_SQL_URL}', 2) AS p FROM pages),
uk AS (SELECT page_id, url, CASE WHEN rtrim(h, '.') = '' THEN '' ELSE {_K.format(h="h")} || '/' || array_to_string(list_filter(string_split(p, '/'), lambda s: s != ''), '/') || '/' END AS k FROM u),
m AS (SELECT uk.page_id, arg_max(rk.action, length(rk.k)) AS action, arg_max(rk.entry, length(rk.k)) AS entry FROM uk JOIN rk ON starts_with(uk.k, rk.k) GROUP BY uk.page_id)
SELECT page_id, url, coalesce(action, 'none') AS verdict, entry, coalesce(action, 'none') != 'block' AS keep FROM uk LEFT JOIN m USING (page_id)
"""
