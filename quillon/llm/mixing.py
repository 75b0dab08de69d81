"""Operator 2, mixing sources to target weights: temperature mixing and budgeted block permutations.

A source's weight is proportional to its token share raised to an exponent in [0, 1] (0: uniform,
1: as found). The exponent is bisected inside the plan, either for a target entropy (a share of the
largest possible) or as the smallest one for which no source is repeated more than ``max_repeats``
times. A source's quota is its weight times the token budget. It is filled by epochs: every epoch is
a permutation of the source made of two levels, blocks in a random order and documents in a random
order within a block, so no task ever sorts a whole source. The last epoch is cut where the quota
is used up. ``mix_block`` deals the stream of every source out over the blocks of the mixture, in
proportion to its quota, so each block holds all sources at their weights.

Tokens are runs of characters other than space, tab, line feed, carriage return and form feed.
Defined results: rows without tokens (null or empty text) are not drawn; a null source is a source
of its own, "(none)"; a null id is drawn as a null id; repeated rows count each; ties in the hash
order fall back on id and tokens; an empty table gives an empty result. A target that no exponent reaches (a
budget of more than ``max_repeats`` times the corpus, or a share of entropy outside [0, 1]) is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.scratch import written

SEED = 11
BLOCK_TOKENS = 250_000
MIX_BLOCK_TOKENS = 500_000
STEPS = 50
#: Blocks of a source that one task sorts, about.
PART_BLOCKS = 4096


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of the rows that have tokens."""
    tokens = F.regexp_count(F.col(text_col), F.lit("[^ \t\n\r\f]+")).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")).alias("source"), tokens.alias("tokens")).where("tokens > 0")


def weights(totals: DataFrame, budget_ratio: float = 1.0, max_repeats: float | None = 1.25, entropy: float | None = None, steps: int = STEPS) -> DataFrame:
    """(source, total, weight, quota) from (source, total); one row per source, all of it in the plan."""
    if entropy is None and (max_repeats is None or budget_ratio > max_repeats):
        raise ValueError(f"a budget of {budget_ratio} times the corpus repeats some source more than {max_repeats} times, whatever the exponent")
    if entropy is not None and not 0 <= entropy <= 1:
        raise ValueError("the target entropy is a share of the largest possible, from 0 to 1")
    all_of = totals.agg(F.sum("total").alias("t"), F.collect_list(F.struct("source", "total")).alias("s")).where("t > 0")
    power = "aggregate(s, 0d, (a, x) -> a + power(x.total / t, {e}))"
    mid = "((b.lo + b.hi) / 2)"
    if entropy is not None:
        # The entropy falls as the exponent grows: keep the largest exponent that still reaches the target.
        z = power.format(e=mid)
        h = f"aggregate(s, 0d, (a, x) -> a - power(x.total / t, {mid}) / {z} * ln(power(x.total / t, {mid}) / {z}))"
        test = f"{h} >= {entropy}d * ln(size(s))"
        up, down = f"named_struct('lo', {mid}, 'hi', b.hi)", f"named_struct('lo', b.lo, 'hi', {mid})"
        end = "lo"
    else:
        # The repetition of a small source falls as the exponent grows: take the smallest one within the limit.
        z = power.format(e=mid)
        test = f"aggregate(s, 0d, (a, x) -> greatest(a, power(x.total / t, {mid}) / {z} * t * {budget_ratio}d / x.total)) <= {max_repeats}d"
        up, down = f"named_struct('lo', b.lo, 'hi', {mid})", f"named_struct('lo', {mid}, 'hi', b.hi)"
        end = "hi"
    at_zero = "named_struct('lo', 0d, 'hi', 0d)" if entropy is None else "named_struct('lo', 1d, 'hi', 1d)"
    edge = "0d" if entropy is None else "1d"
    z_edge = power.format(e=edge)
    if entropy is None:
        edge_ok = f"aggregate(s, 0d, (a, x) -> greatest(a, power(x.total / t, {edge}) / {z_edge} * t * {budget_ratio}d / x.total)) <= {max_repeats}d"
    else:
        edge_ok = f"aggregate(s, 0d, (a, x) -> a - power(x.total / t, {edge}) / {z_edge} * ln(power(x.total / t, {edge}) / {z_edge})) >= {entropy}d * ln(size(s))"
    found = all_of.withColumn("b", F.expr(f"CASE WHEN {edge_ok} THEN {at_zero} ELSE aggregate(sequence(1, {steps}), named_struct('lo', 0d, 'hi', 1d), (b, i) -> CASE WHEN {test} THEN {up} ELSE {down} END) END"))
    found = found.select("t", "s", F.col(f"b.{end}").alias("e")).withColumn("z", F.expr(power.format(e="e")))
    rows = found.select("t", "e", "z", F.explode("s").alias("x")).select(F.col("x.source").alias("source"), F.col("x.total").alias("total"), F.expr("round(power(x.total / t, e) / z, 9)").alias("weight"), F.expr(f"cast(floor(t * {budget_ratio}d) as long)").alias("budget"))
    return rows.withColumn("quota", F.floor(F.col("weight") * F.col("budget")).cast("long"))


def mix(docs: DataFrame, budget_ratio: float = 1.0, max_repeats: float | None = 1.25, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, mix_block_tokens: int = MIX_BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, epoch, block, mix_block, tokens, start): what to read, in which block of the mixture;
    ``start`` is the number of tokens of the source drawn before."""
    counted = written(token_counts(docs, id_col, text_col, source_col), "mix-tokens")
    w = written(weights(counted.groupBy("source").agg(F.sum("tokens").alias("total")), budget_ratio, max_repeats, entropy), "mix-weights")
    w = w.withColumn("blocks", F.expr(f"cast(ceil(total / {block_tokens}d) as long)")).withColumn("n_mix", F.expr(f"cast(ceil(budget / {mix_block_tokens}d) as long)"))
    number = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = counted.join(w.select("source", "blocks"), "source").withColumn("block", F.pmod(number(F.concat(F.lit(f"{seed}/b/"), doc)), F.col("blocks")))
    # Blocks of every epoch in their random order, with the tokens that lie before each.
    sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    epochs = sizes.join(w.select("source", "total", "quota", "n_mix", "blocks"), "source").where("quota > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, quota div total)")))
    epochs = epochs.withColumn("bk", F.md5(F.concat_ws("/", F.lit(str(seed)), "epoch", "source", "block")))
    # A prefix sum in two levels, so that no task sorts all blocks of a source: over ranges of the order, then within each.
    epochs = epochs.withColumn("part", F.shiftright(F.conv(F.substring("bk", 1, 8), 16, 10).cast("long") * F.expr(f"(blocks + {PART_BLOCKS - 1}) div {PART_BLOCKS}"), 32))
    parts = epochs.groupBy("source", "epoch", "part").agg(F.sum("size").alias("in_part"))
    parts = parts.select("source", "epoch", "part", (F.sum("in_part").over(Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part")).alias("ahead"))
    order = Window.partitionBy("source", "epoch", "part").orderBy("bk", "block").rowsBetween(Window.unboundedPreceding, 0)
    epochs = epochs.join(parts, ["source", "epoch", "part"]).withColumn("before", F.col("epoch") * F.col("total") + F.col("ahead") + F.sum("size").over(order) - F.col("size"))
    epochs = epochs.where("before < quota").select("source", "block", "epoch", "before", "quota", "n_mix")
    drawn = placed.join(epochs, ["source", "block"]).withColumn("dk", F.md5(F.concat(F.lit(f"{seed}/"), F.col("epoch").cast("string"), F.lit("/d/"), doc)))
    inner = Window.partitionBy("source", "block", "epoch").orderBy("dk", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("start", F.col("before") + F.sum("tokens").over(inner) - F.col("tokens")).where("start + tokens <= quota")
    return drawn.select("doc_id", "source", "epoch", "block", F.expr("start * n_mix div quota").alias("mix_block"), "tokens", "start")


def oracle(budget_ratio: float = 1.0, max_repeats: float | None = 1.25, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, mix_block_tokens: int = MIX_BLOCK_TOKENS, seed: int = SEED, steps: int = STEPS, documents: str = "documents") -> str:
    """DuckDB SQL for mix()."""
    z = "list_sum(list_transform(s, lambda x: power(x.total / t, {e})))"
    rep = "list_max(list_transform(s, lambda x: power(x.total / t, {e}) / " + z + f" * t * {budget_ratio} / x.total)) <= {max_repeats}"
    rep = rep.replace(z, "list_sum(list_transform(s, lambda y: power(y.total / t, {e})))")
    mid, up, down, edge, end = "((b.lo + b.hi) / 2)", "{'lo': b.lo, 'hi': MID}", "{'lo': MID, 'hi': b.hi}", 0, "hi"
    if entropy is not None:
        share = "(power(x.total / t, {e}) / " + z.replace("x", "y") + ")"
        rep = "list_sum(list_transform(s, lambda x: -" + share + " * ln(" + share + f"))) >= {entropy} * ln(len(s))"
        up, down, edge, end = down, up, 1, "lo"
    up, down = up.replace("MID", mid), down.replace("MID", mid)
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::BIGINT AS tokens FROM {documents}
), c AS (SELECT * FROM counted WHERE tokens > 0),
a AS (SELECT sum(total)::DOUBLE AS t, list({{'source': source, 'total': total::DOUBLE}}) AS s FROM (SELECT source, sum(tokens)::BIGINT AS total FROM c GROUP BY source)),
steps AS (
  SELECT 0 AS i, t, s, CASE WHEN {rep.format(e=edge)} THEN {{'lo': {edge}::DOUBLE, 'hi': {edge}::DOUBLE}} ELSE {{'lo': 0::DOUBLE, 'hi': 1::DOUBLE}} END AS b FROM a WHERE t > 0
  UNION ALL
  SELECT i + 1, t, s, CASE WHEN b.lo = b.hi THEN b WHEN {rep.format(e=mid)} THEN {up} ELSE {down} END FROM steps WHERE i < {steps}
), f AS (SELECT t, s, b.{end} AS e, {z.format(e=f'b.{end}')} AS z FROM steps WHERE i = {steps}),
x AS (SELECT t, e, z, unnest(s) AS x FROM f),
w AS (
  SELECT x.source AS source, x.total::BIGINT AS total, floor(round(power(x.total / t, e) / z, 9) * floor(t * {budget_ratio}))::BIGINT AS quota,
    ceil(x.total / {block_tokens})::BIGINT AS blocks, ceil(floor(t * {budget_ratio}) / {mix_block_tokens})::BIGINT AS n_mix FROM x
), placed AS (
  SELECT c.*, w.total, w.quota, w.n_mix, ('0x' || substr(md5('{seed}/b/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % w.blocks AS block FROM c JOIN w USING (source)
), sizes AS (SELECT source, block, sum(tokens)::BIGINT AS size, any_value(total) AS total, any_value(quota) AS quota FROM placed GROUP BY ALL),
epochs AS (SELECT *, unnest(range(0, quota // total + 1)) AS epoch FROM sizes WHERE quota > 0),
before AS (
  SELECT source, block, epoch, epoch * total + sum(size) OVER (PARTITION BY source, epoch ORDER BY md5('{seed}/' || epoch || '/' || source || '/' || block), block ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM epochs
), drawn AS (
  SELECT p.*, e.epoch, e.before + sum(tokens) OVER (PARTITION BY source, block, epoch ORDER BY md5('{seed}/' || e.epoch || '/d/' || coalesce(doc_id::VARCHAR, '')), doc_id, tokens ROWS UNBOUNDED PRECEDING)::BIGINT - tokens AS start
  FROM placed p JOIN before e USING (source, block) WHERE e.before < p.quota
)
SELECT doc_id, source, epoch::BIGINT AS epoch, block::BIGINT AS block, (start * n_mix // quota)::BIGINT AS mix_block, tokens, start FROM drawn WHERE start + tokens <= quota
"""
