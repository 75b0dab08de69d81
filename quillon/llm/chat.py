r"""Operator 7, chat formatting: relational, Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn number, role and text;
adjacent turns of one role are merged (texts joined by a line feed), and the merged turns are
written as ``<|role|>``, a line feed, the text, ``<|end|>`` and a line feed. Delimiters inside a role or text
are escaped, so that no turn can forge another: ``<|`` becomes ``<\|``, and ``<``, n backslashes and ``|`` become
the same with n + 1 of them (in roles ``|>`` likewise); taking one backslash away gives back what was there.

Defined results: a null turn number sorts last; a null or empty role is "unknown"; a null text is
empty; a null conversation id is a conversation of its own; repeated rows are repeated turns (and so
merged). Every step is linear in the number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, messages, text): turns as found, messages after merging."""
    open_ = lambda x: F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")
    role = F.coalesce(F.nullif(F.col(role_col).cast("string"), F.lit("")), F.lit("unknown"))
    role = F.regexp_replace(open_(role), r"\|(\\*)>", r"|\\$1>")
    turn = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), role.alias("role"), open_(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    found = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = found.withColumn("starts", F.expr("filter(sequence(0, size(ts) - 1), i -> i = 0 OR ts[greatest(i - 1, 0)].role != ts[i].role)"))
    merged = starts.withColumn("ms", F.expr("""transform(starts, (s, k) -> named_struct('role', ts[s].role, 'text',
        array_join(transform(slice(ts, s + 1, coalesce(get(starts, k + 1), size(ts)) - s), t -> t.text), '\n')))"""))
    return merged.select("conv_id", F.size("ts").cast("long").alias("turns"), F.size("ms").cast("long").alias("messages"), F.expr(r"array_join(transform(ms, m -> concat('<|', m.role, '|>\n', m.text, '<|end|>\n')), '')").alias("text"))


ORACLE = r"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i FROM (
    SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(nullif(role, ''), 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS role,
      regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations)
), b AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY i) = role THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM b),
m AS (SELECT conv_id, m, any_value(role) AS role, string_agg(text, chr(10) ORDER BY i) AS text, count(*) AS n FROM g GROUP BY conv_id, m)
SELECT conv_id, sum(n)::BIGINT AS turns, count(*)::BIGINT AS messages, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY m) AS text FROM m GROUP BY conv_id
"""
