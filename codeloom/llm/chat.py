"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

A log often holds a conversation again after each turn. Each conversation's turns
get rolling hashes of their prefixes; the set of proper prefix hashes is
distinct (hot ones are pre-aggregated), and an anti-join of the conversations'
last hashes against it leaves the maximal ones. Equal conversations are first
reduced to the smallest id, by the last hash. What stays is rendered.

Turns are ordered by turn, then role, then text. Null roles and texts count as
empty; rows with a null id form one conversation. Repeated rows are turns of
their own. Roles and texts that hold the marks of a turn have a blank put after
their '<', so that no text can pass for a turn. Extra columns are not read. An empty
table gives no row. A conversation's turns meet in one task, as they are one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
RUN = 256


def _prefix_hashes(turns: Column) -> Column:
    """The rolling SHA-256 after each turn; a turn adds its role and its text's hash. They are
    kept in two levels, RUN hashes in a list, so that lists are not copied for every turn."""
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<string>").alias("now"), F.array().cast("array<array<string>>").alias("full"))

    def step(acc: Column, t: Column) -> Column:
        h = F.sha2(F.concat(acc["h"], F.sha2(t["role"], 256), F.sha2(t["text"], 256)), 256)
        ended = F.size(acc["now"]) >= RUN
        now = F.when(ended, F.array(h)).otherwise(F.array_append(acc["now"], h))
        return F.struct(h.alias("h"), now.alias("now"), F.when(ended, F.array_append(acc["full"], acc["now"])).otherwise(acc["full"]).alias("full"))

    return F.aggregate(turns, start, step, lambda acc: F.flatten(F.array_append(acc["full"], acc["now"])))


def maximal_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns): conversations that are no proper prefix of another one, each once."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = df.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    hashed = whole.select("conv_id", _prefix_hashes(F.col("turns")).alias("hs"))
    last = hashed.select(F.element_at("hs", -1).alias("h"), "conv_id").groupBy("h").agg(F.min("conv_id").alias("keep"), F.count(F.lit(1)).alias("copies"), F.max(F.col("conv_id").isNull()).alias("_null"))
    proper = hashed.select(F.explode(F.slice("hs", 1, F.greatest(F.size("hs") - 1, F.lit(0)))).alias("h")).distinct()
    stay = last.join(proper, "h", "left_anti").select("keep", "copies")
    return whole.join(stay, F.col("conv_id").eqNullSafe(F.col("keep")), "inner").select("conv_id", "turns", "copies")


def render(turns: Column) -> Column:
    """ChatML text: a header with the role, the text, an end mark, for each turn."""
    plain = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("< " + OPEN[1:])), F.lit(CLOSE), F.lit("< " + CLOSE[1:]))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(CLOSE + "\n"))), "")


def format_chats(df: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, copies, text) of the maximal conversations."""
    return maximal_conversations(df).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", render(F.col("turns")).alias("text"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, list({'t': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, ts, list_transform(ts, lambda x: {'role': x.role, 'text': x.text}) AS body FROM c),
u AS (SELECT body, min(conv_id) AS keep, count(*) AS copies FROM k GROUP BY body),
pre AS (SELECT DISTINCT body[1:n] AS body FROM (SELECT body, unnest(range(1, len(body))) AS n FROM k))
SELECT k.conv_id, len(k.ts)::BIGINT AS n_turns, u.copies, array_to_string(list_transform(k.body, lambda x: '<|im_start|>' || replace(replace(x.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10) || replace(replace(x.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10)), '') AS text
FROM u JOIN k ON k.conv_id IS NOT DISTINCT FROM u.keep WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.body = u.body)
"""
