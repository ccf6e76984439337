"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text's counts are higher-order functions over its words. The thresholds
come from mergeable quantile sketches for each (language, source): log-linear
histograms (64 steps for each doubling, so a quantile is off by 1/64 at most)
that are sums of counts, so that partial ones from any tasks add up, and those
of groups under ``min_docs`` documents are merged into their language's, and then into
the corpus's. A document's ratios must lie within fences ``k`` spreads beyond a high
quantile of its group, the spread being that quantile less the median; word length has
a fence below as well. Nothing is fixed in the ratios' own units. Which quantile is a
rule's parameter (QUANTILES): characters that are no words and word lengths go by the
tenth of a group's documents that is most unusual, repetition, of which texts such as
lists rightly have some, by the hundredth. A value in the same step of the sketch as
the quantile is never beyond it. The thresholds are joined to the documents.

Null and empty texts have no words and fail the base rules. Null languages and
sources are groups of their own. Repeated rows count each. Words, windows and lines are
compared as they are, in texts of any length. Extra columns are not read. An empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._util import checkpointed

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: metric -> (the quantile in percent from which its high fence goes up, whether it has a low fence at the other end)
QUANTILES = {"word_len": (90, True), "symbols": (90, False), "dup_lines": (99, False), "repeats": (99, False)}
METRICS = list(QUANTILES)


def _window_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _repeated_starts(w: Column, sorted_windows: Column, bits: Column) -> Column:
    """Places of 3-word windows that are found twice or more. ``sorted_windows`` are numbers of
    a window's hash, and its place in the lowest ``bits``: windows of one hash are neighbours.
    If any two neighbours of one hash differ, the windows' words are sorted themselves."""
    s = sorted_windows
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    head = lambda x: F.call_function("shiftright", x, bits)
    like = lambda x, y: F.coalesce(head(x) == head(y), F.lit(False))
    differ = lambda x, y: F.coalesce(~((F.get(w, place(x)) == F.get(w, place(y))) & (F.get(w, place(x) + 1) == F.get(w, place(y) + 1)) & (F.get(w, place(x) + 2) == F.get(w, place(y) + 2))), F.lit(False))
    clash = F.exists(F.sequence(F.lit(0), F.size(s) - 1), lambda i: like(F.get(s, i), F.get(s, i + 1)) & differ(F.get(s, i), F.get(s, i + 1)))
    again = F.filter(s, lambda x, i: like(x, F.get(s, i - 1)) | like(x, F.get(s, i + 1)))
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
    equal = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))
    exact = F.transform(F.array(windows), lambda ws: F.filter(ws, lambda x, i: equal(x, F.get(ws, i - 1)) | equal(x, F.get(ws, i + 1))))[0]  # sorted once
    return F.when(F.size(s) == 0, F.array().cast("array<int>")).when(clash, F.array_sort(F.transform(exact, lambda x: x["i"]))).otherwise(F.array_sort(F.transform(again, place)))


def _covered(starts: Column) -> Column:
    """Words in 3-word windows that start at the sorted ``starts``."""
    n = F.size(starts)
    gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda k: F.least(F.lit(3), F.get(starts, k + 1) - F.get(starts, k)))
    return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(3)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, b: a + b)).cast("long")


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and drops the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANK_CHARS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    rest = [c for c in df.columns if c != text_col]
    a = df.select(
        *rest,
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.filter(F.split(text, BLANKS, -1), lambda x: x != "").alias("_w"),
    )
    n = F.size("_w")
    w = F.col("_w")
    bits = F.length(F.bin(n))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", _window_hash(w, i), bits).bitwiseOR(i.cast("long")))
    b = a.select(
        *rest, "word_chars", "n_symbols", w, n.cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), bits.alias("_bits"),
        F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("_s"),
    )
    c = b.select(*rest, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _repeated_starts(w, F.col("_s"), F.col("_bits")).alias("_starts"))
    return c.select(*rest, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _covered(F.col("_starts")).alias("n_repeat_words"))


def with_ratios(df: DataFrame) -> DataFrame:
    div = lambda num, den, scale: F.expr(f"CASE WHEN {den} > 0 THEN ({scale} * {num}) DIV {den} ELSE 0L END")
    return df.withColumns({"word_len": div("word_chars", "n_words", 100), "symbols": div("n_symbols", "word_chars", 1000), "dup_lines": div("n_dup_lines", "n_lines", 1000), "repeats": div("n_repeat_words", "n_words", 1000)})


def sketch(df: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, metric, bucket, n) of the ratios; sketches merge by adding n."""
    long = df.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])))
    return long.groupBy("lang", "source", "metric", F.expr("shiftleft(shiftright(x, greatest(length(bin(x)) - 7, 0)), greatest(length(bin(x)) - 7, 0))").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketches: DataFrame, k: int = 3, min_docs: int = 50) -> DataFrame:
    """(lang, source) -> low and high fence of each metric. Groups under ``min_docs``
    documents take their language's merged sketch, languages under it the corpus's."""
    none = F.lit(None).cast("string")
    level = lambda i, lang, source: F.struct(F.lit(i).alias("level"), lang.alias("l"), source.alias("s"))
    levels = F.explode(F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none)))
    merged = sketches.withColumn("g", levels).groupBy("g.level", "g.l", "g.s", "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "l", "s", "metric")
    ranked = merged.withColumns({"up_to": F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(group)})
    at = lambda pct: F.min(F.when(F.col("up_to") * 100 >= F.col("all") * pct, F.col("bucket")))
    pct, two = F.lit(None), F.lit(False)
    for m, (p, low) in QUANTILES.items():
        pct, two = F.when(F.col("metric") == m, F.lit(p)).otherwise(pct), F.when(F.col("metric") == m, F.lit(low)).otherwise(two)
    found = ranked.withColumns({"pct": pct, "two": two}).groupBy("level", "l", "s", "metric", "two").agg(F.max("all").alias("docs"), at(100 - F.col("pct")).alias("ql"), at(F.lit(50)).alias("q50"), at(F.col("pct")).alias("qh"))
    top = F.expr("qh + shiftleft(1L, greatest(length(bin(qh)) - 7, 0)) - 1")  # the largest value of the quantile's step
    fences = found.select("level", "l", "s", "metric", "docs", F.when(F.col("two"), F.col("ql") - k * (F.col("q50") - F.col("ql"))).otherwise(F.lit(-1)).alias("low"), (top + k * (top - F.col("q50"))).alias("high"))
    wide = checkpointed(fences.groupBy("level", "l", "s").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")]))  # three levels are taken from it
    cols = [f"{m}_{side}" for m in METRICS for side in ("low", "high")]
    own, lang, whole = (wide.filter(F.col("level") == i) for i in range(3))
    lang = lang.select(F.col("l").alias("ll"), F.col("docs").alias("lang_docs"), *[F.col(c).alias(f"l_{c}") for c in cols])
    whole = whole.select(F.lit(1).alias("one"), *[F.col(c).alias(f"w_{c}") for c in cols])
    joined = own.join(lang, F.col("l").eqNullSafe(F.col("ll")), "left").withColumn("one", F.lit(1)).join(whole, "one", "left")
    return joined.select(F.col("l").alias("t_lang"), F.col("s").alias("t_source"), *[F.when(F.col("docs") >= min_docs, F.col(c)).when(F.col("lang_docs") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}")).alias(c) for c in cols])


def quality_rules(df: DataFrame, k: int = 3, min_docs: int = 50, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, counts, base_failed, kept) for ``df`` with columns id, text, lang, source."""
    rows = df.select(F.col(id_col), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = with_ratios(text_counts(rows))
    counted = checkpointed(counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    fences = thresholds(sketch(counted.filter(~F.col("base_failed"))), k, min_docs)
    joined = counted.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    return joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM p) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
c AS (SELECT d.rid, d.doc_id, d.lang, d.source, len(w.w)::BIGINT AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(w.ls)::BIGINT AS n_lines,
  (len(w.ls) - len(list_distinct(w.ls)))::BIGINT AS n_dup_lines, coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
m AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  CASE WHEN n_words > 0 THEN (100 * word_chars) // n_words ELSE 0 END AS word_len, CASE WHEN word_chars > 0 THEN (1000 * n_symbols) // word_chars ELSE 0 END AS symbols,
  CASE WHEN n_lines > 0 THEN (1000 * n_dup_lines) // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN (1000 * n_repeat_words) // n_words ELSE 0 END AS repeats FROM c),
x AS (SELECT lang, source, unnest(['word_len', 'symbols', 'dup_lines', 'repeats']) AS metric, unnest([word_len, symbols, dup_lines, repeats]) AS x FROM m WHERE NOT base_failed),
s AS (SELECT lang, source, metric, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) AS bucket, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT 0 AS level, lang AS l, source AS s, metric, bucket, n FROM s UNION ALL SELECT 1, lang, NULL, metric, bucket, n FROM s UNION ALL SELECT 2, NULL, NULL, metric, bucket, n FROM s),
h AS (SELECT level, l, s, metric, bucket, sum(n) AS n FROM g GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS up_to, sum(n) OVER (PARTITION BY level, l, s, metric) AS total FROM h),
q AS (SELECT level, l, s, metric, max(total) AS docs, min(bucket) FILTER (up_to * 100 >= total * CASE WHEN metric IN ('word_len', 'symbols') THEN 10 ELSE 1 END) AS ql, min(bucket) FILTER (up_to * 100 >= total * 50) AS q50,
  min(bucket) FILTER (up_to * 100 >= total * CASE WHEN metric IN ('word_len', 'symbols') THEN 90 ELSE 99 END) AS qh FROM k GROUP BY ALL),
f AS (SELECT *, qh + (1 << greatest(length(bin(qh)) - 7, 0)) - 1 AS top FROM q),
b AS (SELECT level, l, s, metric, docs, CASE WHEN metric = 'word_len' THEN ql - 3 * (q50 - ql) ELSE -1 END AS low, top + 3 * (top - q50) AS high FROM f),
e AS (SELECT o.l AS tl, o.s AS ts, o.metric, CASE WHEN o.docs >= 50 THEN o.low WHEN la.docs >= 50 THEN la.low ELSE wh.low END AS low, CASE WHEN o.docs >= 50 THEN o.high WHEN la.docs >= 50 THEN la.high ELSE wh.high END AS high
  FROM b o LEFT JOIN b la ON la.level = 1 AND la.metric = o.metric AND la.l IS NOT DISTINCT FROM o.l LEFT JOIN b wh ON wh.level = 2 AND wh.metric = o.metric WHERE o.level = 0),
v AS (SELECT m.rid, bool_and(CASE e.metric WHEN 'word_len' THEN word_len WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines ELSE repeats END BETWEEN e.low AND e.high) AS inside
  FROM m JOIN e ON m.lang IS NOT DISTINCT FROM e.tl AND m.source IS NOT DISTINCT FROM e.ts GROUP BY m.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(v.inside, TRUE)) AS kept FROM m LEFT JOIN v USING (rid)
"""
