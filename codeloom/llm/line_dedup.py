"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``ratio_pct`` percent of the host's
pages contain it, and ``min_pages`` pages at least. Counting is one partial
aggregation over distinct (page, line); each count meets its host's total under
a salt of the line, so that a large host's lines are dealt. The boilerplate lines
found are written once and their bytes counted: up to BROADCAST_BYTES they are sent
to the pages, which then stay where they are; beyond that they are joined to them
under a salt of the page, so that a large host's pages are dealt too.

Lines are compared without surrounding blanks; blank lines are never dropped.
Null texts have no lines, and stay null; null hosts are a host of their own.
Repeated rows are pages of their own. Other columns are carried as they are; the
names that this module adds begin with ``_ld_``, and a column of such a name is
an error. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._util import checkpointed

BROADCAST_BYTES = 8 << 20
SALTS = 32
BLANKS = " \t\r"


NO_TEXT = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Text between tags, a line for each stretch. Scripts, styles and comments are no text;
    a tag ends at the first '>', and entities stay as they are written."""
    return F.regexp_replace(F.regexp_replace(html, NO_TEXT, "\n"), "<[^>]*>", "\n")


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _salt(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("_ld_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _lines(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), _key), lambda x: x != ""))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio_pct: int, min_pages: int) -> DataFrame:
    """(_ld_host, _ld_line): each host's boilerplate lines."""
    pages = df.select(host.alias("_ld_host"), text.alias("_ld_text"))
    totals = pages.groupBy("_ld_host").agg(F.count(F.lit(1)).alias("_ld_total")).withColumnRenamed("_ld_host", "_ld_of")
    counts = pages.select("_ld_host", F.explode(_lines(F.col("_ld_text"))).alias("_ld_line")).groupBy("_ld_host", "_ld_line").agg(F.count(F.lit(1)).alias("_ld_n")).filter(F.col("_ld_n") >= min_pages)
    met = counts.withColumn("_ld_salt", _salt(F.col("_ld_line"))).join(_salted(totals), F.col("_ld_host").eqNullSafe(F.col("_ld_of")) & (F.col("_ld_salt") == F.col("_ld_salt_of")))
    return met.filter(F.col("_ld_n") * 100 > F.col("_ld_total") * ratio_pct).select("_ld_host", "_ld_line")


def drop_boilerplate(df: DataFrame, host: Column, text_col: str = "text", ratio_pct: int = 20, min_pages: int = 5, text: Column | None = None) -> DataFrame:
    """``df`` with the kept lines as ``text_col``, and _ld_lines and _ld_removed (counts of non-blank lines)."""
    clash = [c for c in df.columns if c.startswith("_ld_")]
    if clash:
        raise ValueError(f"columns named as this module's own: {clash}")
    text = F.col(text_col) if text is None else text
    lines = checkpointed(boilerplate(df, host, text, ratio_pct, min_pages))
    size = lines.agg(F.sum(F.octet_length("_ld_line") + F.coalesce(F.octet_length(F.col("_ld_host").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    bad = lines.groupBy(F.col("_ld_host").alias("_ld_of")).agg(F.collect_list("_ld_line").alias("_ld_bad"))
    lined = df.withColumns({"_ld_host": host, "_ld_all": F.split(text, "\n", -1)})
    same = F.col("_ld_host").eqNullSafe(F.col("_ld_of"))
    if size <= BROADCAST_BYTES:
        joined = lined.join(F.broadcast(bad), same, "left")
    else:
        joined = lined.withColumn("_ld_salt", _salt(text)).join(_salted(bad), same & (F.col("_ld_salt") == F.col("_ld_salt_of")), "left")
    found = F.array_intersect(F.transform("_ld_all", _key), "_ld_bad")  # by a hash set; few are left to be looked through for each line
    kept = F.when(F.col("_ld_found").isNull() | (F.size("_ld_found") == 0), F.col("_ld_all")).otherwise(F.filter("_ld_all", lambda x: ~F.array_contains(F.col("_ld_found"), _key(x))))
    full = lambda a: F.coalesce(F.size(F.filter(a, lambda x: _key(x) != "")), F.lit(0))
    out = joined.withColumn("_ld_found", found).withColumn("_ld_kept", kept)
    rest = [c for c in df.columns if c != text_col]
    return out.select(*rest, F.array_join("_ld_kept", "\n").alias(text_col), F.greatest(full(F.col("_ld_all")), F.lit(0)).cast("long").alias("_ld_lines"), F.greatest(F.size("_ld_all") - F.size("_ld_kept"), F.lit(0)).cast("long").alias("_ld_removed")).select(*df.columns, "_ld_lines", "_ld_removed")


def page_lines(pages: DataFrame, ratio_pct: int = 20, min_pages: int = 5) -> DataFrame:
    """Rows (page_id, host, n_lines, n_removed, kept_md5, kept_chars) of web pages."""
    rows = pages.select("page_id", F.col("url").alias("url"), F.col("html").alias("html"))
    out = drop_boilerplate(rows, host_of(F.col("url")), "html", ratio_pct, min_pages, html_lines(F.col("html")))
    return out.select("page_id", host_of(F.col("url")).alias("host"), F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.md5("html").alias("kept_md5"), F.length("html").cast("long").alias("kept_chars"))


PAGES_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host, string_split(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages),
tot AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT rid, host, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY host, line HAVING count(*) >= 5),
bad AS (SELECT c.host, list(line) AS lines FROM c JOIN tot ON c.host IS NOT DISTINCT FROM tot.host WHERE n * 100 > total * 20 GROUP BY c.host),
k AS (SELECT p.page_id, p.host, p.ls, CASE WHEN bad.lines IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: NOT list_contains(bad.lines, trim(x, ' ' || chr(9) || chr(13)))) END AS kept FROM p LEFT JOIN bad ON p.host IS NOT DISTINCT FROM bad.host)
SELECT page_id, host, coalesce(len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_removed,
  md5(array_to_string(kept, chr(10))) AS kept_md5, length(array_to_string(kept, chr(10)))::BIGINT AS kept_chars FROM k
"""
