"""Statistics over telemetry, update and registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_interval(text: str) -> Column:
    """'30m', '24h', '7d' as an interval; anything else is a day."""
    unit, number = text[-1:], text[:-1]
    if not number.isdigit() or unit not in "mhd":
        unit, number = "h", "24"
    n = F.lit(int(number))
    zero = F.lit(0)
    return F.make_dt_interval(n if unit == "d" else zero, n if unit == "h" else zero, n if unit == "m" else zero)


def since(df: DataFrame, ts: str, now: Column, span: str) -> DataFrame:
    return df.filter(F.col(ts) >= now - range_interval(span))


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows that are not older than so many days; null times go."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def retrieval_events(results: DataFrame, top_k: int) -> DataFrame:
    """Telemetry rows of (issue, repo_name, timestamp, latency_ms, confidence, success)."""
    return results.select(F.lit("retrieval").alias("type"), "timestamp", F.col("issue").cast("string").alias("issue_id"), "latency_ms", F.lit(top_k).alias("top_k"), "confidence", "repo_name", F.coalesce("success", F.lit(True)).alias("success"))


def indexing_events(runs: DataFrame) -> DataFrame:
    """Telemetry rows of (repo_name, timestamp, files_indexed, functions_count, duration_seconds,
    error): an error makes an error row."""
    failed = F.col("error").isNotNull()
    return runs.select(F.when(failed, "error").otherwise("indexing").alias("type"), "timestamp", "repo_name", (~failed).alias("success"), "files_indexed", "functions_count", "duration_seconds", F.when(failed, "indexing").alias("error_type"), F.col("error").alias("error_msg"))


def index_percentile(values: Column, share: float | None) -> Column:
    """The value at index int(share * n) of the sorted values (None: n // 2), without interpolation."""
    n = F.size(values)
    at = F.floor(n / 2) if share is None else F.floor(n * F.lit(share))
    return F.try_element_at(values, (F.least(at, n - 1) + 1).cast("int"))


def latency_stats(df: DataFrame, group: list[str], latency: str, success: Column) -> DataFrame:
    """Totals, success share, and average, upper median and 95th percentile of successful
    latencies. Latencies are first counted by value, so a group's list is of its
    different values; percentiles come from running counts."""
    by_value = df.groupBy(*group, F.col(latency).alias("_v")).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(success, F.lit(1))).alias("_ok"))
    part = Window.partitionBy(*group)
    run = F.sum("_ok").over(part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("_ok").over(part)
    ranked = by_value.withColumns({"_up": run, "_n": n})
    at = lambda index: F.min(F.when((F.col("_ok") > 0) & (F.col("_up") > index), F.col("_v")))
    return ranked.groupBy(*group).agg(
        F.sum("_all").alias("total"), F.sum("_ok").alias("successful"),
        F.when(F.sum("_all") > 0, F.sum("_ok") / F.sum("_all")).otherwise(0.0).alias("success_rate"),
        F.try_divide(F.sum(F.when(F.col("_ok") > 0, F.col("_v") * F.col("_ok"))), F.sum("_ok")).alias("avg_latency"),
        at(F.floor(F.col("_n") / 2)).alias("median_latency"), at(F.floor(F.col("_n") * F.lit(0.95))).alias("p95_latency"),
    )


def histogram(df: DataFrame, group: list[str], value: str, default: str = "unknown") -> DataFrame:
    counts = df.groupBy(*group, F.coalesce(F.col(value), F.lit(default)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias("histogram"))


def indexing_stats(df: DataFrame, success: Column, files: str, functions: str, seconds: str) -> DataFrame:
    ok = lambda c: F.when(success, F.col(c))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(success, 1)).alias("successful"), F.coalesce(F.sum(ok(files)), F.lit(0)).alias("files"), F.coalesce(F.sum(ok(functions)), F.lit(0)).alias("functions"), F.coalesce(F.avg(ok(seconds)), F.lit(0.0)).alias("avg_seconds"))


def error_stats(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def update_stats(df: DataFrame, group: list[str], success: Column, seconds: str, files: str) -> DataFrame:
    """Totals, successes, failures, percentage, averages over rows that have the values."""
    n, ok = F.count(F.lit(1)), F.count(F.when(success, 1))
    return df.groupBy(*group).agg(n.alias("total"), ok.alias("successful"), (n - ok).alias("failed"), F.when(n > 0, ok * 100.0 / n).otherwise(0.0).alias("success_percent"), F.avg(seconds).alias("avg_seconds"), F.avg(files).alias("avg_files"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n).drop("_n")


def storage_stats(df: DataFrame, repo: str, size: str) -> DataFrame:
    """Each repository and, with a null one, all of them."""
    return df.groupingSets([[F.col(repo)], []], F.col(repo)).agg(F.count(F.lit(1)).alias("versions"), F.sum(size).alias("size"), F.countDistinct(repo).alias("repos"))


def language_stats(df: DataFrame, language: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(language), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def index_status(df: DataFrame, repo: str, kind: str, at: str) -> DataFrame:
    return df.groupBy(repo).agg(F.count(F.lit(1)).alias("entities"), F.countDistinct(kind).alias("kinds"), F.max(at).alias("updated"))


def recent(df: DataFrame, ts: str, n: int = 10, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(ts), *([F.desc(tie)] if tie else [])).limit(n)


def alerts(df: DataFrame, seconds: Column, most: float = 10.0) -> DataFrame:
    return df.filter(seconds > most)
