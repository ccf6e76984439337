"""Ranking quality: hits, precision, recall, F1, average precision, summaries.

``predictions`` has (issue, pos from 1, value), ``truth`` (issue, value). A value
matches if it ends with the other one, character by character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import normal_path, safe_ratio


def suffix_match(a: Column, b: Column) -> Column:
    return a.endswith(b) | b.endswith(a)


def distinct_predictions(df: DataFrame, most: int = 10) -> DataFrame:
    """First occurrences within the first ``most`` selections, ranked anew."""
    first = df.filter(F.col("pos") <= most).groupBy("issue", "value").agg(F.min("pos").alias("pos"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("issue").orderBy("pos")))


def metrics_at_k(predictions: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Rows (issue, k, hit, tp, precision_raw, precision_ref, recall, f1, all_correct,
    all_incorrect) for each issue of either table. Precision divides by the length of
    the list; ``precision_ref`` is 1 where recall is at least one half, and F1 uses it."""
    top = max(ks)
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    norm = lambda df: df.withColumn("value", normal_path(F.col("value")))
    p, g = norm(predictions.filter(F.col("pos") <= top)), norm(truth).select("issue", "value").distinct()
    issues = predictions.select("issue").union(truth.select("issue")).distinct()
    per_value = p.groupBy("issue", "value").agg(F.min("pos").alias("first"))
    met = per_value.join(g.withColumnRenamed("value", "gt"), "issue").filter(suffix_match(F.col("value"), F.col("gt")))
    # Positions by issue; cut-offs are counted in them at the end, so that no step moves a row for each cut-off.
    listed = lambda df, c, name: df.groupBy("issue").agg(F.collect_list(c).alias(name))
    tp = listed(met.select("issue", "value", "first").distinct(), "first", "_tp")
    found = listed(met.groupBy("issue", "gt").agg(F.min("first").alias("first")), "first", "_found")
    length = listed(p, "pos", "_listed")
    size = g.groupBy("issue").agg(F.count(F.lit(1)).alias("truths"))
    full = issues.join(tp, "issue", "left").join(found, "issue", "left").join(length, "issue", "left").join(size, "issue", "left").fillna(0, ["truths"])
    upto = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x <= F.col("k"))), F.lit(0)).cast("long")
    full = full.select("*", cuts).select("issue", "k", "truths", *[F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(upto(F.col(c))).alias(c[1:]) for c in ("_tp", "_found", "_listed")])
    rated = full.withColumns({"recall": safe_ratio(F.col("found"), F.col("truths")), "precision_raw": safe_ratio(F.col("tp"), F.col("listed"))})
    rated = rated.withColumn("precision_ref", F.when(F.col("recall") >= 0.5, F.lit(1.0)).otherwise(F.col("precision_raw")))
    both = F.col("precision_ref") + F.col("recall")
    return rated.select("issue", "k", (F.col("found") > 0).cast("int").alias("hit"), "tp", "precision_raw", "precision_ref", "recall", safe_ratio(2 * F.col("precision_ref") * F.col("recall"), both).alias("f1"), ((F.col("truths") > 0) & (F.col("found") == F.col("truths"))).cast("int").alias("all_correct"), (F.col("tp") == 0).cast("int").alias("all_incorrect"))


def average_precision(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Over whole lists: running hits by rank at each match, over the number of true
    values; as every matching prediction counts, it may exceed 1."""
    g = truth.withColumn("value", normal_path(F.col("value"))).select("issue", "value").distinct()
    p = predictions.withColumn("value", normal_path(F.col("value")))
    matched = p.join(g.select(F.col("issue").alias("_i"), F.col("value").alias("gt")), (F.col("issue") == F.col("_i")) & suffix_match(F.col("value"), F.col("gt")), "left_semi").withColumn("hit", F.lit(1))
    running = matched.withColumn("hits", F.sum("hit").over(Window.partitionBy("issue").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    summed = running.groupBy("issue").agg(F.sum(F.col("hits") / F.col("pos")).alias("s"))
    issues = predictions.select("issue").union(truth.select("issue")).distinct()
    size = g.groupBy("issue").agg(F.count(F.lit(1)).alias("truths"))
    return issues.join(summed, "issue", "left").join(size, "issue", "left").select("issue", F.coalesce(F.try_divide("s", "truths"), F.lit(0.0)).alias("ap"))


def summary(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Means by group, and over all rows as 'Total'."""
    out = rows.rollup(group).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("issues"), F.grouping(group).alias("_all"))
    return out.withColumn(group, F.when(F.col("_all") == 1, F.lit("Total")).otherwise(F.col(group).cast("string"))).drop("_all")


def recall_diagnostics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per issue how many true values were retrieved, of how many, and the missing ones."""
    p = predictions.groupBy("issue").agg(F.collect_set("value").alias("p"))
    g = truth.groupBy("issue").agg(F.array_sort(F.collect_set("value")).alias("g"))
    none = F.array().cast("array<string>")
    joined = g.join(p, "issue", "left").withColumn("p", F.coalesce("p", none))
    return joined.select("issue", F.size(F.array_intersect("g", "p")).alias("found"), F.size("g").alias("truths"), F.array_except("g", "p").alias("missing"))


def issues_by_repo(issues: DataFrame, meta: list[str]) -> DataFrame:
    """(repo, n, issues, metadata) of (repo, issue, ...): the metadata are those of the first issue."""
    return issues.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("issue")).alias("issues"), *[F.min_by(c, "issue").alias(c) for c in meta])


def path_of_basename(names: DataFrame, paths: DataFrame) -> DataFrame:
    """(name) to the first of (path, pos) that has it as its last segment."""
    found = paths.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "pos")
    return names.join(found, "name").groupBy("name").agg(F.min_by("path", "pos").alias("path"))


def entity_lists(rows: DataFrame) -> DataFrame:
    """(issue, functions, classes, predicted functions, predicted classes) as one truth, each
    value once, and one list of predictions, functions first."""
    return rows.select("issue", F.array_union("functions", "classes").alias("truth"), F.concat("predicted_functions", "predicted_classes").alias("predicted"))


def tokens_used(row_input: Column, other_input: Column, output: Column) -> Column:
    return F.coalesce(row_input, other_input, F.lit(0)) + F.coalesce(output, F.lit(0))


def worst_first_sample(repos: DataFrame, n: int = 3) -> DataFrame:
    """The repositories with the fewest files."""
    return repos.orderBy("files", "repo").limit(n)


LEVELS = {"retriever": (1, 5, 10, 20, 30), "file": (1, 3, 5, 10), "class": (1, 3, 5, 10), "function": (1, 3, 5, 10), "function_class": (1, 3, 5, 10)}


def levelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, truth) with a level each, of rows (issue, retrieved, predicted_files,
    predicted_classes, predicted_functions, files, classes, functions): lists, best first.
    Functions and classes together are one truth, each value once, and one list, functions first."""
    both = rows.withColumns({"_p": F.concat("predicted_functions", "predicted_classes"), "_t": F.array_union("functions", "classes")})
    listed = {"retriever": ("retrieved", "files"), "file": ("predicted_files", "files"), "class": ("predicted_classes", "classes"), "function": ("predicted_functions", "functions"), "function_class": ("_p", "_t")}
    at = lambda side: F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(c[side]).alias("l")) for level, c in listed.items()])).alias("x")
    p = both.select("issue", at(0)).select("x.level", "issue", F.posexplode("x.l").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
    return p, both.select("issue", at(1)).select("x.level", "issue", F.explode("x.l").alias("value")).distinct()


def level_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics at each level's cut-offs and ``ap`` for (level, issue, pos, value) and
    (level, issue, value): all levels in one job, as a level and an issue are one key."""
    keyed = lambda df: df.withColumn("issue", F.struct("level", "issue")).drop("level")
    p, g = keyed(predictions), keyed(truth)
    cuts = sorted({k for ks in LEVELS.values() for k in ks})
    wanted = F.exists(F.create_map(*[x for level, ks in LEVELS.items() for x in (F.lit(level), F.array(*map(F.lit, ks)))])[F.col("issue.level")], lambda k: k == F.col("k"))
    rows = metrics_at_k(p, g, cuts).filter(wanted).join(average_precision(p, g), "issue")
    return rows.select("issue.level", F.col("issue.issue").alias("issue"), *[c for c in rows.columns if c != "issue"])


def level_summary(metrics: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """By level and repository, and a total over all issues: hits at 1, 3 and 5, the others at ``k``. ``groups`` has (issue, repo)."""
    hit = lambda n: F.max(F.when(F.col("k") == n, F.col("hit"))).alias(f"hit_{n}")
    at = lambda c: F.max(F.when(F.col("k") == k, F.col(c))).alias(c)
    named = ["precision_ref", "recall", "all_correct", "all_incorrect"]
    wide = metrics.groupBy("level", "issue").agg(hit(1), hit(3), hit(5), *map(at, named)).join(groups, "issue")
    means = [F.avg(c).alias(c) for c in ("hit_1", "hit_3", "hit_5", *named)]
    out = wide.groupingSets([["level", "repo"], ["level"]], "level", "repo").agg(*means, F.count(F.lit(1)).alias("issues"), F.grouping("repo").alias("_all"))
    return out.withColumn("repo", F.when(F.col("_all") == 1, F.lit("Total")).otherwise(F.col("repo"))).drop("_all")
