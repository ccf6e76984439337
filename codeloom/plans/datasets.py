"""Test datasets of issues with the files and entities that their fixes changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import hunk_entity, language_of, repo_of_url
from codeloom.operators import parsing


def named_issues(rows: DataFrame) -> DataFrame:
    """Adds ``repository`` (owner/name, else from an address) and ``issue_url``; rows without a repository go."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    url = F.coalesce(some("html_url"), some("issue_url"))
    own = F.concat(some("repo_owner"), F.lit("/"), some("repo_name"))
    return rows.withColumn("issue_url", url).withColumn("repository", F.coalesce(own, repo_of_url(url))).filter("repository IS NOT NULL")


def repositories(issues: DataFrame, language: str, least: int = 10) -> DataFrame:
    """(repository, issues, total_files, lines, stars, language) of those with enough issues;
    the values are those of the first issue by ``pos``."""
    value = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    meta = F.struct(value("repo_files", 0).alias("total_files"), value("repo_lines", 0).alias("lines"), value("repo_stars", 0).alias("stars"), value("repo_language", language).alias("language"))
    found = issues.groupBy("repository").agg(F.count(F.lit(1)).alias("issues"), F.min_by(meta, "pos").alias("m"))
    return found.filter(F.col("issues") >= least).select("repository", "issues", "m.*")


def changes(diffs: DataFrame) -> DataFrame:
    """(id, diff) to (id, changed_files, changed_classes, changed_functions, changed_lines):
    names of hunks' contexts once each, sorted; new line numbers in the diff's order."""
    hunks = parsing.diff_hunks(diffs)
    entity = hunk_entity(F.col("context"), language_of(F.col("file_path"), default="unknown"))
    named = hunks.withColumn("e", entity)
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("e.kind") == kind, F.col("e.name"))))
    lines = F.array_sort(F.collect_list(F.struct("seq", "lines")))
    return named.groupBy("id").agg(F.array_sort(F.collect_set("file_path")).alias("changed_files"), of("class").alias("changed_classes"), of("function").alias("changed_functions"), F.flatten(F.transform(lines, lambda x: x["lines"])).alias("changed_lines"))


def prepared(rows: DataFrame, language: str, repos: int = 3, least: int = 10, per_repo: int = 10) -> DataFrame:
    """The first issues of the smallest repositories that have enough issues, with what their
    diffs change. ``rows`` has pos (their order), repo_owner, repo_name, html_url, issue_url,
    repo_files, repo_lines, repo_stars, repo_language, issue_title, issue_body, diff, diff_url.
    ``size_kb`` is an estimate of 50 lines a KB. A null diff changes nothing."""
    issues = named_issues(rows)
    smallest = repositories(issues, language, least).orderBy("total_files", "repository").limit(repos)
    order = Window.partitionBy("repository").orderBy("pos")
    first = issues.join(F.broadcast(smallest.drop("issues")), "repository").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_repo)
    key = F.col("pos").cast("string")
    changed = changes(first.select(key.alias("id"), "diff"))
    link = F.concat(F.lit("https://github.com/"), "repository")
    out = first.withColumn("id", key).join(changed, "id", "left")
    listed = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("changed_files", "array<string>"), ("changed_classes", "array<string>"), ("changed_functions", "array<string>"), ("changed_lines", "array<int>"))]
    return out.select(F.lit(language).alias("language"), "repository", link.alias("repo_link"), F.expr("lines div 50").alias("size_kb"), "total_files", "pos", "issue_title", "issue_body", "issue_url", *listed, "diff_url")
