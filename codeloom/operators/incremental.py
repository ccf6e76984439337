"""Change sets, incremental upserts, update strategy, index registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import has_source_extension


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, status) of two snapshots (repo, path, content_hash): A, M, D."""
    a = old.select("repo", "path", F.col("content_hash").alias("_old"))
    b = new.select("repo", "path", F.col("content_hash").alias("_new"))
    joined = a.join(b, ["repo", "path"], "full_outer")
    status = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").when(F.col("_old") != F.col("_new"), "M")
    return joined.select("repo", "path", status.alias("status")).filter("status IS NOT NULL")


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(repo, line of a name-status listing) to (repo, status, old_path, path); a rename
    counts as modified under its new name, other extensions are left out."""
    parts = F.split("line", "\t")
    code = F.substring(parts[0], 1, 1)
    renamed = code == "R"
    rows = lines.select("repo", F.when(renamed, "M").otherwise(code).alias("status"), F.when(renamed, F.get(parts, F.lit(1))).alias("old_path"), F.when(renamed, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"))
    return rows.filter(F.col("status").isin("A", "M", "D") & has_source_extension(F.col("path")))


def change_counts(changes: DataFrame) -> DataFrame:
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return changes.groupBy("repo").agg(n("A").alias("added"), n("M").alias("modified"), n("D").alias("deleted"), n("A", "M").alias("to_reindex"), n("D").alias("to_remove"))


def strategy(enabled: Column, indexed: Column, changes: Column, most: int = 50) -> Column:
    """Off: full; not indexed: initial; more than ``most`` files, or unknown: full; else incremental."""
    return F.when(~enabled, "full").when(~indexed, "initial").when(changes.isNull() | (changes > most), "full").otherwise("incremental")


def upsert(entities: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities without those of changed files, plus the fresh ones of added and modified files."""
    stay = entities.join(changes.select("repo", F.col("path").alias("file_path")), ["repo", "file_path"], "left_anti")
    new = fresh.join(changes.filter(F.col("status").isin("A", "M")).select("repo", F.col("path").alias("file_path")), ["repo", "file_path"], "left_semi")
    return stay.unionByName(new, allowMissingColumns=True)


def upsert_edges(edges: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges without those from removed entities (repo, id), plus the fresh ones; an edge to a
    removed entity goes unless it is among the fresh ones."""
    stay = edges.join(gone.select("repo", F.col("id").alias("src")), ["repo", "src"], "left_anti").join(gone.select("repo", F.col("id").alias("dst")), ["repo", "dst"], "left_anti")
    return stay.select("repo", "src", "dst", "rel").unionByName(fresh.select("repo", "src", "dst", "rel")).distinct()


def removed_ids(entities: DataFrame, changes: DataFrame) -> DataFrame:
    return entities.join(changes.filter(F.col("status") != "A").select("repo", F.col("path").alias("file_path")), ["repo", "file_path"], "left_semi").select("repo", "id")


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import changed ones."""
    return edges.filter(F.col("rel") == "IMPORTS").join(changed.select("repo", F.col("id").alias("dst")), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("id")).distinct()


def register(registry: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by (repo, commit): a known commit keeps its place, a new one goes last."""
    known = registry.select("repo", "commit_sha", F.col("seq").alias("_seq"))
    last = registry.groupBy("repo").agg(F.max("seq").alias("_last"))
    placed = fresh.drop("seq").join(known, ["repo", "commit_sha"], "left").join(last, "repo", "left")
    order = Window.partitionBy("repo", F.col("_seq").isNull()).orderBy("indexed_at", "commit_sha")
    placed = placed.withColumn("seq", F.coalesce("_seq", F.coalesce("_last", F.lit(0)) + F.row_number().over(order))).drop("_seq", "_last")
    return registry.join(fresh.select("repo", "commit_sha"), ["repo", "commit_sha"], "left_anti").unionByName(placed, allowMissingColumns=True)


def without_version(registry: DataFrame, repo: str, commit_sha: str | None = None) -> DataFrame:
    """The registry without a repository's commit, or without all of them."""
    gone = F.col("repo").eqNullSafe(F.lit(repo))
    return registry.filter(~(gone if commit_sha is None else gone & F.col("commit_sha").eqNullSafe(F.lit(commit_sha))))


def versions(registry: DataFrame) -> DataFrame:
    """Each repository's commits in their order."""
    return registry.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "commit_sha"))), lambda x: x["commit_sha"]).alias("commits"))


def latest_version(registry: DataFrame) -> DataFrame:
    return registry.groupBy("repo").agg(F.max_by(F.struct(*[c for c in registry.columns if c != "repo"]), "seq").alias("v")).select("repo", "v.*")


def unseen(fresh: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return fresh.dropDuplicates([key]).join(known.select(key), key, "left_anti")
