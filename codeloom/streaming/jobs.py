"""Handlers of routed events over an index in a shared folder: pushes, removals, issues.

A store has the tables entities, edges and registry (by repository) and the logs telemetry,
updates and comments, where each micro-batch of a route has a folder of its own, which a
repeated one replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import render
from codeloom.operators import incremental, telemetry
from codeloom.plans import workflows
from codeloom.sources import repository

Snapshots = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def table(spark: SparkSession, store: str, name: str, repos: DataFrame) -> DataFrame | None:
    """The repositories' rows; None if the table is not there yet."""
    path = f"{store}/{name}"
    return repository.read_index(spark, path).join(repos.select("repo").distinct(), "repo", "left_semi") if repository.exists(spark, path) else None


def log(df: DataFrame, store: str, name: str, route: str, number: int) -> None:
    df.write.mode("overwrite").json(f"{store}/{name}/{route}-{number}")


def read_log(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{store}/{name}/*")


def update_rows(runs: DataFrame) -> DataFrame:
    """Update log rows of (repo, timestamp, ...): a missing time is the present one."""
    return runs.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")))


def on_push(store: str, snapshots: Snapshots, settings: workflows.UpdateSettings | None = None) -> Callable[[DataFrame, int], None]:
    """Brings the index of pushed repositories up to date. ``snapshots`` gives the files before
    and after the last push of each of (repo, before, after). A repository without an index is
    indexed whole; a repeated micro-batch writes the same rows again."""
    settings = settings or workflows.UpdateSettings()

    def handle(events: DataFrame, number: int) -> None:
        if events.isEmpty():
            return
        spark = events.sparkSession
        pushes = events.groupBy("repo").agg(F.max_by(F.struct("before", "after"), F.coalesce(F.col("received"), F.timestamp_seconds(F.lit(0)))).alias("p")).select("repo", "p.*")
        old, new = (df.join(pushes.select("repo"), "repo", "left_semi") for df in snapshots(pushes))
        known, edges = table(spark, store, "entities", pushes), table(spark, store, "edges", pushes)
        indexed = known.select("repo").distinct() if known is not None else pushes.select("repo").filter("false")
        if known is None or not settings.incremental:
            entities, edges = workflows.index_repository(new)
            counts = None
        else:
            before = old.join(indexed, "repo", "left_semi")
            entities = workflows.update_index(known, before, new, settings.most_changes)
            edges = workflows.update_graph(edges, before, new)
            h = lambda df: df.select("repo", "path", F.md5("content").alias("content_hash"))
            counts = incremental.change_counts(incremental.snapshot_changes(h(before), h(new)))
        # Cut here: the tables are read and replaced, and several counts follow.
        entities, edges, indexed = entities.checkpoint(), edges.checkpoint(), indexed.checkpoint()
        emptied = [r["repo"] for r in pushes.join(new, "repo", "left_anti").select("repo").collect()]  # of one micro-batch
        n = lambda kind: F.count(F.when(F.col("entity_type") == kind, 1)).cast("int")
        held = entities.groupBy("repo").agg(n("file").alias("files_indexed"), n("function").alias("functions_count"))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        runs = pushes.join(held, "repo", "left").fillna(0, ["files_indexed", "functions_count"])
        versions = runs.filter("after IS NOT NULL").select("repo", F.col("after").alias("commit_sha"), "files_indexed", "functions_count", F.current_timestamp().alias("indexed_at"))
        registry = table(spark, store, "registry", pushes)
        if registry is None:
            registry = versions.withColumn("seq", F.lit(0).cast("long")).filter("false")
        registry = incremental.register(registry, versions).withColumn("seq", F.col("seq").cast("long")).checkpoint()
        repository.write_by_repo(entities, f"{store}/entities", emptied)
        repository.write_by_repo(edges, f"{store}/edges", emptied)
        repository.write_by_repo(registry, f"{store}/registry")
        kinds = incremental.strategy(F.lit(settings.incremental), F.col("_known"), F.coalesce("_changes", F.lit(0)), settings.most_changes)
        changed = runs.join(indexed.withColumn("_known", F.lit(True)), "repo", "left").fillna(False, ["_known"])
        if counts is not None:
            changed = changed.join(counts, "repo", "left").withColumn("_changes", F.col("to_reindex") + F.col("to_remove"))
        else:
            changed = changed.withColumn("_changes", F.lit(0))
        if settings.log_updates:
            log(update_rows(changed.select("repo", F.lit(None).cast("string").alias("timestamp"), kinds.alias("type"), F.col("before").alias("old_commit"), F.col("after").alias("new_commit"), F.col("_changes").cast("int").alias("files_changed"), F.lit(True).alias("success"))), store, "updates", "index", number)
        timed = runs.select(F.col("repo").alias("repo_name"), now.alias("timestamp"), "files_indexed", "functions_count", F.lit(None).cast("double").alias("duration_seconds"), F.lit(None).cast("string").alias("error"))
        log(telemetry.indexing_events(timed), store, "telemetry", "index", number)

    return handle


def on_remove(store: str) -> Callable[[DataFrame, int], None]:
    """Deletes all tables' partitions of removed repositories."""

    def handle(events: DataFrame, number: int) -> None:
        gone = [r["repo"] for r in events.filter("repo IS NOT NULL").select("repo").distinct().collect()]  # of one micro-batch
        for name in ("entities", "edges", "registry"):
            repository.delete_repos(events.sparkSession, f"{store}/{name}", gone)

    return handle


def on_issue(store: str, settings: workflows.Settings | None = None) -> Callable[[DataFrame, int], None]:
    """Comments on opened issues, and their telemetry. A repository without an index gets a
    notice; an issue without a result an error comment, and a failure in telemetry. Issues'
    keys are repository#number; rows of one issue count once."""
    settings = settings or workflows.Settings()

    def handle(events: DataFrame, number: int) -> None:
        if events.isEmpty():
            return
        spark = events.sparkSession
        key = F.concat_ws("#", "repo", F.col("issue_number").cast("string"))
        issues = events.select(key.alias("issue"), "repo", "title", "body", F.coalesce("default_branch", F.lit("main")).alias("branch"), F.lower("title").contains("test").alias("is_test_related")).dropDuplicates(["issue"]).checkpoint()
        entities, edges = table(spark, store, "entities", issues), table(spark, store, "edges", issues)
        body = "issue string, seq int, body string"
        if entities is None:
            ready, found = issues.filter("false"), spark.createDataFrame([], body)
        else:
            ready = issues.join(entities.select("repo").distinct(), "repo", "left_semi")
            lines = entities.select("id", "start_line", "end_line")
            ranked = workflows.localise(ready, entities, edges, settings).join(lines, "id", "left").join(ready.select("issue", "repo", "branch"), "issue").checkpoint()
            part = lambda i: F.get(F.split("repo", "/"), F.lit(i))
            linked = ranked.withColumns({"owner": part(0), "repo_name": part(1)})
            # Permalinks differ by repository, so they are made of columns.
            found = workflows.comments(linked, workflows.default_texts(linked), F.col("owner"), F.col("repo_name"), F.col("branch")).checkpoint()
        done = found.filter("seq = 1").select("issue")
        failed = ready.join(done, "issue", "left_anti")
        waiting = issues.join(ready, "issue", "left_anti").select("issue", F.lit(1).alias("seq"), F.lit("## Indexing in progress\n\nThe repository is being indexed.").alias("body"))
        errors = failed.select("issue", F.lit(1).alias("seq"), render.error_comment(F.lit("No results")).alias("body"))
        log(found.join(done, "issue", "left_semi").unionByName(waiting).unionByName(errors), store, "comments", "localise", number)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        ok = ready.join(done.withColumn("success", F.lit(True)), "issue", "left").fillna(False, ["success"])
        timed = ok.select(F.col("issue"), F.col("repo").alias("repo_name"), now.alias("timestamp"), F.lit(None).cast("double").alias("latency_ms"), F.when(F.col("success"), "medium").otherwise("low").alias("confidence"), "success")
        rows = telemetry.retrieval_events(timed, settings.kept).withColumn("top_k", F.when(F.col("success"), F.col("top_k")).otherwise(0))
        wrong = failed.select(F.lit("error").alias("type"), now.alias("timestamp"), F.lit("retrieval_failed").alias("error_type"), F.lit("No results").alias("error_msg"), F.create_map(F.lit("issue"), F.col("issue"), F.lit("repo"), F.col("repo")).alias("context"))
        log(rows.unionByName(wrong, allowMissingColumns=True), store, "telemetry", "localise", number)

    return handle


def handlers(store: str, snapshots: Snapshots, settings: workflows.Settings | None = None, updates: workflows.UpdateSettings | None = None) -> dict[str, Callable[[DataFrame, int], None]]:
    """The handlers for ``events.process``, in the order in which a micro-batch's rows are handled."""
    return {"remove": on_remove(store), "index": on_push(store, snapshots, updates), "localise": on_issue(store, settings)}
