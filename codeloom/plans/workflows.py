"""Whole workflows: index a repository, localise issues, evaluate, update."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import render
from codeloom.functions.text import clean_text, language_of, long_enough
from codeloom.functions.vectors import hashed_embedding
from codeloom.operators import evaluation, graph, incremental, parsing, retrieval


@dataclass
class Settings:
    """Fixed values of the workflow: candidates fetched, given to the selector, kept."""

    fetched: int = 60
    per_type: int = 20
    kept: int = 10
    dim: int = 64

    def __post_init__(self) -> None:
        if min(self.fetched, self.per_type, self.kept, self.dim) < 1:
            raise ValueError("all settings are at least 1")


@dataclass
class UpdateSettings:
    """How indexes are kept up to date."""

    incremental: bool = True
    log_updates: bool = True
    most_changes: int = 50
    timeout_seconds: int = 300
    retries: int = 2
    parallel_files: int = 4
    batch: int = 16
    retention_days: int = 90
    repositories: str = "repositories"
    store: str = "indices"

    @classmethod
    def of(cls, values: Mapping[str, str]) -> UpdateSettings:
        """From texts, such as a session's settings; what is absent, or no number, is the default."""
        out = {}
        for f in fields(cls):
            text = values.get(f.name)
            if text is None:
                continue
            if isinstance(f.default, bool):
                out[f.name] = text.lower() in ("true", "1", "yes", "on")
            elif isinstance(f.default, str):
                out[f.name] = text
            elif re.fullmatch(r"\s*[+-]?\d+\s*", text):
                out[f.name] = int(text)
        return cls(**out)

    def problems(self) -> list[str]:
        """Names of settings whose values are not allowed."""
        least = {"most_changes": 1, "timeout_seconds": 1, "retries": 0, "parallel_files": 1, "batch": 1, "retention_days": 1}
        return [n for n, low in least.items() if getattr(self, n) < low] + [n for n in ("repositories", "store") if not getattr(self, n)]


def index_repository(files: DataFrame, settings: Settings | None = None, embed: Callable[[Column, int], Column] = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(entities with embeddings, edges) of source files."""
    settings = settings or Settings()
    parsed = parsing.parse_files(files).persist()
    found = parsing.entities(parsed)
    texts = parsing.embedding_texts(found, graph.class_methods(found), parsed)
    vectors = texts.dropDuplicates(["id"]).select("id", embed(F.col("text"), settings.dim).alias("embedding"))
    functions = found.filter(F.col("entity_type") == "function")
    modules = graph.module_edges(graph.import_paths(parsed), found.filter(F.col("entity_type") == "file"))
    edges = graph.contains_edges(found).unionByName(graph.call_edges(parsing.call_pairs(parsed), functions).distinct()).unionByName(modules)
    # As in parse_files: neither is as small as the plan says.
    return found.dropDuplicates(["repo", "id"]).join(vectors, "id", "left").hint("merge"), edges.hint("merge")


def localise(issues: DataFrame, entities: DataFrame, edges: DataFrame, settings: Settings | None = None, select: Callable[[DataFrame], DataFrame] = retrieval.default_selection, embed: Callable[[Column, int], Column] = hashed_embedding) -> DataFrame:
    """Ranked candidates of (issue, title, body, is_test_related); too short issues have none.
    Issues with a ``repo`` are held against that repository's entities only."""
    settings = settings or Settings()
    within = ["repo"] if "repo" in issues.columns else []
    text = F.concat_ws("\n", "title", "body")
    asked = issues.filter(long_enough(clean_text(text))).select("issue", F.coalesce("is_test_related", F.lit(False)).alias("is_test_related"), embed(clean_text(text), settings.dim).alias("q"), *within)
    known = entities.select("id", "entity_type", "name", "file_path", "embedding", *within)
    fetched = settings.fetched + 10
    ranked = retrieval.top_k(retrieval.similarities(asked, known, *within), fetched) if within else retrieval.nearest(asked, known, fetched)
    kept = retrieval.without_tests(ranked, settings.fetched).select("issue", "id", "entity_type", "name", "file_path", "score")
    nodes = graph.nodes(entities)
    parents = graph.ancestors(edges).join(nodes.select(F.col("id").alias("ancestor"), F.lower("label").alias("entity_type"), "name", "file_path"), "ancestor")
    full = retrieval.with_parents(kept, parents.select(F.col("id").alias("child"), F.col("ancestor").alias("id"), "entity_type", "name", "file_path"))
    chosen = select(retrieval.capped_by_type(full, settings.per_type).drop("type_rank"))
    around = graph.neighbour_names(edges, nodes).select("id", "callers", "callees").hint("merge")  # lists of names are longer than the plan says
    return retrieval.final_ranking(full, chosen).join(around, "id", "left")


def comments(ranked: DataFrame, texts: DataFrame, owner: str | Column, name: str | Column, branch: str | Column = "main") -> DataFrame:
    """(issue, seq, body): the functions where the bug is likely to be; an analysis, if (issue,
    analysis, hypothesis, plan) has one; a plan, if there is one. ``ranked`` has a final
    ranking with reasons and lines; owner, name and branch are texts or columns of it."""
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    named = retrieval.comment_candidates(ranked)
    link = render.permalink(lit(owner), lit(name), lit(branch), F.col("file_path"), F.col("start_line"), F.col("end_line"))
    line = F.struct("rank", render.candidate_line(F.col("rank"), F.col("name"), F.col("file_path"), link).alias("line"))
    listed = named.groupBy("issue").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    first = listed.select("issue", F.lit(1).alias("seq"), F.concat(F.lit("## Bug localisation\n\n### Functions where the bug is likely to be\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("body"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    part = lambda c, head, tail: F.when(has(c), F.concat(F.lit(head), F.col(c), F.lit(tail))).otherwise(F.lit(""))
    second = texts.filter(has("analysis") | has("hypothesis")).select("issue", F.lit(2).alias("seq"), F.concat(F.lit("## Analysis\n\n"), part("analysis", "", "\n\n"), part("hypothesis", "**Hypothesis:**\n", "\n")).alias("body"))
    third = texts.filter(has("plan")).select("issue", F.lit(3).alias("seq"), F.concat(F.lit("## How such bugs are often mended\n\n"), F.col("plan"), F.lit("\n\n> A suggestion by a machine: please review it.\n")).alias("body"))
    return first.unionByName(second).unionByName(third)


def default_texts(ranked: DataFrame, most: int = 3) -> DataFrame:
    """A deterministic stand-in for the model's analysis: the best candidates by name; no plan."""
    best = ranked.filter(F.col("final_rank") <= most).groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("final_rank", "name"))).alias("best"))
    names = F.array_join(F.transform("best", lambda x: x["name"]), ", ")
    return best.select("issue", F.concat(F.lit("Closest to the report: "), names, F.lit(".")).alias("analysis"), F.lit(None).cast("string").alias("hypothesis"), F.lit(None).cast("string").alias("plan"))


def results(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(issue, top_files, analysis, hypothesis, plan), the workflow's result: a row of
    (final_rank, file_path, score, name, language) for each candidate function, in order; issues
    without one are absent."""
    row = F.struct("final_rank", "file_path", F.coalesce("score", F.lit(0.0)).alias("score"), "name", language_of(F.col("file_path"), default="unknown").alias("language"))
    listed = ranked.filter(F.col("entity_type") == "function").groupBy("issue").agg(F.array_sort(F.collect_list(row)).alias("top_files"))
    return listed.join(texts.select("issue", "analysis", "hypothesis", "plan"), "issue", "left")


def evaluate_levels(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, summary) of all five levels: ``rows`` as for ``evaluation.levelled``, ``groups`` (issue, repo)."""
    metrics = evaluation.level_metrics(*evaluation.levelled(rows))
    return metrics, evaluation.level_summary(metrics, groups)


def evaluate(ranking: DataFrame, truth: DataFrame, group: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """(metrics by issue and k, summary by repository with a total) of file predictions."""
    predictions = evaluation.distinct_predictions(ranking.select("issue", F.col("final_rank").alias("pos"), F.col("file_path").alias("value")))
    metrics = evaluation.metrics_at_k(predictions, truth, ks)
    ap = evaluation.average_precision(predictions, truth)
    rows = metrics.filter(F.col("k") == 5).join(ap, "issue").join(group, "issue")
    return metrics, evaluation.summary(rows, "repo", ["hit", "precision_ref", "recall", "f1", "ap"])


def update_graph(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The edges after a push: those of changed files and of the files that have edges to them
    are made anew, so that calls and imports by name find what has come and lose what has gone."""
    before, after = index_repository(old)[0], index_repository(new)
    h = lambda df: df.select("repo", "path", F.md5("content").alias("content_hash"))
    changes = incremental.snapshot_changes(h(old), h(new))
    gone = incremental.removed_ids(before, changes)
    new_ids = after[0].join(changes.select("repo", F.col("path").alias("file_path")), ["repo", "file_path"], "left_semi").select("repo", "id")
    touched = gone.unionByName(new_ids).distinct()
    ends = touched.withColumnRenamed("id", "src"), touched.withColumnRenamed("id", "dst")
    fresh = after[1].join(ends[0], ["repo", "src"], "left_semi").unionByName(after[1].join(ends[1], ["repo", "dst"], "left_semi"))
    return incremental.upsert_edges(edges, gone, fresh)


def update_index(entities: DataFrame, old: DataFrame, new: DataFrame, most_changes: int = 50) -> DataFrame:
    """The index after a push: repositories with few changed files are updated in place, others are built anew."""
    h = lambda df: df.select("repo", "path", F.md5("content").alias("content_hash"))
    changes = incremental.snapshot_changes(h(old), h(new))
    counts = changes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.withColumn("plan", incremental.strategy(F.lit(True), F.lit(True), F.col("n"), most_changes))
    full = plan.filter(F.col("plan") == "full").select("repo")
    part = changes.join(full, "repo", "left_anti")
    whole = new.join(full, "repo", "left_semi").select("repo", "path").withColumn("status", F.lit("M")).unionByName(old.join(full, "repo", "left_semi").select("repo", "path").withColumn("status", F.lit("D"))).dropDuplicates(["repo", "path"])
    todo = part.unionByName(whole.select("repo", "path", "status"))
    fresh, _ = index_repository(new.join(todo.select("repo", "path"), ["repo", "path"], "left_semi"))
    return incremental.upsert(entities, todo, fresh)
