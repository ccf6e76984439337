"""Streams over a store, dataset preparation, levels of evaluation, settings, localisation by brute force."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import vectors
from codeloom.operators import evaluation, parsing
from codeloom.plans import datasets, queries, workflows
from codeloom.sources import repository
from codeloom.streaming import events, jobs

FILES = "repo string, path string, language string, content string"
SF = "/root/testdata/sf0.001"


def test_store_follows_pushes_issues_and_removals(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    store, source = str(tmp_path / "store"), tmp_path / "in"
    source.mkdir()
    body = {"c1": "def load_table(x):\n    return x\n\ndef main():\n    return load_table(1)\n", "c2": "def loaded(x):\n    return x\n"}
    state = {"old": [], "new": []}
    frame = lambda rows: spark.createDataFrame(rows, FILES)
    handlers = jobs.handlers(store, lambda pushes: (frame(state["old"]), frame(state["new"])))

    def send(number, *rows):
        (source / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        assert events.process(events.event_stream(spark, str(source)), handlers, str(tmp_path / "cp")).awaitTermination(300)

    issue = {"event": "issues", "action": "opened", "repo": "o/r", "issue_number": 7, "title": "load_table fails with a wrong number", "body": "see load_table"}
    send(1, issue)
    comments = lambda: {r["issue"]: r["body"] for r in jobs.read_log(spark, store, "comments", "issue string, seq int, body string").filter("seq = 1").collect()}
    assert "Indexing in progress" in comments()["o/r#7"]
    state["new"] = [("o/r", "src/a.py", "python", body["c1"])]
    send(2, {"event": "push", "ref": "refs/heads/main", "repo": "o/r", "after": "c1"}, issue | {"issue_number": 8}, issue | {"issue_number": 9, "title": "short", "body": ""}, issue | {"issue_number": 8})
    assert "`load_table`](https://github.com/o/r/blob/main/src/a.py#L1-L2)" in comments()["o/r#8"]
    assert "failed" in comments()["o/r#9"] and "Indexing" in comments()["o/r#7"]
    state["old"], state["new"] = state["new"], [("o/r", "src/a.py", "python", body["c2"])]
    send(3, {"event": "push", "ref": "refs/heads/main", "repo": "o/r", "before": "c1", "after": "c2"})
    found = repository.read_index(spark, f"{store}/entities")
    assert {r["name"] for r in found.filter("entity_type = 'function'").collect()} == {"loaded"}
    whole = workflows.index_repository(frame(state["new"]))[1]
    key = lambda df: {(r["src"], r["dst"], r["rel"]) for r in df.collect()}
    assert key(repository.read_index(spark, f"{store}/edges")) == key(whole)
    assert [(r["commit_sha"], r["seq"], r["functions_count"]) for r in repository.read_index(spark, f"{store}/registry").orderBy("seq").collect()] == [("c1", 1, 2), ("c2", 2, 1)]
    updates = jobs.read_log(spark, store, "updates", "repo string, type string, timestamp string, files_changed int")
    assert [(r["type"], r["files_changed"]) for r in updates.orderBy("timestamp").collect()] == [("initial", 0), ("incremental", 1)]
    assert updates.filter("timestamp IS NULL").count() == 0
    told = {(r["type"], r["issue_id"], r["success"], r["top_k"]) for r in repository.read_telemetry(spark, f"{store}/telemetry/*").collect()}
    assert told == {("indexing", None, True, None), ("retrieval", "o/r#8", True, 10), ("retrieval", "o/r#9", False, 0), ("error", None, None, None)}
    send(4, {"event": "installation", "action": "deleted", "repo": "o/r"})
    assert not repository.exists(spark, f"{store}/entities")


def test_issues_meet_their_own_repository(spark):
    files = spark.createDataFrame([(r, "a.py", "python", f"def load_{r}(x):\n    return x\n") for r in "rs"], FILES)
    entities, edges = workflows.index_repository(files)
    asked = spark.createDataFrame([(i, r, "the load function fails with wrong numbers", "", False) for i, r in ((1, "r"), (2, "s"))], "issue long, repo string, title string, body string, is_test_related boolean")
    names = {(r["issue"], r["name"]) for r in workflows.localise(asked, entities, edges).filter("entity_type = 'function'").collect()}
    assert names == {(1, "load_r"), (2, "load_s")}


def test_diff_hunks_and_preparation(spark):
    diff = "diff --git a/lib/x.py b/lib/x.py\n--- a/lib/x.py\n+++ b/lib/x.py\n@@ -1,2 +1,3 @@ class Big(Base):\n a\n+b\n@@ -9 +10,0 @@ def small(x):\n-c\ndiff --git a/old.py b/old.py\n--- a/old.py\n+++ /dev/null\n"
    df = spark.createDataFrame([("1", diff), ("2", None)], "id string, diff string")
    assert {(r["file_path"], r["context"], tuple(r["lines"])) for r in parsing.diff_hunks(df).collect()} == {("lib/x.py", None, ()), ("lib/x.py", "class Big(Base):", (2,)), ("lib/x.py", "def small(x):", ()), ("old.py", None, ())}
    r = datasets.changes(df).collect()
    assert [tuple(x) for x in r] == [("1", ["lib/x.py", "old.py"], ["Big"], ["small"], [2])]
    schema = "pos long, repo_owner string, repo_name string, html_url string, issue_url string, repo_files long, repo_lines long, repo_stars long, repo_language string, issue_title string, issue_body string, diff string, diff_url string"
    row = lambda pos, owner, name, url, size: (pos, owner, name, None, url, size, 120, None, None, "t", "b", diff if pos % 2 else None, None)
    rows = [row(i, "o", "big", None, 9) for i in range(3)] + [row(i, "", "", "https://github.com/o/small/issues/1", 2) for i in range(3, 6)] + [row(9, "o", "few", None, 1), row(10, None, None, None, 1)]
    got = datasets.prepared(spark.createDataFrame(rows, schema), "python", repos=1, least=2, per_repo=2).orderBy("pos").collect()
    assert [(x["repository"], x["pos"], x["size_kb"], x["changed_lines"], x["changed_classes"]) for x in got] == [("o/small", 3, 2, [2], ["Big"]), ("o/small", 4, 2, [], [])]
    assert datasets.prepared(spark.createDataFrame([], schema), "python").count() == 0


def test_levels_of_evaluation(spark):
    schema = "issue long, " + ", ".join(f"{c} array<string>" for c in ("retrieved", "predicted_files", "predicted_classes", "predicted_functions", "files", "classes", "functions"))
    rows = spark.createDataFrame([(1, ["b.py", "a.py"], ["a.py"], ["C"], ["g", "f"], ["a.py"], ["C"], ["f", "C"]), (2, [], ["z.py"], [], [], ["q.py"], [], [])], schema)
    metrics, summary = workflows.evaluate_levels(rows, spark.createDataFrame([(1, "r"), (2, "s")], "issue long, repo string"))
    got = {(r["level"], r["issue"], r["k"]): r for r in metrics.collect()}
    assert got["retriever", 1, 1]["hit"] == 0 and got["retriever", 1, 5]["hit"] == 1 and ("retriever", 1, 3) not in got and ("file", 1, 20) not in got
    assert got["function_class", 1, 3]["recall"] == 1.0 and got["function_class", 1, 1]["recall"] == 0.0 and got["function", 1, 3]["recall"] == 0.5
    assert got["retriever", 1, 1]["ap"] == 0.5 and got["file", 2, 1]["all_incorrect"] == 1
    totals = {(r["level"], r["repo"]): (r["hit_1"], r["issues"]) for r in summary.collect()}
    assert totals["file", "Total"] == (0.5, 2) and totals["file", "r"] == (1.0, 1)
    p, g = evaluation.levelled(rows)
    assert p.filter("level = 'function_class'").orderBy("pos").select("value").toPandas()["value"].tolist() == ["g", "f", "C"] and g.filter("level = 'function_class'").count() == 2


def test_model_embedding_loads_once_and_checks_sizes(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), (None,), ("x" * 5000,)], "t string")
    embed = vectors.model_embedding("length", load, batch=2)
    assert sorted(r["v"][0] for r in df.select(embed(F.col("t"), 2).alias("v")).collect()) == [0.0, 2.0, 5000.0]
    with pytest.raises(Exception, match="dimensions"):
        df.select(embed(F.col("t"), 3).alias("v")).collect()


def test_update_settings():
    s = workflows.UpdateSettings.of({"incremental": "off", "most_changes": "7", "retries": "x", "store": ""})
    assert (s.incremental, s.most_changes, s.retries) == (False, 7, 2) and s.problems() == ["store"]
    assert workflows.UpdateSettings(batch=0, retries=-1).problems() == ["retries", "batch"] and not workflows.UpdateSettings().problems()

def test_localise_issues_by_brute_force(spark):
    import xxhash

    entities, _ = workflows.index_repository(queries.source_files(spark, SF))
    known = {r["id"]: r for r in entities.collect()}
    by = {(r["file_path"], r["entity_type"], r["name"]): r["id"] for r in known.values()}

    def embedded(words):
        v = [0.0] * 64
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            v[h % 64] += 1.0 if 0 < h < 1 << 63 else -1.0
        return [x / sum(y * y for y in v) ** 0.5 for x in v]

    def parents(r):
        k = r["file_path"][1:-3]
        up = [by[r["file_path"], "file", r["file_path"]]] if r["entity_type"] != "file" else []
        return up + ([by[r["file_path"], "class", f"C{k}"]] if r["name"] == f"run_{k}" else [])

    want = {}
    for issue in range(25):
        q = embedded(["helper_" + str(issue), "fails", "when", "run", "with", "a", "wrong", "number"])
        score = {i: sum(x * y for x, y in zip(r["embedding"], q, strict=True)) for i, r in known.items()}
        kept = sorted(known, key=lambda i: (-score[i], i))[:60]
        score = {i: score[i] for i in kept} | {p: 0.0 for i in kept for p in parents(known[i]) if p not in kept}
        order = sorted(score, key=lambda i: (-score[i], i))
        chosen = [i for kind in ("function", "class", "file") for i in [i for i in order if known[i]["entity_type"] == kind][:3]]
        for rank, i in enumerate(chosen + [i for i in order if known[i]["entity_type"] == "function" and i not in chosen], 1):
            want[issue, i] = (rank, score[i])
    got = queries.localise_issues(spark, SF).collect()
    assert {(r["issue"], r["id"]): r["final_rank"] for r in got} == {k: rank for k, (rank, _) in want.items()}
    assert all(abs(r["score"] - want[r["issue"], r["id"]][1]) < 1e-6 for r in got)
    parts = [int(r["file_path"][1:-3]) for r in known.values() if r["entity_type"] == "file"]
    for r in got:
        kind, _, k = r["name"].partition("_")
        assert r["callees"] == ([f"helper_{int(k) % 5 + 1}"] if kind == "run" else [])
        assert r["callers"] == (sorted(f"run_{p}" for p in parts if p % 5 + 1 == int(k)) if kind == "helper" else [])
