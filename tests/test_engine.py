"""Operators on literal rows; all registered queries against their SQL."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codeloom.functions import render, text, vectors
from codeloom.operators import evaluation, graph, incremental, parsing, retrieval, telemetry
from codeloom.plans import queries, workflows
from codeloom.sources import repository
from codeloom.streaming import events

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    dirty = "# Title\nSee [docs](http://a.b/c) `x=1` <b>bold</b> http://x.y/z café!\n```\ncode\n```"
    assert one(spark, text.clean_text(F.lit(dirty))) == "Title See docs bold café!"
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.long_enough(F.lit("one two three four"))) is False
    assert one(spark, text.stable_id(F.lit("o/r"), F.lit("a/b.py"), F.lit("f"), F.lit(3))) == "81878c0bff6a7bd3"
    assert [one(spark, text.normal_path(F.lit(p))) for p in ("a/./b//c", "a/../b", "../a", "", "/../a")] == ["a/b/c", "b", "../a", ".", "/a"]
    assert one(spark, text.fenced_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(spark, text.lines_between(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, text.literal_list(F.lit("['a', 'b']"))) == ["a", "b"]
    assert one(spark, text.hunk_entity(F.lit("public int size(String a) {"), F.lit("java")))["name"] == "size"
    assert one(spark, text.is_test_entity(F.lit("tests/x.py"), F.lit("f"))) is False
    assert one(spark, text.is_test_entity(F.lit("src/tests/x.py"), F.lit("f"))) is True


def test_vectors_and_rendering(spark):
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    v = one(spark, vectors.hashed_embedding(F.lit("alpha beta alpha"), 16))
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert one(spark, render.permalink(F.lit("o"), F.lit("r"), F.lit("main"), F.lit("a.py"), F.lit(10), F.lit(20))).endswith("a.py#L10-L20")
    assert one(spark, render.permalink(F.lit(""), F.lit("r"), F.lit("main"), F.lit("a.py"), F.lit(1), F.lit(1))) == ""
    assert one(spark, render.code_fence(F.lit("  "), F.lit("python"), F.lit(1), F.array(F.lit(1)))) == ""


def test_metrics_of_the_worked_example(spark):
    p = spark.createDataFrame([(1, 1, "a.py"), (1, 2, "b.py")], "issue long, pos int, value string")
    g = spark.createDataFrame([(1, "src/a.py"), (1, "c.py"), (2, "z.py")], "issue long, value string")
    m = {r["issue"]: r for r in evaluation.metrics_at_k(p, g, [2]).collect()}
    assert (m[1]["tp"], m[1]["recall"], m[1]["precision_raw"], m[1]["precision_ref"]) == (1, 0.5, 0.5, 1.0)
    assert abs(m[1]["f1"] - 2 / 3) < 1e-9 and m[2]["hit"] == 0 and m[2]["all_incorrect"] == 1
    assert {r["issue"]: r["ap"] for r in evaluation.average_precision(p, g).collect()} == {1: 0.5, 2: 0.0}


def test_file_score_floor_and_boost(spark):
    rows = [(1, 1, "f.py", "function", 0.5), (1, 2, "f.py", "class", 0.45), (1, 3, "f.py", "file", 0.42), (1, 4, "g.py", "file", -0.5)]
    s = retrieval.file_scores(spark.createDataFrame(rows, "issue long, id long, file_path string, entity_type string, score double"))
    assert {r["file_path"]: round(r["score"], 6) for r in s.collect()} == {"f.py": 0.504, "g.py": 0.0}


def test_test_filter_reverts_when_nothing_is_left(spark):
    rows = [(1, i, "a/tests/x.py", "f", False, i) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "issue long, id long, file_path string, name string, is_test_related boolean, rank int")
    assert retrieval.without_tests(df, 2).count() == 2


def test_similarities_in_blocks_are_the_same(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, embedding array<float>")
    q = e.filter("id < 4").select(F.col("id").alias("issue"), F.col("embedding").alias("q"))
    whole = {tuple(r) for r in retrieval.similarities(q, e).select("issue", "id", "score").collect()}
    old = retrieval.BROADCAST_BYTES, retrieval.PART_ROWS
    try:
        retrieval.BROADCAST_BYTES, retrieval.PART_ROWS = 0, 2
        assert whole == {tuple(r) for r in retrieval.similarities(q, e).select("issue", "id", "score").collect()}
    finally:
        retrieval.BROADCAST_BYTES, retrieval.PART_ROWS = old


def test_latency_percentiles_by_index(spark):
    df = spark.createDataFrame([("r", 1000.0 + 100 * i, True) for i in range(10)] + [("r", 9.0, False)], "repo string, ms double, ok boolean")
    r = telemetry.latency_stats(df, ["repo"], "ms", F.col("ok")).first()
    assert (r["total"], r["successful"], r["median_latency"], r["p95_latency"]) == (11, 10, 1500.0, 1900.0)


def test_registry_keeps_the_place_of_a_known_commit(spark):
    cols = "repo string, commit_sha string, indexed_at string, seq long"
    old = spark.createDataFrame([("a", "c1", "1", 1), ("a", "c2", "2", 2)], cols)
    new = spark.createDataFrame([("a", "c1", "9", None), ("a", "c3", "3", None), ("b", "c1", "1", None)], cols)
    got = {(r["repo"], r["commit_sha"]): (r["seq"], r["indexed_at"]) for r in incremental.register(old, new).collect()}
    assert got == {("a", "c1"): (1, "9"), ("a", "c2"): (2, "2"), ("a", "c3"): (3, "3"), ("b", "c1"): (1, "1")}
    assert one(spark, incremental.strategy(F.lit(True), F.lit(True), F.lit(50))) == "incremental"
    assert one(spark, incremental.strategy(F.lit(True), F.lit(True), F.lit(51))) == "full"


def test_name_status_lines(spark):
    df = spark.createDataFrame([("r", x) for x in ("A\ta.py", "M\tb.java", "D\tc.py", "R100\td.py\te.py", "A\tf.txt")], "repo string, line string")
    got = {(r["status"], r["path"]) for r in incremental.parse_name_status(df).collect()}
    assert got == {("A", "a.py"), ("M", "b.java"), ("D", "c.py"), ("M", "e.py")}


PYTHON = 'import os\nfrom a import b\n\ndef outer(x):\n    """Says so."""\n    def inner():\n        return one()\n    return inner() + two(x)\n\nclass A:\n    def m(self):\n        return outer(1)\n    @property\n    def p(self):\n        return 2\n'
JAVA = "import java.util.List;\n/** A box. */\npublic class Box {\n  // size()\n  private int n;\n  public Box(int n) { this.n = n; }\n  /** How many. */\n  public int size(String s) throws E {\n    return other.count(n);\n  }\n}\ninterface Can { void go(int x); }\n"


def test_python_parser():
    functions, classes, imports, calls = parsing.parse_python(PYTHON)
    assert [(f["name"], f["start_line"], f["end_line"], f["class_name"]) for f in functions] == [("outer", 4, 8, None), ("inner", 6, 7, None), ("m", 11, 12, "A"), ("p", 14, 15, "A")]
    assert functions[0]["docstring"] == "Says so." and functions[0]["signature"].startswith("def outer(x)")
    assert classes[0]["functions"] == ["m"] and len(imports) == 2
    assert "two" in calls["outer"] and "one" not in calls["outer"] and "one" in calls["inner"]


def test_broken_python_and_java():
    functions, classes, _, _ = parsing.parse_python("class A:\n    def f(self:\n        return 1\n\ndef g(x):\n    return (\n")
    assert [(f["name"], f["class_name"]) for f in functions] == [("f", "A"), ("g", None)] and classes[0]["name"] == "A"
    functions, classes, imports, calls = parsing.parse_java(JAVA)
    assert [(f["name"], f["class_name"], f["docstring"]) for f in functions] == [("size", "Box", "How many."), ("go", "Can", None)]
    assert [(c["name"], c["class_type"]) for c in classes] == [("Box", "class"), ("Can", "interface")]
    assert imports == ["import java.util.List;"] and calls["size"] == ["count"]


def test_index_localise_and_update(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in (("src/a.py", "def load_table(x):\n    return x\n"), ("src/b.py", "def main():\n    return load_table(1)\n"), ("build/c.py", "def no():\n    pass\n"), ("src/d.txt", "x")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    files = repository.read_repository(spark, str(root), "o/r")
    assert {r["path"] for r in files.select("path").collect()} == {"src/a.py", "src/b.py"}
    found, edges = workflows.index_repository(files)
    assert found.filter("entity_type = 'function'").count() == 2
    assert edges.filter("rel = 'CALLS'").count() == 1
    issues = spark.createDataFrame([(1, "load_table fails with a wrong number", "see load_table in module a", False), (2, "too short", "", False)], "issue long, title string, body string, is_test_related boolean")
    ranked = workflows.localise(issues, found, edges)
    assert {r["issue"] for r in ranked.select("issue").distinct().collect()} == {1}
    new = files.withColumn("content", F.when(F.col("path") == "src/a.py", "def loaded(x):\n    return x\n").otherwise(F.col("content")))
    after = workflows.update_index(found, files, new)
    full, full_edges = workflows.index_repository(new)
    rows = lambda df: {tuple(r) for r in df.select("repo", "src", "dst", "rel").collect()}
    assert rows(workflows.update_graph(edges, files, new)) == rows(full_edges) != rows(edges)
    assert workflows.update_graph(edges, files, files).exceptAll(edges).count() == 0
    key = lambda df: {(r["id"], r["name"]) for r in df.select("id", "name").collect()}
    assert key(after) == key(full)


def test_graph_of_equal_names(spark):
    calls = spark.createDataFrame([("r", "1", "f")], "repo string, caller string, callee string")
    fns = spark.createDataFrame([("r", "2", "f"), ("r", "3", "f"), ("s", "4", "f")], "repo string, id string, name string")
    assert graph.call_edges(calls, fns).count() == 2


def test_event_stream(spark, tmp_path):
    rows = [{"event": "push", "ref": "refs/heads/main", "repo": "a"}, {"event": "push", "ref": "refs/heads/x", "repo": "b"}, {"event": "issues", "action": "opened", "repo": "c", "issue_number": 1}, {"event": "installation", "action": "deleted", "repo": "d"}]
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    seen = {}
    handlers = {r: lambda df, n, r=r: seen.setdefault(r, []).extend(x["repo"] for x in df.collect()) for r in ("index", "localise", "remove")}
    q = events.process(events.event_stream(spark, str(source)), handlers, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == {"index": ["a"], "localise": ["c"], "remove": ["d"]}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda d: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_streamed_windows_and_state(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("2024-01-01 00:05:00", "view", 2.0), ("2024-01-01 00:50:00", "view", 4.0), ("2024-01-02 00:00:00", "view", 9.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = events.telemetry_windows(stream, width="1 hour", slide="1 hour").writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n"], r["avg_value"], r["max_value"]) for r in spark.read.parquet(sink).collect()] == [(2, 3.0, 4.0)]
    got = []
    q = events.last_n_per_key(stream, 2).writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp2")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == [("view", 2, 9.0)]


def test_embedding_reads_the_whole_text(spark):
    row = spark.createDataFrame([("a " * 1500,)], "t string").select(*[vectors.hashed_embedding(x).alias(n) for n, x in (("short", F.col("t")), ("long", F.concat("t", F.lit("zebra " * 2000))))]).first()
    assert row["short"] != row["long"]


def test_rendering_parts(spark):
    c = lambda x: F.lit(x)
    assert [one(spark, render.highlight_name(c(p))) for p in ("a.py", "A.java", "a.c")] == ["python", "java", ""]
    lines = one(spark, render.with_context(F.array(c("x")), c(2), c(1)))
    assert len(lines) == 3 and lines[1] == "x"
    assert one(spark, render.with_context(F.array(c("x")), c(0), c(0))) == ["x"]
    section = one(spark, render.entity_section(c("f"), c("function"), c("a.py"), c(0.456), c("u"), c("why")))
    assert "`f`" in section and "0.46" in section and section.endswith("why")
    assert one(spark, render.entity_section(c("f"), c("function"), c("a.py"), c(0.5), c("u"), c(""))).endswith("0.50")
    prompt = one(spark, render.prompt_candidate(c("1"), c("function"), c("a.py"), F.lit(None).cast("string"), c("f"), c("x" * 2000)))
    assert prompt.startswith("ID: 1\nType: function") and prompt.count("x") == 1500
    assert "none" in one(spark, render.graph_context(c("f"), F.array().cast("array<string>"), F.array(c("g"))))
    assert "unknown error" in one(spark, render.error_comment(F.lit(None).cast("string")))
    assert one(spark, render.candidate_line(c(1), c("f"), c("a.py"), c(""))) == "1. **`f`** in `a.py`\n\n"


def test_small_functions(spark):
    c = F.lit
    assert one(spark, text.query_text(c("crash"), F.array(c("A"), c("B")), c("t"), c("b"))) == "crash A B"
    assert len(one(spark, text.query_text(F.lit(None).cast("string"), F.array().cast("array<string>"), c("t" * 300), c("b")))) == 200
    assert one(spark, text.safe_name(c("o/r"))) == "o_r"
    assert [one(spark, text.is_prose_file(c(p))) for p in ("README.md", "docs/a.TXT", "a.py")] == [True, True, False]
    assert one(spark, text.iso_utc(F.to_timestamp(c("2024-01-02 03:04:05")))) == "2024-01-02T03:04:05+00:00"
    assert one(spark, vectors.or_zero(F.lit(None).cast("array<float>"), 3)) == [0.0, 0.0, 0.0]
    assert one(spark, evaluation.tokens_used(F.lit(None).cast("int"), c(3), c(4))) == 7
    assert {"java", "python"} <= set(parsing.registered())
    assert [telemetry.range_interval(x) is not None for x in ("30m", "x")] == [True, True]
    assert one(spark, telemetry.index_percentile(F.array(*[c(float(i)) for i in range(10)]), 0.95)) == 9.0
    r = evaluation.entity_lists(spark.createDataFrame([(1, ["f", "g"], ["g", "C"], ["f"], ["f"])], "issue long, functions array<string>, classes array<string>, predicted_functions array<string>, predicted_classes array<string>")).first()
    assert r["truth"] == ["f", "g", "C"] and r["predicted"] == ["f", "f"]


def test_sources_and_sinks(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    df = spark.createDataFrame([("o/r", "1", "x"), ("o/s", "2", "y")], "repo string, id string, name string")
    repository.write_by_repo(df, at("index"))
    repository.write_by_repo(df.filter("repo = 'o/s'").withColumn("name", F.lit("z")), at("index"), emptied=["o/r"])
    assert [(r["repo"], r["name"]) for r in repository.read_index(spark, at("index")).collect()] == [("o/s", "z")]
    df.write.parquet(at("legacy"))
    assert {(r["repo"], r["name"]) for r in repository.read_index(spark, at("index"), at("legacy")).collect()} == {("o/r", "x"), ("o/s", "z")}
    runs = spark.createDataFrame([("o/r", "2024", 3, 4, 1.5, None), ("o/s", "2024", 0, 0, 0.1, "bad")], "repo_name string, timestamp string, files_indexed int, functions_count int, duration_seconds double, error string")
    found = spark.createDataFrame([(7, "o/r", "2024", 12.0, "high", None)], "issue long, repo_name string, timestamp string, latency_ms double, confidence string, success boolean")
    repository.append_json_lines(telemetry.indexing_events(runs), at("telemetry"))
    repository.append_json_lines(telemetry.retrieval_events(found, 10), at("telemetry"))
    rows = {(r["type"], r["repo_name"], r["success"], r["top_k"], r["error_msg"]) for r in repository.read_telemetry(spark, at("telemetry")).collect()}
    assert rows == {("indexing", "o/r", True, None, None), ("error", "o/s", False, None, "bad"), ("retrieval", "o/r", True, 10, None)}
    repository.write_state(df, at("state"))
    assert repository.read_state(spark, at("state"), "repo string, id string, name string").exceptAll(df).count() == 0
    df.limit(1).write.parquet(at("train"))
    df.withColumn("extra", F.lit(1)).write.parquet(at("test"))
    assert repository.read_splits(spark, [at("train"), at("test")]).count() in (3,)
    (tmp_path / "tree.json").write_text(json.dumps({"tree": [{"path": "a.py", "type": "blob", "size": 3}, {"path": "d", "type": "tree"}]}))
    assert [r["url"] for r in repository.read_tree_listing(spark, at("tree.json"), "https://x", "o/r", "main").collect()] == ["https://x/o/r/blob/main/a.py"]
    repository.write_report({"sheet": df}, at("report"))
    assert spark.read.option("header", True).csv(at("report/sheet")).count() == 2


def test_registry_graph_and_installations(spark):
    reg = spark.createDataFrame([("a", "c1", 1), ("a", "c2", 2), ("b", "c1", 1)], "repo string, commit_sha string, seq long")
    assert {(r["repo"], tuple(r["commits"])) for r in incremental.versions(incremental.without_version(reg, "a", "c1")).collect()} == {("a", ("c2",)), ("b", ("c1",))}
    assert incremental.without_version(reg, "a").count() == 1 and graph.without_repo(reg, "b").count() == 2
    edges = spark.createDataFrame([("r", "1", "2", "IMPORTS"), ("r", "3", "2", "CALLS")], "repo string, src string, dst string, rel string")
    assert [r["id"] for r in incremental.dependents(edges, spark.createDataFrame([("r", "2")], "repo string, id string")).collect()] == ["1"]
    imports = spark.createDataFrame([("r", "src/a.py", ["from lib.b import x", "import os.path", "from . import y"]), ("r", "src/B.java", ["import lib.b.C;"])], "repo string, path string, imports array<string>")
    assert {r["imported"] for r in graph.import_paths(imports).collect()} == {"lib/b", "os/path", "lib/b/C"}
    files = spark.createDataFrame([("r", "x", "my/lib/b.py"), ("r", "y", "lib/b/C.java"), ("s", "z", "lib/b.py")], "repo string, id string, file_path string")
    assert {r["dst"] for r in graph.module_edges(graph.import_paths(imports), files).collect()} == {"x", "y"}
    installs = spark.createDataFrame([("installation", "o/r", None, "x"), ("installation", "o/s", "dev", "x")], "event string, repo string, default_branch string, before string")
    assert [r["ref"] for r in events.as_pushes(installs).collect()] == ["refs/heads/main", "refs/heads/dev"]
    ranked = spark.createDataFrame([(1, k, "e", 1.0 - k / 10) for k in range(4)], "issue long, id long, name string, score double")
    assert [r["final_rank"] for r in retrieval.fallback_ranking(ranked, 2).collect()] == [1, 2]
    changes = spark.createDataFrame([("r", "a.py", "M"), ("r", "b.py", "A")], "repo string, path string, status string")
    known = spark.createDataFrame([("r", "1", "a.py"), ("r", "2", "c.py")], "repo string, id string, file_path string")
    assert [r["id"] for r in incremental.removed_ids(known, changes).collect()] == ["1"]


def test_evaluation_of_a_ranking(spark):
    ranking = spark.createDataFrame([(1, 1, "a.py"), (1, 2, "b.py"), (2, 1, "c.py")], "issue long, final_rank int, file_path string")
    truth = spark.createDataFrame([(1, "a.py"), (2, "z.py")], "issue long, value string")
    groups = spark.createDataFrame([(1, "r"), (2, "r")], "issue long, repo string")
    metrics, summary = workflows.evaluate(ranking, truth, groups)
    assert metrics.count() == 8
    assert {r["repo"]: (r["hit"], r["issues"]) for r in summary.collect()} == {"r": (0.5, 2), "Total": (0.5, 2)}


def test_comments(spark):
    ranked = spark.createDataFrame([(1, 1, "function", "f", "a.py", 0.9, 3, "", 2, 2), (1, 2, "function", "g", "b.py", 0.1, 1, "why", 5, 9), (1, 3, "class", "C", "b.py", 0.1, 2, "why", 1, 9)], "issue long, id long, entity_type string, name string, file_path string, score double, final_rank int, reason string, start_line int, end_line int")
    texts = spark.createDataFrame([(1, None, "h", ""), (2, "", None, None)], "issue long, analysis string, hypothesis string, plan string")
    got = {r["seq"]: r["body"] for r in workflows.comments(ranked, texts, "o", "r").collect()}
    assert set(got) == {1, 2} and got[2] == "## Analysis\n\n**Hypothesis:**\nh\n"
    assert got[1].index("`g`") < got[1].index("`f`") and "b.py#L5-L9" in got[1] and "a.py#L2)" in got[1] and "`C`" not in got[1]
