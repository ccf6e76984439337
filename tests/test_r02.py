"""Findings of round 2 about the retrieval queries."""

import re
import time

from pyspark.sql import functions as F

from codeloom.functions import text, vectors
from codeloom.operators import evaluation, graph, parsing, retrieval


def test_prompt_lines_lose_blanks_not_digits(spark):
    rows = [("a0\nb1  \nc2\t\n  \nd　",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(text.compact_prompt(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["a0\nb1\nc2\nd", ""]


def test_nearest_is_top_k_of_all_pairs(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    odd = [(9001, None), (9002, [1.0, None, 0.0]), (9003, [nan, 0.0, 1.0]), (9004, [inf, 1.0, 0.0]), (9005, [1.0]), (9006, [1e38, -1e38, 3.0]), (None, [0.5, 0.5, 0.5])]
    rows = [(i, [((i * 37) % 11) / 7, ((i * 53) % 13) / 3 - 1, float(i % 2)]) for i in range(400)] + odd
    e = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))).repartition(3)
    q = e.filter("id % 40 = 0 OR id > 9000").select(F.col("id").alias("issue"), F.col("embedding").alias("q"))
    text_ids = e.withColumn("id", F.col("name"))
    for entities, k in ((e, 1), (e, 25), (text_ids, 25), (e, 1000)):
        want = sorted(map(str, retrieval.top_k(retrieval.similarities(q, entities), k).select("issue", "id", "name", "score", "rank").collect()))
        for few, cells, pending, blocks in ((512, 1 << 22, 1 << 21, 2048), (0, 64, 50, 4)):
            for name, value in (("FEW_QUERIES", few), ("CELLS", cells), ("PENDING", pending), ("BLOCK_QUERIES", blocks)):
                monkeypatch.setattr(retrieval, name, value)
            got = retrieval.nearest(q, entities, k).select("issue", "id", "name", "score", "rank")
            assert sorted(map(str, got.collect())) == want
    assert retrieval.nearest(q.filter("false"), e, 3).count() == 0 and retrieval.nearest(q, e.filter("false"), 3).count() == 0


def test_default_ranking_is_the_selection_joined(spark):
    rows = [(i % 3, i, ("function", "class", "file")[i % 4 % 3], "n", "f", (i * 7 % 10) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "issue long, id long, entity_type string, name string, file_path string, score double")
    cols = ["issue", "id", "pos", "reason", "final_rank"]
    assert sorted(map(str, retrieval.default_ranking(df).select(cols).collect())) == sorted(map(str, retrieval.final_ranking(df, retrieval.default_selection(df)).select(cols).collect()))


def test_long_texts_are_embedded_in_short_time(spark):
    words = [f"w{i % 700}" for i in range(3000)]
    began = time.time()
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(vectors.hashed_embedding(F.col("t"), 64).alias("v"), F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h"))
    row = df.first()
    want = [0.0] * 64
    for h in row["h"]:
        want[h % 64] += 1.0 if h > 0 else -1.0
    size = sum(x * x for x in want) ** 0.5
    assert row["v"] == [x / size for x in want] and time.time() - began < 30


def test_files_are_parsed_in_pieces_and_leave_nothing(monkeypatch):
    import gc

    import pandas as pd

    monkeypatch.setattr(parsing, "PIECE_CHARS", 10)
    pdf = pd.DataFrame({"content": ["x" * 4, None, "x" * 40, "x"] + ["y"] * 600})
    pieces = list(parsing._pieces(pdf))
    assert pd.concat(pieces).equals(pdf) and max(map(len, pieces)) <= 256 and len(pieces) > 3
    gc.collect()
    gc.disable()
    try:
        functions = parsing.parse_python("def f(a):\n    return g(a)\n")[0]
        held = [x for x in gc.get_objects() if getattr(x, "__name__", "") == "walk" and getattr(x, "__module__", "") == parsing.__name__]
    finally:
        gc.enable()
    assert functions[0]["name"] == "f" and not held


def test_no_step_of_the_metrics_moves_rows_by_cut_off(spark):
    p = spark.createDataFrame([(1, 1, "a.py"), (1, 2, "b.py"), (3, 4, "c.py")], "issue long, pos int, value string")
    g = spark.createDataFrame([(1, "src/a.py"), (1, "c.py"), (2, "z.py"), (3, "c.py")], "issue long, value string")
    m = evaluation.metrics_at_k(p, g, [1, 3, 5])
    assert not re.search(r"hashpartitioning\(issue#\d+L?, k#", m._jdf.queryExecution().executedPlan().toString())
    assert {(r["issue"], r["k"], r["tp"], r["hit"], r["precision_raw"]) for r in m.collect()} == {(1, 1, 1, 1, 1.0), (1, 3, 1, 1, 0.5), (1, 5, 1, 1, 0.5), (2, 1, 0, 0, 0.0), (2, 3, 0, 0, 0.0), (2, 5, 0, 0, 0.0), (3, 1, 0, 0, 0.0), (3, 3, 0, 0, 0.0), (3, 5, 1, 1, 1.0)}


def test_call_edges_are_the_join_by_name(spark, monkeypatch):
    rows = [("r" if i % 3 else "s", None if i % 17 == 0 else str(i % 40), "hot" if i % 2 else f"f{i % 7}") for i in range(300)] + [(None, "1", "hot"), ("r", "1", None), ("t", "1", "hot"), ("r", "2", "none")]
    calls = spark.createDataFrame(rows, "repo string, caller string, callee string").repartition(3)
    fns = [("r" if i % 4 else "s", None if i == 9 else i % 50, "hot" if i % 3 else f"f{i % 7}") for i in range(60)] + [(None, 1, "hot"), ("r", 2, None), ("r", 3, "not called")]
    functions = spark.createDataFrame(fns, "repo string, id int, name string")
    plain = lambda c: c.join(functions.withColumnRenamed("name", "callee"), ["repo", "callee"]).select("repo", F.col("caller").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("rel"))
    for sizes in ((16, 1024, 256), (1, 2, 3), (3, 5, 1)):
        for name, value in zip(("SHARES", "CALLERS", "FUNCTIONS"), sizes, strict=True):
            monkeypatch.setattr(graph, name, value, raising=False)
        for once in (False, True):
            got, want = graph.call_edges(calls, functions, once), plain(calls.distinct() if once else calls)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert graph.call_edges(calls.filter("false"), functions).count() == 0 and graph.call_edges(calls, functions.filter("false"), True).count() == 0


def test_edges_take_little_room(spark, tmp_path):
    names = 16
    calls = spark.range(30000).select(F.lit("r").alias("repo"), F.xxhash64("id").alias("caller"), F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(names)).cast("string")).alias("callee"))
    functions = spark.range(names * 250).select(F.lit("r").alias("repo"), F.xxhash64("id").alias("id"), F.concat(F.lit("f"), (F.col("id") % names).cast("string")).alias("name"))
    graph.call_edges(calls, functions).select("src", "dst").write.parquet(str(tmp_path / "edges"))
    size = sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 30000 * 250 and size < 0.4 * 30000 * 250
