"""Vector retrieval, file scores, candidate filters, parent completion, final ranking.

Queries and entities are tables, so many issues are served by one job. Ties are
broken by id everywhere, which makes results reproducible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from codeloom.functions.text import is_test_entity, lines_between
from codeloom.functions.vectors import boost, inner_product

BROADCAST_BYTES = 32 << 20
PART_ROWS = 50_000  # entities of a part that meets all queries
FEW_QUERIES = 512  # up to so many go to the entities where they are
BLOCK_QUERIES, TASKS = 2048, 48  # queries that one pass over entities serves; tasks that the passes are dealt over at least
CELLS, PENDING = 1 << 22, 1 << 21  # scores held at a time; candidates after which only the best are kept


def similarities(queries: DataFrame, entities: DataFrame, within: str | None = None) -> DataFrame:
    """Every stated query against every entity: ``queries`` (issue, q), ``entities`` with id
    and embedding; or against those with its value of ``within``, a column of both. A query
    set whose measured bytes are few is broadcast; a larger one is sent to parts of the
    entities, which are moved once."""
    size = queries.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = entities.join(F.broadcast(queries), within) if within else entities.crossJoin(F.broadcast(queries))
    else:
        parts = -(-entities.count() // PART_ROWS)
        sent = queries.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, parts - 1)).cast("long"))))
        met = entities.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(max(1, parts)))).join(sent, ["_part", within] if within else ["_part"]).drop("_part")
    return met.withColumn("score", inner_product(F.col("embedding"), F.col("q"))).drop("embedding", "q")


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: (rows, matrix) of the vectors that are whole; those that are or hold nulls have length -1."""
    n = len(vectors)
    start, end = vectors.offsets.to_numpy()[:-1], vectors.offsets.to_numpy()[1:]
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), end - start, -1)
    if vectors.values.null_count:
        absent = np.r_[0, np.cumsum(vectors.values.is_null().to_numpy(zero_copy_only=False))]
        size = np.where(absent[end] > absent[start], -1, size)
    out = {}
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        whole = len(rows) == n and length > 0 and end[-1] - start[0] == n * length
        out[length] = rows, flat[start[0] : end[-1]].reshape(n, length) if whole else flat[start[rows][:, None] + np.arange(max(length, 0))]
    return out


class _Best:
    """The best ``k`` entities of each query of a block, while entities pass by. Products of
    matrices tell which may be among them; only those are scored as ``inner_product`` does,
    component by component, so results do not depend on the way. Scores are ordered as in
    Spark: NaN first, none last, ties by id."""

    def __init__(self, queries: pa.StructArray, vectors: pa.ListArray, k: int, id_at: int):
        self.queries, self.k, self.id_at = queries, k, id_at
        n = len(queries)
        self.parts = _by_length(vectors)
        self.least = np.full(n, -np.inf)  # no result that is still missing scores less
        self.got = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # query, score, entity
        self.fresh: list[tuple] = []
        self.pending = 0
        self.none = {length: np.zeros(0, np.int64) for length in self.parts}  # entities without a score for these queries
        self.held: pa.StructArray | None = None

    def add(self, entities: pa.StructArray, vectors: pa.ListArray) -> None:
        base = len(self.held) if self.held is not None else 0
        self.held = pa.concat_arrays([self.held, entities]) if base else entities
        found = _by_length(vectors)
        for length, (mine, q) in self.parts.items():
            lost = [rows for other, (rows, _) in found.items() if other != length or length < 0]
            if lost:
                self.none[length] = self.first_ids(np.concatenate([self.none[length], *[base + r for r in lost]]))
            if length >= 0 and length in found:
                rows, e = found[length]
                step = max(1, CELLS // len(mine))
                for at in range(0, len(rows), step):
                    self.score(mine, q, base + rows[at : at + step], e[at : at + step])
        if self.pending or len(self.held) > PENDING:
            self.keep_best()

    def first_ids(self, at: np.ndarray) -> np.ndarray:
        return at[np.argsort(self.ranks(at), kind="stable")][: self.k]

    def ranks(self, at: np.ndarray) -> np.ndarray:
        ids = self.held.field(self.id_at).take(pa.array(at))
        return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()

    def score(self, mine: np.ndarray, q: np.ndarray, rows: np.ndarray, e: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            lengths = np.sqrt((q * q).sum(1)), np.sqrt((e * e).sum(1).max(initial=0))
            most = lengths[0].max(initial=0) * lengths[1]
            small = most < 1e30 and max(lengths[0].max(initial=0), lengths[1]) < 1e30
            kind = np.float32 if small else np.float64
            near = q.astype(kind) @ e.astype(kind).T
            # Bound of the errors of both sums, with room for what underflows.
            slack = lengths[0] * lengths[1] * (q.shape[1] + 8) * 4 * np.finfo(kind).eps + 1e-30
            least = self.least[mine]
            new = least == -np.inf
            if new.any() and len(rows) >= self.k:
                kth = np.partition(near[new], len(rows) - self.k, axis=1)[:, len(rows) - self.k].astype(np.float64)
                least[new] = np.where(np.isnan(kth), -np.inf, kth - 2 * slack[new])
            x, y = np.nonzero(~(near < (least - slack)[:, None]))
            for at in range(0, len(x), 1 << 17):
                i, j = x[at : at + (1 << 17)], y[at : at + (1 << 17)]
                terms = q[i] * e[j]
                exact = np.zeros(len(i))
                for d in range(terms.shape[1]):
                    exact += terms[:, d]
                stay = ~(exact < least[i])
                self.fresh.append((mine[i[stay]], exact[stay], rows[j[stay]]))
                self.pending += int(stay.sum())
            self.least[mine] = least
        if self.pending > max(PENDING, len(self.queries) * self.k // 2):
            self.keep_best(prune=False)

    def keep_best(self, prune: bool = True) -> None:
        no, score, entity = (np.concatenate(c) for c in zip(self.got, *self.fresh, strict=True))
        self.fresh, self.pending = [], 0
        nan = np.isnan(score)
        order = np.lexsort((self.ranks(entity), -np.where(nan, np.inf, score), ~nan, no))
        no, score, entity = no[order], score[order], entity[order]
        first = np.r_[True, no[1:] != no[:-1]] if len(no) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(no)), 0))
        place = np.arange(len(no)) - begin
        last = place == self.k - 1
        kth = np.where(np.isnan(score[last]), np.inf, score[last])
        self.least[no[last]] = np.maximum(self.least[no[last]], kth)
        stay = place < self.k
        self.got = no[stay], score[stay], entity[stay]
        if prune:  # rows of entities that are in no list go
            used = np.unique(np.concatenate([self.got[2], *self.none.values()]))
            self.held = self.held.take(pa.array(used))
            self.got = *self.got[:2], np.searchsorted(used, self.got[2])
            self.none = {length: np.searchsorted(used, at) for length, at in self.none.items()}

    def results(self, names: list[str], most: int = 50_000) -> Iterator[pa.RecordBatch]:
        if self.held is None:
            return
        self.keep_best()
        no, score, entity = self.got
        have = np.bincount(no, minlength=len(self.queries))
        valid = np.ones(len(no), bool)
        for length, at in self.none.items():
            short = self.parts[length][0]
            short = short[have[short] < self.k]
            if len(at) and len(short):
                no, entity = np.r_[no, np.repeat(short, len(at))], np.r_[entity, np.tile(at, len(short))]
                score, valid = np.r_[score, np.zeros(len(no) - len(score))], np.r_[valid, np.zeros(len(no) - len(valid), bool)]
        for at in range(0, len(no), most):
            cut = slice(at, at + most)
            q, e = self.queries.take(pa.array(no[cut])), self.held.take(pa.array(entity[cut]))
            yield pa.RecordBatch.from_arrays([*q.flatten(), *e.flatten(), pa.array(score[cut], mask=~valid[cut])], names=names)


def nearest(queries: DataFrame, entities: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """``top_k(similarities(queries, entities), k)`` without a row for each pair: blocks of
    queries meet groups of entities, and only the best of each leave. A few queries go to
    the entities; more are dealt in blocks, to which the entities are sent."""
    n = queries.count()
    both_float = all(isinstance(df.schema[c].dataType, ArrayType) and isinstance(df.schema[c].dataType.elementType, FloatType) for df, c in ((queries, "q"), (entities, "embedding")))
    vector = "array<float>" if both_float else "array<double>"
    asked, own = [c for c in queries.columns if c != "q"], [c for c in entities.columns if c != "embedding"]
    schema = StructType([*[queries.schema[c] for c in asked], *[entities.schema[c] for c in own], StructField("score", DoubleType())])
    schema = StructType([StructField(f.name, f.dataType) for f in schema.fields])  # all may be null
    names, id_at = [f.name for f in schema.fields], own.index(id_col)
    q = queries.select(F.col("q").cast(vector).alias("v"), F.struct(*asked).alias("asked"))
    e = entities.select(F.col("embedding").cast(vector).alias("v"), F.struct(*own).alias("own"))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value.combine_chunks().to_batches()[0]
        best = _Best(rows.column(1), rows.column(0), k, id_at)
        for batch in batches:
            best.add(batch.column(1), batch.column(0))
        yield from best.results(names)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asking, best = None, [], None
        for batch in batches:
            tasks, entity = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(entity) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                some = batch.slice(a, b - a)
                if tasks[a] != task:
                    if best:
                        yield from best.results(names)
                    task, asking, best = tasks[a], [], None
                if not entity[a]:  # a task's queries come first
                    asking.append(some)
                elif asking or best:
                    if asking:
                        best = _Best(pa.concat_arrays([x.column(3) for x in asking]), pa.concat_arrays([x.column(2) for x in asking]), k, id_at)
                        asking = []
                    best.add(some.column(4), some.column(2))
        if best:
            yield from best.results(names)

    if n <= FEW_QUERIES:
        sent = queries.sparkSession.sparkContext.broadcast(q.toArrow())  # FEW_QUERIES rows at most
        found = e.mapInArrow(few, schema) if n else queries.sparkSession.createDataFrame([], schema)
    else:
        blocks = -(-n // BLOCK_QUERIES)
        groups = -(-TASKS // blocks)
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        of_block = q.withColumn("block", F.pmod(F.xxhash64(*[f"asked.{c}" for c in asked]), F.lit(blocks)).cast("int")).withColumn("group", each(groups))
        of_group = e.withColumn("group", F.pmod(F.xxhash64(F.col(f"own.{id_col}"), F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", each(blocks))
        task = (F.col("block") * groups + F.col("group")).alias("task")
        both = of_block.select(task, F.lit(0).alias("entity"), "v", "asked", none(e, "own")).unionByName(of_group.select(task, F.lit(1).alias("entity"), "v", none(q, "asked"), "own"))
        dealt = both.repartitionById(blocks * groups, "task").sortWithinPartitions("task", "entity")
        found = dealt.mapInArrow(many, schema)
    return top_k(found, k, id_col=id_col)


def top_k(scored: DataFrame, k: int | Column, partition: str = "issue", id_col: str = "id") -> DataFrame:
    order = Window.partitionBy(partition).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def single_query_top_k(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def file_scores(scored: DataFrame, entities: int = 200, files: int = 5) -> DataFrame:
    """Best boosted score of each file among an issue's best entities, not under 0."""
    best = top_k(scored, entities)
    per_file = best.groupBy("issue", "file_path").agg(F.greatest(F.lit(0.0), F.max(boost(F.col("score"), F.col("entity_type")))).alias("score"))
    return top_k(per_file, files, id_col="file_path")


def group_by_file(scored: DataFrame) -> DataFrame:
    """Per file its entities by score, and the best score as the file's."""
    entry = F.struct(F.col("score"), F.col("id"), F.col("name"))
    return scored.groupBy("issue", "file_path").agg(F.sort_array(F.collect_list(entry), asc=False).alias("entities"), F.max("score").alias("file_score"))


def without_tests(ranked: DataFrame, k: int) -> DataFrame:
    """Of rows with issue, is_test_related, rank: over-fetched test entities go, unless the
    issue is about tests (then its first k stay) or nothing would be left; then k."""
    keep = F.col("is_test_related") | ~is_test_entity(F.col("file_path"), F.col("name"))
    fetched = ranked.filter(F.col("rank") <= F.when(F.col("is_test_related"), F.lit(k)).otherwise(F.lit(k + 10)))
    any_kept = F.max(keep).over(Window.partitionBy("issue"))
    stayed = fetched.withColumns({"_keep": keep, "_any": any_kept}).filter(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")
    again = Window.partitionBy("issue").orderBy("rank")
    return stayed.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k)


def capped_by_type(candidates: DataFrame, cap: int = 20) -> DataFrame:
    order = Window.partitionBy("issue", "entity_type").orderBy(F.desc("score"), "id")
    return candidates.withColumn("type_rank", F.row_number().over(order)).filter(F.col("type_rank") <= cap)


def with_parents(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds with score 0.0 the parents (child, id, entity_type, name, file_path) that an
    issue's candidates lack: classes and files of its functions, files of its classes."""
    found = candidates.select("issue", F.col("id").alias("child"), F.col("entity_type").alias("child_type"))
    missing = found.join(parents, "child").filter((F.col("child_type") == "function") | ((F.col("child_type") == "class") & (F.col("entity_type") == "file")))
    missing = missing.select("issue", "id", "entity_type", "name", "file_path").dropDuplicates(["issue", "id"]).join(candidates.select("issue", "id"), ["issue", "id"], "left_anti")
    return candidates.unionByName(missing.withColumn("score", F.lit(0.0)), allowMissingColumns=True)


def default_selection(candidates: DataFrame, per_type: int = 3) -> DataFrame:
    """A deterministic selector: the best of each type, with position and reason."""
    best = capped_by_type(candidates, per_type)
    return best.select("issue", "id", F.col("type_rank").alias("pos"), F.format_string("score %.4f", "score").alias("reason"))


def default_ranking(candidates: DataFrame, per_type: int = 3) -> DataFrame:
    """``final_ranking`` by ``default_selection`` in one pass, as a rank within the type tells what is selected."""
    order = Window.partitionBy("issue", "entity_type").orderBy(F.desc("score"), "id")
    placed = candidates.withColumn("_place", F.row_number().over(order))
    chosen = F.col("_place") <= per_type
    return _ordered(placed.withColumns({"pos": F.when(chosen, F.col("_place")), "reason": F.when(chosen, F.format_string("score %.4f", "score"))}).drop("_place"))


def final_ranking(candidates: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected ones first (functions, classes, files, in the selector's order), then the
    other functions by score. Other classes and files are left out."""
    return _ordered(candidates.join(selection, ["issue", "id"], "left"))


def _ordered(joined: DataFrame) -> DataFrame:
    priority = F.when(F.col("entity_type") == "class", 1).when(F.col("entity_type") == "file", 2).otherwise(0)
    stay = joined.filter(F.col("pos").isNotNull() | (priority == 0))
    chosen = F.col("pos").isNotNull()
    order = Window.partitionBy("issue").orderBy(F.desc(chosen), F.when(chosen, priority), F.col("pos"), F.desc("score"), "id")
    return stay.withColumn("final_rank", F.row_number().over(order))


def with_code(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``code`` from files (file_path, content): a file's whole text, others' lines; where
    there is none, docstring and signature."""
    joined = candidates.join(files.select("file_path", "content"), "file_path", "left")
    cut = F.when(F.col("entity_type") == "file", F.col("content")).otherwise(lines_between(F.col("content"), F.col("start_line"), F.col("end_line")))
    said = F.concat_ws("\n", "docstring", "signature")
    return joined.withColumn("code", F.when(F.trim(F.coalesce(cut, F.lit(""))) != "", cut).otherwise(said)).drop("content")


def comment_candidates(ranked: DataFrame, most: int = 3) -> DataFrame:
    """The functions that a comment names, with ``rank``: those with a reason in the selector's
    order, then the others by score."""
    reasoned = F.coalesce(F.col("reason"), F.lit("")) != ""
    order = Window.partitionBy("issue").orderBy(F.desc(reasoned), F.when(reasoned, F.col("final_rank")), F.desc("score"), "id")
    return ranked.filter(F.col("entity_type") == "function").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def snippet_budget(scored: DataFrame, most: int = 10) -> DataFrame:
    """Adds ``has_snippet``: an issue's first functions have one, by file (best score first), then score."""
    best = F.max("score").over(Window.partitionBy("issue", "file_path"))
    order = Window.partitionBy("issue").orderBy(F.desc("_best"), "file_path", F.desc("score"), "id")
    return scored.withColumn("_best", best).withColumn("has_snippet", F.row_number().over(order) <= most).drop("_best")


def min_max(scored: DataFrame, partition: str = "issue") -> DataFrame:
    """Adds ``norm``, the score between the partition's least (0) and largest (1); 1 if all are equal."""
    w = Window.partitionBy(partition)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def fallback_ranking(candidates: DataFrame, k: int = 10) -> DataFrame:
    return top_k(candidates, k).withColumnRenamed("rank", "final_rank")


def store_stats(entities: DataFrame) -> DataFrame:
    return entities.agg(F.max(F.size("embedding")).alias("dimension"), F.count("embedding").alias("vectors"), F.count(F.lit(1)).alias("rows"))
