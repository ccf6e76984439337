"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token counts; only the number of pieces of each length matters
to the packing, and there are at most ``capacity`` lengths, so the plan is made
on the driver from a histogram whose size does not depend on the input. The
reduction fixes the sets that provably dominate every alternative for the
longest piece left; the rest is packed best fit, longest first. Pieces find
their places by their rank among the pieces of equal length: a count in each
partition, a running sum over partitions, and a search in the plan's ranges.

Null and empty texts are documents of only the end id. Repeated rows are packed
once each. Null document ids are kept. An empty table gives no row. Only the id
and text columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._util import checkpointed, rows_of, tidy
from codeloom.llm.tokens import CACHE_BYTES, encoder


class _Counts:
    """How many pieces of each length are left, with ordered lengths."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else None

    def smallest(self, k: int) -> int:
        """Sum of the k smallest pieces left; beyond any capacity if there are fewer."""
        total = 0
        for x in self.lengths:
            m = min(k, self.n[x])
            total += m * x
            k -= m
            if not k:
                return total
        return 1 << 60


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often, lengths left). For the longest piece j, with room r
    beside it, a set is fixed if each other set that holds j can be split into parts
    that fit into its pieces: j alone if nothing fits; j and a piece of exactly r; j
    and the largest piece that fits, if two never fit or if it is as long as any two
    that fit; j, that piece and a second one, if three never fit and the second is
    the largest that any pair could hold."""
    left, fixed = _Counts(counts), []

    def fix(j: int, others: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in (j, *others):
            need[x] += 1
        k = min(left.n[x] // m for x, m in need.items())
        for x, m in need.items():
            left.take(x, m * k)
        fixed.append(((j, *others), k))

    def proven(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        usable = left if left.n[j] else _without(left, j)
        a = usable.largest(room)
        if a is None:
            return ()
        if a == room or usable.smallest(2) > room:
            return (a,)
        if usable.smallest(3) > room and (pair := _best_pair(usable, room)):
            if a >= pair[2]:
                return (a,)
            if pair[0] == a and pair[1] >= pair[3]:
                return (a, pair[1])
        return None

    changed = True
    while changed:  # what is fixed may prove more: passes until one fixes nothing
        changed = False
        for j in sorted(left.lengths, reverse=True):
            while j in left.n:
                alone = left.n[j]
                left.n[j] -= 1  # the piece itself is not beside itself
                others = proven(j)
                left.n[j] = alone
                if others is None:
                    break
                fix(j, others)
                changed = True
    return fixed, dict(left.n)


def _without(left: _Counts, j: int) -> _Counts:
    view = _Counts({})
    view.n, view.lengths = left.n, [x for x in left.lengths if x != j]
    return view


def _best_pair(c: _Counts, room: int) -> tuple[int, int, int, int] | None:
    """Of the largest first piece the largest second one, the largest sum of a pair,
    and the largest second (smaller) piece of any pair."""
    first = second = total = most_second = 0
    for x in c.lengths:
        if x > room:
            break
        y = c.largest(min(room - x, x if c.n[x] > 1 else x - 1))
        if y is None:
            continue
        total, most_second = max(total, x + y), max(most_second, y)
        first, second = x, y
    largest = c.largest(room)
    return (first, second, total, most_second) if total and first == largest else ((0, 0, total, most_second) if total else None)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece to the fullest sequence that still takes it; equal
    sequences are handled together. (contents, how many)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, contents: tuple[int, ...], k: int) -> None:
        if room not in open_ or not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append((contents, k))

    done = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length  # new sequences; best fit fills one before the next
                full, rest = divmod(left, each)
                for times, k in ((each, full), (rest, 1)):
                    if times and k:
                        put(capacity - times * length, (length,) * times, k)
                break
            room = rooms[i]
            contents, k = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            times = room // length
            whole = min(k, left // times) if times <= left else 0
            if whole:
                put(room - times * length, contents + (length,) * times, whole)
                left -= whole * times
                k -= whole
            if k and left and left < times:
                put(room - left * length, contents + (length,) * left, 1)
                left, k = 0, k - 1
            if k:
                put(room, contents, k)
    for held in open_.values():
        done += held
    return done


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length its ranges (first rank, first sequence, offset), and how many
    sequences there are. Fixed sets first."""
    fixed, rest = reduce_instance(counts, capacity)
    patterns = fixed + best_fit(rest, capacity)
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for contents, k in patterns:
        offset = 0
        for length in contents:
            ranges[length].append((used[length], base, offset))
            used[length] += k
            offset += length
        base += k
    return {x: np.array(v, dtype=np.int64) for x, v in ranges.items()}, base


def token_pieces(df: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep_caches=True)
        enc, end = encoder(vocabulary, cache_bytes), np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for keys, texts in rows_of(batch, 1 << 20):
                out: list[tuple] = []
                for key, found in zip(keys, enc.encode_all(texts), strict=True):
                    ids = found + end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        out.append((key, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text").mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


def pack_pieces(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = df.sparkSession
    pieces = checkpointed(token_pieces(df, vocabulary, capacity, end_id, id_col, text_col, cache_bytes))
    per_part = pieces.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    ranges, _ = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(ranges)  # as large as the plan, which the capacity bounds
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = pieces.join(ranks, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        by_length = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            seq, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)].astype(int), strict=True):
                at = order[a:b]
                table = by_length[int(length[at[0]])]
                k = np.searchsorted(table[:, 0], rank[at], side="right") - 1
                seq[at] = table[k, 1] + rank[at] - table[k, 0]
                offset[at] = table[k, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(5)] + [pa.array(seq), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
