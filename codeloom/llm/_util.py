"""What the training-data operators share: shared-folder checkpoints and text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import compress
from operator import not_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

NULL_ID = (1 << 63) - 1  # a null id sorts behind every other id


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Where that is unset, a local folder is set if driver and executors are
    on one machine, as in tests; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; a lost executor only costs a reread.
    The driver then collects its garbage, as Spark deletes the shuffle files and
    checkpoints of finished steps only when their handles are collected. That of ``df``
    itself goes first, so that a caller that does not name it keeps no shuffle of this step."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    del df
    tidy(keep_caches=True)
    spark.sparkContext._jvm.System.gc()
    return done


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written for steps that are done."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batch: pa.RecordBatch, max_chars: int = 4 << 20) -> Iterator[tuple[list, ...]]:
    """The columns of ``batch`` as lists, a few million characters of the last
    column at a time, so that long texts do not pile up as Python objects."""
    texts = batch.column(batch.num_columns - 1)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > max_chars:
            yield tuple(batch.column(c).slice(start, i - start).to_pylist() for c in range(batch.num_columns))
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield tuple(batch.column(c).slice(start).to_pylist() for c in range(batch.num_columns))


_caches: list[WordCache] = []


def tidy(keep_caches: bool = False) -> None:
    """Python workers are used again for other steps: gives what they hold back to the
    system. Word caches only go when a step begins that does not use them."""
    if not keep_caches:
        for cache in _caches:
            cache.clear()
            cache.old, cache.held = {}, 0
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordCache(dict):
    """word -> encoded form; ``encode`` gets a list of new words. Two generations of at
    most about ``limit`` bytes: a full one becomes the old one, from which words that
    are used again come back, so memory stays bounded and frequent words stay."""

    ENTRY = 200  # bytes of an entry's two objects and its place in the table, beside its characters

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 128 << 20):
        super().__init__()
        self.encode, self.limit, self.old, self.held = encode, limit, {}, 0
        _caches.append(self)

    def __missing__(self, word: str):
        self.add([word], [self.old[word]])
        return self.old[word]

    def add(self, words: list[str], found: list) -> None:
        self.held += self.ENTRY * len(words) + sum(map(len, words)) + sum(map(len, found))
        self.update(zip(words, found, strict=True))

    def learn(self, words: Iterable[str]) -> None:
        """After this all of ``words`` are held."""
        words = dict.fromkeys(words)
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        out = [w for w in words if w not in self]
        back = [w for w in out if w in self.old]
        if back:
            self.add(back, [self.old[w] for w in back])
        new = [w for w in out if w not in self.old]
        if new:
            self.add(new, self.encode(new))

    def lookup(self, words: list[str]) -> list:
        got = list(map(self.get, words))
        missing = list(compress(range(len(got)), map(not_, got)))
        if missing:
            self.learn([words[i] for i in missing])
            for i in missing:
                got[i] = self[words[i]]
        return got
