"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MODELS: dict[str, Callable[[list[str]], Sequence[Sequence[float]]]] = {}


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is evaluated once, however often ``f`` names it; by itself Spark
    evaluates what a lambda names again for each element."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = lambda w, n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(v, lambda w: bound(norm(w), lambda n: scaled(w, n)))


def or_zero(v: Column, dim: int) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(0.0).cast("float"), dim))


def boost(score: Column, entity_type: Column) -> Column:
    """Files count 1.2 times, classes 1.1 times."""
    return score * F.when(entity_type == "file", F.lit(1.2)).when(entity_type == "class", F.lit(1.1)).otherwise(F.lit(1.0))


def hashed_embedding(text: Column, dim: int = 64, most_chars: int | None = None) -> Column:
    """A deterministic stand-in for a learned model: signed counts of word hashes, normalised.
    The whole text counts, unless ``most_chars`` is given."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text if most_chars is None else F.substring(text, 1, most_chars)), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    # Each hash as its cell, from 1, with its sign: the sum of a cell is the number of its positive hashes less that of the others.
    signed = F.transform(words, lambda w: bound(F.xxhash64(w), lambda h: F.when(h > 0, F.pmod(h, F.lit(dim)) + 1).otherwise(-1 - F.pmod(h, F.lit(dim)))))
    count = lambda all_, x: F.size(F.filter(all_, lambda y: y == x)).cast("double")
    cells = lambda s: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: count(s, i) - count(s, -i))
    return unit(bound(signed, cells))


def model_embedding(name: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 32) -> Callable[[Column, int], Column]:
    """An embedding by a model: ``load`` gives a function from texts to vectors. A worker loads the
    model ``name`` once and keeps it; texts go to it in batches. Null texts count as empty."""

    def embed(text: Column, dim: int) -> Column:
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from codeloom.functions import vectors  # the worker's own, which outlives the task

            model = vectors.MODELS.get(name) or vectors.MODELS.setdefault(name, load())
            for texts in parts:
                words = texts.fillna("").tolist()
                out = [list(map(float, v)) for i in range(0, len(words), batch) for v in model(words[i : i + batch])]
                if any(len(v) != dim for v in out):
                    raise ValueError(f"vectors of {name} have not {dim} dimensions")
                yield pd.Series(out, dtype=object)

        run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<double>")(text)

    return embed
