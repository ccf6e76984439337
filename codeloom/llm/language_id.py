"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of up to ORDER bytes, over all 256 bytes. A byte
that was seen after its longest known context costs -log2(c / (n + d)); otherwise an
escape, -log2(d / (n + d)), is paid and the next shorter context is asked (n bytes, d
different ones; below order 0 all 256 bytes are alike). With frozen statistics the
cost of a byte follows from the byte and the ORDER ones before it, so code lengths
are sums of table look-ups, in whole numbers of 1/1024 bit: exact for the trees, and
the same in whatever batches rows come. Texts are compared in lower case, and begin
after blanks.

The trees are learned from a sample of labelled rows with a documented bound
(``max_docs`` rows of each language, chosen by a hash of the id, whole texts), and
have a bounded size: of the contexts of two bytes or more a language keeps those seen
at least so often that each order has at most ``max_cells`` / languages strings
(contexts that go are as if never seen). Every other thing covers all rows.

Strings are listed for blocks of languages, sparse, with the cost in each language of
the block; of a string that is not listed the escapes of its contexts are, so that
one look-up serves a block wherever one of its languages knows the string.

``und`` (score 0) is given for null texts, texts without a letter, and where no
labelled row exists. Equal code lengths go to the first language by name. A null
id is never trained on and never held out. Repeated rows count each, very long texts
are read whole, a piece at a time. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._util import checkpointed, rows_of, tidy

UNIT = 1024  # of a bit
ORDER = 4
CHUNK = 1 << 18  # bytes scored at a time
BLOCK = 8  # languages
PAD = b" " * ORDER
#: language -> for each order the strings (a byte longer than the order, as numbers) and how often they were seen
Grams = dict[str, list[tuple[np.ndarray, np.ndarray]]]


class CodeIndex:
    """Where in a list of different numbers one stands: an open-addressed table, at most half full."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.places = np.zeros(1 << self.bits, dtype=np.int32)
        at, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.places[at[put]] = codes[put], put
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for those that are not listed."""
        at = self._slot(codes)
        found = self.keys[at]
        place = np.where(found == codes, self.places[at], -1)
        on = np.flatnonzero((found != codes) & (found != -1))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[on]]
            hit = got == codes[on]
            place[on[hit]] = self.places[at[on[hit]]]
            on = on[~hit & (got != -1)]
        return place


class TreeBlock:
    """The trees of up to BLOCK languages as tables, a column for each language."""

    def __init__(self, trees: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.strings: list[CodeIndex] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[CodeIndex] = []
        self.escapes: list[np.ndarray] = []
        for order in range(ORDER + 1):
            listed = np.unique(np.concatenate([t[order][0] for t in trees]))
            known = np.unique(listed >> 8)
            escape = np.zeros((len(known), len(trees)), dtype=np.int32)
            hits = []
            for k, tree in enumerate(trees):
                codes, counts = tree[order]
                by = np.argsort(codes, kind="stable")
                codes, counts = codes[by], counts[by].astype(np.float64)
                context, at = np.unique(codes >> 8, return_inverse=True)
                n, d = np.bincount(at, weights=counts, minlength=len(context)), np.bincount(at, minlength=len(context))
                escape[np.searchsorted(known, context), k] = np.round(-np.log2(d / (n + d)) * UNIT)
                hits.append((np.searchsorted(listed, codes), np.round(-np.log2(counts / (n + d)[at]) * UNIT)))
            self.contexts.append(CodeIndex(known))
            self.escapes.append(escape)
            cost = escape[np.searchsorted(known, listed >> 8)] + self._below(listed, order)
            for k, (at, bits) in enumerate(hits):
                cost[at, k] = bits
            self.strings.append(CodeIndex(listed))
            self.costs.append(cost)

    def _below(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Costs of the strings' last bytes in the contexts shorter than ``order``."""
        if not order:
            return np.full((len(codes), self.escapes[0].shape[1]), 8 * UNIT, dtype=np.int32)
        return self.cost(codes & ((1 << (8 * order)) - 1), order - 1)

    def cost(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """For strings of order + 1 bytes, the last byte's cost in each language."""
        at = self.strings[order].find(codes)
        out = self.costs[order][at] if len(self.costs[order]) else np.zeros((len(codes), self.escapes[order].shape[1]), dtype=np.int32)
        new = np.flatnonzero(at < 0)
        if len(new):
            rest = codes[new]
            context = self.contexts[order].find(rest >> 8)
            out[new] = self._below(rest, order)
            seen = context >= 0
            out[new[seen]] += self.escapes[order][context[seen]]
        return out


@dataclass
class ContextTrees:
    """Frozen statistics of all languages, in blocks."""

    langs: list[str]
    blocks: list[TreeBlock]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """In 1/1024 bit, for each text and language."""
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), dtype=np.uint8)
        owner_end = np.cumsum(lens + ORDER)
        for a in range(0, len(flat), CHUNK):
            b = min(len(flat), a + CHUNK)
            low = max(0, a - ORDER)
            c = np.r_[np.zeros(ORDER - (a - low), dtype=np.int64), flat[low:b].astype(np.int64)]
            codes = np.zeros(b - a, dtype=np.int64)
            for k in range(ORDER + 1):
                codes = (codes << 8) | c[k : k + b - a]
            first = int(np.searchsorted(owner_end, a, side="right"))
            last = int(np.searchsorted(owner_end, b - 1, side="right"))
            starts = np.r_[a, owner_end[first:last]] - a
            begins = np.r_[0, owner_end[:-1]][first : last + 1] - a
            pad = (begins[:, None] + np.arange(ORDER)[None, :]).ravel()  # the bytes in front of each text only give context
            pad = pad[(pad >= 0) & (pad < b - a)]
            for no, block in enumerate(self.blocks):
                cost = block.cost(codes)
                cost[pad] = 0
                out[first : last + 1, no * BLOCK : (no + 1) * BLOCK] += np.add.reduceat(cost, starts, axis=0, dtype=np.int64)
        return out


def learn(grams: Grams) -> ContextTrees:
    """Tables from each language's strings and their counts."""
    langs = sorted(grams)
    return ContextTrees(langs, [TreeBlock([grams[x] for x in langs[a : a + BLOCK]]) for a in range(0, len(langs), BLOCK)])


def count_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different strings of ORDER + 1 bytes that end in a text, as numbers, and their
    counts. Each text stands after blanks."""
    flat = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), dtype=np.uint8).astype(np.int64)
    n = max(0, len(flat) - ORDER)
    codes = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        codes = (codes << 8) | flat[k : k + n]
    inside = np.ones(len(flat), dtype=bool)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + ORDER
    inside[((np.cumsum(lens) - lens)[:, None] + np.arange(ORDER)[None, :]).ravel()] = False
    return np.unique(codes[inside[ORDER:]], return_counts=True)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, max_cells: int = 1 << 18, seed: int = 7) -> ContextTrees | None:
    """Context trees from the labelled rows of ``df``, at most about ``max_docs`` of each
    language. What reaches the driver, and the trees that are sent out, hold at most
    ``max_cells`` strings for each order but the two lowest, which have at most 65,792
    for each language."""
    rows = df.selectExpr(f"CAST(`{id_col}` AS STRING) AS id", f"CAST(`{lang_col}` AS STRING) AS lang", f"CAST(`{text_col}` AS STRING) AS text").filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    cut: Column = F.lit(0.0)
    for k, n in sorted(sizes.items()):
        cut = F.when(F.col("lang") == k, F.lit(min(1.0, max_docs / n))).otherwise(cut)
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < cut * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            """Distinct codes and counts of what is held, as the only thing held from now on."""
            codes, n = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            codes, at = np.unique(codes, return_inverse=True)
            held[lang] = [(codes, np.bincount(at, weights=n, minlength=len(codes)).astype(np.int64))]
            return held[lang][0]

        for batch in batches:
            for langs, texts in rows_of(batch, 1 << 20):
                for lang in dict.fromkeys(langs):
                    held.setdefault(lang, []).append(count_strings([_bytes(t) for t, k in zip(texts, langs, strict=True) if k == lang]))
                    if len(held[lang]) > 8:
                        merged(lang)
        for lang in list(held):
            codes, n = merged(lang)
            del held[lang]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    longest = picked.mapInArrow(count, "lang string, code long, n long")
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col("code").bitwiseAND(F.lit((1 << (8 * o + 8)) - 1)).alias("code")) for o in range(ORDER + 1)]))
    strings = longest.select("lang", each.alias("s"), "n").groupBy("lang", "s.o", "s.code").agg(F.sum("n").alias("n"))
    strings = checkpointed(strings.withColumn("context", F.shiftright("code", 8)))
    contexts = strings.groupBy("lang", "o", "context").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("d"))
    often = contexts.filter("o >= 2").groupBy("lang", "o", F.least(F.col("seen"), F.lit(1 << 16)).alias("seen")).agg(F.sum("d").alias("d"))  # at most 65,536 rows for each language and order
    least = {(lang, o): _least_seen(g, max_cells // len(sizes)) for (lang, o), g in often.toArrow().to_pandas().groupby(["lang", "o"])}
    kept = contexts
    for (lang, o), n in least.items():
        if n > 1:
            kept = kept.filter(~((F.col("lang") == lang) & (F.col("o") == o) & (F.col("seen") < n)))
    names = sorted(sizes)
    number = F.lit(-1)
    for k, lang in enumerate(names):
        number = F.when(F.col("lang") == lang, F.lit(k)).otherwise(number)
    got = strings.join(kept.select("lang", "o", "context"), ["lang", "o", "context"], "left_semi").select((number * (ORDER + 1) + F.col("o")).alias("tree"), "code", "n").toArrow()
    tree, code, n = (got.column(c).to_numpy() for c in ("tree", "code", "n"))
    grams: Grams = {}
    for k, lang in enumerate(names):
        at = [tree == k * (ORDER + 1) + o for o in range(ORDER + 1)]
        if at[0].any():
            grams[lang] = [(code[x], n[x]) for x in at]
    return learn(grams) if grams else None


def _least_seen(contexts, most: int) -> int:
    """How often contexts (seen, d: their strings) must be seen for ``most`` strings at most."""
    by = contexts.sort_values("seen", ascending=False)
    fits = by["d"].cumsum() <= most
    return 1 if fits.all() else int(by["seen"][fits].min()) if fits.any() else 1 << 62


def identify(df: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, carried columns, lang_pred, score, bits_per_byte). The score is the best
    language's posterior under equal priors."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(trees)  # bounded by max_cells
    names = [f"c{k}" for k in range(len(carry))]
    source = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.col(text_col).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([f"{n} {types[n]}" for n in ["id", *names, "text"]] + ["lang_pred string", "score double", "bits_per_byte double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        model = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            pred: list[str] = []
            score: list[float] = []
            fit: list[float] = []
            for (some,) in rows_of(pa.RecordBatch.from_arrays([texts], names=["t"])):
                known = [bool(t) and any(map(str.isalpha, t)) and model is not None for t in some]
                raw = [_bytes(t) if k else b"" for t, k in zip(some, known, strict=True)]
                if model is None:
                    pred, score, fit = pred + ["und"] * len(some), score + [0.0] * len(some), fit + [0.0] * len(some)
                    continue
                cost = model.code_lengths(raw)
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(some)), best]
                part = np.exp2(-np.minimum((cost - least[:, None]) / UNIT, 1000)).sum(axis=1)
                for k, b, p, bits, t in zip(known, best, part, least, raw, strict=True):
                    pred.append(model.langs[b] if k else "und")
                    score.append(round(1 / p, 9) if k else 0.0)
                    fit.append(bits / UNIT / len(t) if k else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    found = source.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], F.col("text").alias(text_col), "lang_pred", "score", "bits_per_byte")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
