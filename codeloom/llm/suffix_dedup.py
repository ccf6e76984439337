"""Suffix-array dedup: repeated byte strings of a given length across documents.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. The steps:

1. Documents are put into shards of some megabytes; of equal texts in a shard only
   the one of the smallest id goes on. The suffix array of all the shard's bytes is
   built by Larsson-Sadakane refinement (ranks by the first symbols, then doubling,
   sorting only groups that are not yet single). Kasai's pass gives the common
   prefixes of neighbours, and suffixes in a run of common prefixes of ``length`` or
   more start with equal strings: all but those of the run's smallest id are repeats.
   Shards are written once, compressed, with their repeats as bits.
2. What is left is each shard's first place of every string. Of those, only what
   other shards may have too crosses shards. Each string belongs to one anchor, the
   place of the least hash among its 24-byte grams, which its bytes alone decide.
   Shards exchange 32-bit anchor hashes; those of two shards or more come back (a
   superset is harmless).
3. Each shard sends its suffixes at the first string of each such anchor, cut where
   the anchor's last string ends, as sorted lists of different ones with their
   smallest document, dealt by anchor.
4. For each range of anchors the sorted lists of all shards are merged by binary
   search, two by two. Among different suffixes of one anchor, the suffix array of
   the range's suffixes and its common prefixes tell the equal strings, as in 1.
   Anchors of very many suffixes send single strings, dealt by the string's own
   hash, so that no anchor gathers in one task.
5. Each shard marks what its strings' first documents leave to it.

How many ranges there are follows from the bytes of all documents, so that a range
stays of some megabytes. A shard of one document has no repeats of its own, so no
array is built for it, however long the document. Equal texts of several shards are
found by digest, one row for each shard and text; only the smallest id goes on.

Null texts are empty. Texts shorter than ``length`` lose nothing. Equal texts
lose all but one copy, if they are that long; rows that repeat an id do not count
against each other. A null id counts as larger than all others (as the id 2^63-1
does) and stays null. Only the id and text columns are read. An empty table gives
no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._util import NULL_ID, checkpointed, rows_of, tidy, width

GRAM = 24
SHARD_BYTES = 2 << 20
RANGE_BYTES = 16 << 20  # of all documents, for each range of anchors
LANE = 256  # places that one lane of Kasai's pass goes through
PIECE = 1 << 16  # bytes hashed at a time, so that their hashes stay in the processor's cache
HOT = 8_192  # occurrences from which an anchor's strings are sent one by one
BATCH = 1 << 13  # contexts in one suffix array
POWER = 0x9E3779B97F4A7C15
SYMBOLS = 7  # of 9 bits in a first rank
KEYS = 1 << 16  # first ranks made at a time


@lru_cache(maxsize=1)
def _byte_hash() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on."""
    power = lambda k: np.uint64(pow(POWER, k, 1 << 64))
    h1 = _byte_hash()[b]
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    return _mix(h16[:-8] * power(8) + h8[16:])


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by doubling."""
    done = 1
    while done * 2 <= span:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (span - done)], v[span - done :]) if span > done else v


def anchor_runs(docs: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(document, first string, last string, anchor, hash), places in the document, for
    each stretch of neighbouring strings that have the same anchor."""
    span = length - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []

    def cut(flat: np.ndarray, owner: np.ndarray, base: np.ndarray, limit: np.ndarray) -> None:
        """Strings of ``flat`` from places whose document goes on for ``length``."""
        if len(flat) < length:
            return
        h = _gram_hashes(flat)
        low = np.uint64((1 << 24) - 1)
        at = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), span) & low
        at = at.astype(np.int64)
        ok = np.arange(len(at)) + length <= limit[: len(at)]
        new = np.r_[True, (np.diff(at) != 0) | (owner[1 : len(at)] != owner[: len(at) - 1]) | (ok[1:] != ok[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        p = at[first]
        out.append((owner[first], first + base[first], last + base[first], p + base[first], h[p]))

    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            lens = np.array([len(docs[i]) for i in group])
            starts = np.cumsum(lens) - lens
            cut(np.frombuffer(b"".join(docs[i] for i in group), dtype=np.uint8), np.repeat(group, lens), np.repeat(-starts, lens), np.repeat(starts + lens, lens))
        group, size = [], 0

    for i, d in enumerate(docs):
        if len(d) < length:
            continue
        if len(d) > PIECE:
            for a in range(0, len(d) - length + 1, PIECE):
                part = np.frombuffer(d, dtype=np.uint8, offset=a, count=min(PIECE + length - 1, len(d) - a))
                cut(part, np.full(len(part), i), np.full(len(part), a), np.full(len(part), len(part)))
            continue
        if size + len(d) > PIECE:
            flush()
        group.append(i)
        size += len(d)
    flush()
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def suffix_array(symbols: np.ndarray, room: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes by Larsson-Sadakane refinement. ``symbols`` are positive,
    ``room`` says how many symbols are left in the string that a place belongs to;
    equal suffixes are in the order of their places."""
    return _refined(symbols, room, longest)[0]


def _first_keys(symbols: np.ndarray, room: np.ndarray | None, bits: int = 63) -> tuple[np.ndarray, int]:
    """For each place a number of at most ``bits`` bits that is ordered as its first symbols are, and how
    many these are. Without ``room`` the symbols are digits of a base that just holds the different ones."""
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    if room is not None:
        many = min(SYMBOLS, bits // 9)
        padded = np.r_[symbols.astype(np.int64), np.zeros(many, dtype=np.int64)]
        for k in range(many):
            key = (key << 9) | np.where(room > k, padded[k : k + n], 0)
        return key, many
    present = np.bincount(symbols, minlength=1) > 0
    base = max(2, int(present.sum()))
    many = 1
    while base ** (many + 1) < 1 << bits:
        many += 1
    digits = np.r_[(np.cumsum(present) - 1).astype(np.int16)[symbols], np.zeros(many, dtype=np.int16)]
    for a in range(0, n, KEYS):
        some = digits[a : a + KEYS + many].astype(np.int64)
        m = min(KEYS, n - a)
        at = some[:m].copy()
        for k in range(1, many):
            at *= base
            at += some[k : k + m]
        key[a : a + m] = at
    return key, many


def _by_key(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys); equal keys stay in order. ``keys``, of ``bits`` bits, may be used up: with
    their numbers below them where both fit, as sorting numbers is much faster than sorting places."""
    low = max(1, int(len(keys) - 1).bit_length()) if len(keys) else 1
    if bits + low > 63:
        by = np.argsort(keys, kind="stable")
        return by, keys[by]
    keys <<= low
    for a in range(0, len(keys), KEYS):
        keys[a : a + KEYS] |= np.arange(a, min(a + KEYS, len(keys)), dtype=np.int64)
    keys.sort()
    by = np.empty(len(keys), dtype=np.int32)
    for a in range(0, len(keys), KEYS):
        by[a : a + KEYS] = keys[a : a + KEYS] & ((1 << low) - 1)
    keys >>= low
    return by, keys


def _refined(symbols: np.ndarray, room: np.ndarray | None, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, where in it those stand that may share ``longest`` symbols
    with another). Without ``room`` the strings end with the symbol 0, what follows it
    decides between suffixes that are equal up to there, and refinement goes on until all
    ranks are single; with it, for as many symbols as the longest string has."""
    n = len(symbols)
    wide = max(1, n.bit_length())
    key_bits = max(63 - wide, 9)
    key, depth = _first_keys(symbols, room, key_bits)
    rank = np.empty(n, dtype=np.int32)

    def rerank(places: np.ndarray, keys: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of ``places`` (sorted by ``keys``; ``begin``: where each stands in the
        order): the first place of its group. Returns what is not yet single, and its groups' numbers."""
        new = np.ones(len(keys), dtype=bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        head = np.flatnonzero(new).astype(np.int32)
        size = np.diff(head, append=np.int32(len(places)))
        rank[places] = np.repeat(begin[head], size)
        several = size > 1
        return np.repeat(several, size), np.repeat(np.arange(int(several.sum()), dtype=np.int32), size[several])

    if not n:
        order = np.zeros(0, dtype=np.int32)
        return order, order
    order, key = _by_key(key, key_bits)
    order = order.astype(np.int32, copy=False)
    at = np.arange(n, dtype=np.int32)
    some, group = rerank(order, key, at)
    at = at[some]
    del key, some
    last = at
    while len(at) and (depth < longest or room is None):
        last = at if depth < longest else last
        places = order[at]
        further = places + np.int32(min(depth, n))
        after = rank[np.minimum(further, n - 1)] + 1
        after[(further >= n) if room is None else (room[places] <= depth)] = 0
        bits = wide + int(group[-1]).bit_length()  # groups are numbered in their order
        keys = group.astype(np.int64)
        keys <<= wide
        keys |= after
        del further, after, group
        by, keys = _by_key(keys, bits)
        order[at] = places = places[by]
        some, group = rerank(places, keys, at)
        at = at[some]
        depth *= 2
    return order, last


def kasai(symbols: np.ndarray, room: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``: Kasai's pass, for
    all strings side by side, place after place, one symbol less each time."""
    return _prefixes_along(symbols, room, starts, room[starts], order, len(symbols))


def _prefixes_along(symbols: np.ndarray, room: np.ndarray, starts: np.ndarray, lens: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """Kasai's pass along the lanes that begin at ``starts`` and have ``lens`` places; common
    prefixes count up to ``longest``, and are 0 for places in no lane."""
    n = len(symbols)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    lcp = np.zeros(n, dtype=np.int32)
    by = np.argsort(-lens, kind="stable")  # longest lanes first, so that those still going on are in front
    starts, lens = starts[by], lens[by]
    h = np.zeros(len(starts), dtype=np.int32)
    live = len(starts)
    for t in range(int(lens.max(initial=0))):
        live = int(np.searchsorted(-lens[:live], -t, side="left"))
        i = (starts[:live] + t).astype(np.int32)
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(np.minimum(room[i], room[j]), longest), 0).astype(np.int32)
        k = np.minimum(np.maximum(h[:live] - 1, 0), most)
        on = np.flatnonzero(k < most)
        while len(on):
            on = on[symbols[i[on] + k[on]] == symbols[j[on] + k[on]]]
            k[on] += 1
            on = on[k[on] < most[on]]
        h[:live] = k
        lcp[r] = k
    return lcp


def repeats_in_shard(texts: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the concatenated ``texts``: whether the string of ``length`` bytes that
    starts there also starts in a text of a smaller id. By the suffix array of all bytes."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros(int(lens.sum()), dtype=bool)
    long = np.flatnonzero(lens >= length)
    if len(long) < 2 or (ids[long] == ids[long[0]]).all():
        return out
    flat = np.frombuffer(b"\xff".join([texts[i] for i in long] + [b""]), dtype=np.uint8)  # a byte that no UTF-8 has
    symbols = flat.astype(np.int16) + 1
    ends = np.cumsum(lens[long] + 1) - 1  # of each text, in flat
    symbols[ends] = 0
    order, last = _refined(symbols, None, length)
    places = np.sort(order[last])  # all suffixes whose strings may not be single, as stretches in the texts
    owner = np.searchsorted(ends, places)
    room = np.zeros(len(flat), dtype=np.int32)
    room[places] = ends[owner] - places
    places = places[room[places] >= length]
    head = np.flatnonzero(np.r_[True, np.diff(places) != 1]) if len(places) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[head, len(places)])
    lanes = -(-size // LANE)
    no = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = np.repeat(places[head] if len(places) else head, lanes) + no * LANE
    lcp = _prefixes_along(symbols, room, starts, np.minimum(np.repeat(size, lanes) - no * LANE, LANE), order, length)
    if not len(last):
        return out
    same = lcp[last] >= length
    run = np.flatnonzero(~same)  # the first of ``last`` has no neighbour of an equal string before it
    who = ids[long][np.searchsorted(ends, order[last])]
    first = np.repeat(np.minimum.reduceat(who, run), np.diff(np.r_[run, len(last)]))
    again = order[last[first < who]]
    begin = np.cumsum(lens) - lens
    which = np.searchsorted(ends, again)
    out[begin[long[which]] + again - (ends[which] - lens[long[which]])] = True
    return out


def first_documents(contexts: np.ndarray, lens: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place, first document) of the strings of ``length`` bytes in ``contexts``
    (rows of bytes, ``lens`` of them used) that a smaller document than the context's own,
    ``least``, has in another one of them."""
    used = np.arange(contexts.shape[1])[None, :] < lens[:, None]
    symbols = contexts[used].astype(np.int16) + 1
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    place = (np.arange(len(symbols)) - starts[owner]).astype(np.int32)
    room = (lens[owner] - place).astype(np.int32)
    order = suffix_array(symbols, room, int(lens.max(initial=0)))
    lcp = kasai(symbols, room, starts, order)
    head = np.flatnonzero(lcp < length)
    run = np.cumsum(lcp < length) - 1
    first = np.minimum.reduceat(least[owner[order]], head)[run]
    earlier = np.flatnonzero(first < least[owner[order]])
    earlier = earlier[room[order[earlier]] >= length]
    return owner[order[earlier]], place[order[earlier]], first[earlier]


def _z(x: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x if isinstance(x, bytes) else x.tobytes())


def _unz(x: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


def pack_shard(ids: list[int | None], texts: list[bytes], length: int) -> dict:
    """A shard's fields: each different text once, with its smallest id and its repeats in the shard."""
    ranks = np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64)
    number: dict[bytes, int] = {}
    text_no = np.array([number.setdefault(hashlib.sha256(t).digest(), len(number)) for t in texts], dtype=np.int64)
    first = np.unique(text_no, return_index=True)[1]
    different = [texts[i] for i in first]
    least = np.full(len(number), NULL_ID, dtype=np.int64)
    np.minimum.at(least, text_no, ranks)
    repeats = repeats_in_shard(different, least, length)
    ends = np.cumsum([len(t) for t in different], dtype="<i8")
    return {"ids": ids, "text_no": text_no.tolist(), "least": least.tolist(), "digests": list(number), "n_bytes": sum(map(len, texts)), "ends": _z(ends), "body": _z(b"".join(different), 4), "repeats": _z(np.packbits(repeats, bitorder="little"))}


SHARD = "ids array<long>, text_no array<int>, least array<long>, digests array<binary>, n_bytes long, ends binary, body binary, repeats binary"
SHARD_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _shards(docs: DataFrame, length: int) -> DataFrame:
    """(shard, its fields): documents in shards of about SHARD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        part, no = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            fields = pack_shard(ids, held, length)
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + no], pa.int64()), *[pa.array([v], t) for v, t in zip(fields.values(), SHARD_TYPES, strict=True)]], names=["shard", *fields])

        for batch in batches:
            for keys, texts in rows_of(batch):
                for key, text in zip(keys, texts, strict=True):
                    raw = (text or "").encode("utf-8", "replace")
                    if held and size + len(raw) > SHARD_BYTES:
                        yield flush()
                        no, ids, held, size = no + 1, [], [], 0
                    ids.append(key)
                    held.append(raw)
                    size += len(raw)
        if held:
            yield flush()

    return docs.select("id", "text").mapInArrow(run, f"shard long, {SHARD}")


def _texts(row: dict) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(smallest ids, texts, repeats in the shard by byte) of a shard's different texts."""
    ends, body = _unz(row["ends"], "<i8"), zstandard.ZstdDecompressor().decompress(row["body"])
    repeats = np.unpackbits(_unz(row["repeats"], "u1"), count=len(body), bitorder="little").view(bool)
    return np.array(row["least"], dtype=np.int64), [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], repeats


def _first_runs(texts: list[bytes], repeats: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``anchor_runs`` of the texts, but for stretches of which every string is a repeat in the shard."""
    runs = anchor_runs(texts, length)
    doc, s, e = runs[:3]
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    base = (np.cumsum(lens) - lens)[doc]
    new = np.r_[0, np.cumsum(~repeats, dtype=np.int64)]
    some = new[base + e + 1] > new[base + s]
    return tuple(x[some] for x in runs)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def _anchors(shards: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each bucket the shard's different anchor hashes, with in how many different texts they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for row in _rows(batches):
            _, texts, repeats = _texts(row)
            doc, _, _, _, h = _first_runs(texts, repeats, length)
            bucket = _bucket(h, buckets)
            short = h.astype(np.uint32)
            order = np.lexsort((doc, short, bucket))
            doc, short, bucket = doc[order], short[order], bucket[order]
            one = np.r_[True, (np.diff(doc) != 0) | (short[1:] != short[:-1]) | (np.diff(bucket) != 0)] if len(doc) else np.zeros(0, dtype=bool)
            short, bucket = short[one], bucket[one]
            head = np.flatnonzero(np.r_[True, (short[1:] != short[:-1]) | (np.diff(bucket) != 0)]) if len(short) else np.zeros(0, dtype=np.int64)
            times = np.minimum(np.diff(np.r_[head, len(short)]), 65535).astype("<u2")
            short, bucket = short[head], bucket[head]
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else []
            ends = np.r_[cuts[1:], len(bucket)].astype(int) if len(bucket) else []
            m = len(cuts)
            deltas = [_z(np.diff(short[a:b], prepend=np.uint32(0)).astype("<u4").reshape(-1, 1).view("u1").T.copy()) for a, b in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * m, pa.int64()), pa.array(bucket[cuts] if m else [], pa.int32()), pa.array(deltas, pa.binary()), pa.array([_z(times[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["shard", "bucket", "hashes", "times"])

    return shards.select("shard", "least", "ends", "body", "repeats").mapInArrow(run, "shard long, bucket int, hashes binary, times binary")


def _hashes(x: bytes) -> np.ndarray:
    planes = _unz(x, "u1").reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _repeated(pdf: pd.DataFrame, hot: int) -> pd.DataFrame:
    """For each shard of a bucket: its hashes that another shard has too, and which are hot."""
    lists = [_hashes(x) for x in pdf["hashes"]]
    times = [_unz(x, "<u2").astype(np.int64) for x in pdf["times"]]
    values, number = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate(times), minlength=len(values))
    holders = np.bincount(number, minlength=len(values))
    out, at = [], 0
    for shard, mine in zip(pdf["shard"], lists, strict=True):
        mine_at = number[at : at + len(mine)]
        t = total[mine_at]
        at += len(mine)
        keep = holders[mine_at] >= 2
        out.append((shard, _z(mine[keep].astype("<u4")), _z((t[keep] >= hot).astype("u1"))))
    return pd.DataFrame({"shard": [o[0] for o in out], "bucket": pdf["bucket"].to_numpy(), "wanted": [o[1] for o in out], "hot": [o[2] for o in out]})


def _cut(row: dict, length: int, buckets: int) -> tuple:
    """(smallest ids, texts, repeats, (text, first string, last string, bucket, number) of
    each occurrence, (bucket, sorted different contexts, their least ids)) of a shard. The
    numbers count a bucket's contexts, and are the same each time."""
    span = length - GRAM + 1
    wide = length + span - 1
    ids, docs, repeats = _texts(row)
    gone = set(row["copies"] or [])
    doc, s, e, p, h = _first_runs(docs, repeats, length)
    if gone:
        stay = np.array([i not in gone for i in range(len(docs))], dtype=bool)[doc]
        doc, s, e, p, h = (x[stay] for x in (doc, s, e, p, h))
    bucket, short = _bucket(h, buckets), h.astype(np.uint32)
    wanted, hot = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for answer in row["wanted"] or []:
        values, flags = _unz(answer["wanted"], "<u4"), _unz(answer["hot"], "u1")
        at = by[cuts[answer["bucket"]] : cuts[answer["bucket"] + 1]]
        if len(values) and len(at):
            k = np.minimum(np.searchsorted(values, short[at]), len(values) - 1)
            hit = values[k] == short[at]
            wanted[at[hit]] = True
            hot[at[hit]] = flags[k[hit]] > 0
    sel = np.flatnonzero(wanted)
    doc, s, e, p, h, hot = doc[sel], s[sel], e[sel], p[sel], h[sel], hot[sel]
    if hot.any():  # a string each
        times = np.where(hot, e - s + 1, 1)
        again = np.repeat(np.arange(len(s)), times)
        step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        doc, p, h, was_hot = doc[again], p[again], h[again], hot[again]
        s, e = np.where(was_hot, s[again] + step, s[again]), np.where(was_hot, s[again] + step, e[again])
        hot = was_hot
    lens = np.array([len(t) for t in docs], dtype=np.int64)
    base = np.cumsum(lens) - lens
    flat = np.frombuffer(b"".join(docs) + bytes(wide), dtype=np.uint8)
    size = (e - s + length).astype(np.int64)
    keys = np.zeros((len(s), wide + 4), dtype=np.uint8)
    keys[:, 0], keys[:, 1] = size >> 8, size & 255
    keys[:, 2], keys[:, 3] = (p - s) >> 8, (p - s) & 255
    for a in range(0, len(s), 1 << 16):
        z = slice(a, a + (1 << 16))
        grid = (base[doc[z]] + s[z])[:, None] + np.arange(wide)[None, :]
        keys[z, 4:] = np.where(np.arange(wide)[None, :] < size[z, None], flat[grid], 0)
    if hot.any():
        own = np.array([int.from_bytes(hashlib.blake2b(k.tobytes(), digest_size=8).digest(), "little") for k in keys[hot]], dtype=np.uint64)
        h = h.copy()
        h[hot] = own
    bucket = _bucket(h, buckets)
    texts = keys.reshape(-1).view(f"S{wide + 4}") if len(s) else np.zeros(0, dtype=f"S{wide + 4}")
    no = np.zeros(len(s), dtype=np.int64)
    owner = ids[doc]
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    sent: list[tuple] = []
    for k in range(buckets):
        at = by[cuts[k] : cuts[k + 1]]
        if len(at):
            values, number = np.unique(texts[at], return_inverse=True)
            least = np.full(len(values), NULL_ID, dtype=np.int64)
            np.minimum.at(least, number, owner[at])
            no[at] = number
            sent.append((k, values, least))
    return ids, docs, repeats, (doc, s, e, bucket, no), sent


def _contexts(shards: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each bucket and shard its different contexts, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for row in _rows(batches):
            sent = _cut(row, length, buckets)[4]
            m = len(sent)
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * m, pa.int64()), pa.array([x[0] for x in sent], pa.int32()), pa.array([_z(x[1].tobytes()) for x in sent], pa.binary()), pa.array([_z(x[2]) for x in sent], pa.binary())], names=["shard", "bucket", "data", "least"])

    return shards.mapInArrow(run, "shard long, bucket int, data binary, least binary")  # all columns, as the last step reads the same exchange


def merge_sorted(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted lists of different strings as one, two by two: places by binary search."""
    while len(lists) > 1:
        merged = []
        for x, y in zip(lists[::2], lists[1::2], strict=False):
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            at = np.searchsorted(x, y)
            new = x[np.minimum(at, len(x) - 1)] != y if len(x) else np.ones(len(y), dtype=bool)
            merged.append(np.insert(x, at[new], y[new]))
        lists = merged + lists[len(lists) // 2 * 2 :]
    return lists[0]


def _merge(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """A bucket's contexts of all shards: for each shard's contexts the smallest document,
    and the places of strings that a smaller one has in another context."""
    span = length - GRAM + 1
    wide = length + span - 1
    lists = [_unz(x, f"S{wide + 4}") for x in pdf["data"]]
    mins = [_unz(x, "<i8") for x in pdf["least"]]
    merged = merge_sorted(lists)
    where = [np.searchsorted(merged, x) for x in lists]  # each sorted list, by binary search
    least = np.full(len(merged), NULL_ID, dtype=np.int64)
    for w, m in zip(where, mins, strict=True):
        np.minimum.at(least, w, m)
    raw = np.frombuffer(merged.tobytes(), dtype=np.uint8).reshape(len(merged), wide + 4)
    size = raw[:, 0].astype(np.int64) * 256 + raw[:, 1]
    left = raw[:, 2].astype(np.int64) * 256 + raw[:, 3]
    # Contexts of one anchor: those with the same gram; ones that stand alone have nothing to compare.
    body = raw[:, 4:]
    gram = body[np.arange(len(merged))[:, None], left[:, None] + np.arange(GRAM)[None, :]]
    _, group, times = np.unique(np.ascontiguousarray(gram).view(f"V{GRAM}").ravel(), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[group] > 1)
    several = several[np.argsort(group[several], kind="stable")]
    mask = np.zeros((len(merged), (span + 7) // 8 * 8), dtype=np.uint8)
    a = 0
    while a < len(several):
        b = min(len(several), a + BATCH)
        while b < len(several) and group[several[b]] == group[several[b - 1]]:
            b += 1
        at = several[a:b]
        ctx, place, _ = first_documents(body[at], size[at], least[at], length)
        mask[at[ctx], place] = 1
        a = b
    packed = np.packbits(mask, axis=1, bitorder="little")
    return pd.DataFrame({"shard": pdf["shard"], "bucket": pdf["bucket"], "least": [_z(least[w]) for w in where], "masks": [_z(packed[w]) for w in where]})


def _removed(row: dict, length: int, buckets: int) -> Iterator[tuple[int | None, bytes, np.ndarray]]:
    """(id, bytes, which of them are removed) for each of a shard's documents."""
    span = length - GRAM + 1
    ids, docs, repeats, (doc, s, e, bucket, no), _ = _cut(row, length, buckets)
    lens = np.array([len(d) for d in docs], dtype=np.int64)
    base = np.cumsum(lens) - lens
    edge = np.zeros(len(repeats) + 1, dtype=np.int32)
    again = np.flatnonzero(repeats)
    edge[again] += 1
    edge[again + length] -= 1
    if len(s):
        by = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[by]
        for answer in row["answers"] or []:
            at = by[np.searchsorted(sorted_buckets, answer["bucket"]) : np.searchsorted(sorted_buckets, answer["bucket"] + 1)]
            least = _unz(answer["least"], "<i8")
            masks = _unz(answer["masks"], "u1").reshape(len(least), (span + 7) // 8)
            later = ids[doc[at]] > least[no[at]]
            all_of = at[later]
            np.add.at(edge, base[doc[all_of]] + s[all_of], 1)
            np.add.at(edge, base[doc[all_of]] + e[all_of] + length, -1)
            some = at[~later]
            some = some[masks[no[some]].any(axis=1)]
            bits = np.unpackbits(masks[no[some]], axis=1, bitorder="little")
            k, t = np.nonzero(bits)
            begin = base[doc[some[k]]] + s[some[k]] + t
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    copies = set(row["copies"] or [])
    for key, k in zip(row["ids"], row["text_no"], strict=True):
        whole = lens[k] >= length and (k in copies or (NULL_ID if key is None else key) > ids[k])
        yield key, docs[k], np.ones(lens[k], dtype=bool) if whole else gone[base[k] : base[k] + lens[k]]


def _marked(df: DataFrame, length: int, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, int]:
    """Shards with all that says what goes (copies, wanted, answers), and into how many
    buckets anchors are dealt."""
    shards = checkpointed(_shards(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), length))
    total = shards.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    buckets = max(width(df.sparkSession), -(-total // RANGE_BYTES))

    digests = shards.select("shard", "least", F.posexplode("digests").alias("text_no", "digest")).select("shard", "text_no", F.get("least", F.col("text_no")).alias("id"), "digest")
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest", "first")
    copies = digests.join(firsts, "digest").filter(F.col("id") > F.col("first")).groupBy("shard").agg(F.collect_list("text_no").alias("copies"))
    repeated = _anchors(shards, length, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda pdf: _repeated(pdf, hot), "shard long, bucket int, wanted binary, hot binary")
    wanted = repeated.groupBy("shard").agg(F.collect_list(F.struct("bucket", "wanted", "hot")).alias("wanted"))
    known = checkpointed(copies.join(wanted, "shard", "full"))
    asked = shards.drop("digests", "n_bytes").join(known, "shard", "left")
    merged = _contexts(asked, length, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda pdf: _merge(pdf, length), "shard long, bucket int, least binary, masks binary")
    back = merged.groupBy("shard").agg(F.collect_list(F.struct("bucket", F.col("least"), "masks")).alias("answers"))
    return asked.join(back, "shard", "left"), buckets


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeat_digests(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256)."""

    marked, buckets = _marked(df, length, id_col, text_col, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for row in _rows(batches):
            out = []
            for key, d, gone in _removed(row, length, buckets):
                begins, _ = _runs(gone)
                rest = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes() if len(begins) else d
                out.append((key, len(d), len(d) - len(rest), len(begins), hashlib.sha256(rest).hexdigest()))
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (id, text, n_bytes, n_removed, starts, ends, whole_md5): what is left of each text,
    the removed spans in bytes, and the digest of the whole text, which tells rows of one id
    apart. Characters that a span cuts through go with it."""

    marked, buckets = _marked(df, length, id_col, text_col, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for row in _rows(batches):
            out = []
            for key, d, gone in _removed(row, length, buckets):
                begins, ends = _runs(gone)
                parts = [d[a:b].decode("utf-8", "ignore") for a, b in zip([0, *ends], [*begins, len(d)], strict=True)]
                out.append((key, "".join(parts), len(d), int(gone.sum()), begins.tolist(), ends.tolist(), hashlib.md5(d).hexdigest()))
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.list_(pa.int64())), pa.array(c[6])], names=["id", "text", "n_bytes", "n_removed", "starts", "ends", "whole_md5"])

    return marked.mapInArrow(run, "id long, text string, n_bytes long, n_removed long, starts array<long>, ends array<long>, whole_md5 string").withColumnRenamed("id", id_col)
