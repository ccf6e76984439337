"""SentencePiece encoding and decoding by vectorised merge rounds.

Words are flat numpy symbol arrays. In each round every pair of neighbours gets
the rank of the piece that it forms, a segmented minimum finds each word's best
pair, all words merge their leftmost best pair at once (all its places where that
is provably the same), arrays are compacted, and words without a pair leave.
Only the piece table (pieces, scores, kinds) comes from the model file.

Null texts are empty texts: no ids. Any text has a result, as characters outside
the vocabulary become byte pieces. Repeated rows give repeated results; only the
id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._util import WordCache, rows_of, tidy

SPACE = "▁"
NONE = np.iinfo(np.int32).max


class PieceCodec:
    """Encoder and decoder for one BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.surface: list[bytes] = [b""] * n
        self.is_byte = np.zeros(n, dtype=bool)
        self.byte_id = np.zeros(256, dtype=np.int64)
        ids: dict[str, int] = {}
        scores = np.zeros(n)
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[b := int(piece[3:5], 16)] = i
                self.surface[i], self.is_byte[i] = bytes([b]), True
            elif lib.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not lib.is_control(i):
                ids[piece], scores[i] = i, lib.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that go over a word's end are not supported")
        self.n = n
        self.name = list(map(str, range(n)))
        # Symbols: ids of pieces, then characters that are only parts of pieces, then one for all other characters.
        symbols = dict(ids)
        for ch in sorted({c for p in ids for c in p} - ids.keys()):
            symbols[ch] = n + len(symbols) - len(ids)
        self.other = n + len(symbols) - len(ids)
        self.m = self.other + 1
        points = np.array(sorted((ord(s), k) for s, k in symbols.items() if len(s) == 1), dtype=np.int64)
        self.of_point = np.full(0x110000, self.other, dtype=np.int32)
        self.of_point[points[:, 0]] = points[:, 1]
        rank_of = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.m + b] = (int(rank_of[i]), i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self._index(keys, np.array([pairs[k][0] for k in keys], dtype=np.int32), np.array([pairs[k][1] for k in keys], dtype=np.int32))
        solo = [c for c in "\n\t\r" if all(c not in p for p in ids)]  # in no piece: a boundary on both sides
        cls = re.escape("".join(solo))
        self.words = re.compile(f"[{cls}]|{SPACE}*[^{SPACE}{cls}]+|{SPACE}+" if solo else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache = WordCache(self._listed, 64 << 20)  # word -> its ids; strings only, which cost the garbage collector nothing
        self.texts = WordCache(self._spelled, 64 << 20)  # ids of a word -> text

    def _index(self, keys: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressed table of pairs, at most half full."""
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.t_key = np.full(size, -1, dtype=np.int64)
        self.t_rank = np.full(size, NONE, dtype=np.int32)
        self.t_piece = np.zeros(size, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.t_key[at[left]] == -1
            first = np.unique(at[left][free], return_index=True)[1]
            put = left[free][first]
            self.t_key[at[put]], self.t_rank[at[put]], self.t_piece[at[put]] = keys[put], rank[put], merged[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such piece) and piece of each pair of symbols."""
        keys = left.astype(np.int64) * self.m + right
        at = self._slot(keys)
        found = self.t_key[at]
        rank = np.where(found == keys, self.t_rank[at], NONE)
        piece = self.t_piece[at]
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            got = self.t_key[at[on]]
            hit = on[got == keys[on]]
            rank[hit], piece[hit] = self.t_rank[at[hit]], self.t_piece[at[hit]]
            on = on[(got != keys[on]) & (got != -1)]
        return rank, piece

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; words are as in the escaped text
        (spaces are U+2581)."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.of_point[flat]
        point = np.where(sym >= self.n, flat, -1)  # a character is still needed where it may end as bytes
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = piece = None
        stale = np.ones(len(sym), dtype=bool)
        while len(sym):
            if rank is None:
                rank, piece = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
            todo = np.flatnonzero(stale[:-1] & (word[1:] == word[:-1])) if len(sym) > 1 else np.zeros(0, dtype=np.int64)
            rank[stale] = NONE
            rank[todo], piece[todo] = self._pairs(sym[todo], sym[todo + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                out = np.repeat(over, sizes)
                done.append((word[out], sym[out], point[out]))
                stay = ~out
                sym, point, word, rank, piece = sym[stay], point[stay], word[stay], rank[stay], piece[stay]
                if not len(sym):
                    break
                best, sizes = best[~over], sizes[~over]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            is_best = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = np.repeat(np.arange(len(starts)), sizes)[is_best]
            take = self._choose(sym, word, rank, piece, is_best, owner)
            sym[take] = piece[take]
            point[take] = -1
            stale = np.zeros(len(sym), dtype=bool)
            stale[take] = True
            stale[np.maximum(take - 1, 0)] = True
            stay = np.ones(len(sym), dtype=bool)
            stay[take + 1] = False
            sym, point, word, rank, piece, stale = (x[stay] for x in (sym, point, word, rank, piece, stale))
        w, s, p = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, dtype=np.int64),) * 3
        by = np.argsort(w, kind="stable")
        w, s, p = w[by], s[by].astype(np.int64), p[by]
        raw = np.flatnonzero(s >= self.n)
        if len(raw):  # characters that are no piece end as bytes
            spelled = [self.byte_id[list(chr(c).encode("utf-8", "replace"))] for c in p[raw].tolist()]
            times = np.ones(len(s), dtype=np.int64)
            times[raw] = list(map(len, spelled))
            w, s = np.repeat(w, times), np.repeat(s, times)
            s[s >= self.n] = np.concatenate(spelled)
        return s, np.bincount(w, minlength=len(words))

    def _choose(self, sym, word, rank, piece, at, owner) -> np.ndarray:
        """Places to merge now: each word's leftmost best pair, and the later ones of
        the same piece where no pair that a merge makes ranks as high or higher."""
        first = np.r_[True, owner[1:] != owner[:-1]]
        if first.all():
            return at
        run = np.cumsum(np.r_[True, (np.diff(at) != 1) | (owner[1:] != owner[:-1])]) - 1
        run_start = np.flatnonzero(np.r_[True, np.diff(run) != 0])
        apart = (np.arange(len(at)) - run_start[run]) % 2 == 0  # of overlapping places every other one
        same = piece[at] == piece[at[np.flatnonzero(first)][np.cumsum(first) - 1]]
        c, own = at[apart], owner[apart]
        new, r = piece[c], rank[c]
        safe = np.ones(len(c), dtype=bool)
        n = len(sym)
        for there, beside in ((c - 1, -1), (c + 2, 2)):
            ok = (there >= 0) & (there < n)
            ok[ok] &= word[there[ok]] == word[c[ok]]
            k = np.flatnonzero(ok)
            left, right = (sym[there[k]], new[k]) if beside < 0 else (new[k], sym[there[k]])
            safe[k] &= self._pairs(left, right)[0] > r[k]
        near = np.flatnonzero((np.diff(c) == 2) & (own[1:] == own[:-1]))  # two merged neighbours
        safe[near] &= self._pairs(new[near], new[near + 1])[0] > r[near]
        bad = np.zeros(int(owner[-1]) + 1, dtype=bool)
        bad[own[~safe]] = True
        bad[owner[~same]] = True
        return at[first | (apart & ~bad[owner])]

    def _listed(self, words: list[str]) -> list[str]:
        """Each word's decimal ids joined by commas; their texts are kept as well."""
        ids, counts = self.merge(words)
        listed = ids.tolist()
        names, parts = list(map(self.name.__getitem__, listed)), list(map(self.surface.__getitem__, listed))
        out, texts, a = [], [], 0
        for b in np.cumsum(counts).tolist():
            out.append(",".join(names[a:b]))
            try:
                texts.append(b"".join(parts[a:b]).decode())
            except UnicodeDecodeError:
                texts.append(self._mend(ids[a:b]))
            a = b
        self.texts.add(out, texts)
        return out

    def _spelled(self, listed: list[str]) -> list[str]:
        return [self.decode_part(np.array(x.split(","), dtype=np.int64)) for x in listed]

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> np.ndarray:
        words = self.split(text or "")
        return self.merge(words)[0] if words else np.zeros(0, dtype=np.int64)

    def decode_part(self, ids: np.ndarray) -> str:
        out = b"".join([self.surface[i] for i in ids])
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._mend(ids)

    def _mend(self, ids: np.ndarray) -> str:
        """Byte pieces that are not UTF-8 become U+FFFD, one for each byte."""
        parts, i = [], 0
        while i < len(ids):
            k = i
            while k < len(ids) and self.is_byte[ids[k]] == self.is_byte[ids[i]]:
                k += 1
            raw = b"".join(self.surface[x] for x in ids[i:k])
            while raw:
                try:
                    parts.append(raw.decode())
                    break
                except UnicodeDecodeError as e:
                    parts.append(raw[: e.start].decode() + "�")
                    raw = raw[e.start + 1 :]
            i = k
        return "".join(parts)

    def decode(self, ids) -> str:
        """The text of ``ids``; the blank that encoding put in front goes."""
        text = self.decode_part(np.asarray(ids, dtype=np.int64))
        return text[1:] if text.startswith(" ") else text

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded text) of each text."""
        split = [self.split(t or "") for t in texts]
        ids = self.cache.lookup(list(chain.from_iterable(split)))
        back = self.texts.lookup(ids)
        a = 0
        for words in split:
            b = a + len(words)
            joined, text = ",".join(ids[a:b]).encode(), "".join(back[a:b])[1:].encode()
            a = b
            yield joined.count(b",") + 1 if joined else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each Python worker and model file."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, ``ids`` array<int>, ``decoded`` string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep_caches=True)
        c = codec(model)
        for batch in batches:
            for keys, texts in rows_of(batch):
                ids = [c.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())], names=["id", "ids", "decoded"])

    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text").mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def piece_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_pieces``, with the ids and the decoded text as SHA-256 digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep_caches=True)
        c = codec(model)
        for batch in batches:
            for keys, texts in rows_of(batch, 1 << 20):
                n, ids, back = zip(*c.digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text").mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
