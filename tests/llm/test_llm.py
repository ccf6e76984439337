"""Training-data operators against brute force, and their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat, language_id, line_dedup, ngram_join, packing, piece_codec, quality, suffix_dedup, token_files, tokens, topk
from codeloom.llm.graph import connected_components
from codeloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from codeloom.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, shard int"  # with names that the operators use


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i if i is not None else None, t, "en", "s", 0, 7, "k", 1) for i, t in texts], DOCS)


def fixture():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(30)
    out = [base, base, text(3), "", None, "é" * 40 + base, "word", "word", passage + " " + text(40), text(20) + " " + passage, text(60) + " " + passage, text(4000)]
    for k in range(12):
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += ["a b c", "A b C", "a b c d", base.upper(), "\n".join([base[:60]] * 3)]
    return list(enumerate(out)) + [(None, base), (3, "x" * 130), (3, "x" * 130)]


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_repeats(rows, length):
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, 1 << 64), key(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < key(i):
                gone[a : a + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [2, 10_000])
def test_suffix_dedup(spark, hot):
    rows = fixture()
    got = Counter(tuple(r) for r in suffix_dedup.repeat_digests(docs(spark, rows), 50, hot=hot).collect())
    assert got == brute_repeats(rows, 50)
    largest = rows + [((1 << 63) - 1, rows[0][1])]
    assert Counter(tuple(r) for r in suffix_dedup.repeat_digests(docs(spark, largest).coalesce(1), 50, hot=hot).collect()) == brute_repeats(largest, 50)  # one shard
    left = suffix_dedup.remove_repeats(docs(spark, rows), 50).collect()
    assert sum(r["n_removed"] for r in left) == sum(k[2] * n for k, n in brute_repeats(rows, 50).items())
    assert suffix_dedup.repeat_digests(docs(spark, []), 50).count() == 0


def test_suffix_array_and_kasai():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    symbols = np.concatenate([np.frombuffer(s.encode(), dtype=np.uint8) for s in strings]).astype(np.int16)
    lens = np.array(list(map(len, strings)))
    starts = np.cumsum(lens) - lens
    room = np.concatenate([np.arange(n, 0, -1) for n in lens])
    suffixes = [s[k:] for s in strings for k in range(len(s))]
    order = suffix_dedup.suffix_array(symbols, room, 30)
    assert order.tolist() == sorted(range(len(suffixes)), key=lambda i: (suffixes[i], i))
    lcp = suffix_dedup.kasai(symbols, room, starts, order)
    for r in range(1, len(order)):
        a, b = suffixes[order[r - 1]], suffixes[order[r]]
        assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_repeats_of_a_shard_by_its_suffix_array():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n)).encode()
    shared, run = text(400), b"z" * 300
    texts = [text(200) + shared, shared[:120] + text(90), run, run + text(30) + run, text(20), b"", text(700) + shared[40:330] + text(60), shared + run, text(49), b"ab" * 200, b"ab" * 333]
    ids = np.array([5, 3, 3, 9, 1, 2, 7, 7, 4, 6, 6])
    first = {}
    for i, t in zip(ids.tolist(), texts):
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(first.get(t[a : a + 50], 99), i)
    want = [a + 50 <= len(t) and first[t[a : a + 50]] < i for i, t in zip(ids.tolist(), texts) for a in range(len(t))]
    assert suffix_dedup.repeats_in_shard(texts, ids, 50).tolist() == want


def test_shards_merge_by_binary_search():
    rng = random.Random(2)
    lists = [np.array(sorted({rng.randrange(200) for _ in range(rng.randint(0, 60))}), dtype=np.int64) for _ in range(7)]
    assert suffix_dedup.merge_sorted(list(lists)).tolist() == sorted({int(x) for v in lists for x in v})


def test_ngram_join(spark, monkeypatch):
    rows = [*fixture(), ((1 << 63) - 1, "only the largest id has these words of its own"), (None, "only a null id has these other words of its own")]
    for words, pct in ((4, 85), (5, 80)):
        sets = [frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []) for w in (word_list(t) for _, t in rows)]
        key = [(1 << 63) - 1 if i is None else i for i, _ in rows]
        comp = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                    x, y = comp[a], comp[b]
                    comp = [y if c == x else c for c in comp]
        least = defaultdict(lambda: 1 << 64)
        for c, k in zip(comp, key):
            least[c] = min(least[c], k)
        real = {c: max((i for (i, _), d in zip(rows, comp) if d == c and i is not None), default=None) for c in comp}
        want = Counter((i, len(s), real[c] if least[c] == (1 << 63) - 1 else least[c]) for (i, _), s, c in zip(rows, sets, comp))
        for small, large, block in ((48, 1024, 2048), (1, 1024, 2048), (1, 2, 3)):  # without and with groups, and with representatives and blocks
            with monkeypatch.context() as m:
                m.setattr(ngram_join, "SMALL_BUCKET", small)
                m.setattr(ngram_join, "LARGE", large)
                m.setattr(ngram_join, "BLOCK", block)
                assert Counter(tuple(r) for r in ngram_join.jaccard_components(docs(spark, rows), words, pct).collect()) == want
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("few", [1 << 18, 40, 0])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr("codeloom.llm.graph.FEW", few)
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and {got[k] for k in range(200, 260)} == {200}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


ODD = ["", "  a  b ", "a\tb\nc", "▁x", "ﬁ é ① 　x", "0\x00a", "<s> <0x0A>", "aaaa" * 50, " " * 40, "漢字😀", "x" * 3000, "Σ ΑΣ İ", "can't 'S \x1c \x85 .", "\n\n a  \n", "<|endoftext|>"]


def test_piece_codec(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    c = piece_codec.PieceCodec(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(ODD) for _ in range(5)) for _ in range(200)]
    for t in texts:
        ids = lib.encode(t)
        assert c.encode(t).tolist() == ids and c.decode(ids) == lib.decode(ids)
    rows = piece_codec.piece_digests(docs(spark, list(enumerate(ODD)) + [(99, None), (0, "")]), path).collect()
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(ODD):
        ids = lib.encode(t)
        assert by[i]["n_tokens"] == len(ids) and by[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert by[99]["n_tokens"] == 0 and len(rows) == len(ODD) + 2
    assert piece_codec.encode_pieces(docs(spark, [(1, "a b")]), path).first()["ids"] == lib.encode("a b")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_by_word_ids(name):
    e = Encoder(tokenizer_path(name))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(ODD + [" th", "ing", ", "]) for _ in range(6)) for _ in range(300)]
    assert e.encode_all(texts) == [e.whole(t) for t in texts] and e.encode(None) == b""


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_with_tails(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MOST_TAILS", 5)
    monkeypatch.setattr(tokens, "TOGETHER", 300)
    lib = Tokenizer.from_file(tokenizer_path(name))
    e = Encoder(tokenizer_path(name))
    rng = random.Random(8)
    stems = ["it", "Été", "straße", "ÀÉ", "x1", "3", "ª", "жар", "日本", "don't", "e\u0301", "o'", "", "K", "İ"]
    tails = ["", ",", "'s", "'", "!!", "'ll.", "...", "</w>", "<", "=\u0338", "²", "\xa0", "-a", '"', "$$$"]
    texts = [rng.choice(" \n").join(rng.choice(stems) + rng.choice(tails) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert e.encode_all(texts) == want and len(e.tails) <= len(tails)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_library_has_them(name):
    from tokenizers import Tokenizer

    lib, e = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    texts = ["a <|endoftext|> b", "a<|endoftext|>", "<|startoftext|>x", "A <|ENDOFTEXT|> <| b", "plain words " * 40 + "<|endoftext|> and more", "", "< | endoftext |>"]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert e.encode_all(texts) == want and [e.whole(t) for t in texts] == want


def test_word_cache_is_bounded_in_bytes():
    from codeloom.llm._util import WordCache

    cache = WordCache(lambda words: [w.upper() for w in words], 5000)
    for k in range(200):
        words = [f"w{k}", "often", f"w{k // 2}"]
        assert cache.lookup(words) == [w.upper() for w in words]
        assert cache.held <= 5000 + 3 * 220 and len(cache.old) <= 30


def test_plan_is_no_worse_than_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([10, 20, 50])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 40)))
        ranges, n = packing.plan(dict(counts), capacity)
        filled = defaultdict(list)
        for length, t in ranges.items():
            for (a, seq, off), b in zip(t, [*t[1:, 0], counts[length]]):
                for k in range(b - a):
                    filled[seq + k].append((off, length))
        assert len(filled) == n and Counter(x for b in filled.values() for _, x in b) == counts
        for b in filled.values():
            at = 0
            for off, length in sorted(b):
                assert off == at
                at += length
            assert at <= capacity
        rooms = []
        for x in sorted(counts.elements(), reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - x)
        assert n <= len(rooms)


def test_packing(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = fixture()
    lib = Encoder(path)
    got = packing.pack_pieces(docs(spark, rows), path, 128).collect()
    assert packing.pack_pieces(docs(spark, []), path, 128).count() == 0
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in seqs.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 128
    want = Counter()
    for i, t in rows:
        ids = lib.whole(t or "") + struct.pack("<I", 0)
        n, start, piece = len(ids) // 4, 0, 0
        while start < n:
            length = (n - start) % 128 or 128
            want[(i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))] += 1
            start, piece = start + length, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(5, np.uint32), rng.integers(0, 49408, 3000).astype(np.uint32), np.r_[rng.integers(0, 50, 2000), 2**32 - 1].astype(np.uint32)):
        cut = len(ids) // 3
        seg = token_files.Segment(token_files.pack_segment([4, -1], [ids[:cut].astype("<u4").tobytes(), ids[cut:].astype("<u4").tobytes()]))
        assert (seg.read_ids(0, len(ids)) == ids).all() and (seg.read_ids(cut, len(ids) - 1) == ids[cut:-1]).all()
        assert seg.ends.tolist() == [cut, len(ids)] and seg.doc_ids.tolist() == [4, -1]


def test_token_files(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [r for r in fixture() if r[0] is not None]
    lib = Encoder(path)
    odd = token_files.token_file_digests(docs(spark, [(None, "a b"), (-(1 << 63), "c"), ((1 << 63) - 1, "<|endoftext|>"), (None, None)]), path).collect()
    assert Counter(r["doc_id"] for r in odd) == Counter([None, None, -(1 << 63), (1 << 63) - 1])
    assert sorted(r["start"] for r in odd if r["doc_id"] is None)[0] == 0 and sum(r["n_tokens"] for r in odd) == 8
    got = sorted(tuple(r) for r in token_files.token_file_digests(docs(spark, rows), path).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = lib.whole(t or "") + struct.pack("<I", 1)
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    three = [w[2] for w in want if w[0] == 3]
    assert len(three) == 3 and [w for w in got if w[0] != 3] == [w for w in want if w[0] != 3] and sorted(w[2] for w in got if w[0] == 3) == sorted(three)
    assert token_files.token_file_digests(docs(spark, []), path).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.round(rng.normal(size=(90, 6)) / 4, 2))]
    rows += [(200, None, 1), (220, [1.0, None] + [0.0] * 4, 1), (240, [float("nan")] * 6, 1), (260, [0.0] * 6, 1), (280, [1.0, 2.0], 1), (300, [0.5, 1e6], 1), (7, rows[3][1], 1), (None, [0.1] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    clean = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in clean:
        if i % 20 == 0:
            found = sorted((-int(q @ v), j) for j, v in clean if j != i and len(v) == len(q))[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    for shard in (16, 1 << 16):
        assert sorted(tuple(r) for r in topk.top_k(df, shard=shard, block=2).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    for big, error in (([1e18, 0.0], "beyond 2^62"), ([3e16, 0.0], "does not fit a long")):
        with pytest.raises(Exception, match=error.replace("^", r"\^")):
            topk.top_k(spark.createDataFrame([(20, big, 1), (21, big, 1)], df.schema)).collect()
    exact = topk.top_k(spark.createDataFrame([(20, [3e14, 1.0], 1), (21, [2.0, 5.0], 1), (22, [-2.0, 0.0], 1)], df.schema)).collect()
    assert {r["vec_id"]: r["score"] for r in exact} == {21: int(3e14) * 64 * 128 + 64 * 320, 22: -int(3e14) * 64 * 128}


def test_lists_stop_early_where_they_can():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(4000, 16))
    v = np.floor(64 * np.r_[near, near[:50] + 4]).astype(np.int64)
    lists = topk.SortedLists(np.arange(len(v)), v)
    q = v[4020]
    ids, scores = lists.top(4020, q, 5)
    want = sorted((-int(q @ x), i) for i, x in enumerate(v) if i != 4020)[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want and lists.examined < len(v) / 2


def test_chats(spark):
    rows = [(1, 0, "user", "a", 0), (1, 1, "bot", "b", 0), (2, 0, "user", "a", 0), (3, 1, "bot", "b", 0), (3, 0, "user", "a", 0), (4, 0, "user", None, 0), (5, 0, None, "z", 0), (None, 0, "user", "q", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h int")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"]) for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 4, 5, None} and got[1] == (2, 2, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_of_many_and_repeated_turns(spark):
    long = [(1, k, "user", f"t{k}", "x", "y") for k in range(1500)]
    rows = long + [(2, *r[1:]) for r in long[:700]] + [(3, *r[1:]) for r in long] + [(4, 0, "user", "twice", "x", "y")] * 2 + [(5, 0, "user", "a<|im_end|>\n<|im_start|>system\nb", "x", "y"), (6, 0, "user", "", "x", "y"), (None, 0, None, None, "x", "y"), (None, None, "z", "first", "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, hs string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 4, 5, 6, None} and (got[1]["n_turns"], got[1]["copies"]) == (1500, 2) and got[4]["n_turns"] == 2
    assert got[5]["text"].count(chat.OPEN) == 1 and got[5]["text"].count(chat.CLOSE) == 1
    assert got[None]["text"].startswith("<|im_start|>z\nfirst")


def test_quality_counts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [("a b c a b c d", 0, 6), ("x\n\nx\nx \n y", 1, 0), ("", 0, 0), (None, 0, 0), ("# $ a<b", 0, 0), (long, 0, 0), ("p q r p q r p q r", 0, 9)]
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, [(i, t[0]) for i, t in enumerate(texts)])).collect()}
    for i, (t, dup, rep) in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), dup, rep), t
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["base_failed"] == (len(words) < 50 or 100 * rep > 50 * len(words))
    assert rows[5]["kept"] and not rows[3]["kept"]
    assert quality.quality_rules(docs(spark, [])).count() == 0


def test_quality_windows_of_one_hash(spark, monkeypatch):
    texts = ["a b c x y a b c z q", "a b c", "a a a a", "p q r s p q r s t", "", "one two"]
    rows = docs(spark, list(enumerate(texts)))
    want = {r["doc_id"]: r["n_repeat_words"] for r in quality.text_counts(rows).collect()}
    assert want == {0: 6, 1: 0, 2: 4, 3: 8, 4: 0, 5: 0}
    for h in (F.lit(0).cast("long"), None):  # all windows of one hash, and of few
        monkeypatch.setattr(quality, "_window_hash", lambda w, i, h=h: h if h is not None else F.length(F.get(w, i)).cast("long") + F.ascii(F.get(w, i + 2)) % 2)
        assert {r["doc_id"]: r["n_repeat_words"] for r in quality.text_counts(rows).collect()} == want


def test_thresholds_adapt_to_the_source(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    prose = lambda symbols: " ".join([word() for _ in range(80)] + ["#$%"] * symbols)
    odd = prose(12)
    rows = [(k, prose(0), "en", "news", 1) for k in range(70)] + [(100 + k, prose(k % 16), "en", "code", 1) for k in range(70)]
    rows += [(1000, odd, "en", "news", 1), (1001, odd, "en", "code", 1), (1002, odd, None, None, 1), (1003, None, None, None, 1), (1003, prose(0), "en", "few", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bucket int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(table).collect() if r["doc_id"] >= 1000 and not r["base_failed"]}
    assert kept[1000] is False and kept[1001] is True and kept[1003] is True
    clean = [r["kept"] for r in quality.quality_rules(table).collect() if r["doc_id"] < 1000]
    assert sum(clean) >= len(clean) - 2
    same = spark.createDataFrame([(k, prose(0), "en", "s", 1) for k in range(60)] * 2, table.schema)
    assert sum(not r["kept"] for r in quality.quality_rules(same).collect()) <= 2


def test_line_dedup(spark):
    rows = [(k, "h", f"menu\nown {k}\n menu \n") for k in range(6)] + [(9, None, "menu\nx"), (10, "g", None)]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    got = {r["id"]: (r["text"], r["_ld_lines"], r["_ld_removed"]) for r in line_dedup.drop_boilerplate(df, F.col("host")).collect()}
    assert got[2] == ("own 2\n", 3, 2) and got[9] == ("menu\nx", 2, 0) and got[10] == (None, 0, 0)
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("host")).count() == 0


def test_line_dedup_with_a_large_table_of_lines(spark, monkeypatch):
    rows = [(k, f"h{k % 3}" if k % 4 else None, f"menu {k % 3}\nown {k}\nmenu {k % 3} \n" + "long line " * (5000 if k == 7 else 0)) for k in range(60)] + [(5, "h2", "menu 2\nown 5\nmenu 2 \n")]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    want = Counter(tuple(r) for r in line_dedup.drop_boilerplate(df, F.col("host")).collect())
    assert sum(r[4] for r in want.elements()) == 2 * 61
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert Counter(tuple(r) for r in line_dedup.drop_boilerplate(df, F.col("host")).collect()) == want
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(df.withColumn("_ld_x", F.lit(1)), F.col("host"))


def test_page_lines_of_odd_pages(spark):
    page = "<html><script>var x = '<p>no</p>';</script><!-- no --><p>menu</p><STYLE>p {}</STYLE><p>own {}</p></html>"
    rows = [(k, "http://a.b/x", page.replace("{}", str(k)), 1) for k in range(6)] + [(6, None, page, 1), (7, "http://a.b/y", None, 1), (7, "http://a.b/y", None, 1), (8, "no address", "", 1), (None, "http://u@A.B:80/z", "<p>menu</p>", 1), (9, "http://a.b/z", "<p>word</p>" * 50_000, 1)]
    got = line_dedup.page_lines(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["n_lines"], r["n_removed"]) for r in got}
    assert by[0] == ("a.b", 2, 1) and by[6] == (None, 2, 0) and by[7] == ("a.b", 0, 0) and by[8] == (None, 0, 0) and by[None] == ("a.b", 1, 1) and by[9] == ("a.b", 50_000, 0)
    assert line_dedup.page_lines(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_id(spark):
    table = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    trees = language_id.train(table.filter(~language_id.held_out()))
    got = language_id.identify(table, trees, carry=("lang",)).withColumn("held", language_id.held_out()).toPandas()
    assert (got["lang"] == got["lang_pred"])[got["held"]].mean() > 0.98
    odd = language_id.identify(docs(spark, [(1, None), (2, ""), (3, "12 34 !?"), (4, "the"), (None, "der die das und")]), trees).collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in odd) and odd[3]["lang_pred"] != "und"
    assert language_id.train(docs(spark, [])) is None
    assert language_id.identify(docs(spark, [(1, "a")]), None).first()["lang_pred"] == "und"


SCRIPTS = {"x": "abracadabra abra", "y": "zyzzyva zyz zyzzyva", "ru": "жили были дед да баба и была у них курочка", "el": "ένα δύο τρία τέσσερα πέντε", "zh": "学而时习之不亦说乎有朋自远方来", "he": "שלום עולם שלום"}


def strings_of(texts):
    out = []
    for o in range(language_id.ORDER + 1):
        c = Counter(int.from_bytes((language_id.PAD + t)[i - o : i + 1], "big") for t in texts for i in range(language_id.ORDER, language_id.ORDER + len(t)))
        out.append((np.array(list(c), dtype=np.int64), np.array(list(c.values()), dtype=np.int64)))
    return out


def brute_code_length(texts, text):
    """Of ``text`` after blanks, by the trees of ``texts``, in bits."""
    order = language_id.ORDER
    stats = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        data = language_id.PAD + t
        for i in range(order, len(data)):
            for o in range(order + 1):
                stats[o][data[i - o : i]][data[i]] += 1
    total, padded = 0.0, language_id.PAD + text
    for i in range(order, len(padded)):
        for o in range(order, -1, -1):
            seen = stats[o].get(padded[i - o : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if padded[i] in seen:
                    total -= np.log2(seen[padded[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_by_brute_force(monkeypatch):
    data = {k: [t.encode()] for k, t in SCRIPTS.items()}
    texts = [b"abra zyz abracadabra", "была баба курочка abra".encode(), "有朋 δύο שלום".encode(), bytes(range(1, 250)), b"", b"z"]
    for block in (8, 4):
        monkeypatch.setattr(language_id, "BLOCK", block)
        m = language_id.learn({k: strings_of(b) for k, b in data.items()})
        got = m.code_lengths(texts)
        want = [[brute_code_length(data[k], t) for k in m.langs] for t in texts]
        assert np.allclose(got / language_id.UNIT, want, atol=0.5)  # each byte is rounded
        assert [m.langs[i] for i in got[:2].argmin(axis=1)] == ["x", "ru"]
        for chunk in (7, 3):
            monkeypatch.setattr(language_id, "CHUNK", chunk)
            assert (m.code_lengths(texts) == got).all()
        monkeypatch.setattr(language_id, "CHUNK", 1 << 18)


def test_trees_from_a_table(spark, monkeypatch):
    rows = [(k, t, lang, "s", 0, 7, "k", 1) for lang, t in SCRIPTS.items() for k in range(3)]
    long = "дед да баба " * 60_000
    table = spark.createDataFrame([*rows, (9, None, "x", "s", 0, 7, "k", 1), (None, "x", "x", "s", 0, 7, "k", 1), (8, "x", None, "s", 0, 7, "k", 1)], DOCS)
    m = language_id.train(table)
    data = {k: [t.encode()] * 3 for k, t in SCRIPTS.items()}
    assert m.langs == sorted(SCRIPTS)
    texts = ["курочка zyz".encode(), "学而 τρία".encode()]
    assert np.allclose(m.code_lengths(texts) / language_id.UNIT, [[brute_code_length(data[k], t) for k in m.langs] for t in texts], atol=0.5)
    asked = [(1, long), (1, "שלום עולם"), (1, "שלום עולם"), (None, "zyz zyzzyva"), (2, None), (3, ""), (4, "7 !")]
    got = language_id.identify(docs(spark, asked), m, carry=("id",)).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter([(1, "ru"), (1, "he"), (1, "he"), (None, "y"), (2, "und"), (3, "und"), (4, "und")])
    small = language_id.train(table, max_cells=6 * 20)  # contexts that were seen seldom go
    assert all(len(c.costs[o]) <= 6 * 20 for c in small.blocks for o in range(2, language_id.ORDER + 1))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    rows = lambda d: sorted(tuple(str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in table.collect()}
    df = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, SF).toPandas(), table.schema)
        assert df.columns == table.columns, name
    after = df.collect()
    assert 0 < len(after) <= len(before) and len({r["doc_id"] for r in after}) == len(after)
    assert all(len(r["text"]) <= len(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in after)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in after}


def test_pipeline_keeps_null_ids_and_one_row_of_repeated_ones(spark):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    near = lambda t: t + " end"
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, near(b)), (1, c), (2, near(c)), (2, d), (5, e), (5, e), (5, f), (None, near(f)), (8, None), (None, ""), (None, "")]
    table = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.join_near_copies(spark, table, SF)
    count = Counter((r["doc_id"], r["text"]) for r in got.collect())
    kept_of_b = [t for t in (b, near(b)) if count[(None, t)]]
    assert len(kept_of_b) == 1
    assert count == Counter([(None, a), (None, kept_of_b[0]), (1, c), (2, d), (5, e), (5, f), (8, None), (None, ""), (None, "")])
    assert corpus_pipeline.join_near_copies(spark, table.limit(0), SF).count() == 0

    left = corpus_pipeline.remove_repeated_passages(spark, spark.createDataFrame(got.collect(), table.schema), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter({(i, t or ""): n for (i, t), n in count.items()})
    source = {(i, t or ""): {f"s{k}" for k, x in enumerate(rows) if x == (i, t)} for i, t in rows}
    assert all(r["source"] in source[(r["doc_id"], r["text"])] for r in left)



def test_pipeline_drops_repeated_lines_of_a_source(spark):
    import corpus_pipeline

    own = lambda k: f"first words of {k} and some more\nlast words of {k} and some more"
    rows = [(k, own(k) + ("\nsubscribe now" if k % 20 == 0 else "\nseen twice" if k in (3, 5) else "")) for k in range(300)]
    copies = [(1000 + k, f"a long line that near copies share, and another one\ncopy {k}") for k in range(10)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + copies], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, df, SF).collect()}
    want = {i: own(i) if i % 20 == 0 else t for i, t in rows} | dict(copies)
    assert got == want


def test_small_languages_keep_their_bytes():
    rng = random.Random(3)
    data = {"big": bytes(rng.randrange(128) for _ in range(20_000)), "p": bytes(rng.randrange(192, 208) for _ in range(300)), "q": bytes(rng.randrange(208, 224) for _ in range(300))}
    m = language_id.learn({k: strings_of([b]) for k, b in data.items()})
    cost = m.code_lengths([data["p"][:60], data["q"][:60]])
    assert cost.argmin(axis=1).tolist() == [m.langs.index("p"), m.langs.index("q")]
    assert cost[0, m.langs.index("q")] > 60 * 4 * language_id.UNIT > cost[0, m.langs.index("p")]
