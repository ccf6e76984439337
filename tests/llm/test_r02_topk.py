"""Findings of round 2 that were open: a block of queries scores together."""

import numpy as np

from codeloom.llm import topk


def test_a_block_finds_what_each_query_finds(monkeypatch):
    monkeypatch.setattr(topk, "SCORED", 50)
    rng = np.random.default_rng(5)
    for n, most in ((1, 3), (17, 2), (700, 3), (700, 9000)):  # small components have many ties
        v = rng.integers(-most, most + 1, (n, 6))
        ids = np.sort(rng.integers(0, n, n))
        lists = topk.SortedLists(ids, v)
        q = np.concatenate([v[: n // 2 + 1], np.zeros((1, 6), dtype=np.int64)])
        own = np.concatenate([ids[: n // 2 + 1], [ids[0]]])
        for (got_ids, got), key, x in zip(lists.tops(own, q, 5), own, q, strict=True):
            s = v @ x
            want = sorted((-int(s[i]), int(ids[i])) for i in range(n) if ids[i] != key)[:5]
            assert [(-int(a), int(b)) for a, b in zip(got, got_ids, strict=True)] == want


def test_a_block_stops_early_on_clusters():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-2, 3, (4000, 8)), 500 + rng.integers(-2, 3, (40, 8))])
    lists = topk.SortedLists(np.arange(len(v)), v)
    found = lists.tops(np.arange(4000, 4010), v[4000:4010], 5)
    assert all((ids >= 4000).all() for ids, _ in found) and lists.examined < len(v) / 2
