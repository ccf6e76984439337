"""Findings of round 2 that were open: sorting in suffix arrays."""

import numpy as np

from codeloom.llm import suffix_dedup


def test_sorted_keys_carry_their_places():
    rng = np.random.default_rng(3)
    for bits in (12, 40, 62):  # the last has no room for places
        keys = rng.integers(0, 1 << bits, 5000) >> (bits // 2)
        by, ordered = suffix_dedup._by_key(keys.copy(), bits)
        assert by.tolist() == np.argsort(keys, kind="stable").tolist() and ordered.tolist() == np.sort(keys).tolist()


def test_repeats_do_not_depend_on_the_bits_of_a_first_rank(monkeypatch):
    part = bytes(range(33, 120))
    texts, ids = [b"ab" + part + b"x", part * 2, b"z" + part[5:] + part], np.array([3, 1, 2])
    want = []
    for own, t in zip(ids.tolist(), texts, strict=True):
        for a in range(len(t)):
            s = t[a : a + 50]
            want.append(len(s) == 50 and any(i < own and s in u for i, u in zip(ids.tolist(), texts, strict=True)))
    whole = suffix_dedup._by_key
    used = []
    monkeypatch.setattr(suffix_dedup, "_by_key", lambda keys, bits: used.append(bits) or whole(keys, bits))
    assert suffix_dedup.repeats_in_shard(texts, ids, 50).tolist() == want and used and max(used) <= 63
