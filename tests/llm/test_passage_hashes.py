"""Words and windows hashed by passage removal."""

import numpy as np

from graphmend.llm import substring_dedup


def test_only_words_of_the_spans_are_hashed(monkeypatch):
    texts = [" ".join(f"w{i % 37}x{j}" for i in range(200 + j)).encode() for j in range(3)] + [b""]
    whole, first, _, _ = substring_dedup._hashed(texts, 13)
    seen = []
    real = substring_dedup._Hashes.of
    monkeypatch.setattr(substring_dedup._Hashes, "of", lambda self, words: seen.append(len(words)) or real(self, words))
    lists, _, _ = substring_dedup._split(texts)
    begin, n = np.array([5, 9, int(first[1]), int(first[2]) + 150]), np.array([4, 6, 1, 40])
    some = substring_dedup._hashed_at(lists, begin, n, 13)
    for b, m in zip(begin.tolist(), n.tolist()):
        assert np.array_equal(substring_dedup.window_hashes(some, 13)[b:b + m], substring_dedup.window_hashes(whole, 13)[b:b + m])
    assert seen == [22 + 13 + 52]


def test_window_hashes_are_the_plain_sums():
    words = np.random.default_rng(0).integers(0, 2**64 - 1, 400, dtype=np.uint64)
    for k in (9, 13, 400):
        plain = words[:len(words) - k + 1].copy()
        for i in range(1, k):
            plain = plain * substring_dedup._A + words[i:i + len(plain)]
        assert np.array_equal(substring_dedup.window_hashes(words, k), substring_dedup._mix(plain).view(np.int64))
