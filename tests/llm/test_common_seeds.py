"""A seed that many passages share costs a document no more than one that a single passage has."""

import numpy as np
import pytest

from lodestone.llm import substring

rng = np.random.default_rng(8)


def words(n, kinds=None):
    return rng.integers(0, kinds or 1 << 62, n).astype(np.uint64)


def plain(passages, doc, hashes):
    """Covered words by all windows of all passages of earlier documents."""
    size, covered = substring.WINDOW, np.zeros(len(hashes), bool)
    seen = {tuple(w[i : i + size].tolist()) for owner, w in passages if owner < doc for i in range(len(w) - size + 1)}
    for i in range(len(hashes) - size + 1):
        if tuple(hashes[i : i + size].tolist()) in seen:
            covered[i : i + size] = True
    return covered


def shard_of(passages):
    shard = substring.Shard()
    for owner, w in passages:
        shard.add(owner, w)
    shard.compile()
    return shard


def calls(monkeypatch, line, many, doc):
    """How often arrays are searched for one document while ``many`` passages hold a common line."""
    shard, count, find = shard_of([(k, np.concatenate([words(2 * substring.BLOCK), line, words(45)])) for k in range(many)]), [0], np.flatnonzero

    def counted(*a):
        count[0] += 1
        return find(*a)

    with monkeypatch.context() as patch:
        patch.setattr(substring.np, "flatnonzero", counted)
        assert not shard.occurrences(many, doc).any()
    return count[0]


def test_a_common_line_is_not_tried_on_every_passage(monkeypatch):
    line = words(49)
    doc = np.concatenate([words(60), line, words(60)])
    assert calls(monkeypatch, line, 400, doc) == calls(monkeypatch, line, 20, doc) < 10


@pytest.mark.parametrize("kinds", [1, 2, 5, None])
def test_occurrences_are_those_of_all_windows(kinds):
    shared = [words(n, kinds) for n in (50, 63, 140)]
    passages = [(int(rng.integers(0, 9)), np.concatenate([words(int(rng.integers(0, 40)), kinds), shared[k % 3], words(int(rng.integers(0, 40)), kinds)])) for k in range(12)]
    shard = shard_of(passages)
    for doc in range(10):
        own = np.concatenate([words(20, kinds), shared[doc % 3], words(30, kinds), shared[(doc + 1) % 3][:49], words(1), shared[2][70:125]])
        for hashes in (own, own[:50], own[:49], own[:0], own[::-1].copy()):
            assert np.array_equal(shard.occurrences(doc, hashes), plain(passages, doc, hashes))


def test_a_shard_without_passages_covers_nothing():
    assert not shard_of([]).occurrences(3, words(80)).any()
