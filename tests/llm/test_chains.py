"""Chains of rising matches, margins split word by word, and what leaves a task of the first pass over seeds."""

import numpy as np
import pytest

from tessera.llm import substring_dedup


def matches(places, own=1, src=2):
    pos, src_pos = np.array(places).T
    same = np.ones_like(pos)
    return np.stack([own * same, src * same, own * same, src * same, pos, src_pos, 6 * pos, 6 * pos + 30, 6 * src_pos, 6 * src_pos + 30], axis=1)


def test_rising_matches_need_no_tree(monkeypatch):
    def refused(*_):
        raise AssertionError("rising matches went through the tree")

    monkeypatch.setattr(substring_dedup, "chain", refused)
    gap = substring_dedup.LONGEST_GAP + substring_dedup.K
    m = np.concatenate([matches([(0, 7), (9, 17), (9 + gap + 1, 90), (9 + gap + 8, 99)]), matches([(5, 5)], src=3), matches([(1, 1), (4, 6)], own=2)])
    rows, counts = substring_dedup._chained(m)
    assert counts.tolist() == [2, 2, 2] and rows.tolist() == [0, 1, 2, 3, 5, 6]


@pytest.mark.parametrize("seed", range(20))
def test_chains_are_those_of_the_tree(seed):
    rng = np.random.default_rng(seed)
    pos = np.sort(rng.integers(0, 500, 60))
    src_pos = np.maximum(0, pos + rng.integers(-40, 41, 60) * (rng.random(60) < 0.2))
    m = np.unique(np.concatenate([matches(np.stack([pos, src_pos], 1)[:30]), matches(np.stack([pos, src_pos], 1)[30:], src=9)]), axis=0)
    rows, counts = substring_dedup._chained(m)
    got = {tuple(part) for part in np.split(rows, np.cumsum(counts)[:-1])}
    cut = int((m[:, 1] == 2).sum())
    expected = {tuple(c + begin) for begin, g in ((0, m[:cut]), (cut, m[cut:])) for c in substring_dedup.chain(g[:, 4], g[:, 5]) if len(c) > 1}
    assert got == expected


def test_margins_grow_as_their_whole_words():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        a = [b"ab"[i : i + 1] for i in rng.integers(0, 2, rng.integers(0, 60))]
        b = [bytes(x) for x in a]
        for _ in range(rng.integers(0, 4)):
            if b:
                b[rng.integers(0, len(b))] = b"c"
        one, other = b" ".join(a), b" ".join(b[: rng.integers(0, 60)])
        assert substring_dedup._grown(one, other, False, False, False) == substring_dedup.grow(one.split(), other.split())
        assert substring_dedup._grown(one, other, True, True, False) == substring_dedup.grow(one.split()[:0:-1], other.split()[::-1])


def test_first_pass_sends_each_seed_once_a_text(spark):
    text = " ".join(["one two three four five six seven eight nine ten eleven twelve thirteen"] * 20).encode()
    sent = substring_dedup._hashes(spark.createDataFrame([(bytearray(text),)], "txt binary"))
    assert sent.columns == ["h"]
    found = [r["h"] for r in sent.collect()]
    assert len(found) == len(set(found)) and set(found) == set(substring_dedup.seeds_of([text])[1].tolist())
