"""The fingerprints that propose near copies, against plain Python and all pairs."""

import random

import numpy as np
import pytest

from veridact.llm import near_copies, simhash


def test_fingerprints_of_sets_are_majorities():
    r = np.random.RandomState(5)
    for n in (1, 2, 4, 5, 100, 101):
        found = np.unique(r.randint(0, 1 << 63, n, np.uint64))
        prints = near_copies.set_prints(found)
        for k in range(near_copies.PRINTS):
            mask, mul, mix = (1 << 64) - 1, int(near_copies._MUL[k]), int(near_copies._MIX[k])
            mixed = []
            for h in found.tolist():
                h = h * mul & mask
                h = (h ^ h >> 32) * mix & mask
                mixed.append(h ^ h >> 29)
            for b in range(64):
                ones = sum(h >> b & 1 for h in mixed)
                if 2 * ones != len(mixed):
                    assert int(prints[k]) >> b & 1 == (2 * ones > len(mixed))
    assert not near_copies.set_prints(np.zeros(0, np.uint64)).any()


def component(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if k in (x, y) else k for k in root]
    return root


@pytest.mark.parametrize("most", [64, 0])
def test_links_connect_candidates(spark, monkeypatch, most):
    """With ``most`` 0 every bucket takes the path of those with too many candidates (in this process)."""
    monkeypatch.setattr(near_copies, "MOST", most)
    r = random.Random(9)
    rows = []
    for g in range(60):
        base = [r.getrandbits(64) for _ in range(3)]
        for _ in range(5):
            rows.append([100 + g, *(w ^ sum(1 << b for b in r.sample(range(64), r.randrange(12))) for w in base)])
    rows.sort(key=lambda x: x[0])
    sizes, prints = np.array([x[0] for x in rows]), np.array([x[1:] for x in rows], np.uint64)
    radius, limit = near_copies.print_radius(0.8), near_copies.print_limit(0.8)

    def fits(i, j, words):
        apart = [int(x).bit_count() for x in prints[i] ^ prints[j]]
        return sizes[i] / sizes[j] >= 0.8 and sum(apart) <= limit and min(apart[k] for k in words) <= radius

    for own in range(3):
        want = component(len(rows), [(i, j) for j in range(len(rows)) for i in range(j) if fits(i, j, [own])])
        assert component(len(rows), near_copies.close_links(prints, sizes, own, 0.8).tolist()) == want
    classes = spark.createDataFrame([(i, *x) for i, x in enumerate([x[0], *np.array(x[1:], np.uint64).view(np.int64).tolist()] for x in rows)], "node long, size int, p0 long, p1 long, p2 long")
    got = component(len(rows), [tuple(x) for x in near_copies.near_prints(classes, 0.8).collect()])
    assert got == component(len(rows), [(i, j) for j in range(len(rows)) for i in range(j) if fits(i, j, range(3))])
    assert len(set(got)) < len(rows)


def test_sizes_far_apart_are_compared_in_blocks():
    """A few small sets before many large ones make no block of all rows."""
    r = np.random.RandomState(2)
    sizes = np.array([5] * 3 + [300] * 40_000)
    prints = r.randint(0, 1 << 63, (len(sizes), 3), np.uint64)
    prints[-1] = prints[10]
    found = near_copies.close_links(prints, sizes, 0, 0.8).tolist()
    assert [len(sizes) - 1, 10] in found and len(found) < 100


def test_fingerprints_alone_propose(spark, monkeypatch):
    """Without links of fingerprints nothing is a near copy: no other path proposes."""
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["x"])), (3, " ".join(words).upper())], "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()} == {1}
    monkeypatch.setattr(near_copies, "near_prints", lambda classes, similarity: spark.createDataFrame([], "a long, b long"))
    assert {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()} == {1, 2}
