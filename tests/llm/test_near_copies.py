"""Near copies against all pairs of shingle sets."""

import random

from pyspark.sql import functions as F

from veridact.llm import near_copies, simhash


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(texts, similarity):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def changed(words, k, r):
    out = list(words)
    for at in r.sample(range(len(out)), k):
        out[at] = f"new{r.randrange(10**9)}"
    return " ".join(out)


def test_components_equal_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    texts = ["", " ", "one two", "ONE two", "three"]
    for g in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 400))]
        texts += [" ".join(words), changed(words, max(1, len(words) * (g % 6) // 200), r)]
    hub = [f"h{r.randrange(5000)}" for _ in range(150)]
    texts += [changed(hub, r.randrange(1, 4), r) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = roots(texts, 0.8)
    for most in (64, 3):
        monkeypatch.setattr(near_copies, "MOST", most)
        got = {x["doc_id"]: x["component_id"] for x in near_copies.near_copies(df).collect()}
        assert [got[i] for i in range(len(texts))] == want
    kept = {x["doc_id"] for x in simhash.deduplicate(df, similarity=0.8).collect()}
    assert kept == set(want)


def test_texts_without_ids_connect(spark):
    words = [f"w{i}" for i in range(100)]
    a, b, c = " ".join(words), " ".join(words[:92] + ["x"]), " ".join(words[:84] + ["y"])
    assert roots([a, b, c], 0.8) == [0, 0, 0] and roots([a, c], 0.85) == [0, 1]
    df = spark.createDataFrame([(7, a), (None, b), (3, c), (9, None), (None, "z")], "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"]) for x in near_copies.near_copies(df).collect()}
    assert got == {(7, 3), (None, 3), (3, 3), (9, 9), (None, None)}
    assert near_copies.near_copies(df.limit(0)).count() == 0
