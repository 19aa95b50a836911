"""How many random stretches of each encoding the secrets scan finds, and how few ordinary ones."""

import random
import re

import pytest

from veridact.llm import secrets

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("text").collect()
    return [r["text"] or "" for r in rows]


def found(spark, texts, alphabets, lengths):
    """Shares of random stretches found by alphabet and length, and of ordinary stretches."""
    r = random.Random(7)
    words = sorted({w for t in texts for w in re.findall("[A-Za-z]{3,12}", t)})
    rows = [("text", t) for t in texts]
    for name, alphabet in alphabets.items():
        for n in lengths:
            rows += [((name, n), f"{r.choice(words)} {''.join(r.choices(alphabet, k=n))} {r.choice(words)}") for _ in range(60)]
    for _ in range(200):
        some = [r.choice(words).lower() for _ in range(9)]
        for s in ("".join(w.capitalize() for w in some), "_".join(some), "".join(some), "".join(some).upper(), "".join(some) + "12"):
            rows.append(("ordinary", f"{r.choice(words)} {s} {r.choice(words)}"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    scanned = secrets.scan(df).persist()
    spans = {x["doc_id"]: x["spans"] for x in secrets.find(scanned, secrets.discovery_thresholds(scanned)).collect()}
    out = {}
    for i, (kind, _) in enumerate(rows):
        out.setdefault(kind, []).append("random" in spans[i])
    return {k: sum(v) / len(v) for k, v in out.items()}


def test_small_alphabets_are_found(spark, texts):
    share = found(spark, texts, {"base32": UPPER + "234567", "hex": DIGITS + "ABCDEF", "base36": LOWER + DIGITS}, (20, 40))
    assert share.pop("ordinary") <= 0.01 and share.pop("text") <= 0.01
    assert min(share.values()) >= 0.75, share


def test_letters_alone_are_found(spark, texts):
    share = found(spark, texts, {"a-z": LOWER, "A-Z": UPPER, "A-Za-z": UPPER + LOWER}, (20, 40, 200))
    assert share.pop("ordinary") <= 0.01 and share.pop("text") <= 0.01
    assert min(v for (_, n), v in share.items() if n > 20) >= 0.85 and share["A-Za-z", 20] >= 0.75, share


def test_every_candidate_is_tested(spark):
    texts = ["a" * 20, "A" * 21, "aB" * 12, "a-b_" * 6, "1-2_" * 6, "A/1" * 8, "-" * 20, "1" * 20, "G1" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = secrets.scan(df).selectExpr("size(secret_candidates) + size(secret_base) AS n").collect()
    assert [x["n"] for x in sizes] == [1] * len(texts)
    strata = secrets.scan(df).selectExpr("explode(secret_candidates) AS c").selectExpr("c.stratum", "c.bin", "c.random").collect()
    assert all(":" in x["stratum"] and x["bin"] is not None and x["random"] is not None for x in strata)
