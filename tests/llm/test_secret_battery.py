"""The battery, its p-values and the false-discovery rule against plain Python, and long stretches."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from veridact.llm import secrets

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WINDOW = re.compile(r"[A-Za-z0-9+/_-]{20,491}+(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/_-]{472}")


def kind_of(c):
    return "lower" if c in LOWER else "upper" if c in UPPER else "digit" if c in DIGITS else "sign"


def changes(values):
    return sum(a != b for a, b in zip(values, values[1:]))


def judge(window, o):
    """(encoding, joint statistic, three scores, z) in plain Python."""
    s = window.replace("-", "+").replace("_", "/")
    encoding = next(name for name, (p, *_) in secrets.ENCODINGS.items() if re.search(p, window))
    alphabet, rate = secrets.ENCODINGS[encoding][1:]
    n, k = len(s), len(alphabet)
    digits = [alphabet.index(c) for c in (s.lower() if encoding in ("hex", "base36") else s)]
    same = sum(v * v for v in Counter(s).values())
    df, chi = k - 1, max(0.0, k * same / n - n)
    z_chi = max(0.0, ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    halves = [v * 2 >= k for v in digits]
    n1 = sum(halves)
    mean = 1 + 2 * n1 * (n - n1) / n
    z_runs = 10.0 if n1 in (0, n) else (1 + changes(halves) - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    centre = sum(digits) / n
    spread = sum((v - centre) ** 2 for v in digits)
    z_serial = 10.0 if not spread else sum((a - centre) * (b - centre) for a, b in zip(digits, digits[1:])) / spread * math.sqrt(n)
    joint = z_chi**2 + z_runs**2 + z_serial**2

    of = Counter(map(kind_of, s))
    q2, q3 = sum(q**2 for q in o.letters), sum(q**3 for q in o.letters)
    mean = var = 0.0
    for name, second, third in (("lower", q2, q3), ("upper", q2, q3), ("digit", 0.1, 0.01), ("sign", 0.5, 0.25)):
        m = of[name]
        mean += m + m * (m - 1) * second
        var += 2 * m * (m - 1) * second + 4 * m * (m - 1) * (m - 2) * third - 2 * m * (m - 1) * (2 * m - 3) * second**2
    if encoding == "hex":
        chi = -math.sqrt(2 * max(0.0, -(of["lower"] + of["upper"]) * math.log(sum(o.letters[:6])) - math.log(2)))
    else:
        chi = (same - mean) / math.sqrt(var) if var > 1e-6 else 0.0
    if rate is not None:
        runs = ((n - 1) * rate - changes([kind_of(c) for c in s])) / math.sqrt((n - 1) * rate * (1 - rate))
    else:
        swings = changes([(c in "aeiouy") if c in LOWER else c for c in s.lower()])
        runs = (swings - (n - 1) * o.turn) / math.sqrt((n - 1) * o.turn * (1 - o.turn))
    pulls = [o.pull[LOWER.index(a) * 26 + LOWER.index(b)] for a, b in zip(s.lower(), s.lower()[1:]) if a in LOWER and b in LOWER]
    serial = (sum(pulls) - len(pulls) * o.pull_mean) / math.sqrt(len(pulls) * o.pull_var) if pulls and encoding != "hex" else 0.0
    tests = 2 if encoding == "hex" else 3
    return encoding, joint, (chi, runs, serial), (chi + runs + serial) / math.sqrt(tests + tests * (tests - 1) * 0.5)


def drawn(seed=5):
    r = random.Random(seed)
    alphabets = (DIGITS + "ABCDEF", UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS, LOWER, UPPER, LOWER + UPPER, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + DIGITS + "_-", "ab", "1", "-_")
    out = ["".join(r.choices(a, k=n)) for a in alphabets for n in (20, 21, 33, 130, 491, 492, 963, 1500)]
    return out + ["some_ordinary_identifier_of_words", "SomeOrdinaryIdentifierOfWords", "usr/local/lib/python/site-packages"] * 8


def test_scores_equal_plain_python(spark):
    ordinary = secrets.Ordinary.of({"th": 50, "he": 40, "an": 30, "er": 35, "qu": 5, "ee": 9, "st": 20, "ta": 11, "is": 17})
    texts = drawn()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = df.select("i", F.explode(secrets.battery(secrets._located(F.col("text"), secrets.CANDIDATE), ordinary)).alias("c")).select("i", "c.*")
    got = {(r["i"], r["start"]): r for r in found.collect()}
    want = {(i, m.start()): m for i, t in enumerate(texts) for m in WINDOW.finditer(t)}
    assert got.keys() == want.keys()
    for key, m in want.items():
        encoding, joint, scores, _ = judge(m.group(), ordinary)
        r = got[key]
        assert (r["encoding"], r["end"]) == (encoding, m.end())
        assert math.isclose(r["joint"], joint, rel_tol=1e-9, abs_tol=1e-9)
        for a, b in zip((r["z"]["chi"], r["z"]["runs"], r["z"]["serial"]), scores):
            assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (m.group(), r["z"], scores)


def test_rule_equals_plain_python(spark):
    texts = drawn() + drawn(6)
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)], "doc_id int, text string")
    ordinary = secrets.prose(df)
    words = [w for t in texts for w in re.split("[^a-z0-9+/_-]+", f"x {t} y".lower()) if re.fullmatch("[a-z]{2,19}", w)]
    assert ordinary == secrets.Ordinary.of(Counter(w[i : i + 2] for w in words for i in range(len(w) - 1)))
    scanned = secrets.scan(df, ordinary=ordinary)
    strata = {}
    bases = {r["doc_id"]: [(b["start"], b["end"]) for b in r["secret_base"]] for r in scanned.collect()}
    for i, t in enumerate(texts):
        for m in WINDOW.finditer(t):
            if any(a < m.end() + 2 and m.start() + 2 < b for a, b in bases[i]):
                continue
            encoding, joint, _, z = judge(m.group(), ordinary)
            p = 10 ** -(math.floor((z * z / 2 + math.log(2)) / math.log(10) * 10) / 10) if z < 0 and joint <= 16.266 else 1.0
            length = max(c for c in secrets.LENGTH_CLASSES if c <= len(m.group()))
            strata.setdefault(f"{encoding}:{length}", []).append((max(p, 1e-40), i, m.start() + 2, m.end() + 2))
    chosen = {}
    for ps in strata.values():
        ps.sort()
        last = max((k for k, (p, *_) in enumerate(ps, 1) if p <= 0.01 * k / len(ps) * (1 + 1e-9)), default=0)
        for _, i, a, b in ps[:last]:
            chosen.setdefault(i, []).append((a, b))
    want = {}
    for i, spans in chosen.items():
        merged = []
        for a, b in sorted(spans):
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        want[i] = [f"random:{a}:{b}" for a, b in merged]
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("random")] for r in secrets.find(scanned, secrets.discovery_thresholds(scanned)).collect()}
    assert {i: s for i, s in got.items() if s} == want
    assert len(want) > 60


def test_one_long_stretch_takes_linear_time(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(LOWER + UPPER + DIGITS + "+/", k=n)) for n in (50_000, 400_000)]
    seconds = []
    for t in texts:
        df = spark.createDataFrame([(1, f"data:image/png;base64, {t}")], "doc_id int, text string")
        at = time.time()
        row = secrets.find(secrets.scan(df, ordinary=secrets.Ordinary.of({})), {"base64:128": 20}).collect()[0]
        seconds.append(time.time() - at)
        covered = sum(int(b) - int(a) for _, a, b in (s.split(":") for s in row["spans"].split(",")))
        assert covered > 0.9 * len(t)
    assert seconds[1] < 16 * max(seconds[0], 2), seconds
