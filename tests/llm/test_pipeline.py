"""The pipeline against plain Python on a small corpus."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from veridact.llm import mixing
from veridact.session import ship

TONGUES = {"en": "the of and to in that was for with this from", "de": "der die und nicht ein ich auf mit sich dem"}


def speech(lang, n, r):
    base = TONGUES[lang].split()
    return " ".join(r.choice(base) if r.random() < 0.3 else "".join(r.choices(base, k=2)) + str(r.randrange(900)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    item = speech("en", 30, r)
    texts = [(i, speech("en" if i % 3 else "de", 120, r)) for i in range(60)]
    texts += [(60, texts[5][1]), (61, texts[6][1] + " more"), (62, "12345 !!!"), (63, None), (64, ""), (65, speech("en", 50, r) + " " + item), (66, speech("en", 60, r) + ' token = "0123456789abcdef0123456789abcdef01234567" end')]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t or "")) for i, t in texts]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_do_what_they_say(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(ship(spark), docs, corpus)
        docs.persist()
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.columns == columns
    all_ids = set(range(67))
    assert set(seen[0]) == all_ids - {62, 63, 64}
    assert set(seen[1]) == set(seen[0]) - {60, 61}
    assert set(seen[2]) == set(seen[1]) - {65}
    assert set(seen[3]) == set(seen[2]) and "[REDACTED]" in seen[3][66] and "0123456789abcdef" not in seen[3][66]
    assert sum(seen[3][i] != seen[2][i] for i in seen[3]) == 1
    assert set(seen[4]) <= set(seen[3])


def test_run_equals_its_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    kept = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id NOT IN (60, 61, 62, 63, 64, 65)")
    before = {r["doc_id"]: r["copies"] for r in mixing.with_copies(kept).collect()}
    assert max(counts.values()) <= 3 and set(counts) <= set(before)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}"))


def plainly(rows, items):
    """What is left of (id, text, lang, source) rows: one of each group of near copies, clean, redacted, and as often as the mix asks."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = []
    for _, text, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    rows = [r for i, r in enumerate(rows) if r[0] == least[group[i]]]
    plain = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]

    def overlaps(text):
        words = plain(text)
        for item in map(plain, items):
            n = min(16, len(item))
            for i in range(len(item) - n + 1):
                if any(sum(a == b for a, b in zip(item[i : i + n], words[d : d + n])) >= 0.8 * n for d in range(len(words) - n + 1)):
                    return True
        return False

    out = []
    for doc, text, lang, source in [r for r in rows if not overlaps(r[1])]:
        spans = sorted(m.span() for p in SECRETS for m in p.finditer(text) if len(m.groups()) < 2 or len(m.group(2)) >= 6)
        parts, at = [], 0
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], "[REDACTED]"]
            at = max(at, b)
        out.append((doc, "".join(parts) + text[at:], lang, source))
    size = Counter()
    for _, text, _, source in out:
        size[source] += len(WORD.findall(text))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    target, free, rest = {}, set(size), sum(size.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        rest, free = rest - sum(3 * size[s] for s in full), free - full
    target |= {s: level * weight[s] for s in free}
    mixed = Counter()
    for doc, text, lang, source in out:
        rate = target[source] / size[source]
        draw = int(hashlib.md5(f"42:{doc}".encode()).hexdigest()[:8], 16) / 2**32
        mixed[doc, text, lang, source, len(text)] += int(rate) + (draw < rate - int(rate))
    return +mixed


def test_run_equals_plain_python(spark, corpus):
    rows = [tuple(r) for r in spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in corpus_pipeline.run(spark, corpus).collect())
    want = plainly(rows, items)
    assert got == Counter({k[:4]: n for k, n in want.items()}) and len(got) > 30
    lengths = {r["doc_id"]: r["n_chars"] for r in corpus_pipeline.run(spark, corpus).collect()}
    assert all(lengths[k[0]] == k[4] for k in want if "[REDACTED]" in k[1])


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names
