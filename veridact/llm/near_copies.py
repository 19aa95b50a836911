"""Near copies by exact Jaccard similarity of shingle sets; SimHash within a wide radius proposes, the sets themselves decide."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridact.llm.common import materialize, may_hold
from veridact.llm.simhash import BITS, WIDE_WORDS, Partitioning, _shingles, allocate, components, integer_id, keys_of, links, named_classes

#: Independent fingerprints of a set, each with a join of its own. Sets of similarity 0.8 differ in 9.7 of 64 bits on
#: average; one fingerprint misses 1.3% of them at 16 bits, all three some 2 of a million.
PRINTS = 3
#: Standard deviations above the mean that the radius of a fingerprint and the limit of all bits allow.
RADIUS_DEVIATIONS, LIMIT_DEVIATIONS = 2.2, 6
#: What a pair of a bucket costs here, in emitted and shuffled rows: pairs are compared as blocks, and sets of like sizes only.
PAIR_COST = 0.0001
#: Fingerprints that the cost estimates see, at most; the search itself covers all.
SAMPLE = 1024
#: Candidate pairs of a bucket are gathered up to so many a member; with more, members are compared one by one with those not yet reached.
MOST = 64
#: Elements of a block of comparisons.
BLOCK = 1 << 17
_R = np.random.RandomState(42)
_MUL, _MIX = (_R.randint(0, 1 << 63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_DECIDE = _R.randint(0, 1 << 63, PRINTS * BITS // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n_words: int = WIDE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    import xxhash

    runs = set(_shingles(text, n_words))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)))


def set_prints(found: np.ndarray) -> np.ndarray:
    """SimHash of a sorted set of hashes, ``PRINTS`` times: a bit is set where over half of the members' mixed hashes have it.

    Where just half have it, one member decides, another one for each byte and mostly the same in sets that are alike: else
    small sets would have few bits set and be near each other by chance.
    """
    if not len(found):
        return np.zeros(PRINTS, np.uint64)
    mixed = found[:, None] * _MUL
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    hashes = (mixed ^ (mixed >> np.uint64(29))).view(np.uint8)
    counts = np.zeros(PRINTS * BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    if len(found) % 2 == 0:
        decider = (found[:4096, None] * _DECIDE).argmin(0)
        counts = 2 * counts + np.unpackbits(hashes[decider, np.arange(len(decider))], bitorder="little")
    else:
        counts *= 2
    return np.packbits(counts > len(found), bitorder="little").view(np.uint64)


def _differing(n_bits: int, similarity: float, deviations: float) -> int:
    """Bits of ``n_bits`` that fingerprints of sets of that Jaccard similarity differ in, so many deviations above the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(n_bits * p + deviations * math.sqrt(n_bits * p * (1 - p)))


def print_radius(similarity: float) -> int:
    return _differing(BITS, similarity, RADIUS_DEVIATIONS)


def print_limit(similarity: float) -> int:
    return _differing(PRINTS * BITS, similarity, LIMIT_DEVIATIONS)


def _star(n: int, pairs: np.ndarray) -> np.ndarray:
    """Pairs of each of ``n`` row numbers with the least that ``pairs`` connect it to: a forest."""
    least, (x, y) = np.arange(n), pairs.T
    while len(x):
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, least[x], low)
        np.minimum.at(least, least[y], low)
        while (least != least[least]).any():
            least = least[least]
        apart = least[x] != least[y]
        x, y = x[apart], y[apart]
    linked = np.flatnonzero(least != np.arange(n))
    return np.stack([linked, least[linked]], 1)


def close_links(prints: np.ndarray, sizes: np.ndarray, own: int, similarity: float) -> np.ndarray:
    """A forest of row numbers that connects all members of a bucket which may be similar; rows are sorted by size.

    Candidates differ by at most the radius on fingerprint ``own``, by at most the limit on all, and, where pairs are gathered,
    fit in size.
    """
    radius, limit = print_radius(similarity), print_limit(similarity)
    ends = np.searchsorted(sizes, sizes / similarity + 1, "right")
    word = np.ascontiguousarray(prints[:, own])
    out, n, a = [np.zeros((0, 2), np.int64)], 0, 0
    while a < len(word) - 1:
        b = min(len(word), a + max(1, BLOCK // max(1, int(ends[a]) - a)))
        while b - a > 1 and (b - a) * (int(ends[b - 1]) - a) > 2 * BLOCK:
            b = a + (b - a) // 2
        x, y = np.nonzero(np.bitwise_count(word[a:b, None] ^ word[None, a : ends[b - 1]]) <= radius)
        x, y = x[x < y] + a, y[x < y] + a
        near = (sizes[x] / sizes[y] >= similarity) & (np.bitwise_count(prints[x] ^ prints[y]).sum(1) <= limit)
        out.append(np.stack([x[near], y[near]], 1))
        n += len(out[-1])
        if n > MOST * len(word):
            found = links(np.ascontiguousarray(prints[:, [own, *range(PRINTS)]]), radius, limit, len(word))
            return _star(len(word), np.array(found, np.int64).reshape(-1, 2))
        a = b
    return _star(len(word), np.concatenate(out))


def near_prints(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between classes (node, size, p0, p1, ...) that connect all which may have that similarity.

    For each of the fingerprints, bits are dealt to parts and thresholds allocated to them as for :func:`simhash.near_links`;
    one shuffle, by key. A set that no set of another content can be similar to, as it has too few members, takes no part.
    """
    names = [f"p{k}" for k in range(PRINTS)]
    searched = classes.filter(F.col("size") / (F.col("size") + 1) >= similarity).select("node", "size", *names)
    total = searched.agg(F.count("*").alias("n")).first()["n"]
    rows = searched.select(*names).orderBy(F.xxhash64("p0"), "p0").limit(SAMPLE).collect()  # bounded, for the estimates
    radius = print_radius(similarity)
    sample = np.array([tuple(r) for r in rows], np.int64).reshape(-1, PRINTS).view(np.uint64)
    plans: list[Partitioning] = [allocate(sample[:, k].copy(), total, radius, PAIR_COST, 2) for k in range(PRINTS)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, plan in enumerate(plans):
                # Parts are told by the highest four bits, fingerprints by the next two; no part has more than half of the bits.
                for keys, keep in keys_of(batch.column(2 + k).to_numpy().view(np.uint64), plan):
                    tagged = (keys[keep] | np.uint64(k << 56)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(tagged), *batch.filter(pa.array(keep)).columns], ["key", *batch.schema.names])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts) if parts else np.zeros((0, 3 + PRINTS), np.int64)
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            found = [np.zeros((0, 2), np.int64)]
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                if e - s > 1:
                    own = int(rows[s, 0]) >> 56 & 3
                    pairs = close_links(np.ascontiguousarray(rows[s:e, 3:]).view(np.uint64), rows[s:e, 2], own, similarity)
                    found.append(np.sort(rows[s:e, 1][pairs], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            if not len(rows):
                continue
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))  # the last bucket may go on
            if last or (held and held[-1][-1, 0] != rows[0, 0]):
                yield from linked([*held, rows[:last]])
                held = []
            held.append(rows[last:])
        yield from linked(held)

    columns = "key long, node long, size long, " + ", ".join(f"{c} long" for c in names)
    keyed = searched.withColumn("size", F.col("size").cast("long")).mapInArrow(emit, columns)
    return keyed.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(verify, "a long, b long").distinct()


def _name(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh128_digest(found.tobytes()), "<i8").tolist())


def _similar(inner: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, similarity: float) -> np.ndarray:
    return inner / (a + b - inner) >= similarity


def bucket_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect members exactly as all links would, as pairs of row numbers: a forest, never all pairs.

    Each member is compared once, by its whole set, with those not yet reached.
    """
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    members = np.split(ids, np.cumsum(sizes)[:-1])
    seen, rows, starts = np.zeros(len(values), np.int32), np.arange(len(sets)), np.cumsum(sizes) - sizes
    left, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front and left.any():
            x = front.pop()
            kept = left[rows]
            if 2 * kept.sum() < len(rows):
                ids, rows = ids[np.repeat(kept, sizes[rows])], rows[kept]
                starts = np.cumsum(sizes[rows]) - sizes[rows]
            seen[members[x]] = 1
            inner = np.add.reduceat(seen[ids], starts)
            seen[members[x]] = 0
            near = rows[left[rows] & _similar(inner, sizes[rows], sizes[x], similarity)]
            left[near] = False
            out += [(x, y) for y in near.tolist()]
            front += near.tolist()
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, component_id): every row with the smallest id of all rows that links of that similarity or more connect it to.

    Rows link where the Jaccard similarity of their sets of five-word shingles is at least ``similarity``. SimHash proposes:
    a set has three fingerprints, and sets within the radius on one of them, which share a probe by the generalised
    pigeonhole principle, are candidates. What candidates connect is a group, and within it the whole sets are counted. Only
    pairs beyond the radius on all fingerprints are missed: at 0.8 some 2 of a million, and 4 of 10,000 where sets have 4
    and 5 members. Rows with equal sets are one class and never expanded into pairs; texts without words are one class. A null id
    names no component unless all its rows have none, and then the name is null. Ids are any integers.
    """
    names = [f"p{k}" for k in range(PRINTS)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            named = np.array([_name(s) for s in sets], np.int64).reshape(-1, 2)
            prints = np.array([set_prints(s) for s in sets], np.uint64).reshape(-1, PRINTS).view(np.int64)
            columns = [batch.column(0), *map(pa.array, named.T), pa.array([len(s) for s in sets], pa.int32()), *map(pa.array, prints.T)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "c0", "c1", "size", *names])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
                named = np.array([_name(s) for s in sets], np.int64).reshape(-1, 2)
                columns = [part.column(0), *map(pa.array, named.T), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "c0", "c1", "grams"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, n, g) for b in batches for k, n, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        out: list[tuple[int, int]] = []
        for _, group in itertools.groupby(rows, lambda r: r[0]):
            nodes, sets = zip(*[(n, g.values.to_numpy().view(np.uint64)) for _, n, g in group])
            out += [(nodes[x], nodes[y]) for x, y in bucket_links(list(sets), similarity)]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*out)], ["a", "b"])

    source = docs.select(F.col(integer_id(docs, id_col)).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = materialize(source.mapInArrow(sign, "id long, c0 long, c1 long, size int, " + ", ".join(f"{c} long" for c in names)), "sets")
    classes = marked.groupBy("c0", "c1").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("size", *names)])
    classes = materialize(classes.withColumn("node", F.coalesce("least", "c0")), "classes")
    groups = materialize(components(near_prints(classes, similarity)), "groups")
    asked = materialize(classes.filter("size > 0").select("node", "c0", "c1").join(groups, "node"), "asked")
    # Texts move only where a group may ask for them: those of a group are a part of all, and the marks of their ids a bounded table.
    nodes = asked.select("node").distinct()
    held = may_hold(source.filter("id IS NOT NULL"), "id", nodes.withColumnRenamed("node", "id")).filter("may_hold").drop("may_hold")
    ids = held.join(nodes, F.col("id") == F.col("node"), "left_semi").union(source.filter("id IS NULL"))
    fetched = ids.mapInArrow(fetch, "id long, c0 long, c1 long, grams array<long>")
    sets = fetched.withColumn("node", F.coalesce("id", "c0")).drop("id").dropDuplicates(["node", "c0", "c1"])  # and the join finds them dealt
    dealt = asked.join(sets, ["node", "c0", "c1"]).select("root", "node", "grams").repartition("root").sortWithinPartitions("root")
    reach = materialize(components(dealt.mapInArrow(settle, "a long, b long")), "reach")
    named = named_classes(classes.select("c0", "c1", "node", "least"), reach).select("c0", "c1", "component_id")
    return marked.select("id", "c0", "c1").join(named, ["c0", "c1"]).select(F.col("id").alias(id_col), "component_id")
