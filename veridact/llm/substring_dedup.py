"""Removal of repeated byte strings: anchors find candidates, a Burrows-Wheeler transform settles them.

Every window of ``WINDOW`` bytes has an anchor: of the ``ANCHOR``-byte strings inside it, the one whose hash is least. The
anchor depends on the window's bytes only, so equal windows have equal anchors. Neighbouring windows share their
anchor; such a run is named by its anchor and by 128 bits of two independent hashes of all its bytes. Runs whose anchor occurs
once can't repeat. Equal runs repeat as a whole and are folded into one before anything else. What is left, different runs around one anchor, is settled exactly from their bytes: their
suffixes are ordered, and breadth-first backward extension on the Burrows-Wheeler transform finds all common prefixes
in ascending length, stopping at the window's length.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridact.llm import blocks as B
from veridact.llm.common import blocks_for, files_for, materialize

WINDOW, ANCHOR = 100, 24
CHUNK = 256 << 10
#: Text that is put in one Burrows-Wheeler transform, but for the anchor that reaches beyond it.
EXPAND_BYTES = 256 << 10
#: Anchors with more different runs are settled window by window, by hashes dealt over all tasks.
HOT_RUNS = 4096
#: Text per piece, which bounds a worker's memory, and text whose anchors a bucket holds.
PIECE_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Pieces whose runs meet in one group, at most; of more, groups fold their equal runs first, level by level.
FAN_IN = 4096
RANGES, RUNS, WINDOWS = 0, 1, 2

_BASE = 0x9E3779B97F4A7C15
#: Base and values of the 256 bytes, for two independent hashes.
_HASHES = tuple((base, np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) for base, seed in ((_BASE, 20240229), (0xD1342543DE82EF95, 20240301)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Hashes:
    """Polynomial hashes of any substring of one buffer, by the first or second of two independent functions."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n, (base, values) = len(data), _HASHES[which]
        powers = np.full(n, base, np.uint64)
        powers[:1] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * np.cumprod(powers), out=self.sums[1:])
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _segments(starts: np.ndarray, sizes: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, first byte, end) lists of about ``CHUNK`` bytes; long texts are cut so that every window is in one piece."""
    held, size = [], 0
    for k, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        for a in range(0, n - window + 1, CHUNK):
            b = min(n, a + CHUNK + window - 1)
            held.append((k, at + a, at + b))
            size += b - a
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in order: text, position of the first window, number of windows, both hashes."""
    found = []
    for segments in _segments(starts, sizes, window):
        text = np.array([s[0] for s in segments])
        first = np.array([s[1] for s in segments])
        length = np.array([s[2] - s[1] for s in segments])
        part = np.concatenate([data[a:b] for _, a, b in segments])
        at = np.cumsum(length) - length
        hashes = _Hashes(part)
        grams = np.arange(len(part) - anchor + 1)
        gram = hashes.of(grams, grams + anchor)
        least = _least((gram & np.uint64(0xFFFFFFFFFC000000)) | grams.astype(np.uint64), window - anchor + 1)
        place = (least & np.uint64(0x3FFFFFF)).astype(np.int64)
        valid = np.zeros(len(part) + 1, np.int8)
        valid[at] += 1
        np.subtract.at(valid, at + length - window + 1, 1)
        windows = np.flatnonzero(np.cumsum(valid[: len(place)]) > 0)
        own = place[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
        new |= np.isin(windows, at)
        edge = np.flatnonzero(new)
        count = np.diff(np.append(edge, len(windows)))
        begin, mark = windows[edge], own[edge]
        seg = np.searchsorted(at, begin, "right") - 1
        whole = hashes.of(begin, begin + count + window - 1)
        extra = _Hashes(part, 1).of(begin, begin + count + window - 1)
        whole = _mixed(whole + (mark - begin).astype(np.uint64) * np.uint64(1009) + count.astype(np.uint64))
        # least hashes are small numbers: mixed again, they spread over all buckets
        name = _mixed(gram[mark] ^ np.uint64(_BASE))
        found.append((text[seg], begin - at[seg] + first[seg] - starts[text[seg]], count, name, whole, extra))
    kinds = (np.int32, np.int32, np.uint8, np.uint64, np.uint64, np.uint64)
    names = ("row", "pos", "count", "anchor", "whole", "extra")
    return {n: np.concatenate([f[k] for f in found]).astype(t) if found else np.zeros(0, t) for k, (n, t) in enumerate(zip(names, kinds))}


def bounded_repeats(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text`` by its first symbols, and which neighbours in it share at least ``window`` symbols.

    ``text`` holds symbols below 512, with 0 between strings. The order comes from doubling the compared prefix; the second
    array from breadth-first backward extension: intervals of suffixes with a common prefix are extended by every
    symbol that precedes them in the transform, shortest prefixes first; the end of a new interval marks where the common prefix
    ends. It stops at ``window``: places not reached by then share that much or more.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    depth = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])).astype(np.uint64)
        if depth > window:
            break
        after = np.zeros(n, np.uint64)
        after[: n - depth] = rank[depth:] + np.uint64(1)
        key = (rank << np.uint64(32)) | after
        depth *= 2
    before = text[order - 1].astype(np.int64)  # the transform
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # place of the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last_seen, next_seen = np.full(n, -1), np.full(n, n)
    last_seen[by_symbol[1:][same]] = by_symbol[:-1][same]
    next_seen[by_symbol[:-1][same]] = by_symbol[1:][same]
    open_ = np.ones(n + 1, bool)
    left, right = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(window):
        one = right - left == 1
        a, b = step[left[one]], step[left[one]] + 1
        left, right = left[~one], right[~one]
        if len(left):
            width = right - left
            own = np.repeat(np.arange(len(left)), width)
            place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + left[own]
            first, last = last_seen[place] < left[own], next_seen[place] >= right[own]
            f = place[first][np.lexsort((before[place[first]], own[first]))]
            g = place[last][np.lexsort((before[place[last]], own[last]))]
            a, b = np.concatenate([a, step[f]]), np.concatenate([b, step[g] + 1])
        new = open_[b]
        left, right = a[new], b[new]
        open_[right] = False
        if not len(left):
            break
    return order, open_[:n]


def repeated_windows(strings: list[bytes], counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of the first ``counts[i]`` windows of every string, in turn: which occur earlier among them."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    starts = np.cumsum(sizes) - sizes
    text[starts + sizes - 1] = 0
    order, shared = bounded_repeats(text, window)
    asked = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(~shared | (np.arange(len(text)) == 0))
    own = group[asked]
    first = np.full(own.max() + 1, len(text)) if len(own) else np.zeros(0, np.int64)
    np.minimum.at(first, own, asked)
    return asked > first[own]


#: Columns of packed rows, in this order where they are present.
_COLUMNS = (("row", "<i4"), ("pos", "<i4"), ("count", "u1"), ("anchor", "<u8"), ("whole", "<u8"), ("extra", "<u8"), ("id", "<i8"), ("hot", "?"))


def _pack(tail: bytes = b"", **arrays: np.ndarray) -> bytes:
    """Rows as a byte that tells the columns, their number, column after column, and what else belongs to them."""
    mask = sum(1 << k for k, (name, _) in enumerate(_COLUMNS) if name in arrays)
    return struct.pack("<BI", mask, len(arrays["row"])) + b"".join(np.asarray(arrays[n], t).tobytes() for n, t in _COLUMNS if n in arrays) + tail


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    mask, n = struct.unpack_from("<BI", blob)
    at, out = 5, {}
    for k, (name, kind) in enumerate(_COLUMNS):
        if mask >> k & 1:
            out[name] = np.frombuffer(blob, kind, n, at)
            at += out[name].nbytes
    return out, blob[at:]


def _joined(blobs: list[bytes], places: list[int]) -> dict[str, np.ndarray]:
    parts = [_unpack(b)[0] for b in blobs]
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    out["place"] = np.repeat(np.array(places, np.int64), [len(p["row"]) for p in parts])
    return out


def _by_place(found: dict[str, np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(found["place"], kind="stable")
    places = found["place"][order]
    edges = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else []
    for part in np.split(order, edges[1:]) if len(edges) else []:
        yield int(found["place"][part[0]]), kind, _pack(**{k: v[part] for k, v in found.items() if k != "place"})


def _answer_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({
        "place": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary()),
    })


def _first(*keys: np.ndarray) -> np.ndarray:
    """Of rows in the order of precedence: which are the first with their keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return first


def _met(rows: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A group's runs by anchor, digest and precedence, and which of them are the first of their digest."""
    runs = _joined(rows["blob"].to_pylist(), rows["place"].to_pylist())
    order = np.lexsort((runs["pos"], runs["row"], runs["place"], runs["id"], runs["extra"], runs["whole"], runs["anchor"]))
    runs = {k: v[order] for k, v in runs.items()}
    return runs, _first(runs["extra"], runs["whole"], runs["anchor"])


def _later(runs: dict[str, np.ndarray], holder: np.ndarray) -> dict[str, np.ndarray]:
    return {k: runs[k][~holder] for k in ("place", "row", "pos", "count")}


def _fold(rows: pa.Table) -> list[tuple[int, int, bytes]]:
    """Of a group's runs: those that an equal run precedes, settled, and the others as they came."""
    runs, holder = _met(rows)
    return [*_by_place(_later(runs, holder), RANGES), *_by_place({k: v[holder] for k, v in runs.items()}, rows["kind"][0].as_py())]


def _resolve(rows: pa.Table, hot_runs: int) -> list[tuple[int, int, bytes]]:
    """Of a bucket's runs: those that an equal run precedes, and the first of each, where its anchor has others."""
    runs, holder = _met(rows)
    new_anchor = np.ones(len(holder), bool)
    new_anchor[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
    anchor_no = np.cumsum(new_anchor) - 1
    different = np.bincount(anchor_no[holder], minlength=anchor_no[-1] + 1)[anchor_no]
    mixed = holder & (different > 1)
    need = {k: runs[k][mixed] for k in ("place", "row", "pos", "count", "anchor", "id")} | {"hot": different[mixed] > hot_runs}
    return [*_by_place(_later(runs, holder), RANGES), *_by_place(need, RUNS)]


def _expand(rows: pa.Table, window: int) -> list[tuple[int, int, bytes]]:
    """Of different runs around common anchors: the windows that precede in another, by the transform."""
    blobs, places = rows["blob"].to_pylist(), rows["place"].to_pylist()
    runs = _joined(blobs, places)
    text = b"".join(_unpack(b)[1] for b in blobs)
    sizes = runs["count"].astype(np.int64) + window - 1
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((runs["pos"], runs["row"], runs["place"], runs["id"], runs["anchor"]))
    anchors = runs["anchor"][order]
    reach = np.cumsum(sizes[order])
    edges, out = [0], {k: [] for k in ("place", "row", "pos", "count")}
    while edges[-1] < len(order):
        done = reach[edges[-1] - 1] if edges[-1] else 0
        k = min(len(order) - 1, int(np.searchsorted(reach, done + EXPAND_BYTES)))
        edges.append(int(np.searchsorted(anchors, anchors[k], "right")))  # anchors stay whole
    for a, b in zip(edges, edges[1:]):
        part = order[a:b][np.lexsort(tuple(runs[k][order[a:b]] for k in ("pos", "row", "place", "id")))]
        counts = runs["count"][part].astype(np.int64)
        dup = repeated_windows([text[s : s + z] for s, z in zip(starts[part].tolist(), sizes[part].tolist())], counts, window)
        run = np.repeat(np.arange(len(part)), counts)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = dup.copy()
        begin[1:] &= ~dup[:-1] | (run[1:] != run[:-1])
        at = np.flatnonzero(begin)
        if len(at):
            out["place"].append(runs["place"][part][run[at]])
            out["row"].append(runs["row"][part][run[at]])
            out["pos"].append(runs["pos"][part][run[at]] + offset[at].astype(np.int32))
            out["count"].append(np.add.reduceat(dup.astype(np.uint8), at, dtype=np.int64).astype(np.uint8))
    if not out["place"]:
        return []
    return list(_by_place({k: np.concatenate(v) for k, v in out.items()}, RANGES))


def _buffer(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, bytes of all texts in turn, and where each begins and how long it is."""
    texts = rows["text"].cast(pa.binary()).fill_null(b"").to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return rows["rank"].to_numpy(), np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
    piece_bytes: int = PIECE_BYTES, hot_runs: int = HOT_RUNS, fan_in: int = FAN_IN, with_text: bool = False,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Each byte goes that a string of ``window`` bytes covers which also starts earlier: in a row with a smaller id, or before
    in the same text. Strings are taken from the input, may overlap and never cross texts. ``kept`` holds the bytes that
    stay. Null and empty texts have no bytes. The id is an integer; rows without one come last, and rows that share an
    id, or have none, are ordered by a hash of their texts, so that only equal rows are interchangeable.

    Texts move once, into blocks (once more, to be ordered, if ids repeat); what is shuffled is three hashes and a place
    per run of windows, some 30 bytes for 40 bytes of text, and the bytes of runs that share an anchor but differ. Equal
    runs of a piece are folded before the shuffle, and those of up to ``fan_in`` pieces before the next, so that a string
    in every document costs a group ``fan_in`` entries, whatever the input; anchors with more than ``hot_runs`` different
    runs are settled by 128-bit hashes of single windows, dealt over all tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("rank", F.coalesce("id", F.lit((1 << 63) - 1)))
    if rows.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        rows = rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"), "text").withColumn("rank", F.monotonically_increasing_id())
    table, name, total = B.pack(rows, "text", piece_bytes)
    n_buckets = blocks_for(total, BUCKET_BYTES)
    asked_schema, answer_schema = "kind int, bucket int, place long, blob binary", "place long, kind int, blob binary"

    def packed(place: int, kind: int, runs: dict[str, np.ndarray], key: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        order = np.argsort(key, kind="stable")
        buckets, at = B.cuts(key[order], n_buckets)
        for bucket, a, b in zip(buckets.tolist(), at, at[1:]):
            yield kind, bucket, place, _pack(**{k: v[order[a:b]] for k, v in runs.items()})

    def batch_of(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["kind", "bucket", "place", "blob"])

    def request(place: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, data, starts, sizes = _buffer(rows)
        runs = find_runs(data, starts, sizes, window, anchor)
        runs["id"] = ids[runs["row"]]
        order = np.lexsort((runs["pos"], runs["row"], runs["id"]))
        runs = {k: v[order] for k, v in runs.items()}
        first = _first(runs["extra"], runs["whole"], runs["anchor"])
        later = ~first
        if later.any():  # an equal run in this piece comes first
            yield batch_of([(RANGES, int(place % n_buckets), place, _pack(**{k: runs[k][later] for k in ("row", "pos", "count")}))])
        if first.any():
            yield batch_of(list(packed(place, RUNS, {k: v[first] for k, v in runs.items()}, runs["anchor"][first])))

    def settle(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_pylist()
        if kinds[0] == RANGES:
            return _answer_table(list(zip(rows["place"].to_pylist(), kinds, rows["blob"].to_pylist())))
        return _answer_table(_resolve(rows, hot_runs))

    def folded(asked: DataFrame, kind: int) -> DataFrame:
        def fold(rows: pa.Table) -> pa.Table:
            if rows["kind"][0].as_py() != kind:
                return rows.select(["kind", "bucket", "place", "blob"])
            bucket = rows["bucket"][0].as_py()
            return pa.Table.from_batches([batch_of([(k, bucket, place, blob) for place, k, blob in _fold(rows)])])

        groups = -(-total // piece_bytes)
        while groups > fan_in:
            groups = -(-groups // fan_in)
            asked = asked.groupBy("kind", "bucket", F.pmod(F.xxhash64("place"), F.lit(groups))).applyInArrow(fold, asked_schema)
        return asked

    answers = folded(B.ask(table, request, asked_schema), RUNS).groupBy("kind", "bucket").applyInArrow(settle, answer_schema)
    answers = materialize(answers, "runs", files_for(total))

    def fetch(place: int, rows: pa.Table, need: pa.Table) -> pa.Table:
        if not need.num_rows:
            return pa.Table.from_batches([batch_of([])])
        ids, data, starts, sizes = _buffer(rows)
        runs = _joined(need["blob"].to_pylist(), [place] * need.num_rows)
        del runs["place"]
        hot = runs.pop("hot")
        cold = {k: v[~hot] for k, v in runs.items()}
        out = []
        order = np.argsort(cold["anchor"], kind="stable")
        cold = {k: v[order] for k, v in cold.items()}
        buckets, at = B.cuts(cold["anchor"], n_buckets)
        begin = starts[cold["row"]] + cold["pos"]
        end = begin + cold["count"] + window - 1
        for bucket, a, b in zip(buckets.tolist(), at, at[1:]):
            text = b"".join(data[s:e].tobytes() for s, e in zip(begin[a:b].tolist(), end[a:b].tolist()))
            out.append((RUNS, bucket, place, _pack(text, **{k: v[a:b] for k, v in cold.items()})))
        if hot.any():
            count = runs["count"][hot].astype(np.int64)
            pos = np.repeat(runs["pos"][hot], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            row = np.repeat(runs["row"][hot], count)
            own, extra = (_window_hashes(data, starts[row] + pos, window, which) for which in range(2))
            windows = {"row": row, "pos": pos, "count": np.ones(len(pos), np.uint8), "anchor": own, "whole": own, "extra": extra, "id": ids[row]}
            order = np.lexsort((pos, row, windows["id"]))
            windows = {k: v[order] for k, v in windows.items()}
            first = _first(windows["extra"], windows["whole"])
            if not first.all():  # an equal window in this piece comes first
                out.append((RANGES, int(place % n_buckets), place, _pack(**{k: windows[k][~first] for k in ("row", "pos", "count")})))
            out += packed(place, WINDOWS, {k: v[first] for k, v in windows.items()}, windows["whole"][first])
        return pa.Table.from_batches([batch_of(out)])

    def compare(rows: pa.Table) -> pa.Table:
        kind = rows["kind"][0].as_py()
        if kind == RANGES:
            return settle(rows)
        return _answer_table([a for a in _resolve(rows, hot_runs) if a[1] == RANGES] if kind == WINDOWS else _expand(rows, window))

    need = answers.filter(F.col("kind") == RUNS)
    compared = folded(B.join_answers(table, need, fetch, asked_schema), WINDOWS).groupBy("kind", "bucket").applyInArrow(compare, answer_schema)
    compared = materialize(compared.repartition(files_for(total)), "compared")  # small rows; their making keeps all its tasks

    def cut(place: int, rows: pa.Table, found: pa.Table) -> pa.Table:
        ids, data, starts, sizes = _buffer(rows)
        depth = np.zeros(len(data) + 1, np.int32)
        if found.num_rows:
            ranges = _joined(found["blob"].to_pylist(), [place] * found.num_rows)
            begin = starts[ranges["row"]] + ranges["pos"]
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + ranges["count"].astype(np.int64) + window - 1, -1)
        gone = np.cumsum(depth[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        real = starts[sizes > 0]
        opens[real] = gone[real]
        removed, spans = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        if len(real):
            removed[sizes > 0] = np.add.reduceat(gone.astype(np.int64), real)
            spans[sizes > 0] = np.add.reduceat(opens.astype(np.int64), real)
        kept = [data[s : s + z][~gone[s : s + z]].tobytes() if r else data[s : s + z].tobytes() for s, z, r in zip(starts.tolist(), sizes.tolist(), removed.tolist())]
        columns = {"id": rows["id"], "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    ranges = answers.filter(F.col("kind") == RANGES).union(compared)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = materialize(B.join_answers(table, ranges, cut, schema), "kept")
    B.drop(spark, name)
    return out.withColumnRenamed("id", id_col)


def _window_hashes(data: np.ndarray, places: np.ndarray, window: int, which: int) -> np.ndarray:
    """Hashes of the windows at these places, chunk by chunk of the buffer."""
    out = np.zeros(len(places), np.uint64)
    chunk = places // CHUNK
    for c in np.unique(chunk):
        own = chunk == c
        at = places[own] - c * CHUNK
        out[own] = _Hashes(data[c * CHUNK : (c + 1) * CHUNK + window], which).of(at, at + window)
    return out
