"""Language-model scores by deleted interpolation of n-gram estimates, with weights learned by expectation-maximisation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridact.llm import blocks as B
from veridact.llm.common import ASCII_LOWER, WORD, blocks_for, files_for, materialize

_WORDS = re.compile(WORD.encode())
#: Contexts are grouped by how often they occur: never, once, 2 to 3, 4 to 7, ...
N_BUCKETS = 41
#: Estimates are told apart to half an octave when the weights are learned; this bounds what the driver gets.
STEPS, MAX_STEP = 2, 126
EM_ROUNDS = 60
UNI, BI = 0, 1
#: Text whose n-grams a bucket counts.
BUCKET_BYTES = 6 << 20


@dataclass
class Weights:
    """Counts of the corpus, and mixture weights (pair, word, uniform) for each bucket of context frequency."""

    tokens: int
    distinct: int
    starts: int
    mix: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def score(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        mix = self.mix[bucket_of(context)]
        p = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * word / max(self.tokens, 1) + mix[:, 2] / (self.distinct + 1)
        return np.log10(p)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(int)


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, then the end, written as an empty word."""
    return [*_WORDS.findall((text or "").encode().translate(ASCII_LOWER)), b""]


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts in turn, and the texts' numbers of tokens."""
    import xxhash

    words, sizes = [], []
    for t in texts:
        own = tokens_of(t)
        words += own
        sizes.append(len(own))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.array(sizes, np.int64)


def _pairs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of (previous token, token); a text's first token follows a start mark of its own."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = np.uint64(0x5851F42D4C957F2D)
    mixed = (before ^ (before >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + words
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and for each key its place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def count_ngrams(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """Answers (place, kind, bucket, totals): training counts of each piece's distinct words and pairs, in key order.

    A piece sends each distinct key once, with its training count in the piece, packed by bucket of the key's hash; a
    bucket adds the counts up and answers every piece. A frequent key costs a bucket one entry per piece. Rows without
    place hold the bucket's distinct training words and their total.
    """

    def request(place: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, sizes = _hashed(rows["text"].to_pylist())
        training = np.repeat(rows["training"].to_numpy(zero_copy_only=False), sizes)
        for kind, keys in ((UNI, words), (BI, _pairs(words, sizes))):
            distinct, at_key = _distinct(keys)
            counts = np.bincount(at_key[training], minlength=len(distinct))
            buckets, at = B.cuts(distinct, n_buckets)
            n = len(buckets)
            packed = [distinct[a:b].tobytes() for a, b in zip(at, at[1:])]
            added = [B.planes(counts[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(buckets), pa.array(np.full(n, place, np.int64)), pa.array(packed, pa.binary()), pa.array(added, pa.binary())],
                ["kind", "bucket", "place", "keys", "counts"],
            )

    def total(rows: pa.Table) -> pa.Table:
        kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        parts = [np.frombuffer(k, np.uint64) for k in rows["keys"].to_pylist()]
        counts = np.concatenate([B.from_planes(c) for c in rows["counts"].to_pylist()]).astype(np.int64)
        distinct, at_key = _distinct(np.concatenate(parts))
        totals = np.bincount(at_key, counts, len(distinct)).astype(np.int64)
        answers = np.split(totals[at_key], np.cumsum([len(p) for p in parts])[:-1])
        n = len(parts)
        words = kind == UNI
        return pa.table({
            "place": pa.array([*rows["place"].to_pylist(), None], pa.int64()), "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "totals": pa.array([*map(B.planes, answers), None], pa.binary()),
            "n_distinct": pa.array([None] * n + [int((totals > 0).sum()) if words else 0], pa.int64()), "n_tokens": pa.array([None] * n + [int(totals.sum()) if words else 0], pa.int64()),
        })

    asked = B.ask(blocks, request, "kind int, bucket int, place long, keys binary, counts binary")
    return asked.groupBy("kind", "bucket").applyInArrow(total, "place long, kind int, bucket int, totals binary, n_distinct long, n_tokens long")


def _counts(rows: pa.Table, answers: pa.Table, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token in a piece: the training counts of its pair, its context and itself; and the texts' sizes."""
    words, sizes = _hashed(rows["text"].to_pylist())
    kinds, buckets, totals = (answers[c].to_pylist() for c in ("kind", "bucket", "totals"))
    out = []
    for kind, keys in ((UNI, words), (BI, _pairs(words, sizes))):
        _, place = _distinct(keys)
        own = sorted((b, t) for k, b, t in zip(kinds, buckets, totals) if k == kind)
        out.append(np.concatenate([B.from_planes(t) for _, t in own]).astype(np.int64)[place])
    word, pair = out
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = starts
    return pair, context, word, sizes


def learn_weights(seen: list[tuple[int, int, int, int]], tokens: int, distinct: int) -> np.ndarray:
    """Weights per bucket from (bucket, step of the pair's estimate, step of the word's, events) by expectation-maximisation.

    Step 0 stands for an estimate of zero. A bucket without events gets the weights of the nearest smaller one with some.
    """
    mix = np.zeros((N_BUCKETS, 3))
    data = np.array(seen, float).reshape(-1, 4)
    last = np.array([0.0, 0.5, 0.5])
    for b in range(N_BUCKETS):
        own = data[data[:, 0] == b]
        if len(own):
            p = np.stack([np.where(own[:, k] > 0, 2.0 ** (-(own[:, k] - 1) / STEPS), 0.0) for k in (1, 2)] + [np.full(len(own), 1 / (distinct + 1))], 1)
            w = np.array([1 / 3, 1 / 3, 1 / 3])
            for _ in range(EM_ROUNDS):
                share = p * w
                share /= share.sum(1, keepdims=True)
                w = (share * own[:, 3:]).sum(0) / own[:, 3].sum()
            w = np.maximum(w, [0.0, 1e-9, 1e-9])
            last = w / w.sum()
        mix[b] = last if b else np.array([0.0, *(last[1:] / last[1:].sum())])
    return mix


def _step(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.minimum(MAX_STEP - 1, np.round(-STEPS * np.log2(np.maximum(p, 1e-30)))), 0).astype(np.int64)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = B.PIECE_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows where ``training`` holds.

    The model mixes maximum-likelihood estimates of a token given the one before, of the token alone, and a uniform one, with
    weights by how often the context occurs. The weights come from all training tokens, each held out in turn: its own
    occurrence is deleted from the counts (leaving-one-out) before its estimates are taken. Tokens are counted over all
    texts; words are told apart by 64-bit hashes. Null and empty texts are one end token; a null ``training`` is false;
    repeated rows each count. ``score`` and ``base_score`` are sums of log10 probabilities; a word never seen has those of
    the uniform estimate, and no probability is zero.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    id_type = rows.schema["id"].dataType.simpleString()
    blocks, name, total = B.pack(rows, "text", piece_bytes)
    answers = materialize(count_ngrams(blocks, blocks_for(total, BUCKET_BYTES)), "counts", files_for(total))
    size = answers.filter("place IS NULL").agg(F.sum("n_distinct"), F.sum("n_tokens")).first()
    distinct, tokens = size[0] or 0, size[1] or 0
    starts = rows.filter("training").count()  # every training text has one start
    given = answers.filter("place IS NOT NULL").select("place", "kind", "bucket", "totals")

    def events(place: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        pair, context, word, sizes = _counts(rows, answers, starts)
        own = np.repeat(rows["training"].to_numpy(zero_copy_only=False), sizes)
        pair, context, word = pair[own] - 1, context[own] - 1, word[own] - 1
        code = (bucket_of(context) * 128 + _step(pair / np.maximum(context, 1))) * 128 + _step(word / max(tokens - 1, 1))
        codes, n = np.unique(code, return_counts=True)
        return pa.table({"code": codes.astype(np.int64), "n": n.astype(np.int64)})

    seen = B.join_answers(blocks, given, events, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    mix = learn_weights([(r["code"] >> 14, r["code"] >> 7 & 127, r["code"] & 127, r["n"]) for r in seen], tokens, distinct)
    weights = spark.sparkContext.broadcast(Weights(tokens, distinct, starts, mix))

    def judge(place: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        pair, context, word, sizes = _counts(rows, answers, starts)
        at = np.cumsum(sizes) - sizes
        w = weights.value
        return pa.table({
            "id": rows["id"], "n_tokens": sizes, "n_known": np.add.reduceat((word > 0).astype(np.int64), at), "train_tokens": np.full(len(sizes), w.tokens, np.int64),
            "base_score": np.add.reduceat(w.base(word), at), "score": np.add.reduceat(w.score(pair, context, word), at), "training": rows["training"],
        })

    schema = f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double, training boolean"
    out = materialize(B.join_answers(blocks, given, judge, schema), "scores")
    B.drop(spark, name)
    return out.withColumnRenamed("id", id_col)
