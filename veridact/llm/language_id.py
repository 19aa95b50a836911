"""Language identification of mixed text: script ranges, per-word scores, and a Viterbi path over languages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each language that the model learns from, about: the classifier's sample.
SAMPLE_PER_LANGUAGE = 400
SWITCH_PENALTY = 9.0
TABLE_BITS = 17
BATCH_CHARS = 3_000_000
CACHE_WORDS = 400_000
UNKNOWN = "und"

#: A word: letters, with the marks that belong to them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# First code points of blocks by script, up to the next block.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``\\x02word\\x03`` for all words in one array, and where each begins."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return points, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words (every word has at least one), and where each word's begin."""
    points, starts = _code_points(words)
    mixed = (points[:-2] * 0x9E3779B1 ^ points[1:-1] * 0x85EBCA77 ^ points[2:] * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
    mixed = (mixed ^ (mixed >> 17)) * 0x27D4EB2F & 0xFFFFFFFFFFFF
    slots = (mixed >> 11) & ((1 << TABLE_BITS) - 1)
    keep = np.ones(len(slots), bool)
    for back in (1, 2):  # those that reach into the next word
        ends = starts[1:] - back
        keep[ends[ends < len(slots)]] = False
    return slots[keep], starts - 2 * np.arange(len(starts))


def _scripts(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, "right") - 1]


def gram_counts(texts: list[str]) -> list[tuple[int, int]]:
    """(place, occurrences) of the texts' trigrams, by slot of the table, and after these of their words by script."""
    words = Counter(w for t in texts for w in LETTERS.findall(t.lower()))
    if not words:
        return []
    keys = list(words)
    weight = np.fromiter(words.values(), float, len(keys))
    slots, starts = _grams(keys)
    grams = np.bincount(slots, np.repeat(weight, np.diff([*starts, len(slots)])), 1 << TABLE_BITS)
    found = np.concatenate([grams, np.bincount(_scripts(keys), weight, len(_NAMES))])
    return [(int(k), int(found[k])) for k in np.flatnonzero(found)]


@dataclass
class LanguageModel:
    """Log-probabilities of hashed trigrams by language, and the languages that each script admits."""

    languages: list[str]
    table: np.ndarray  # slots x languages
    admits: np.ndarray  # scripts x languages

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        """From (language, text) rows; their order doesn't matter."""
        return cls.of([(lang, at, n) for lang, text in rows for at, n in gram_counts([text])])

    @classmethod
    def of(cls, seen: list[tuple[str, int, int]]) -> LanguageModel:
        """From (language, place, occurrences): places are those of :func:`gram_counts`."""
        languages = sorted({lang for lang, _, _ in seen})
        known = {lang: k for k, lang in enumerate(languages)}
        both = np.zeros(((1 << TABLE_BITS) + len(_NAMES), max(1, len(languages))))
        if seen:
            at = np.array([(place, known[lang]) for lang, place, _ in seen])
            np.add.at(both, (at[:, 0], at[:, 1]), [n for _, _, n in seen])
        counts, scripts = both[: 1 << TABLE_BITS], both[1 << TABLE_BITS :]
        smooth = 0.05
        total = counts.sum(0) + smooth * np.maximum(1, (counts.any(1)).sum())
        share = scripts / np.maximum(1, scripts.sum(0))
        admits = share >= 0.01
        admits |= ~admits.any(1, keepdims=True)
        return cls(languages, np.log((counts + smooth) / total).astype(np.float32), admits)

    def parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        return self.languages, self.table, self.admits

    def score(self, words: list[str]) -> np.ndarray:
        """words x languages: log-likelihood above the word's mean; languages that its script excludes get a low score."""
        slots, starts = _grams(words)
        raw = np.add.reduceat(self.table[slots], starts, axis=0)
        raw -= raw.mean(1, keepdims=True)
        return np.where(self.admits[_scripts(words)], raw, raw.min(1, keepdims=True) - 20).astype(np.float32)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word. ``scores`` holds the words of all texts in turn, ``sizes`` their numbers of words.

    All texts advance together, one word a step; longer texts first, so that those still running are a prefix.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    n_lang = scores.shape[1]
    out = np.zeros(len(scores), np.uint8)
    if not len(scores):
        return out
    back = np.zeros(scores.shape, np.uint8)
    running = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "left")  # texts longer than t
    own = np.arange(n_lang, dtype=np.uint8)
    state = scores[starts[: running[0]]].copy()
    for t in range(1, lengths[0]):
        n = running[t]
        state = state[:n] if len(state) > n else state
        top = state.argmax(1)
        jump = state.max(1, keepdims=True) - penalty
        back[starts[:n] + t] = np.where(state >= jump, own, top[:, None])
        state = np.maximum(state, jump) + scores[starts[:n] + t]
        ends = running[t + 1]
        if ends < n:
            out[starts[ends:n] + t] = state[ends:].argmax(1)
    first = running[1] if lengths[0] > 1 else 0
    out[starts[first : running[0]]] = scores[starts[first : running[0]]].argmax(1)
    for t in range(lengths[0] - 1, 0, -1):
        at = starts[: running[t]] + t
        out[at - 1] = back[at, out[at]]
    return out


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows where ``training`` holds and the language is known.

    The classifier sees a sample: of each language, about ``per_language`` rows chosen by a hash of id and text (all, if
    fewer), whole texts of any length. Their trigrams are counted where they are read; the driver gets counts only, at most
    ``2 ** TABLE_BITS`` and one per script for each language.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("draw"), training.alias("training"))
    known = known.filter(F.col("training") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel.of([])
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(sizes.items(), key=str)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                found = gram_counts([t for at, t in zip(langs, texts) if at == lang])
                columns = [pa.array([lang] * len(found), batch.column(0).type), pa.array([k for k, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "n"])

    lang_type = known.schema["lang"].dataType.simpleString()
    some = known.filter(F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).select("lang", "text")
    seen = some.mapInArrow(count, f"lang {lang_type}, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    return LanguageModel.of([tuple(r) for r in seen.collect()])


class _Labeller:
    """Labels texts with one model; keeps the scores of words it has seen, up to a bound."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, max(1, len(model.languages))), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        places = self.places
        ids = np.fromiter((places.get(w, -1) for w in words), np.int64, len(words))
        if len(missing := np.flatnonzero(ids < 0)):
            new = list(dict.fromkeys(words[i] for i in missing))
            self.scores = np.concatenate([self.scores, self.model.score([w.lower() for w in new])])
            places.update(zip(new, range(len(places), len(places) + len(new))))
            ids[missing] = [places[words[i]] for i in missing]
        return ids

    def label(self, texts: list[str]) -> tuple[list[str], list[float], list[int], list[str]]:
        """Predicted language, its share of letters, number of spans and spans of every text."""
        if len(self.places) > CACHE_WORDS:
            self.places.clear()
            self.scores = self.scores[:0]
        found = [LETTERS.findall(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words = [w for ws in found for w in ws]
        languages = self.model.languages
        if not words or not languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [""] * len(texts)
        ids = self._ids(words)
        path = viterbi(self.scores[ids], sizes, self.penalty)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), sizes)
        share = np.bincount(doc * len(languages) + path, letters, len(texts) * len(languages)).reshape(-1, len(languages))
        best, total = share.argmax(1), share.sum(1)
        opens = np.ones(len(path), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(path)) - 1
        first_word = np.cumsum(sizes) - sizes
        spans: list[list[str]] = [[] for _ in texts]
        for d, k, a, b in zip(doc[at].tolist(), path[at].tolist(), (at - first_word[doc[at]]).tolist(), (last - first_word[doc[at]]).tolist()):
            spans[d].append(f"{languages[k]}:{a}:{b}")
        names = [languages[b] if t else UNKNOWN for b, t in zip(best, total)]
        shares = (share[np.arange(len(texts)), best] / np.maximum(total, 1)).tolist()
        return names, shares, [len(x) for x in spans], [",".join(x) for x in spans]

    def batches(self, texts: list[str]) -> Iterator[tuple[int, int, tuple]]:
        """Labels of stretches of about ``BATCH_CHARS``, which bounds memory however long the texts are."""
        cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // BATCH_CHARS)) + 1
        edges = [0, *cuts.tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield a, b, self.label(texts[a:b])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (share of letters in that language's spans, 0 to 1), spans and their number.

    ``lang_spans`` lists ``language:first word:last word`` of every span of one language. A text that is null, empty or
    without letters is ``und`` with score 0; ties go to the language that sorts first; repeated rows each return a row.
    One pass without shuffle; the model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(LanguageModel(*shared.value), penalty)
        for batch in batches:
            for a, b, (names, scores, n, spans) in labeller.batches(batch.column(1).to_pylist()):
                columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(n, pa.int32()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["id", "lang_pred", "score", "n_spans", "lang_spans"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"id {id_type}, lang_pred string, score double, n_spans int, lang_spans string").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs`` with a language that has at least the share ``least`` of the letters; columns unchanged.

    Texts that are null, empty or without letters go. A null label becomes the language found. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at, lang = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(LanguageModel(*shared.value), penalty)
        for batch in batches:
            texts = batch.column(at).fill_null("").to_pylist()
            for a, b, (names, scores, _, _) in labeller.batches(texts):
                part = batch.slice(a, b - a)
                if lang is not None and part.column(lang).null_count:
                    filled = pa.compute.coalesce(part.column(lang), pa.array(names, part.column(lang).type))
                    part = pa.RecordBatch.from_arrays([filled if k == lang else c for k, c in enumerate(part.columns)], schema=part.schema)
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)]))

    return docs.mapInArrow(run, docs.schema)
