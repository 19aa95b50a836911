"""Token counts with public tokenizers: Arrow batches in, lengths out."""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 32_768
BATCH_BYTES = 1 << 20
#: Words whose tokens a task keeps, about, and characters of the longest.
KNOWN_WORDS, KNOWN_CHARS = 1 << 17, 64


def split_safely(text: str, limit: int = PIECE_CHARS, keep_space: bool = True) -> list[str]:
    """Cut a long text before single spaces that stand between two visible characters.

    No pre-tokenizer joins what stands on both sides of such a space, so the pieces' lengths add up to the text's.
    A stretch without such a space stays whole, however long. ``keep_space``: the space opens the next piece; else
    it is left out, for models that put a mark in place of the space before each piece.
    """
    out, start = [], 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start + 1, start + limit)
        while cut > start and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            cut = text.find(" ", start + limit)
            while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= len(text) - 1:
                break
        out.append(text[start:cut])
        start = cut + (not keep_space)
    out.append(text[start:])
    return out


def word_lengths(texts: list[str], count: Callable[[list[str]], Sequence[int]], known: dict[str, int]) -> np.ndarray:
    """Tokens of each text, as the sum over pieces cut before every single space between two visible characters.

    ``known`` has the tokens of words with the space before them, and is filled with those that come three times in the texts. A text's
    other pieces are counted together, in order and as they stand.
    """
    cut = [t.split(" ") for t in texts]
    often = Counter(itertools.chain.from_iterable(cut))
    new = [w for w, k in often.items() if k > 2 and w not in known and 0 < len(w) <= KNOWN_CHARS and not w[0].isspace() and not w[-1].isspace()]
    if len(known) + len(new) > KNOWN_WORDS:
        known.clear()
    known.update(zip(new, count([" " + w for w in new])))
    n, rest = np.zeros(len(texts), np.int64), []
    for i, (first, *words) in enumerate(cut):
        found, open_, left = list(map(known.get, words)), not first or first[-1].isspace(), [first]
        for k, (word, tokens) in enumerate(zip(words, found)):
            # a known word stands alone if what is before it and behind it shows
            if tokens is None or open_ or (k + 1 < len(words) and found[k + 1] is None and (not words[k + 1] or words[k + 1][0].isspace())):
                left.append(word)
                open_ = tokens is None and (not word or word[-1].isspace())
            else:
                n[i] += tokens
        rest.append(" ".join(left))
    return n + np.array(count(rest), np.int64)


def _counter(model: bytes, kind: str):
    if kind == ".json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        whole = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # an added token that takes spaces with it, or has one inside, would reach across words
        return whole, not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in tokenizer.get_added_tokens_decoder().values())
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)], False


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", over: int = 2048,
    piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Per row: the id, UTF-8 bytes, tokens of the whole text, and whether they exceed ``over``.

    The vocabulary file (a few MB whatever the input) is read once on the driver and broadcast. Executors gather texts
    until a batch holds ``batch_bytes``, so that many short or few long texts make equal work, cut long texts with
    :func:`split_safely`, and return lengths only. Frequent words are counted once, see :func:`word_lengths`, if the model allows it. One pass, no shuffle. Null and empty texts have 0 bytes and 0 tokens;
    a null id stays null, repeated rows each return a row, other columns are not read.
    """
    kind = os.path.splitext(tokenizer_path)[1]
    if kind not in (".json", ".model"):
        raise ValueError(f"no library for {tokenizer_path!r}")
    with open(tokenizer_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count, by_words = _counter(model.value, kind)
        known: dict[str, int] = {}

        def lengths(texts: list[str]) -> np.ndarray:
            pieces, owner = [], []
            for i, t in enumerate(texts):
                parts = split_safely(t, piece_chars, kind == ".json")
                pieces += parts
                owner += [i] * len(parts)
            return np.bincount(owner, count(pieces), len(texts)).astype(np.int64)

        for batch in batches:
            texts, sizes = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // batch_bytes)) + 1
            edges = [0, *cuts.tolist(), len(texts)]
            n = np.concatenate([word_lengths(texts[a:b], lengths, known) if by_words else lengths(texts[a:b]) for a, b in zip(edges, edges[1:]) if b > a] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > over)], ["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = source.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
