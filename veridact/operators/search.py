"""Full-text search over an inverted index, and stable pages."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_OFFSET = 100_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def folded_tokens(text: Column) -> Column:
    """Tokens of any script; marks that follow a letter don't count."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}+", "")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(token, key, tf, first_pos). Text stays in its partition; only tokens are grouped."""
    places = docs.select(key, F.posexplode(tokens(text)).alias("pos", "token"))
    return places.groupBy("token", key).agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def search(docs: DataFrame, key: str, text: Column, terms: Sequence[str]) -> DataFrame:
    """Keys of rows that have all terms. No shuffle of texts: terms are looked up in each row's tokens."""
    wanted = F.array(*[F.lit(t.lower()) for t in dict.fromkeys(terms)])
    return docs.filter(F.size(F.array_except(wanted, tokens(text))) == 0).select(key)


def phrase(docs: DataFrame, key: str, text: Column, words: Sequence[str]) -> DataFrame:
    """Keys of rows where the words follow one another."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return docs.filter(joined.contains(" " + " ".join(w.lower() for w in words) + " ")).select(key)


def probe_terms(docs: DataFrame, key: str, text: Column, n: int = 5) -> DataFrame:
    """The first ``n`` distinct tokens in order of key and position: a top-k, not a sort of all tokens."""
    places = docs.select(key, F.posexplode(tokens(text)).alias("pos", "token"))
    first = places.groupBy("token").agg(F.min(F.struct(key, "pos")).alias("at"))
    top = first.orderBy("at").limit(n)
    return top.select(F.row_number().over(Window.orderBy("at")).alias("ordinal"), "token")


def page(df: DataFrame, order: Sequence[str], limit: int, after: Sequence[object] | None = None) -> DataFrame:
    """A page in that total order, after the key of the last row seen, with one row more to tell whether there is another."""
    if after is not None:
        ahead = F.lit(False)
        for k in range(len(order)):
            same = F.lit(True)
            for c, v in zip(order[:k], after[:k]):
                same = same & (F.col(c) == F.lit(v))
            ahead = ahead | (same & (F.col(order[k]) > F.lit(after[k])))
        df = df.filter(ahead)
    return df.orderBy(*order).limit(limit + 1)


def offset_page(df: DataFrame, order: Sequence[str], limit: int, offset: int) -> DataFrame:
    """A page by offset, which is bounded, with one row more."""
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be within 0..{MAX_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def within_bytes(df: DataFrame, order: Sequence[str], budget: int) -> DataFrame:
    """The first rows whose JSON together fits the budget; for the rows of one page."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    running = F.sum("page_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("page_bytes", size).withColumn("page_total", running).filter(F.col("page_total") <= budget).drop("page_bytes", "page_total")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, with_omitted: bool = False) -> DataFrame:
    """The first ``k`` rows of each group; ``with_omitted`` adds how many more it has, so no bound is silent."""
    w = Window.partitionBy(*group)
    out = df.withColumn("place", F.row_number().over(w.orderBy(*order)))
    if with_omitted:
        out = out.withColumn("omitted", F.greatest(F.count("*").over(w) - k, F.lit(0)))
    return out.filter(F.col("place") <= k)


class CursorError(ValueError):
    """A cursor that is forged, expired, or from another request."""


def make_cursor(request: dict, manifest: str, last: Sequence[object], key: bytes, expires: int) -> str:
    """An opaque, signed token that resumes exactly this request over exactly this data."""
    body = json.dumps({"request": _digest(request, manifest), "last": list(last), "expires": expires}, sort_keys=True, separators=(",", ":")).encode()
    mac = hmac.new(key, body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(mac + body).decode()


def read_cursor(cursor: str, request: dict, manifest: str, key: bytes, now: int) -> list:
    """The key of the last row seen; raises :class:`CursorError` on any mismatch."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
    except ValueError as e:
        raise CursorError("not a cursor") from e
    mac, body = raw[:32], raw[32:]
    if not hmac.compare_digest(mac, hmac.new(key, body, hashlib.sha256).digest()):
        raise CursorError("wrong signature")
    token = json.loads(body)
    if token["request"] != _digest(request, manifest):
        raise CursorError("made for another request")
    if token["expires"] <= now:
        raise CursorError("expired")
    return token["last"]


def _digest(request: dict, manifest: str) -> str:
    return hashlib.sha256(json.dumps([request, manifest], sort_keys=True).encode()).hexdigest()
