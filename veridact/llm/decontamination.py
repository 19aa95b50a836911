"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridact.llm.common import materialize, may_hold

#: Positions marked 1 enter a seed's hash, those marked 0 may differ. However an item of 8 or more words differs within what
#: ``SHARE`` allows, in a stretch of ``STRETCH`` words (or all, if shorter) one mask fits where all its marked words agree.
MASKS = ("11111", "111011", "11010011")
#: Items with fewer words have to agree in all of them; with still fewer, they must be all that a document says.
EXACT_BELOW, WHOLE_BELOW = 8, 4
#: An overlap counts where, in a stretch of so many words (or the whole item, if shorter), so large a share agrees.
STRETCH, SHARE = 16, 0.8
#: Seeds of a benchmark that are broadcast, at most, and bytes of its texts; a larger one is joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 32 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(hashes: Column, tag: str, mask: str) -> Column:
    """array<long>: the hash at every position where the mask fits."""
    picks = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(hashes) - len(mask)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(tag), *[F.get(hashes, i + p) for p in picks]))


def _hits(df: DataFrame, keep: list[str], at_name: str, seeds: Column) -> DataFrame:
    rows = df.select(*keep, F.explode(seeds).alias("seeds"))
    return rows.select(*keep, F.posexplode("seeds").alias(at_name, "seed"))


def _whole(hashes: Column, n: int) -> Column:
    return F.when(F.size(hashes) == n, _seeds(hashes, f"whole{n}", "1" * n)).otherwise(F.array().cast("array<bigint>"))


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """Verified overlaps (row_key, id, item_id, matched_words, share) and the keys of all rows with a hit."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item_words")).filter(F.size("item_words") > 0)
    items = items.withColumn("item_key", F.xxhash64("item_id", F.concat_ws(" ", "item_words"))).dropDuplicates(["item_key"])
    items = items.withColumn("hashes", F.transform("item_words", lambda w: F.xxhash64(w))).withColumn("item_size", F.size("item_words"))
    short = [r["item_size"] for r in items.filter(F.col("item_size") < EXACT_BELOW).select("item_size").distinct().collect()]  # seven at most
    hashes = F.col("hashes")
    exact = {n: _seeds(hashes, f"exact{n}", "1" * n) if n >= WHOLE_BELOW else _whole(hashes, n) for n in sorted(short)}
    masked = [_seeds(hashes, m, m) for m in MASKS]
    long_items, short_items = items.filter(F.col("item_size") >= EXACT_BELOW), items.filter(F.col("item_size") < EXACT_BELOW)
    seeds = _hits(long_items, ["item_key", "item_size"], "item_at", F.array(*masked))
    for n, own in exact.items():
        seeds = seeds.union(_hits(short_items.filter(F.col("item_size") == n), ["item_key", "item_size"], "item_at", F.array(own)))
    seeds = materialize(seeds.distinct(), "seeds")

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("id", "text"))
    hashed = texts.select("row_key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    own = _hits(hashed, ["row_key"], "at", F.array(*masked, *exact.values()))
    if seeds.count() <= BROADCAST_SEEDS:
        hits = own.join(F.broadcast(seeds), "seed")
    else:
        hits = may_hold(own, "seed", seeds).filter("may_hold").join(seeds, "seed")
    # `at` counts positions of one mask's array, as `item_at` does; the mask is part of the hash
    places = hits.select("row_key", "item_key", "item_size", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    by_row = materialize(places.groupBy("row_key").agg(F.collect_list(F.struct("item_key", "item_size", "offset")).alias("places")), "places")

    found = may_hold(texts, "row_key", by_row).filter("may_hold").join(by_row, "row_key").select("row_key", "id", words(F.col("text")).alias("words"), "places")

    def place(p: Column) -> Column:
        first = F.greatest(-p["offset"], F.lit(0))
        length = F.least(p["item_size"], F.size("words") - p["offset"]) - first
        return F.struct(p["item_key"].alias("item_key"), first.alias("first"), F.size("words").alias("n"), F.slice("words", first + p["offset"] + 1, length).alias("part"))

    parts = found.select("row_key", "id", F.explode(F.transform("places", place)).alias("p")).select("row_key", "id", "p.*")
    small = (benchmark.agg(F.sum(F.octet_length(item_text_col)).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES
    known = items.select("item_key", "item_id", "item_words", "item_size")
    pairs = parts.join(F.broadcast(known) if small else known, "item_key")
    size, stretch = F.col("item_size"), F.least(F.lit(STRETCH), F.col("item_size"))
    same = F.zip_with(F.slice("item_words", F.col("first") + 1, F.size("part")), "part", lambda a, b: (a == b).cast("int"))
    at_all = F.when(F.size("same") >= F.col("stretch"), F.sequence(F.lit(1), F.size("same") - F.col("stretch") + 1)).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(at_all, lambda i: F.aggregate(F.slice("same", i, F.col("stretch")), F.lit(0), lambda a, v: a + v)))
    enough = F.when(size < WHOLE_BELOW, (F.col("n") == size) & (F.col("agree") == size)).when(size < EXACT_BELOW, F.col("agree") == size).otherwise(F.col("agree") >= F.col("stretch") * SHARE)
    judged = (
        pairs.withColumn("same", same).withColumn("stretch", stretch).withColumn("agree", best).filter(enough)
        .withColumn("matched", F.aggregate("same", F.lit(0), lambda a, v: a + v))
    )
    out = judged.groupBy("row_key", "id", "item_key", "item_id").agg(F.max("matched").cast("long").alias("matched_words"), F.max(F.col("agree") / F.col("stretch")).alias("best_share"))
    return out.drop("item_key"), by_row.select("row_key")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Verified overlaps: one row per different document and item, with the diagonal's best stretch and its agreeing words.

    Every position of every text is hashed under each mask and joined with the hashes of the benchmark. A hit names a
    diagonal (offset of item against document); there the words are compared one by one, and the pair counts if a
    stretch of ``STRETCH`` item words (the whole item, if shorter) agrees in ``SHARE`` of them. The masks find every such
    stretch. Items of 4 to 7 words must agree in all words, those of 1 to 3 words be the whole document.

    Texts are not shuffled for the seeds, which are broadcast up to ``BROADCAST_SEEDS`` and else joined by a shuffle of the
    positions that a bounded table of marks lets through; for the comparison, only documents with a hit are. Null and
    empty texts match nothing; a null id is an id like any other; rows that repeat id and text return one row for all;
    equal items with different ids each return a row.
    """
    return _verified(docs, benchmark, id_col, text_col, item_col, item_text_col)[0].drop("row_key").withColumnRenamed("id", id_col)


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row per contaminated document: the items it overlaps with, and the most words that agree with one."""
    id_col = kw.get("id_col", "doc_id")
    found = overlaps(docs, benchmark, **kw)
    return found.groupBy(id_col).agg(
        F.countDistinct(F.struct("item_id")).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"),
        F.max("matched_words").alias("matched_words"), F.max("best_share").alias("best_share"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any overlap, columns unchanged. Each row is judged by its own text, whatever its id.

    Only rows with a hit are shuffled for the comparison with the overlaps; the others stay where they are.
    """
    bad, hit = _verified(docs, benchmark, id_col, text_col, item_col, item_text_col)
    bad = materialize(bad.select(F.col("row_key").alias("bad_key"), F.col("id").alias("bad_id")).distinct(), "bad")
    key = F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), key.alias("row_key"))
    marked = may_hold(rows, "row_key", bad.select(F.col("bad_key").alias("row_key")))
    clean = marked.filter("may_hold").join(bad, (F.col("row_key") == F.col("bad_key")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti")
    return marked.filter("NOT may_hold").unionByName(clean).select("row.*")
