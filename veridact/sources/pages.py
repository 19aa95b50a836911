"""Paginated collections, and rows of wanted paths out of large line files."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridact.operators.ranking import global_rank
from veridact.sources.sinks import hashed

#: Sorted files that one task writes; more only if there are over 100,000 tasks.
FILES_A_TASK = 200

#: Gaps after which no more requests are made.
STOP_GAPS = ("rate_limited", "request_budget_exhausted")


@dataclass(frozen=True)
class Reply:
    """What a request gives: its status, body, and the number of the page that follows, if one does."""

    status: int
    body: object
    following: int | None = None


def paginate(request: Callable[[str, int], Reply], collection: str, key: Callable[[Mapping], str], max_pages: int, max_records: int) -> Iterator[dict]:
    """Events of reading one collection page by page: a record as it is first seen, and last how it ended.

    Records are told apart by key and kept in first-seen order. The end is complete, or a named gap: pagination_bound_reached,
    page_unavailable, page_malformed, or what the request raised (a :class:`Stopped`). A page that leads back, or nowhere, is malformed.
    """
    seen: set[str] = set()
    page, requests, repeats = 1, 0, 0

    def end(gap: str | None) -> dict:
        return {"collection": collection, "gap": gap, "complete": gap is None, "requests": requests, "duplicates": repeats, "page": page}

    while True:
        if requests >= max_pages:
            yield end("pagination_bound_reached")
            return
        try:
            reply = request(collection, page)
        except Stopped as e:
            yield end(e.gap)
            return
        requests += 1
        if reply.status != 200 or not isinstance(reply.body, list):
            yield end("page_unavailable")
            return
        for place, record in enumerate(reply.body):
            if not isinstance(record, Mapping):
                yield end("page_malformed")
                return
            identity = key(record)
            if identity in seen:
                repeats += 1
                continue
            seen.add(identity)
            if len(seen) > max_records:
                yield end("pagination_bound_reached")
                return
            yield {"collection": collection, "page": page, "place": place, "key": identity, "record": record}
        if reply.following is None:
            yield end(None)
            return
        if reply.following != page + 1:
            yield end("page_malformed")
            return
        page = reply.following


class Stopped(Exception):
    """A request that was not made, or not answered, for a named reason."""

    def __init__(self, gap: str):
        super().__init__(gap)
        self.gap = gap


def collected(collections: DataFrame, request: Callable[[str, int], Reply], key: Callable[[Mapping], str], max_pages: int, max_records: int) -> DataFrame:
    """(collection, kind, page, place, key, record, gap, requests, duplicates) of all collections, each read by one task from its first page on.

    ``collections``: collection. A row of kind ``record`` per record and one of kind ``end`` per collection. After a gap of ``STOP_GAPS`` the task
    asks for nothing more, and its later collections end with that gap.
    """
    schema = "collection string, kind string, page int, place int, key string, record string, gap string, requests int, duplicates int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped = None

        def asked(name: str, page: int) -> Reply:
            if stopped:
                raise Stopped(stopped)
            return request(name, page)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for e in paginate(asked, name, key, max_pages, max_records):
                    if "record" in e:
                        rows.append((name, "record", e["page"], e["place"], e["key"], json.dumps(e["record"], sort_keys=True), None, None, None))
                    else:
                        rows.append((name, "end", e["page"], None, None, None, e["gap"], e["requests"], e["duplicates"]))
                        stopped = stopped or (e["gap"] if e["gap"] in STOP_GAPS else None)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return collections.select("collection").mapInArrow(run, schema)


def write_by_path(rows: DataFrame, path: str, key: str, folders: int = 64) -> None:
    """Rows as line files in folders by a hash of their path, sorted by it: what a reader of wanted paths has to open."""
    placed = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(folders)).cast("int"))
    placed.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").json(path)


def read_wanted(spark: SparkSession, path: str, schema: str, key: str, wanted: DataFrame, folders: int = 64) -> DataFrame:
    """The rows of wanted paths. The folders that hold none are pruned before they are read, by a join on their number."""
    rows = spark.read.schema(f"{schema}, shard int").json(path)
    own = wanted.select(F.col(wanted.columns[0]).alias(key)).distinct().withColumn("shard", F.pmod(F.xxhash64(key), F.lit(folders)).cast("int"))
    return rows.join(own, ["shard", key], "left_semi").drop("shard")


def write_sorted(rows: DataFrame, path: str, order: list[str], per_file: int) -> DataFrame:
    """Rows as sorted line files of at most ``per_file`` rows, whose names sort as their rows do; (name, sha256, rows) of each.

    Spark's names sort by task and, up to a thousand files, within a task: each task gets the rows of so many files by their place among all.
    Places are taken by range, so nothing is gathered; a file is closed by the sink when it is full.
    """
    ranked = global_rank(rows, [F.col(c) for c in order], "sorted_place")
    total = ranked.agg(F.count("*").alias("n")).first()["n"]
    files = math.ceil(total / per_file)
    a_task = max(FILES_A_TASK, math.ceil(files / 100_000))
    if a_task > 1000:
        raise ValueError(f"{files} files are too many for names that sort; write more rows to a file")
    task = F.expr(f"CAST((sorted_place - 1) DIV {per_file * a_task} AS INT)")
    dealt = ranked.repartitionById(max(1, math.ceil(files / a_task)), task).sortWithinPartitions("sorted_place").drop("sorted_place")
    dealt.write.option("maxRecordsPerFile", per_file).json(path)
    return hashed(rows.sparkSession, path)
