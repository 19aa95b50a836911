"""Texts packed into blocks on shared storage, for operators that answer questions about strings from all texts.

Such an operator asks once per piece of a block and distinct key, not once per occurrence, and gets answers in the order in which
it asked, so answers carry no keys. Blocks are rows of a table bucketed by block number: joining answers to blocks moves the
answers and leaves the texts where they are.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veridact.llm.common import blocks_for, total_bytes

BLOCK_BYTES, PIECE_BYTES = 16 << 20, 2 << 20
#: Pieces per block, at most; a piece's place is the block's number times this plus its own.
PIECES = 64


def pack(rows: DataFrame, text_col: str, piece_bytes: int = PIECE_BYTES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, int]:
    """A table (block, blob) of the rows, its name, and the bytes of all texts.

    A blob holds about ``block_bytes`` of text as a compressed Arrow stream of the rows' columns, in pieces of about
    ``piece_bytes``, each a record batch; one longer text is a piece of its own. Operators work piece by piece, which bounds
    their memory, while blocks keep the number of files low. No shuffle. Block numbers come from the content
    and where it was read, so equal contents differ, and are fixed once written.
    """
    total = total_bytes(rows, text_col)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        context, count = TaskContext.get(), itertools.count()

        def close(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pieces[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for p in pieces:
                    writer.write_batch(p)
            blob, seed = sink.getvalue().to_pybytes(), context.partitionId() * 1_000_003 + next(count)
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(blob, seed) >> 8], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])

        def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        pieces, held, size, done = [], [], 0, 0
        for batch in batches:
            start, lengths = 0, np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy() + 64)
            while start < batch.num_rows:
                before = lengths[start - 1] if start else 0
                stop = min(batch.num_rows, int(np.searchsorted(lengths, before + piece_bytes - size, "left")) + 1)
                held.append(batch.slice(start, stop - start))
                size += int(lengths[stop - 1] - before)
                start = stop
                if size >= piece_bytes:
                    pieces.append(whole(held))
                    done, held, size = done + size, [], 0
                if done >= block_bytes or len(pieces) == PIECES:
                    yield close(pieces)
                    pieces, done = [], 0
        if held:
            pieces.append(whole(held))
        if pieces:
            yield close(pieces)

    name = f"veridact_blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(run, "block long, blob binary")
    packed.write.bucketBy(max(12, blocks_for(total, block_bytes)), "block").format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name), name, total


def unpack(block: int, blob: bytes) -> Iterator[tuple[int, pa.Table]]:
    """The pieces of a blob with their places."""
    with pa.ipc.open_stream(blob) as reader:
        for k, batch in enumerate(reader):
            yield block * PIECES + k, pa.Table.from_batches([batch])


def drop(spark, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def cuts(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted 64-bit keys: the buckets that have some, and the bounds of each one's stretch."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, int)
    return bucket[edges].astype(np.int32), np.append(edges, len(keys))


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes: of small numbers, most planes are zero and shrink to nothing."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def join_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """For each piece: ``run(place, rows, answers)``, where ``answers`` has a column ``place``; pieces without any get none."""
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [empty]
        places = right["place"].to_numpy()
        for block, blob in zip(left["block"].to_pylist(), left["blob"].to_pylist()):
            for place, rows in unpack(block, blob):
                out.append(run(place, rows, right.filter(pa.array(places == place))).cast(empty.schema))
        return pa.concat_tables(out)

    given = answers.withColumn("block", F.shiftright("place", PIECES.bit_length() - 1))
    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(call, schema)


def ask(blocks: DataFrame, run: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """For each piece: whatever record batches ``run(place, rows)`` yields. No shuffle."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0), batch.column(1)):
                for place, rows in unpack(block.as_py(), blob.as_py()):
                    yield from run(place, rows)

    return blocks.select("block", "blob").mapInArrow(call, schema)
