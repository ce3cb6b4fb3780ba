"""Best-fit packing by hierarchical residual rounds.

Documents become pieces of at most ``capacity`` tokens. Each partition packs its pieces best-fit, longest first, and
emits the bins that are full or nearly so. The others go to the next round as items, in fewer partitions, until one
partition holds them all or bins of ``most_items`` a partition are left; a bin carries the list of its pieces, which
``capacity`` bounds. Pieces of full length are sequences by themselves.

Null text: empty, so its only token is the closing 0. Repeated rows are packed one by one. An empty table gives no
rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.llm.common import column, stored, table
from glossmill.llm.token_ids import byte_bpe_50k, ids_of

CAPACITY = 2048
CLOSING = 0
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
PIECE = "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint"
BIN = f"used long, pieces array<struct<{PIECE}>>"


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be shorter than the capacity."""
    data = ids.astype("<u4").tobytes()
    start, end = 0, ids.size if ids.size <= capacity else ids.size % capacity or capacity
    piece = 0
    while start < ids.size:
        yield piece, start, end - start, zlib.crc32(data[4 * start : 4 * end])
        piece, start, end = piece + 1, end, end + capacity


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece of each document; its ids are those of the text and a closing 0."""
    path, pattern = vocabulary or byte_bpe_50k()

    def run(rows):
        for batch in rows:
            out = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text")):
                ids = np.append(ids_of(text.as_py(), path, pattern), np.uint32(CLOSING))
                out += [(doc_id, *p) for p in pieces_of(ids, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, PIECES)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still takes it."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set while some bin has s left
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            at, space = len(bins), capacity
            bins.append([])
        bins[at].append(item)
        by_space[space - size].append(at)
        spaces |= 1 << (space - size)
    return bins


def _round(items: DataFrame, parts: int, capacity: int) -> DataFrame:
    """Bins of each of ``parts`` equal shares of the items."""

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        # The result must not hang on the order of arrival.
        rows.sort(key=lambda r: (-r["used"], *((x["doc_id"] is None, x["doc_id"] or 0, x["piece"]) for x in r["pieces"][:1])))
        bins = best_fit(np.array([r["used"] for r in rows], np.int64), capacity) if rows else []
        for at in range(0, len(bins), 10_000):
            some = bins[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([sum(rows[i]["used"] for i in b) for b in some], pa.int64()),
                pa.array([[x for i in b for x in rows[i]["pieces"]] for b in some], pa.list_(pa.struct(list(PIECES)))),
            ], ["used", "pieces"])

    return items.repartition(parts).mapInArrow(run, BIN)


def packed(rows: DataFrame, capacity: int = CAPACITY, nearly: float = 0.995, most_items: int = 20_000,
           fan_in: int = 8) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    rows = stored(rows, "pieces")
    single = rows.select(F.col("length").alias("used"), F.array(F.struct(*PIECES.names)).alias("pieces"))
    done, items = [single.filter(F.col("used") >= capacity)], single.filter(F.col("used") < capacity)
    count, parts, number = items.count(), None, 0
    while count:
        fewer = max(1, count // most_items + 1, -(-parts // fan_in) if parts else 1)
        if parts and fewer >= parts:
            done.append(items)
            break
        parts, number = fewer, number + 1
        bins = stored(_round(items, parts, capacity), f"bins{number}")
        full = F.col("used") >= int(nearly * capacity)
        done.append(bins.filter(full))
        items = bins.filter(~full)
        count = items.count()
    out = done[0]
    for bins in done[1:]:
        out = out.unionByName(bins)
    return _laid_out(out.withColumn("sequence_id", F.monotonically_increasing_id()))


def _laid_out(bins: DataFrame) -> DataFrame:
    """One row per piece, with the tokens of its sequence before it."""
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = 0
                for x in row["pieces"]:
                    out.append({**x, "sequence_id": row["sequence_id"], "offset": at})
                    at += x["length"]
            yield pa.RecordBatch.from_pylist(out, schema)

    return bins.select("sequence_id", "pieces").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents")))
