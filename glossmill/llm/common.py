"""Helpers of the text operators: row keys, shared tables, fixed-size bit filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from glossmill.session import scratch_path

KEYS = ["row_k1", "row_k2"]
SLOTS_PER_ROW = 32768  # bits in one row of Spark's bitmap aggregate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder: later steps read them, and a lost executor repeats no more than its tasks."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key made of both.

    The key needs no numbering pass and is the same in every scan, so a retried task agrees with its peers. Rows
    that repeat a document in full share the key; all results are functions of the text, so they share those too.
    """
    return with_keys(docs.select("doc_id", "text"))


def with_keys(docs: DataFrame) -> DataFrame:
    """All columns and the key."""
    return docs.withColumns({KEYS[0]: F.xxhash64("doc_id", "text"), KEYS[1]: F.hash("text", "doc_id")})


def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of exactly 2**bits bits with the slots of all hashes set.

    Its size never depends on the data. It may answer yes for a hash that was not given, never no for one that was.
    """
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = (
        hashes.select((slot + 1).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("row"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row["row"] - 1) * SLOTS_PER_ROW // 8
        out[at : at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def in_filter(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.uint64) & np.uint64(filter_bits.size * 8 - 1)
    return (filter_bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def appended(df: DataFrame, results: dict[str, tuple[str, pa.DataType]], of_batches: Callable, drop: tuple = ()) -> DataFrame:
    """The rows of ``df`` with result columns from Python added.

    ``of_batches`` takes an iterator of Arrow batches and yields (batch, {result: values}) for batches with the same
    columns. All columns but those to ``drop`` pass through; one that has the name of a result is replaced by it.
    """
    kept = [c for c in df.columns if c not in results and c not in drop]
    schema = T.StructType(df.select(*kept).schema.fields + [
        T.StructField(name, T._parse_datatype_string(kind)) for name, (kind, _) in results.items()
    ])

    def run(rows):
        for batch, found in of_batches(rows):
            arrays = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept]
            arrays += [pa.array(found[name], kind) for name, (_, kind) in results.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*(c for c in batch.schema.names if c in kept), *results])

    return df.mapInArrow(run, schema)


def set_aside(docs: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """docs with columns of taken names renamed, and the selection that gives back the columns as they were."""
    other = {c: f"own column {c}" for c in docs.columns if c in set(taken)}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text; where there was none, there still is none. n_chars, if there, follows."""
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), text))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(rows: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts have about ``most_bytes`` bytes or are a single one."""
    for batch in rows:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column(batch, "text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end
