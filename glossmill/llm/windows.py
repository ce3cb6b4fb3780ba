"""Windows of a text that share a minimiser, and the Spark jobs that bring equal windows together.

A window is ``window`` consecutive units (words or bytes). Of the grams of ``gram`` units inside a window, the one
with the smallest hash is its minimiser. Equal windows have equal minimisers, so it is enough to compare windows
with the same one. Consecutive windows with the same minimiser travel as one string ("run").

The jobs, with N the size of the corpus:
  1. count minimisers (one small row each, summed before the shuffle); the repeated ones fill a filter of fixed size;
  2. write the runs whose minimiser may repeat (a window that repeats has a minimiser that repeats, so none is lost);
  3. cut the runs of crowded minimisers again, by longer grams, until no minimiser has more than ``crowd`` different
     runs; at the longest gram, the window itself, there is only one left;
  4. fold equal runs, sort each bucket's windows exactly, and send the repeated stretches back to their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossmill.llm.common import KEYS, bit_filter, in_filter, stored, with_keys

FACTOR = np.uint64(0x9E3779B97F4A7C15)
PLACE = (1 << 20) - 1  # low bits of a gram's hash that give way to its place
BLOCK = 1 << 19  # windows handled at once in a long text
RUN_TYPE = "row_k1 long, row_k2 int, first int, n int, minimiser long, run binary"
RUN_ARROW = pa.schema([
    ("row_k1", pa.int64()), ("row_k2", pa.int32()), ("first", pa.int32()), ("n", pa.int32()),
    ("minimiser", pa.int64()), ("run", pa.binary()),
])
FOUND_TYPE = "minimiser long, digest long, stretches array<struct<a:int,b:int>>"
FOUND_ARROW = pa.schema([
    ("minimiser", pa.int64()), ("digest", pa.int64()),
    ("stretches", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
])


@dataclass(frozen=True)
class Units:
    """How a text becomes units, and how a stretch of units is packed and compared."""

    hashes: Callable[[bytes], tuple[np.ndarray, object]]  # whole text: a 64-bit hash for each unit, and its handle
    pack: Callable[[object, int, int], bytes]  # handle, first unit, end: the packed stretch
    repack: Callable[[bytes], tuple[np.ndarray, object]]  # the same as ``hashes`` for a packed stretch
    repeated: Callable[[list[bytes], int], list[np.ndarray]]  # packed stretches, window: mask of repeated windows each


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(unit_hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each gram, from the hashes of its two halves."""
    out, size, power = unit_hashes, 1, FACTOR
    with np.errstate(over="ignore"):
        for bit in bin(gram)[3:]:
            out = out[: out.size - size] * power + out[size:]
            size, power = size * 2, power * power
            if bit == "1":
                out = out[:-1] * FACTOR + unit_hashes[size:]
                size, power = size + 1, power * FACTOR
        return mixed(out + np.uint64(gram))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` consecutive ones."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: values.size - size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: values.size - (width - size)], values[width - size :])


def runs_of(unit_hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and minimiser of each run of windows with the same minimiser at the same place.

    The place, in the low bits, settles ties to the left. Two windows of one run then differ in the offset of their
    minimiser, so no window repeats inside its own run.
    """
    parts = []
    with np.errstate(over="ignore"):
        for at in range(0, unit_hashes.size - window + 1, BLOCK):
            grams = gram_hashes(unit_hashes[at : at + BLOCK + window - 1], gram)
            placed = (grams & ~np.uint64(PLACE)) | np.arange(grams.size, dtype=np.uint64)
            least = sliding_min(placed, window - gram + 1)
            first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
            parts.append((first + at, np.append(first[1:], least.size) + at, (least[first] >> np.uint64(20)).view(np.int64)))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts))


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Key and UTF-8 text of each row; null counts as empty."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    k1 = batch.column(batch.schema.get_field_index(KEYS[0])).to_pylist()
    k2 = batch.column(batch.schema.get_field_index(KEYS[1])).to_pylist()
    for a, b, text in zip(k1, k2, texts):
        yield a, b, text.as_py() or b""


def repeated_stretches(docs: DataFrame, units: Units, window: int, gram: int, filter_bits: int, crowd: int,
                       shard_bytes: int) -> DataFrame:
    """For each document key with a repeated window: stretches [a, b) of units that repeated windows cover."""
    spark = docs.sparkSession

    def count(rows):
        for batch in rows:
            seen = [runs_of(units.hashes(t)[0], window, gram)[2] for _, _, t in texts_of(batch) if len(t) >= window]
            h, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["minimiser", "n"])

    counts = docs.mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(bit_filter(counts.filter("n > 1"), "minimiser", filter_bits))

    def emit(rows):
        wanted = shared.value
        for batch in rows:
            out: list[tuple] = []
            size = 0
            for a, b, text in texts_of(batch):
                if len(text) < window:
                    continue
                hashes, handle = units.hashes(text)
                first, end, least = runs_of(hashes, window, gram)
                for i in np.flatnonzero(in_filter(wanted, least)).tolist():
                    f, e = int(first[i]), int(end[i])
                    out.append((a, b, f, e - f, int(least[i]), units.pack(handle, f, e + window - 1)))
                    size += len(out[-1][-1])
                if size > 8 << 20:
                    yield as_batch(out)
                    out, size = [], 0
            yield as_batch(out)

    runs = stored(docs.mapInArrow(emit, RUN_TYPE), "runs").withColumn("digest", F.xxhash64("run"))
    while gram < window:
        # Rows that only the filter let through stop here, as do runs that are alone under their minimiser.
        kinds = runs.groupBy("minimiser", "digest").agg(F.count("*").alias("copies"))
        kinds = kinds.groupBy("minimiser").agg(F.sum("copies").alias("copies"), F.count("*").alias("kinds"))
        crowded = stored(kinds.filter(F.col("kinds") > crowd).select("minimiser"), "crowded")
        if crowded.isEmpty():
            break
        gram = window if window - gram < 4 else (gram + window + 1) // 2
        runs = _cut_again(runs, crowded, units, window, gram)
    return _sorted_buckets(runs, units, window, shard_bytes)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in RUN_ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN_ARROW)], schema=RUN_ARROW)


def _cut_again(runs: DataFrame, crowded: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """The same windows; those under a crowded minimiser in new, shorter runs, by longer grams."""

    def cut(rows):
        for batch in rows:
            out = []
            for r in batch.to_pylist():
                hashes, handle = units.repack(r["run"])
                for f, e, h in zip(*(x.tolist() for x in runs_of(hashes, window, gram))):
                    out.append((r["row_k1"], r["row_k2"], r["first"] + f, e - f, h, units.pack(handle, f, e + window - 1)))
            yield as_batch(out)

    columns = [f.name for f in RUN_ARROW]
    calm = runs.join(crowded, "minimiser", "left_anti").select(*columns)
    hot = runs.join(crowded, "minimiser", "left_semi").select(*columns).mapInArrow(cut, RUN_TYPE)
    return stored(calm.unionByName(hot), "runs").withColumn("digest", F.xxhash64("run"))


def _sorted_buckets(runs: DataFrame, units: Units, window: int, shard_bytes: int) -> DataFrame:
    folded = runs.groupBy("minimiser", "run").agg(F.count("*").alias("copies"))
    buckets = folded.repartition("minimiser").sortWithinPartitions("minimiser")

    def find(rows):
        """Whole buckets are gathered up to ``shard_bytes`` and sorted together."""
        held: list[tuple[int, bytes, int]] = []
        size = 0
        for batch in rows:
            for key, run, copies in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= shard_bytes and held[-1][0] != key:
                    yield shard(held)
                    held, size = [], 0
                held.append((key, run, copies))
                size += len(run)
        if held:
            yield shard(held)

    def shard(held):
        keys = [h[0] for h in held]
        alone = [
            (i == 0 or keys[i - 1] != k) and (i + 1 == len(keys) or keys[i + 1] != k) for i, k in enumerate(keys)
        ]
        masks: list = [None] * len(held)
        compare = [i for i, a in enumerate(alone) if not a]
        for i, mask in zip(compare, units.repeated([held[i][1] for i in compare], window) if compare else []):
            masks[i] = mask
        out = []
        for (key, run, copies), mask in zip(held, masks):
            if copies > 1:
                out.append((key, run, [(0, -1)]))  # as long as the run
            elif mask is not None and mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                out.append((key, run, list(zip(edge[::2].tolist(), edge[1::2].tolist()))))
        return pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
            pa.array([[{"a": a, "b": b} for a, b in x[2]] for x in out], FOUND_ARROW.field("stretches").type),
        ], ["minimiser", "run", "stretches"])

    found = buckets.mapInArrow(find, "minimiser long, run binary, stretches array<struct<a:int,b:int>>")
    found = stored(found.select("minimiser", F.xxhash64("run").alias("digest"), "stretches"), "found")
    hits = runs.select(*KEYS, "first", "n", "minimiser", "digest").join(found, ["minimiser", "digest"])
    stretch = F.inline(F.transform("stretches", lambda s: F.struct(
        (F.col("first") + s.a).alias("a"),
        (F.col("first") + F.when(s.b < 0, F.col("n")).otherwise(s.b) + (window - 1)).alias("b"),
    )))
    # A set: rows that repeat a document in full share the key, and each brings the same stretches.
    return hits.select(*KEYS, stretch).groupBy(*KEYS).agg(F.collect_set(F.struct("a", "b")).alias("stretches"))


def with_stretches(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """docs, of any columns, with the stretches (null: none) of each row.

    The stretches are the hashed side, a small share of a partition; the texts are not sorted.
    """
    return with_keys(docs.drop("stretches")).join(stretches.hint("shuffle_hash"), KEYS, "left").drop(*KEYS)


def merged(stretches: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal stretches of the union, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in stretches or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out

