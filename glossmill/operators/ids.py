"""Dense ids, shards, resume and ordered subsets."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from glossmill.functions.text import bind
from glossmill.schemas import SAMPLE_KEY, SAMPLE_ORDER
from glossmill.session import written

#: Sampled keys for each range border, as Spark draws for a range shuffle.
PER_BORDER = 20
#: Rows that are sorted at once when a border is looked for.
FEW = 20_000
#: Types whose values a text holds exactly.
AS_TEXT = (T.IntegralType, T.FractionalType, T.BooleanType, T.StringType, T.DateType, T.TimestampType)


def borders(keys: DataFrame, order: list[str], ranges: int) -> list[Row]:
    """Keys that cut the rows into about equal ranges, from a sample of bounded size."""
    n = keys.count()
    share = min(1.0, 1.5 * PER_BORDER * ranges / max(n, 1))
    some = keys.select(*order).sample(share, 17) if share < 1 else keys.select(*order)
    drawn = some.orderBy(*order).collect()
    return [drawn[i] for i in sorted({len(drawn) * k // ranges for k in range(1, ranges)}) if drawn]


def _least(schema, order: list[str], cut: Row) -> Column:
    return F.struct(*[F.lit(cut[c]).cast(schema[c].dataType).alias(c) for c in order])


def _written_out(value) -> str | None:
    """A value as text that a cast reads back as the same value."""
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat()
    return None if value is None else str(value)


def _limits(schema, order: list[str], cuts: list[Row]) -> Column:
    """The cuts as one array of keys: a single literal text, which Spark reads when it plans, however many they are."""
    if not all(isinstance(schema[c].dataType, AS_TEXT) for c in order):
        return F.array(*[_least(schema, order, c) for c in cuts])
    names = [f"k{i}" for i in range(len(order))]
    texts = json.dumps([dict(zip(names, (_written_out(c[k]) for k in order))) for c in cuts])
    read = F.from_json(F.lit(texts), T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names])))
    return read.cast(T.ArrayType(T.StructType([T.StructField(c, schema[c].dataType) for c in order])))


def range_of(df: DataFrame, order: list[str], cuts: list[Row]) -> Column:
    """How many of the ascending cuts are not greater than a row's key.

    Looked up by halving, so that a row is compared with as many cuts as their number has binary digits, and its key is
    made once.
    """
    if not cuts:
        return F.lit(0)
    limits = _limits(df.schema, order, cuts)
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])

    def place(key: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(limits, at + s - 1) <= key, at + s).otherwise(at))

    return bind(F.struct(*order), place)


def _counts(keys: DataFrame, order: list[str], cuts: list[Row]) -> list[int]:
    """Exact number of rows in each range."""
    found = keys.select(range_of(keys, order, cuts).alias("_range")).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * (len(cuts) + 1)
    for row in found:
        counts[row["_range"]] = row["n"]
    return counts


def _numbered(rows: DataFrame, order: list[str], cuts: list[Row], starts: list[int], name: str) -> DataFrame:
    """rows with ``_range`` and their rank: the start of their range and their place in it; one shuffle, by range."""
    offsets = rows.sparkSession.createDataFrame(list(enumerate(starts)), "_range int, _start bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranged = rows.withColumn("_range", range_of(rows, order, cuts).cast("int")).withColumn("_place", place)
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_start", "_place")


def _ranges(df: DataFrame) -> int:
    """Ranges to cut into: several for each shuffle partition, which then holds about as many rows as the others."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_dense_id(df: DataFrame, order: list[str] | None = None, name: str = "id") -> DataFrame:
    """Add 0..n-1 in ``order``, which must not have ties.

    The rows are written once, since they are read more than once and must not be computed again.  Their keys alone are
    read to draw range borders and to count each range exactly; the rows then move once, to their range, and are
    numbered from its start.  An id depends on the keys only, not on the borders drawn, so no second copy is needed to
    fix it.  One number per range visits the driver; the table they come back as is that small too.
    """
    order = order or SAMPLE_ORDER
    rows = written(df, "rows")
    cuts = borders(rows, order, _ranges(df))
    starts = list(accumulate(_counts(rows, order, cuts), initial=0))[:-1]
    return _numbered(rows, order, cuts, starts, name).drop("_range")


def with_aligned_id(df: DataFrame, order: list[str], batch: int, name: str = "id") -> DataFrame:
    """As ``with_dense_id``, with ``_range``: rows of a range are in one partition, and no ``batch`` of ids is in two.

    The keys are ranked on their own first, and those at multiples of the batch become the borders.
    """
    rows = written(df, "rows")
    keys = rows.select(*order)
    cuts = borders(keys, order, _ranges(df))
    counts = _counts(keys, order, cuts)
    starts = list(accumulate(counts, initial=0))
    every = batch * max(1, -(-starts[-1] // (batch * _ranges(df))))
    ranked = _numbered(keys, order, cuts, starts[:-1], "_rank")
    exact = ranked.filter((F.col("_rank") % every == 0) & (F.col("_rank") > 0)).select(*order, "_rank").collect()
    exact.sort(key=lambda r: r["_rank"])
    return _numbered(rows, order, exact, [0, *(r["_rank"] for r in exact)], name)


def kth_key(keys: DataFrame, order: list[str], k: int) -> Row:
    """The key with exactly k smaller ones, of keys without ties; k is less than their number.

    Borders from a sample cut the keys into ranges, which are counted exactly; the search goes on in the range that
    holds the k-th, until it is few.  Nothing is shuffled but counts.
    """
    while True:
        cuts = borders(keys, order, 64)
        counts = _counts(keys, order, cuts)
        starts = list(accumulate(counts, initial=0))
        at = max(i for i in range(len(counts)) if starts[i] <= k and counts[i])
        keys, k, n = keys.filter(range_of(keys, order, cuts) == at), k - starts[at], counts[at]
        if n <= FEW:
            return keys.orderBy(*order).limit(k + 1).collect()[k]


def shard(df: DataFrame, n_shards: int, index: int, total: int, id_col: str = "id") -> DataFrame:
    """The rows of one of ``n_shards`` contiguous shards of ``total`` dense ids."""
    return df.filter(shard_of(n_shards, total, id_col) == index)


def shard_of(n_shards: int, total: int, id_col: str = "id"):
    return F.expr(f"({id_col} * {int(n_shards)}L) div {max(int(total), 1)}L")


def pending(samples: DataFrame, done: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Samples without a stored prediction."""
    key = key or SAMPLE_KEY
    return samples.join(done.select(*key), key, "left_anti")


def subset_size(n: int, size: int | float | None) -> int:
    """How many of ``n`` rows to keep: a fraction for a float, a count for an int, all for None or one."""
    if n == 0 or size is None or size == 1:
        return n
    wanted = int(n * size) if isinstance(size, float) else size
    return max(1, min(wanted, n))


def head_subset(df: DataFrame, size: int | float | None, order: list[str] | None = None) -> DataFrame:
    """The first rows in ``order``, which must not have ties.

    The key of the last row that belongs is found by selection; the rows are then filtered where they are.  ``df`` is
    read several times, its keys only, so it should be a stored table.
    """
    order = order or SAMPLE_ORDER
    n = df.count()
    k = subset_size(n, size)
    if k == n:
        return df
    last = kth_key(df.select(*order), order, k - 1)
    lead = order[0]
    first_of = F.lit(last[lead]).cast(df.schema[lead].dataType)
    return df.filter((F.col(lead) <= first_of) & (F.struct(*order) <= _least(df.schema, order, last)))


def step_budget(df: DataFrame, batch: int, accum: int, epochs: int, ratio: float) -> DataFrame:
    """Optimiser steps for the rows and the warm-up share of them."""
    counted = df.agg(F.count(F.lit(1)).alias("n_samples"))
    total = F.ceil(F.col("n_samples") / F.lit(batch * accum)) * epochs
    return counted.select(
        "n_samples", total.cast("bigint").alias("total_steps"),
        F.greatest(F.lit(1), (total * F.lit(float(ratio))).cast("bigint")).cast("bigint").alias("warmup_steps"),
    )
