"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Entries become integers (``floor(SCALE * c) + OFFSET``), so that counts, sums and the scatter are exact whatever the
order in which tasks add them. The jobs:
  1. count and sum the integers of each dimension;
  2. add up the products of the integers, each centred at the rounded mean first; with the sums that gives n squared
     times the covariance as an integer matrix;
  3. its polynomial modulo many primes (Hessenberg form), a prime a row, and each coefficient from its remainders, a
     coefficient a group;
  4. the components, each in a task of its own: its root is isolated by exact counts of roots above a point, narrowed
     to ROOT_BITS bits, and its vector comes from inverse iteration at DIGITS digits;
  5. the covariance of the whitened vectors, then the vectors themselves.

What visits the driver is as large as the matrix, which depends on the dimension and not on the number of rows.

Left out: null and empty vectors, those with null or non-finite entries or entries too large for a 64-bit integer, and
those of another length than most vectors have (of equally common lengths, the longer). Repeated rows and ids count
and are returned each. Components with eigenvalue zero are not returned, since nothing can be divided by it; so one
vector alone, or copies of one, return no rows, as does an empty table. Equal eigenvalues have any orthonormal basis.
A deviation too large for 64 bits is null. Columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossmill.llm.common import column, table
from glossmill.llm.exact_spectrum import Roots, coefficient_bound, combined, null_vectors, polynomial_mod, primes_for

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**55  # of an entry, so that SCALE times it is a 64-bit integer with room to centre it
LIMB = 20  # bits of a factor in products that doubles hold exactly
ROWS = 4096  # rows multiplied at once: LIMB + LIMB + 12 bits are fewer than 53
SPLIT = 1 << 96  # large integers travel as two decimals


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: mean and components of the integer entries."""

    n: int
    centre: np.ndarray  # the rounded mean of each dimension, int64
    rest: list[int]  # n times what the mean has beside the centre, exact
    axes: np.ndarray  # one component a row
    deviations: np.ndarray  # standard deviation of each component
    explained: np.ndarray  # share of the total variance

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Component values of rows of integers less ``centre``."""
        mean = np.array([r / self.n for r in self.rest])
        return (centred - mean) @ self.axes.T / self.deviations

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - S for each row."""
        most = self.n * int(np.abs(centred).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * centred.shape[1] < 1 << 62:
            return (((centred * self.n) - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        wide = centred.astype(object) * self.n - np.array(self.rest, object)
        return [int(x) if x < 1 << 63 else None for x in (wide * wide).sum(axis=1)]


def usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def integers(batch: pa.RecordBatch, size: int | None = None):
    """The vectors of a batch as rows of integers; without a size, (size, rows) for each size there is."""
    vectors = column(batch, "vector")
    offsets, entries = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for found in np.unique(lengths) if size is None else [size]:
        at = offsets[:-1][lengths == found]
        rows = np.floor(SCALE * entries[at[:, None] + np.arange(found)].astype(np.float64)).astype(np.int64) + OFFSET
        yield int(found), rows


def two_parts(values: list[int]) -> list[pa.Array]:
    """High and low decimals of large integers."""
    pairs = [divmod(v, SPLIT) for v in values]
    return [pa.array([Decimal(p[i]) for p in pairs], pa.decimal128(38, 0)) for i in (0, 1)]


def whole(row) -> int:
    return int(row["high"]) * SPLIT + int(row["low"])


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def sums(vectors: DataFrame) -> tuple[int, np.ndarray, list[int]]:
    """Number of vectors of the most common length, rounded mean of each dimension, and n times the rest of the mean."""

    def run(rows):
        total: dict[int, list] = {}
        for batch in rows:
            for size, x in integers(batch):
                n, s = total.get(size, (0, np.zeros(size, object)))
                low, high = (x & ((1 << 32) - 1)).sum(axis=0), (x >> 32).sum(axis=0)
                total[size] = [n + len(x), s + high.astype(object) * (1 << 32) + low.astype(object)]
        for size, (n, s) in total.items():
            high, low = two_parts([n, *s.tolist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size + 1, size, np.int32)), pa.array(np.arange(-1, size, dtype=np.int32)), high, low],
                ["size", "place", "high", "low"])

    found = _summed(vectors.select("vector").mapInArrow(run, "size int, place int, high decimal(38,0), low decimal(38,0)"), "size", "place")
    counts = {r["size"]: whole(r) for r in found.filter("place = -1").collect()}
    if not counts:
        return 0, np.zeros(0, np.int64), []
    size = max(counts, key=lambda s: (counts[s], s))
    total = [whole(r) for r in found.filter((F.col("size") == size) & (F.col("place") >= 0)).orderBy("place").collect()]
    n = counts[size]
    centre = [(2 * s + n) // (2 * n) for s in total]
    return n, np.array(centre, np.int64), [s - n * c for s, c in zip(total, centre)]


def products(centred: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as Python integers: doubles multiply factors of LIMB bits."""
    d = centred.shape[1]
    out = np.zeros((d, d), object)
    most = int(np.abs(centred).max(initial=0))
    limbs = max(1, -(-most.bit_length() // LIMB))
    for at in range(0, len(centred), ROWS):
        rest, parts = centred[at : at + ROWS], []
        for k in range(limbs):
            last = k == limbs - 1
            parts.append((rest if last else rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def scatter(vectors: DataFrame, n: int, centre: np.ndarray, rest: list[int]) -> list[list[int]]:
    """n squared times the covariance of the integers."""
    size = len(centre)
    upper = np.triu_indices(size)

    def run(rows):
        total = np.zeros((size, size), object)
        for batch in rows:
            for _, x in integers(batch, size):
                total = total + products(x - centre)
        high, low = two_parts(total[upper].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), high, low], ["i", "j", "high", "low"])

    added = _summed(vectors.select("vector").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)"), "i", "j")
    out = [[0] * size for _ in range(size)]
    for r in added.collect():
        i, j = r["i"], r["j"]
        out[i][j] = out[j][i] = n * whole(r) - rest[i] * rest[j]
    return out


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, highest power first, of a positive semidefinite integer matrix."""
    primes = primes_for(coefficient_bound(len(matrix), sum(matrix[i][i] for i in range(len(matrix)))))

    def remainders(rows):
        wide = np.array(matrix, dtype=object)
        for batch in rows:
            for p in batch.column(0).to_pylist():
                found = polynomial_mod((wide % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(found), dtype=np.int32)), pa.array(np.full(len(found), p)), pa.array(found)], ["k", "prime", "remainder"])

    def coefficient(group):
        for k, rows in _by_k(group):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([str(combined(*rows))])], ["k", "coefficient"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(tasks, len(primes)), "prime")
    found = dealt.mapInArrow(remainders, "k int, prime long, remainder long").repartition("k").sortWithinPartitions("k")
    rows = found.mapInArrow(coefficient, "k int, coefficient string").collect()
    return [int(r["coefficient"]) for r in sorted(rows, key=lambda r: r["k"])]


def _by_k(batches):
    """(k, (primes, remainders)) of rows in which those of a k stand together; a k has one row for each prime."""
    last, primes, remainders = None, [], []
    for batch in batches:
        for k, p, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if k != last and primes:
                yield last, (primes, remainders)
                primes, remainders = [], []
            last = k
            primes.append(p)
            remainders.append(r)
    if primes:
        yield last, (primes, remainders)


def components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[float, np.ndarray]]:
    """Share of the trace and unit vector of the components with the largest eigenvalues, none of them zero."""
    polynomial = characteristic_polynomial(spark, matrix)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    count = min(most, Roots(polynomial).positive)
    if not count:
        return []

    def solve(rows):
        roots = Roots(polynomial)
        for batch in rows:
            for rank in batch.column(0).to_pylist():
                place, bits, multiplicity, among = roots.nth(rank)
                vector = null_vectors(matrix, place, bits, multiplicity)[among - 1]
                share = float(Fraction(place, trace << bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rank], pa.int32()), pa.array([share]), pa.array([vector.tolist()], pa.list_(pa.float64()))], ["rank", "share", "vector"])

    ranks = spark.createDataFrame([(r,) for r in range(1, count + 1)], "rank int").repartitionByRange(count, "rank")
    found = ranks.mapInArrow(solve, "rank int, share double, vector array<double>").collect()
    return [(r["share"], np.array(r["vector"])) for r in sorted(found, key=lambda r: r["rank"])]


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable vectors (a column ``vector``); None where there is no variance."""
    n, centre, rest = sums(vectors)
    if not n:
        return None
    matrix = scatter(vectors, n, centre, rest)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    found = components(vectors.sparkSession, matrix, most) if trace else []
    if not found:
        return None
    share = np.array([s for s, _ in found])
    return Whitening(n, centre, rest, np.array([v for _, v in found]), np.sqrt(share * (trace / n**2)), share)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    size, count = len(fitted.centre), len(fitted.axes)

    def run(rows):
        first, second = np.zeros(count), np.zeros((count, count))
        for batch in rows:
            for _, x in integers(batch, size):
                w = fitted.whitened(x - fitted.centre)
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = (a.ravel().astype(np.int32) for a in np.indices((count, count + 1)))
        both = np.column_stack((second, first))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel())], ["i", "j", "value"])

    added = vectors.select("vector").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    both = np.zeros((count, count + 1))
    for r in added.collect():
        both[r["i"], r["j"]] = r["value"] / fitted.n
    mean = both[:, count]  # zero but for rounding
    return float(np.abs(both[:, :count] - np.outer(mean, mean) - np.eye(count)).max())


RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, most: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: whitened value, exact deviation from the mean, and the fit's figures."""
    spark = df.sparkSession
    vectors = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    schema = RESULT.format(df.schema[vec_id].dataType.simpleString())
    fitted = fit(vectors, most)
    if fitted is None:
        return spark.createDataFrame([], schema)
    error, size, count = identity_error(vectors, fitted), len(fitted.centre), len(fitted.axes)

    def run(rows):
        for batch in rows:
            for at in range(0, batch.num_rows, ROWS):
                yield from one(batch.slice(at, ROWS))

    def one(batch):
        lengths = np.diff(column(batch, "vector").offsets.to_numpy())
        ids = column(batch, "vec_id").filter(pa.array(lengths == size))
        for _, x in integers(batch, size):
            centred = x - fitted.centre
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), fitted.n)), pa.array(fitted.deviation(centred), pa.int64()).take(each),
                pa.array(fitted.whitened(centred).ravel()), pa.array(np.tile(fitted.explained, len(x))), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
