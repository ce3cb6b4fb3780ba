"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine verification and connected components.

A table hashes a vector to the signs of its products with ``bits`` random directions. Two vectors at an angle of
``a`` get the same sign of one with probability 1 - a / pi, so the number of tables follows from the bits and from the
share of links at the very threshold that may be missed (``miss``); closer pairs are missed less. ``bits`` follows from
the number of different vectors, so that a bucket of unrelated ones has about ``bucket`` members at every size.

Equal vectors are folded first and count by their number. Every bucket's pairs are then compared in double precision,
in blocks of numpy. A pair that meets in several tables is counted only in the first of them: the signs of all tables
travel with each vector, so no list of pairs is made to be deduplicated. What leaves a bucket is one count for each
vector and a forest of its links, never its pairs.

A bucket of more than ``crowd`` vectors is dealt into chunks, and each two chunks are compared in a task of their
own; the result is the same, and no task holds more than two chunks.

Null, empty or zero vectors and those with null or non-finite entries link with nothing, nor do vectors of different
lengths. Cosines that rounding could move across the threshold are computed again with more digits. Repeated rows and
repeated vec_ids each keep their row. A null vec_id names a component only if all of it is null. Long vectors only
make the blocks larger. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil, log, log2, acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossmill.llm.common import column, stored, table
from glossmill.llm.components import components

COSINE = 0.9
MISS = 0.001
BUCKET = 2048
CROWD = 4096
SEED = 13
BLOCK = 1024  # rows compared at once
NEAR = 1e-9  # cosines this close to the threshold are computed again
INDEX = "slot int, size int, sign long, lo int, hi int, node long, w long, chunk int, signs binary, vector binary"
INDEX_ARROW = pa.schema([
    ("slot", pa.int32()), ("size", pa.int32()), ("sign", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("node", pa.int64()),
    ("w", pa.int64()), ("chunk", pa.int32()), ("signs", pa.binary()), ("vector", pa.binary()),
])
KEY = ["slot", "size", "sign", "lo", "hi"]
FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def usable(vector: Column) -> Column:
    """True for vectors with entries that are all finite and not all zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def plan_tables(n: int, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a table and number of tables for n different vectors."""
    bits = min(62, max(1, round(log2(max(n, 1) / bucket))))
    same = (1 - acos(cosine) / pi) ** bits
    return bits, max(1, ceil(log(miss) / log(1 - same)))


def directions(size: int, count: int) -> np.ndarray:
    """Random directions, the same in every task."""
    return np.random.default_rng((SEED, size)).standard_normal((size, count))


def sign_type(bits: int) -> type:
    """The smallest type that holds the signs of one table, of which each row of the index carries one for every table."""
    return next((t for most, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if bits <= most), np.int64)


def signs_of(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """For each vector and table its bits as one number."""
    up = vectors @ directions(vectors.shape[1], tables * bits) > 0
    return up.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _by_length(batch: pa.RecordBatch):
    """(rows, matrix) for each length of vectors in the batch, in the type of their entries."""
    vectors = column(batch, "vector")
    offsets, entries = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, entries[offsets[rows][:, None] + np.arange(size)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors with length one, in double precision; scaled first, so that no square is too large or too small."""
    vectors = vectors.astype(np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def indexed(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """A row for each node (node, w, vector) and table: the table, the bucket and what a comparison needs."""

    kind = sign_type(bits)

    def entries(node, w, vectors, signs):
        each = np.tile(np.arange(len(node)), tables)
        none = np.zeros(len(each), np.int32)
        packed, values = (pa.array([x.tobytes() for x in m], pa.binary()).take(pa.array(each)) for m in (signs.astype(kind), vectors))
        return [signs.T.ravel(), none, none, node[each], w[each], none, packed, values]

    def run(rows):
        for batch in _small(rows):
            node, w = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("node", "w"))
            for at, vectors in _by_length(batch):
                signs = signs_of(unit(vectors), tables, bits)
                columns = [*_slots(len(at), tables, vectors.shape[1]), *entries(node[at], w[at], vectors, signs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX_ARROW)], schema=INDEX_ARROW)

    return nodes.select("node", "w", "vector").mapInArrow(run, INDEX)


def bucket_sizes(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """slot, size, sign and the number of members of every bucket."""

    def run(rows):
        for batch in _small(rows):
            for at, vectors in _by_length(batch):
                signs = signs_of(unit(vectors), tables, bits)
                columns = [*_slots(len(at), tables, vectors.shape[1]), signs.T.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "size", "sign"])

    signs = nodes.select("vector").mapInArrow(run, "slot int, size int, sign long")
    return signs.groupBy("slot", "size", "sign").agg(F.count(F.lit(1)).alias("members"))


def _small(rows):
    for batch in rows:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _slots(n: int, tables: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(tables, dtype=np.int32), n), np.full(n * tables, size, np.int32)


def chunked(index: DataFrame, sizes: DataFrame, crowd: int) -> DataFrame:
    """The index with the members of crowded buckets dealt into chunks, each row once for every chunk to meet."""
    crowded = stored(sizes.filter(F.col("members") > crowd).select(
        "slot", "size", "sign", F.ceil(2 * F.col("members") / crowd).cast("int").alias("chunks")), "vector-crowds")
    rows = index.join(crowded, ["slot", "size", "sign"], "left")
    own = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    met = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("chunk", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(met))
    return rows.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).select(*INDEX_ARROW.names)


def _wide_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, rounded to double precision only at the end."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


class Comparer:
    """Counts and links of one bucket, or of two chunks of one."""

    def __init__(self, slot: int, chunk: np.ndarray, node: np.ndarray, w: np.ndarray, signs: np.ndarray, vectors: np.ndarray,
                 across: bool, cosine: float):
        self.slot, self.chunk, self.node, self.w, self.signs, self.given = slot, chunk, node, w, signs, vectors
        self.vectors = unit(vectors)
        self.across, self.cosine = across, cosine
        self.links = np.zeros(node.size, np.int64)
        self.label = np.arange(node.size)

    def linked(self, i: slice, j: slice) -> np.ndarray:
        """Which rows of i and j are linked and meet in this table first."""
        cosines = self.vectors[i] @ self.vectors[j].T
        hit = cosines >= self.cosine
        edge = np.nonzero(np.abs(cosines - self.cosine) < NEAR)
        if edge[0].size:
            hit[edge] = _wide_cosine(self.given[i][edge[0]], self.given[j][edge[1]]) >= self.cosine
        if i.start == j.start:
            hit &= np.triu(np.ones(hit.shape, bool), 1)
        if self.across:
            hit &= self.chunk[i][:, None] != self.chunk[j]
        if not hit.any():
            return hit
        if np.count_nonzero(hit) * 8 < hit.size:
            a, b = np.nonzero(hit)
            met = (self.signs[i][a, : self.slot] == self.signs[j][b, : self.slot]).any(axis=1)
            hit[a[met], b[met]] = False
        else:
            for earlier in range(self.slot):
                hit &= self.signs[i][:, earlier, None] != self.signs[j][:, earlier]
        return hit

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """The labels of linked rows become their smallest."""
        while a.size:
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]

    def run(self) -> pa.RecordBatch | None:
        n = self.node.size
        for x in range(0, n, BLOCK):
            for y in range(x, n, BLOCK):
                i, j = slice(x, min(x + BLOCK, n)), slice(y, min(y + BLOCK, n))
                if self.across and (self.chunk[i] == self.chunk[i][0]).all() and (self.chunk[j] == self.chunk[i][0]).all():
                    continue
                hit = self.linked(i, j)
                if hit.any():
                    self.links[i] += hit @ self.w[j]
                    self.links[j] += self.w[i] @ hit
                    hit &= self.label[i][:, None] != self.label[j]
                    a, b = np.nonzero(hit)
                    self.join(a + x, b + y)
        some = np.flatnonzero(self.links)
        if not some.size:
            return None
        moved = np.flatnonzero(self.label != np.arange(n))
        a = np.concatenate((self.node[some], self.node[moved]))
        b = pa.array(np.concatenate((np.zeros(some.size, np.int64), self.node[self.label[moved]])), mask=np.arange(a.size) < some.size)
        n = pa.array(np.concatenate((self.links[some], np.zeros(moved.size, np.int64))), mask=np.arange(a.size) >= some.size)
        return pa.RecordBatch.from_arrays([pa.array(a), b, n], schema=FOUND_ARROW)


def compared(index: DataFrame, cosine: float, entry: str, kind: type) -> DataFrame:
    """Rows (a, n): links counted for node a in a bucket; rows (a, b): links that join up the bucket's members."""
    dealt = index.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def run(rows):
        held: list[pa.RecordBatch] = []  # of the bucket that may go on in the next batch
        last = None
        for batch in rows:
            if not batch.num_rows:
                continue
            keys = np.stack([column(batch, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in KEY])
            change = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(change[:-1], change[1:]):
                key = tuple(keys[:, begin].tolist())
                if key != last and held:
                    yield from bucket(last, held)
                    held = []
                last = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from bucket(last, held)

    def bucket(key, held):
        if sum(b.num_rows for b in held) < 2:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        plain = lambda c: rows[c].to_numpy()
        matrix = lambda c, of: np.frombuffer(b"".join(rows[c].to_pylist()), of).reshape(rows.num_rows, -1)
        found = Comparer(key[0], plain("chunk"), plain("node"), plain("w"), matrix("signs", kind), matrix("vector", entry),
                         key[3] != key[4], cosine).run()
        if found is not None:
            yield found

    return dealt.mapInArrow(run, "a long, b long, n long")


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET, crowd: int = CROWD,
                   vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row of vectors: vec_id, n_links, component_id and kept."""
    given = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    entries = F.col(embedding) if given else F.col(embedding).cast("array<double>")
    keys = [F.xxhash64(entries).alias("k1"), F.xxhash64(F.lit(SEED), entries).alias("k2")]
    rows = vectors.select(F.col(vec_id).alias("vec_id"), entries.alias("vector"), *keys).withColumn("ok", usable(F.col("vector")))
    folded = rows.filter("ok").groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first_id"), F.any_value("vector").alias("vector"))
    nodes = stored(folded.withColumn("node", F.monotonically_increasing_id()), "vectors")

    bits, tables = plan_tables(nodes.count(), cosine, miss, bucket)
    index = chunked(indexed(nodes, tables, bits), bucket_sizes(nodes, tables, bits), crowd)
    found = stored(compared(index, cosine, "f4" if given else "f8", sign_type(bits)), "vector-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"))

    named = nodes.drop("vector").join(roots, "node", "left").join(counts, "node", "left").select(
        "k1", "k2", "first_id", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    named = stored(named, "vector-roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = named.join(least, "root").select("k1", "k2", "n_links", "component_id", F.lit(True).alias("ok"))
    return rows.select("vec_id", "k1", "k2", "ok").join(known, ["k1", "k2", "ok"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_hyperplane_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))
