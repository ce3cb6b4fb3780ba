"""SimHash near-dedup by deletion-variant signatures.

For distance ``d`` the 64 bits are cut into ceil((d + 1) / 2) segments, so that of two linked fingerprints one
segment differs by at most one bit. Each segment is indexed once for each of its bits with that bit left out; linked
fingerprints then share an index entry, whose members are compared in full.

Only different fingerprints are indexed; copies hang on theirs. The members of an entry are linked as a forest, not
pair by pair. An entry with more than ``crowd`` members is indexed again by variants of the bits outside its segment,
where the rest of the distance has to fit. At distance 3 members of such a second entry agree in 46 bits: all but one of
the segment, and all but one of half of the other segment. So there are 2**18 of them at most, however large the corpus;
they are compared step by step in one task, in memory of a few numbers each.

A very long text is hashed whole in its row. Null or empty text: fingerprint zero, linked like any other. Fewer words than a shingle: the words are the shingle.
Repeated rows: each gets its row, with the same component. A null doc_id never names a component unless all of it is
null. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossmill.llm.common import KEYS, appended, column, keyed, stored, table, with_keys
from glossmill.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all shingles, as a signed 64-bit number."""
    words = text.translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    begins = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())], np.uint64)
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > hashes.size).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with their fingerprint as a long, ``fp``."""

    def run(rows):
        for batch in rows:
            texts = column(batch, "text").cast(pa.binary())
            yield batch, {"fp": [fingerprint(t.as_py() or b"", shingle) for t in texts]}

    return appended(docs, {"fp": ("long", pa.int64())}, run)


def segments(distance: int, bits: list[int]) -> list[list[int]]:
    """The bit places cut so that of ``distance`` differing bits one part has at most one."""
    return [part.tolist() for part in np.array_split(np.array(bits), (distance + 2) // 2)]


def variants(value: Column, parts: list[list[int]]) -> Column:
    """Array of (part and left-out bit, the other bits of the part)."""
    return F.array(*[
        F.struct(F.lit(i * 64 + out).alias("variant"), value.bitwiseAND(_mask(b for b in part if b != out)).alias("rest"))
        for i, part in enumerate(parts) for out in part
    ])


def _mask(bits) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(entry: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of the same entry (rows of an entry stand together): each to the first it reaches."""
    label = np.arange(fp.size)
    left, right = [], []
    live, step = np.arange(fp.size - 1), 1
    while live.size:
        live = live[live + step < fp.size]
        live = live[entry[live] == entry[live + step]]
        near = live[np.bitwise_count(fp[live] ^ fp[live + step]) <= distance]
        left.append(near)
        right.append(near + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    while a.size:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(fp.size))
    return fp[moved], fp[label[moved]]


LINKED = "a long, b long, variant int, rest long, sub int, sub_rest long"
LINKED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("variant", pa.int32()), ("rest", pa.int64()),
                          ("sub", pa.int32()), ("sub_rest", pa.int64())])


def _link(index: DataFrame, keys: list[str], distance: int, crowd: int | None) -> DataFrame:
    """Links of the entries, and the members (a, entry) of those too crowded to compare here."""
    dealt = index.repartition(*keys).sortWithinPartitions(*keys)

    def run(rows):
        held = np.zeros((len(keys) + 1, 0), np.int64)  # of the entry that may go on in the next batch
        too_many = np.zeros((len(keys), 0), np.int64)  # key of a crowded entry, whose members stream on unheld
        for batch in rows:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(keys) + 1)])
            part = np.concatenate((held, part), axis=1)
            change = np.flatnonzero((part[1:, 1:] != part[1:, :-1]).any(axis=0)) + 1
            last = int(change[-1]) if change.size else 0
            yield from compare(part[:, :last], too_many)
            held = part[:, last:]
            if held.shape[1] and crowd is not None and (held.shape[1] > crowd or (too_many == held[1:, :1]).all(axis=0).any()):
                too_many = held[1:, :1]
                yield crowded(held)
                held = held[:, :0]
        yield from compare(held, too_many)

    def crowded(part):
        empty = np.zeros(part.shape[1], np.int64)
        columns = [part[0], empty, part[1], part[2], empty, empty]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, LINKED_ARROW)], schema=LINKED_ARROW)

    def compare(part, too_many):
        if not part.shape[1]:
            return
        begin = np.concatenate(([True], (part[1:, 1:] != part[1:, :-1]).any(axis=0)))
        entry = np.cumsum(begin) - 1
        size = np.bincount(entry)
        big = size > crowd if crowd is not None else np.zeros(size.size, bool)
        if too_many.shape[1]:
            big[0] |= bool((part[1:, :1] == too_many).all())
        if big.any():
            yield crowded(part[:, big[entry]])
        some = (size > 1)[entry] & ~big[entry]
        a, b = _forest(entry[some], part[0][some].view(np.uint64), distance)
        if a.size:
            none = pa.nulls(a.size, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, pa.nulls(a.size, pa.int64()), none,
                 pa.nulls(a.size, pa.int64())], schema=LINKED_ARROW)

    return dealt.mapInArrow(run, LINKED)


def near_links(fps: DataFrame, distance: int = DISTANCE, crowd: int = 2048) -> DataFrame:
    """(a, b) that join up all distinct fingerprints at most ``distance`` bits apart."""
    parts = segments(distance, list(range(64)))
    index = fps.select("fp", F.inline(variants(F.col("fp"), parts)))
    found = stored(_link(index, ["variant", "rest"], distance, crowd), "linked")
    again = found.filter("variant is not null").select(F.col("a").alias("fp"), "variant", "rest")
    links = found.filter("variant is null").select("a", "b")
    for i, part in enumerate(parts):
        outside = segments(distance, [b for b in range(64) if b not in part])
        own = again.filter(F.col("variant").between(i * 64, i * 64 + 63))
        sub = own.select("fp", "variant", "rest", F.inline(variants(F.col("fp"), outside))).toDF("fp", "variant", "rest", "sub", "sub_rest")
        links = links.union(_link(sub, ["variant", "rest", "sub", "sub_rest"], distance, None).select("a", "b"))
    return links


def rooted(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = 2048) -> DataFrame:
    """doc_id, row keys, fp, component_id and root of each document; only the root, a fingerprint, tells components apart."""
    rows = stored(fingerprints(keyed(docs), shingle).drop("text"), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(fps.select("fp"), distance, crowd))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = 2048) -> DataFrame:
    """doc_id, row keys, fingerprint (16 hex digits) and component_id of each document."""
    return rooted(docs, shingle, distance, crowd).select(
        "doc_id", *KEYS, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = 2048) -> DataFrame:
    """The documents, only one left of each component: that of the smallest doc_id, ties broken by the text's hash.

    All columns are kept. Of rows that repeat a document in full, one stays. Components are told apart by their root:
    doc_ids may be null or repeated in several.
    """
    groups = rooted(docs, shingle, distance, crowd)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *KEYS)).alias("w"))
    kept = with_keys(docs).join(best.select(*(F.col(f"w.{k}") for k in KEYS)), KEYS, "left_semi")
    nth = F.expr(f"row_number() over (partition by {', '.join(KEYS)} order by {KEYS[0]})")
    return kept.withColumn("row_nth", nth).filter("row_nth = 1").select(*docs.columns)


def op5_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop(*KEYS)
