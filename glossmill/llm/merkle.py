"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

A row's leaf is the digest of its fields. The leaves of a group (a language) ascend by their order column and are
hashed in runs of ``fanout`` until one digest is left, the group's subroot; the subroots, ordered by group, are hashed
the same way into the root.

Each level is one table of runs, an eighth of the one below. For the proofs, every inner node holds the siblings on
its way to an ancestor, its parent at first. A round joins the table with itself: the ancestor's ancestor becomes the
node's, and the two segments become one, so the distance doubles until all have reached the root. Only a node that is
an ancestor at this distance is on the joined side, which shrinks with every round. The leaves of a run travel as one
row, since above their parent their proofs are the same.

Ranks come from a range shuffle of keys and digests, so a group of any size is spread; no text is shuffled at all.

Null field: ``-``. Null group: one group, the first. Null order values come first. Ties of the order column are
ordered by leaf, and rows that repeat each other in full have equal leaves and different places. A group of one has
its leaf as subroot. Very long texts are hashed in the row. Empty table: no rows. Columns that are not fields are
ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossmill.llm.common import stored, table
from glossmill.operators.ids import with_dense_id

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TOP = "/"  # the tree above the groups; theirs start with "=", that of the null group is ""
NODE, ANCESTOR = ["tree", "level", "pos"], ["up_tree", "up_level", "up_pos"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return hashed(F.concat(*[field(f) for f in fields]))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hexed), "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with ``pos``, their place 0, 1, ... in their tree."""
    # Rows that tie in everything are told apart by their place in the scan, so that no range is all ties.
    numbered = with_dense_id(rows.withColumn("tie", F.monotonically_increasing_id()), ["tree", *order, "tie"], "place").drop("tie")
    numbered = stored(numbered, "merkle-places")
    first = stored(numbered.groupBy("tree").agg(F.min("place").alias("first")), "merkle-trees")
    return numbered.join(first, "tree").withColumn("pos", F.col("place") - F.col("first")).drop("place", "first")


def levels(nodes: DataFrame, fanout: int, *payload: str) -> list[DataFrame]:
    """For each level the runs (tree, pos, members, digest, alone) of nodes (tree, pos, digest, payload...).

    ``pos`` is the place of the run, its node's on the next level. A run that is ``alone`` is its tree's only node
    and is not hashed again.
    """
    tables: list[DataFrame] = []
    most = (nodes.agg(F.max("pos")).first()[0] or 0) + 1
    while True:
        member = F.struct("pos", "digest", *(payload if not tables else ()))
        grouped = nodes.groupBy("tree", F.expr(f"pos div {fanout}").alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        alone = (F.col("run") == 0) & (F.size("members") == 1)
        whole = F.unhex(hashed(joined_hex(F.col("members.digest"))))
        digest = F.when(alone, F.element_at("members", 1)["digest"]).otherwise(whole)
        runs = stored(grouped.select("tree", F.col("run").alias("pos"), "members", digest.alias("digest"), alone.alias("alone")),
                      f"merkle-level{len(tables)}")
        tables.append(runs)
        if most == 1:
            return tables
        nodes, most = runs.filter(~F.col("alone")).select("tree", "pos", "digest"), ceil(most / fanout)


def step(members: Column, i: Column) -> Column:
    """The siblings of member ``i`` of its run, those before and those behind it, as concatenated digests."""
    digests = F.transform(members, lambda m: m["digest"])
    return F.struct(
        F.unhex(joined_hex(F.slice(digests, F.lit(1), i))).alias("before"),
        F.unhex(joined_hex(F.slice(digests, i + 2, F.size(digests)))).alias("behind"),
    )


def links(runs: DataFrame, level: int) -> DataFrame:
    """Each member of the hashed runs of a level, with its parent and the segment up to it."""
    rows = runs.filter(~F.col("alone")).select("tree", F.col("pos").alias("up_pos"), "members", F.posexplode("members").alias("i", "m"))
    return rows.select(
        "tree", F.lit(level).alias("level"), F.col("m.pos").alias("pos"),
        F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), "up_pos",
        F.array(step(F.col("members"), F.col("i"))).alias("segment"), F.lit(None).cast("binary").alias("subroot"),
    )


def _no_step(segment: Column) -> Column:
    return F.slice(segment, F.lit(1), F.lit(0))


def jumped(paths: DataFrame, rounds: int) -> DataFrame:
    """paths with the ancestor of every node at the root, by doubling."""
    for n in range(rounds):
        distance = 1 << n
        reached = (F.col("tree") == TOP) | (F.col("level") > distance)
        hop = stored(paths.filter(reached), "merkle-hops").select(
            *(F.col(a).alias(b) for a, b in zip(NODE, ANCESTOR)), *(F.col(a).alias(f"next_{a}") for a in ANCESTOR),
            F.col("segment").alias("more"), F.col("subroot").alias("next_subroot"),
        )
        paths = stored(paths.join(hop, ANCESTOR, "left").select(
            *NODE, *(F.col(f"next_{a}").alias(a) for a in ANCESTOR),
            F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more")).alias("segment"),
            F.coalesce("subroot", "next_subroot").alias("subroot"),
        ), "merkle-paths")
    return paths


def proofs(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """leaves (tree, digest, ... order columns and others) with subroot, root and ``proof``, the steps to the root.

    A step is (before, behind): the concatenated digests of the siblings on either side. ``tree`` is "=" and the
    group's name, or "" for the null group.
    """
    payload = [c for c in leaves.columns if c not in ("tree", "digest")]
    own = levels(ranked(leaves, order), fanout, *payload)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    subroots = stored(union([
        runs.filter("alone").select("tree", F.lit(level).alias("level"), "digest") for level, runs in enumerate(own)
    ]), "merkle-subroots")
    places = ranked(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "level", "digest"), ["group"])
    places = stored(places, "merkle-top")
    top = levels(places.select("tree", "pos", "digest"), fanout)
    root = top[-1].select("digest").first()
    root = root["digest"] if root else None

    crossing = places.select(
        F.col("group").alias("tree"), "level", F.lit(0).cast("long").alias("pos"), F.lit(TOP).alias("up_tree"), F.lit(0).alias("up_level"),
        F.col("pos").alias("up_pos"), F.col("digest").alias("subroot"),
    )
    apex = top[-1].select(
        "tree", F.lit(len(top) - 1).alias("level"), "pos", *(F.lit(None).cast(t).alias(c) for c, t in zip(ANCESTOR, ("string", "int", "long"))),
        F.lit(None).cast("binary").alias("subroot"),
    )
    inner = [links(runs, n + 1) for n, runs in enumerate(own[1:])] + [links(runs, n) for n, runs in enumerate(top)]
    nothing = _no_step(F.array(F.struct(F.lit(b"").alias("before"), F.lit(b"").alias("behind"))))
    ends = [x.withColumn("segment", nothing) for x in (crossing, apex)]
    depth = len(own) + len(top)
    paths = jumped(stored(union([*inner, *ends]), "merkle-paths"), ceil(log2(depth + 1)))

    # A run of leaves starts at its parent; a leaf that is its tree's only node starts at itself.
    runs = own[0].select(
        "tree", F.when(F.col("alone"), 0).otherwise(1).alias("level"), "pos", "alone", "members",
    )
    rows = runs.join(paths.select(*NODE, "segment", "subroot"), NODE).select(
        "tree", "alone", "members", "segment", "subroot", F.posexplode("members").alias("i", "m"))
    own_step = F.array(step(F.col("members"), F.col("i")))
    return rows.select(
        "tree", "m.digest", *(F.col(f"m.{c}").alias(c) for c in payload),
        F.when(F.col("alone"), F.col("segment")).otherwise(F.concat(own_step, F.col("segment"))).alias("proof"),
        "subroot", F.lit(root).cast("binary").alias("root"),
    )


def folded(start: Column, proof: Column) -> Column:
    """The root, as hex text, that a leaf's hex digest leads to over the steps of its proof."""
    return F.aggregate(proof, start, lambda d, s: hashed(F.concat(hexed(s["before"]), d, hexed(s["behind"]))))


def proof_digest(proof: Column) -> Column:
    return hashed(F.array_join(F.transform(proof, lambda s: F.concat(hexed(s["before"]), hexed(s["behind"]))), ""))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT,
             altered: Column | None = None) -> DataFrame:
    """For each row of docs: order column, leaf, subroot, root (hex), proof, and claimed, the hex leaf to be checked.

    ``altered`` is another leaf to be checked in place of a row's own, null where there is none.
    """
    own = F.unhex(leaf([F.col(f) for f in fields]))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    other = F.lit(None).cast("binary") if altered is None else F.unhex(altered)
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("ordered_by"), own.alias("digest"), other.alias("other"))
    rows = proofs(stored(leaves, "merkle-leaves"), ["ordered_by", "digest"], fanout)
    return rows.select(
        F.col("ordered_by").alias(order), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"),
        hexed("root").alias("root"), "proof", hexed(F.coalesce("other", "digest")).alias("claimed"),
    )


def op12_pointer_jumping_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, altered=F.when(hit, tampered))
    root = folded(F.col("claimed"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
