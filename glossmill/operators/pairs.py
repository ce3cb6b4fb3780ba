"""Candidate entity pairs of a record: generation, allowed labels, relation label, markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from glossmill.functions.spans import insert_markers
from glossmill.ontology import NO_RELATION, Ontology
from glossmill.schemas import ORDER_KEY, RECORD_KEY
from glossmill.session import computed_once


def _allowed(subject: Column, obj: Column, ontology: Ontology) -> Column:
    tests = [(subject == s) & obj.isin(objs) for s, objs in ontology.objects_by_subject().items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def entity_pairs(
    docs: DataFrame,
    ontology: Ontology | None = None,
    keep: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Ordered pairs of different entities of a record; with an ontology only the allowed label pairs.

    Pairs stream out of two generators on the record's own row, so nothing is shuffled.  The objects a subject may
    have are picked inside the array, so no pair is made to be dropped.  ``tasks`` sends the subjects, each with its
    objects, out over that many tasks, for input whose records are few and long.
    """
    keep = keep or [*ORDER_KEY, "doc_id", "words"]
    placed = F.transform("entities", lambda e, i: F.struct(i.alias("pos"), e.alias("entity")))
    subjects, candidates = placed, placed
    if ontology is not None:
        by_subject = ontology.objects_by_subject()
        ends = list(dict.fromkeys(label for labels in by_subject.values() for label in labels))
        subjects = F.filter(placed, lambda s: s["entity"]["label"].isin(list(by_subject)))
        candidates = F.filter(placed, lambda o: o["entity"]["label"].isin(ends))
    own = F.filter("relations", lambda r: r["subject_id"] == F.col("_subject.entity.entity_id"))

    def fits(o: Column) -> Column:
        other = o["pos"] != F.col("_subject.pos")
        return other if ontology is None else other & _allowed(F.col("_subject.entity.label"), o["entity"]["label"], ontology)

    # The candidates are picked once for a record and the objects once for a subject: a plain column of them would be
    # made again by the filter on empty lists that Spark puts in front of the second generator.
    rows = computed_once(docs.select(*keep, "entities", "relations"), "_candidates", candidates)
    rows = rows.filter(F.size("_candidates") > 0).select(*keep, "relations", "_candidates", F.explode(subjects).alias("_subject"))
    rows = computed_once(rows, "_objects", F.filter("_candidates", fits)).filter(F.size("_objects") > 0)
    rows = rows.select(*keep, "_subject", own.alias("subject_relations"), "_objects")
    if tasks:
        rows = rows.repartition(tasks, *RECORD_KEY, "_subject.pos")
    return rows.select(*keep, "_subject", "subject_relations", F.explode("_objects").alias("_object")).select(
        *keep, F.col("_subject.pos").alias("subj_pos"), F.col("_subject.entity").alias("subject"), "subject_relations",
        F.col("_object.pos").alias("obj_pos"), F.col("_object.entity").alias("object"))


def label_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``relation``: the first relation from subject to object, else the no-relation label."""
    hits = F.filter("subject_relations", lambda r: r["object_id"] == F.col("object.entity_id"))
    first = F.get(hits, F.lit(0))
    return pairs.withColumn("relation", F.coalesce(first["relation_type"], F.lit(NO_RELATION)))


def mark_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``marked``: the sentence with both entities tagged."""
    return pairs.withColumn("marked", insert_markers(F.col("words"), F.col("subject"), F.col("object")))
