"""Set keys for scoring, and the precision / recall / F1 arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glossmill.functions.text import normalize_term
from glossmill.ontology import NO_RELATION


def _filled(value: Column) -> Column:
    """True for a non-empty string; a missing value counts as empty."""
    return F.coalesce(value, F.lit("")) != ""


def _joined(*parts: Column) -> Column:
    """One string per tuple; the lengths in front keep different tuples different.

    Strings, not structs, because Spark hashes strings in array set operations and compares structs
    pair by pair.
    """
    sizes = [c for p in parts[:-1] for c in (F.length(p).cast("string"), F.lit(":"))]
    return F.concat(*sizes, *parts)


def entity_key(label: Column, term: Column) -> Column:
    return _joined(label, term)


def relation_key(label: Column, subject_id: Column, object_id: Column) -> Column:
    return _joined(label, subject_id, object_id)


def _set_of(items: Column, keep, key) -> Column:
    keys = F.array_distinct(F.transform(F.filter(items, keep), key))
    return F.coalesce(keys, F.array().cast("array<string>"))


def ner_set(entities: Column) -> Column:
    """Distinct (label, normalised term) keys; entities without a label or a term do not count."""
    terms = F.transform(
        entities, lambda e: F.struct(e["label"].alias("label"), normalize_term(e["term"]).alias("term"))
    )
    return _set_of(
        terms,
        lambda e: _filled(e["label"]) & _filled(e["term"]),
        lambda e: entity_key(e["label"], e["term"]),
    )


def re_set(relations: Column, label: str = "label") -> Column:
    """Distinct (label, subject, object) keys; incomplete and no-relation entries do not count."""
    return _set_of(
        relations,
        lambda r: _filled(r[label]) & (r[label] != NO_RELATION) & _filled(r["subject_id"]) & _filled(r["object_id"]),
        lambda r: relation_key(r[label], r["subject_id"], r["object_id"]),
    )


def pair_label(prediction: Column) -> Column:
    """The label of a pairwise answer; a missing one is the no-relation label."""
    return F.coalesce(prediction["relation"], F.lit(NO_RELATION))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def round4(x: Column) -> Column:
    """Round to four places as Python does: to the nearest by exact binary value, ties to even.

    ``x`` is split into two halves whose products with 20000 are exact, so the sign of the distance to
    the halfway point is exact too.
    """
    below = F.floor(x * 10000)
    high = x.cast("float").cast("double")
    distance = (high * 20000 - (below * 2 + 1)) + (x - high) * 20000
    up = (distance > 0) | ((distance == 0) & (below % 2 == 1))
    return (below + F.when(up, 1).otherwise(0)).cast("double") / F.lit(10000.0)


def prf(tp: Column, fp: Column, fn: Column, prefix: str) -> list[Column]:
    """Counts and rounded scores, zero where a denominator is zero."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = precision + recall
    f1 = F.when(both > 0, F.lit(2.0) * precision * recall / both).otherwise(F.lit(0.0))
    return [
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"),
        round4(precision).alias(f"{prefix}_precision"),
        round4(recall).alias(f"{prefix}_recall"),
        round4(f1).alias(f"{prefix}_f1"),
    ]
