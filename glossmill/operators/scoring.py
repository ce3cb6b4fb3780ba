"""Regrouping pair answers, aligning with gold, and micro-averaged scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossmill.functions.jsontext import re_json
from glossmill.functions.matching import (
    ner_set, pair_label, prf, re_set, relation_key,
)
from glossmill.ontology import NO_RELATION
from glossmill.operators.render import gold_json, variant
from glossmill.schemas import PAIR_POS, RECORD_KEY


def gold_references(docs: DataFrame, task: str, re_mode: str = "global") -> DataFrame:
    """Gold answer of every document, in the shape predictions are scored in."""
    kind = variant(task, re_mode)
    return docs.withColumn("reference", gold_json("re" if kind == "pair" else kind))


def align(preds: DataFrame, gold: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Predictions next to gold by key; ``side`` tells rows that lack a partner."""
    key = key or RECORD_KEY
    left = preds.withColumn("_p", F.lit(True))
    right = gold.withColumn("_g", F.lit(True))
    side = F.when(F.col("_p").isNull(), "gold_only").when(F.col("_g").isNull(), "pred_only").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("side", side).drop("_p", "_g")


def unmatched_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def _none() -> Column:
    return F.array().cast("array<string>")


def set_counts(aligned: DataFrame, pred: str, gold: str, prefix: str) -> list[Column]:
    """Sums of hits, extra and missing keys over two set columns; a missing side is an empty set."""
    p, g = F.coalesce(F.col(pred), _none()), F.coalesce(F.col(gold), _none())
    hits = F.size(F.array_intersect(p, g))
    return [
        F.sum(hits).alias(f"{prefix}_hit"), F.sum(F.size(p)).alias(f"{prefix}_pred"),
        F.sum(F.size(g)).alias(f"{prefix}_gold"),
    ]


def _finish(totals: DataFrame, *prefixes: str) -> DataFrame:
    out = []
    for p in prefixes:
        hit, pred, gold = (F.coalesce(F.col(f"{p}_{x}"), F.lit(0)) for x in ("hit", "pred", "gold"))
        columns = prf(hit, pred - hit, gold - hit, p)
        out += [c.alias(f"{p}_{n}") for c, n in zip(columns[:3], ("tp", "fp", "fn"))] + columns[3:]
    return totals.select(*out)


def total(scores: DataFrame) -> DataFrame:
    """One row of scores from several, by the sums of their counts."""
    prefixes = [c.removesuffix("_tp") for c in scores.columns if c.endswith("_tp")]
    sums = scores.agg(*[F.coalesce(F.sum(f"{p}_{n}"), F.lit(0)).alias(f"{p}_{n}") for p in prefixes for n in ("tp", "fp", "fn")])
    out = []
    for p in prefixes:
        columns = prf(*(F.col(f"{p}_{n}") for n in ("tp", "fp", "fn")), p)
        out += [c.alias(f"{p}_{n}") for c, n in zip(columns[:3], ("tp", "fp", "fn"))] + columns[3:]
    return sums.select(*out)


def ner_metrics(aligned: DataFrame, pred: str = "pred_ner", gold: str = "gold_ner") -> DataFrame:
    """Entity precision, recall and F1 over (label, normalised term) sets."""
    return _finish(aligned.agg(*set_counts(aligned, pred, gold, "ner")), "ner")


def re_metrics(aligned: DataFrame, pairwise: bool = False, pred: str = "pred_re", gold: str = "gold_re") -> DataFrame:
    """Relation scores over (label, subject, object) sets, or over one label per pair.

    Pairwise is lopsided on purpose: a wrong relation is only an extra one, and a relation is only
    missing when nothing was predicted.
    """
    if not pairwise:
        return _finish(aligned.agg(*set_counts(aligned, pred, gold, "re")), "re")
    p, g = F.coalesce(F.col(pred), F.lit(NO_RELATION)), F.coalesce(F.col(gold), F.lit(NO_RELATION))
    outcome = (
        F.when((p == g) & (g != NO_RELATION), "tp")
        .when((p != NO_RELATION) & (p != g), "fp")
        .when((g != NO_RELATION) & (p == NO_RELATION), "fn")
    )
    totals = aligned.select(outcome.alias("o")).agg(
        *[F.count(F.when(F.col("o") == o, 1)).alias(o) for o in ("tp", "fp", "fn")]
    )
    columns = prf(F.col("tp"), F.col("fp"), F.col("fn"), "re")
    return totals.select(*[c.alias(f"re_{n}") for c, n in zip(columns[:3], ("tp", "fp", "fn"))], *columns[3:])


# ---- pair answers back to documents -----------------------------------------------------------

def predicted_relations(preds: DataFrame, *keep: str) -> DataFrame:
    """Pair answers that name a relation."""
    rows = preds.select(*keep, pair_label(F.col("prediction")).alias("label"), "subject_id", "object_id")
    return rows.filter(F.col("label") != NO_RELATION)


def regroup_pairs(preds: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document with its predicted relations in pair order; without any, an empty list.

    Grouping is by record, so a list is no longer than one record has pairs.
    """
    item = F.struct(*PAIR_POS, "label", "subject_id", "object_id")
    lists = predicted_relations(preds, *RECORD_KEY, *PAIR_POS).groupBy(*RECORD_KEY).agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )
    found = F.transform(
        "_items",
        lambda r: F.struct(r["label"].alias("relation_type"), r["subject_id"].alias("subject_id"),
                           r["object_id"].alias("object_id")),
    )
    empty = F.array().cast("array<struct<relation_type:string,subject_id:string,object_id:string>>")
    return docs.join(lists, RECORD_KEY, "left").withColumn("predicted", F.coalesce(found, empty)).drop("_items")


def relations_by_doc_id(preds: DataFrame, docs: DataFrame) -> DataFrame:
    """Predicted relations under their document id, one row each with its sample ``id``.

    Records that share an id share these rows, and such an id may be very frequent, so no list is made of them.  An
    id without any relation has one row without a relation.
    """
    rows = predicted_relations(preds, "id", "doc_id").select("doc_id", "id", "label", "subject_id", "object_id")
    empty = docs.select("doc_id").distinct().join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.unionByName(empty, allowMissingColumns=True)


def prediction_lines(grouped: DataFrame) -> DataFrame:
    """Add the JSON line of a regrouped document."""
    return grouped.withColumn("value", re_json(F.col("predicted")))


def shared_id_metrics(preds: DataFrame, docs: DataFrame) -> DataFrame:
    """Relation scores when every record is scored against all answers given under its document id.

    Pairing records with answers is quadratic where an id is shared, so nothing is paired.  Per id and
    relation only two numbers count: how many of its records hold it, and whether it was predicted.
    Hits are the sum of the former over predicted relations, and each predicted relation is offered to
    every record of the id.  Both groupings are pre-aggregated, so a very frequent id is no hot spot.
    """
    found = predicted_relations(preds, "doc_id").filter(
        (F.col("label") != "") & (F.coalesce("subject_id", F.lit("")) != "") & (F.coalesce("object_id", F.lit("")) != "")
    ).select(
        "doc_id", relation_key(F.col("label"), F.col("subject_id"), F.col("object_id")).alias("rel"),
        F.lit(0).alias("held"), F.lit(1).alias("said"), F.lit(0).alias("record"),
    )
    # Every record yields one row for itself and one per gold relation.
    gold = docs.select("doc_id", F.explode(F.concat(F.array(F.lit("")), re_set(F.col("relations"), "relation_type"))).alias("rel"))
    held = gold.select(
        "doc_id", "rel", (F.col("rel") != "").cast("int").alias("held"), F.lit(0).alias("said"),
        (F.col("rel") == "").cast("int").alias("record"),
    )
    per_relation = found.unionByName(held).groupBy("doc_id", "rel").agg(
        F.sum("held").alias("held"), F.max("said").alias("said"), F.sum("record").alias("records")
    )
    per_id = per_relation.groupBy("doc_id").agg(
        F.sum(F.when(F.col("said") == 1, F.col("held")).otherwise(0)).alias("hit"),
        F.sum("said").alias("said"), F.sum("held").alias("gold"), F.sum("records").alias("records"),
    )
    totals = per_id.filter(F.col("records") > 0).agg(
        F.sum("hit").alias("re_hit"), F.sum(F.col("said") * F.col("records")).alias("re_pred"),
        F.sum("gold").alias("re_gold"),
    )
    return _finish(totals, "re")


def record_pair_metrics(preds: DataFrame, docs: DataFrame) -> DataFrame:
    """Relation scores when every record has only its own answers: one grouping by record, then sets in the row."""
    said = predicted_relations(preds, *RECORD_KEY).filter(
        (F.col("label") != "") & (F.coalesce("subject_id", F.lit("")) != "") & (F.coalesce("object_id", F.lit("")) != ""))
    sets = said.groupBy(*RECORD_KEY).agg(
        F.collect_set(relation_key(F.col("label"), F.col("subject_id"), F.col("object_id"))).alias("pred_re"))
    gold = docs.select(*RECORD_KEY, re_set(F.col("relations"), "relation_type").alias("gold_re"))
    aligned = gold.join(sets, RECORD_KEY, "left")
    return _finish(aligned.agg(*set_counts(aligned, "pred_re", "gold_re", "re")), "re")


# ---- end to end -------------------------------------------------------------------------------

def with_prediction_sets(preds: DataFrame) -> DataFrame:
    return preds.withColumn("pred_ner", ner_set(F.col("prediction.entities"))).withColumn(
        "pred_re", re_set(F.col("prediction.relations"))
    )


def with_gold_sets(docs: DataFrame) -> DataFrame:
    return docs.withColumn("gold_ner", ner_set(F.col("entities"))).withColumn(
        "gold_re", re_set(F.col("relations"), "relation_type")
    )


def evaluate(preds: DataFrame, docs: DataFrame, task: str, re_mode: str = "global",
             key: list[str] | None = None) -> DataFrame:
    """Scores of parsed predictions against documents: one row.

    Pair answers are regrouped by document id, as records sharing an id are scored together; pass
    ``key=RECORD_KEY`` to keep every record to its own answers.  Other tasks join on the record.
    """
    kind = variant(task, re_mode)
    if kind == "pair":
        if key is None or list(key) == ["doc_id"]:
            return shared_id_metrics(preds, docs)
        if list(key) == RECORD_KEY:
            return record_pair_metrics(preds, docs)
        together = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key])
        return shared_id_metrics(preds.withColumn("doc_id", together), docs.withColumn("doc_id", together))
    key = key or RECORD_KEY
    prefixes = {"ner": ["ner"], "re": ["re"], "joint": ["ner", "re"]}[kind]
    sets = with_prediction_sets(preds).select(*key, *[f"pred_{p}" for p in prefixes])
    gold = with_gold_sets(docs).select(*key, *[f"gold_{p}" for p in prefixes])
    aligned = align(sets, gold, key)
    sums = [c for p in prefixes for c in set_counts(aligned, f"pred_{p}", f"gold_{p}", p)]
    return _finish(aligned.agg(*sums), *prefixes)
