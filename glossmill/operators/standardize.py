"""From raw JSON lines to standardised documents: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossmill.functions.jsontext import strict_object
from glossmill.functions.text import padded_text, span_in, split_words, strip
from glossmill.schemas import LANGUAGES, ORDER_KEY, RAW_RECORD
from glossmill.session import computed_once

# Defaults of missing fields.
UNKNOWN_LABEL = "UNKNOWN"
NO_INDEX = -1

#: Why a line is no document.
REASONS = ["not a JSON object", "entities is not a list of objects", "relations is not a list of objects"]


def without_empty_ends(value: Column) -> Column:
    """A relation end that is a number zero, false, or an empty list or object counts as not given.

    As text it could not be told from the string "0".  Inside a JSON string the quotes of a key are escaped, so only
    keys are found.
    """
    nothing = r'"(subject_id|object_id)"(\s*:\s*)(?:-?0(?:\.0*)?(?:[eE][+-]?\d+)?|false|\[\s*\]|\{\s*\})(?=\s*[,}])'
    with_ends = value.contains('"subject_id"') | value.contains('"object_id"')
    return F.when(with_ends, F.regexp_replace(value, nothing, '"$1"$2null')).otherwise(value)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``record``; lines that are not one JSON object, or with annotations that are not objects, yield no row.

    The parse sits in a generator so that later filters cannot be pushed below it, where they would
    parse every line a second time.
    """
    rows = computed_once(lines, "record", strict_object(without_empty_ends(F.col(value)), RAW_RECORD))
    return rows.filter(F.col("record").isNotNull() & list_problem(F.col(value), F.col("record")).isNull())


def mark_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``record`` and ``reason``, which is NULL for lines of one JSON object with sound annotation lists; one parse."""
    marked = computed_once(lines, "record", strict_object(without_empty_ends(F.col(value)), RAW_RECORD))
    record = F.col("record")
    return marked.withColumn("reason", F.when(record.isNull(), REASONS[0]).otherwise(list_problem(F.col(value), record)))


def list_problem(value: Column, record: Column) -> Column:
    """Which annotation list is there but is not a list of objects; NULL if none.

    Such a list reads as NULL although its key is there, and must not pass for an empty one.
    """

    def lost(name: str) -> Column:
        there = record[name].isNull() & value.contains(f'"{name}"')
        return F.when(there, F.coalesce(F.get_json_object(value, f"$.{name}"), F.lit("null")) != "null").otherwise(False)

    return F.when(lost("entities"), REASONS[1]).when(lost("relations"), REASONS[2])


def _has_key(value: Column, record: Column, name: str) -> Column:
    """Is the top-level key present, null value included?  Only a null needs the second look."""
    listed = F.coalesce(F.array_contains(F.json_object_keys(value), name), F.lit(False))
    # A branch, because Spark computes what both sides of AND and OR share for every row.
    return record[name].isNotNull() | F.when(value.contains(name), listed).otherwise(False)


def detect_language(value: Column, record: Column) -> Column:
    """Vietnamese when only the Vietnamese sentence key is present, else English."""
    english = _has_key(value, record, "en_sentence_str")
    vietnamese = _has_key(value, record, "vi_sentence_str")
    return F.when(vietnamese & ~english, "vi").otherwise("en")


def resolve_language(value: Column, record: Column, hint: Column) -> Column:
    """An explicit hint wins over detection."""
    return F.when(hint == "auto", detect_language(value, record)).otherwise(hint)


def by_language(language: Column, source: Column, suffix: str) -> Column:
    """The ``{language}_{suffix}`` field of a struct."""
    picked = F.when(language == LANGUAGES[0], source[f"{LANGUAGES[0]}_{suffix}"])
    for code in LANGUAGES[1:]:
        picked = picked.when(language == code, source[f"{code}_{suffix}"])
    return picked


def project_language(parsed: DataFrame) -> DataFrame:
    """Add ``language`` and the sentence of that language, trimmed; a missing sentence is empty."""
    record = F.col("record")
    rows = parsed.drop("text").withColumn("language", resolve_language(F.col("value"), record, F.col("hint")))
    return computed_once(rows, "text", strip(F.coalesce(by_language(F.col("language"), record, "sentence_str"), F.lit(""))))


def clean_text(projected: DataFrame) -> DataFrame:
    """Drop records without text, whatever else they hold."""
    return projected.filter(F.col("text") != "")


def parse_entities(entities: Column, language: Column) -> Column:
    """Entity spans in list order with defaults for whatever is missing."""

    def span(raw: Column, position: Column) -> Column:
        return F.struct(
            F.coalesce(raw["id"], F.concat(F.lit("E"), position.cast("string"))).alias("entity_id"),
            F.coalesce(raw["label"], F.lit(UNKNOWN_LABEL)).alias("label"),
            F.coalesce(by_language(language, raw, "term"), F.lit("")).alias("term"),
            F.coalesce(by_language(language, raw, "start_token_idx"), F.lit(NO_INDEX)).alias("start_token_idx"),
            F.coalesce(by_language(language, raw, "end_token_idx"), F.lit(NO_INDEX)).alias("end_token_idx"),
        )

    empty = F.array().cast(
        "array<struct<entity_id:string,label:string,term:string,start_token_idx:int,end_token_idx:int>>"
    )
    return F.coalesce(F.transform(entities, span), empty)


def parse_relations(relations: Column, entities: Column) -> Column:
    """Directed relations between entities of the same record; dangling ones are removed."""

    def triple(raw: Column) -> Column:
        return F.struct(
            F.coalesce(raw["label"], F.lit(UNKNOWN_LABEL)).alias("relation_type"),
            F.coalesce(F.nullif(raw["subject_id"], F.lit("")), raw["head_idx"]).alias("subject_id"),
            F.coalesce(F.nullif(raw["object_id"], F.lit("")), raw["tail_idx"]).alias("object_id"),
        )

    triples = F.transform(relations, triple)
    ends = F.concat(F.transform(triples, lambda r: r["subject_id"]), F.transform(triples, lambda r: r["object_id"]))
    # Hashed once per record; what is left is usually nothing.
    unknown = F.array_except(ends, F.transform(entities, lambda e: e["entity_id"]))

    def anchored(rel: Column, nowhere: Column) -> Column:
        known = lambda end: end.isNotNull() & ~F.coalesce(F.array_contains(nowhere, end), F.lit(False))
        return known(rel["subject_id"]) & known(rel["object_id"])

    # A list of one holds the unknown ids, so that they are searched for once.
    kept = F.flatten(F.transform(F.array(unknown), lambda nowhere: F.filter(triples, lambda r: anchored(r, nowhere))))
    empty = F.array().cast("array<struct<relation_type:string,subject_id:string,object_id:string>>")
    return F.coalesce(F.when(F.size(relations) > 0, kept), empty)


def standardize(lines: DataFrame, **more: Column) -> DataFrame:
    """Documents with a stable key: text, words, entity spans and relations of one language.

    ``n_entities`` lets a later Parquet scan skip row groups by size; ``more`` are further columns made from the
    parsed ``record``.
    """
    return standardize_parsed(parse_lines(lines), **more)


def standardize_parsed(parsed: DataFrame, **more: Column) -> DataFrame:
    """The documents of lines with their ``record``."""
    docs = clean_text(project_language(parsed))
    record = F.col("record")
    return (
        docs.withColumn("entities", parse_entities(record["entities"], F.col("language")))
        .withColumn("relations", parse_relations(record["relations"], F.col("entities")))
        .select(
            *ORDER_KEY[:1], "source", *ORDER_KEY[1:],
            F.coalesce(record["id"], F.lit("")).alias("doc_id"),
            "text", split_words(F.col("text")).alias("words"), "entities", "relations", "language",
            F.coalesce(F.size(record["entities"]), F.lit(0)).alias("n_entities"),
            *(value.alias(name) for name, value in more.items()),
        )
    )


def entity_by_id(entities: Column, entity_id: Column) -> Column:
    """First entity with that id, or NULL."""
    return F.get(F.filter(entities, lambda e: e["entity_id"] == entity_id), F.lit(0))


def relation_endpoints(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per relation with the entities it connects, which are looked up before the relations become rows."""
    entities = F.col("entities")
    ends = F.transform("relations", lambda r: F.struct(
        r["relation_type"].alias("relation_type"),
        entity_by_id(entities, r["subject_id"]).alias("subject"), entity_by_id(entities, r["object_id"]).alias("object"),
    ))
    return docs.select(*keep, F.posexplode(ends).alias("rel_pos", "rel")).select(*keep, "rel_pos", "rel.*")


def mentions_with_spans(docs: DataFrame, terms: Column, keep: list[str]) -> DataFrame:
    """One row per term of a text, an array column: its position, the term, and its first token span.

    The text is normalised once, before its terms become rows.
    """
    ready = computed_once(docs.select(*keep, "text", terms.alias("_terms")), "_hay", padded_text(F.col("text")))
    rows = ready.select(*keep, "_hay", F.posexplode("_terms").alias("pos", "term"))
    return rows.select(*keep, "pos", "term", span_in(F.col("term"), F.col("_hay")).alias("span"))
