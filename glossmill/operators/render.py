"""Samples as text: definitions, prompts, gold answers; causal and instruction formats."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from glossmill.functions.chat import OUTPUT_MARKER
from glossmill.functions.jsontext import joint_json, ner_json, pair_json, re_json
from glossmill.ontology import Ontology
from glossmill.operators.pairs import entity_pairs, label_pairs, mark_pairs
from glossmill.schemas import ORDER_KEY, PAIR_POS

FORMATS = ("causal", "instruction")
TASKS = ("ner_only", "re_only", "joint")
RE_MODES = ("pairwise", "global")

# The shapes a model is asked to answer in.
NER_SHAPE = '{"entities": [{"id": "T0", "label": "...", "term": "..."}]}'
PAIR_SHAPE = '{"relation": "<LABEL>"}'
RE_SHAPE = '{"relations": [{"label": "...", "subject_id": "T0", "object_id": "T1"}]}'
JOINT_SHAPE = NER_SHAPE[:-1] + ", " + RE_SHAPE[1:]


@dataclass(frozen=True)
class Templates:
    """Prompt wording with ``$slot`` places; pass your own to reproduce a given model's prompts.

    Slots: entity_defs, relation_defs, entities, sentence, subject_label, object_label.
    """

    causal_ner: str = (
        "Task: find the clinical entities of a sentence.\n\nLabels for entities\n$entity_defs\n\n"
        "Reply with JSON shaped as " + NER_SHAPE + '\n\nSentence: "$sentence"'
    )
    causal_pair: str = (
        "Task: name the relation that leads from <e1> to <e2>.\n\nLabels for relations\n$relation_defs\n\n"
        'Sentence: "$sentence"\n<e1> is a $subject_label\n<e2> is a $object_label'
    )
    causal_re: str = (
        "Task: relate the entities given below.\n\nGiven entities\n$entities\n\n"
        "Labels for relations\n$relation_defs\n\nLeave unrelated entities out. "
        "Reply with JSON shaped as " + RE_SHAPE + '\n\nSentence: "$sentence"'
    )
    causal_joint: str = (
        "Task: find the clinical entities of a sentence and relate them.\n\nLabels for entities\n$entity_defs\n\n"
        "Labels for relations\n$relation_defs\n\nReply with JSON shaped as " + JOINT_SHAPE
        + '\n\nSentence: "$sentence"'
    )
    system_ner: str = (
        "You label clinical entities.\n\nLabels for entities\n$entity_defs\n\nReply with JSON shaped as " + NER_SHAPE
    )
    system_pair: str = (
        "You label the relation that leads from <e1> to <e2>.\n\nLabels for relations\n$relation_defs\n\n"
        "Reply with JSON shaped as " + PAIR_SHAPE
    )
    system_re: str = (
        "You relate the entities you are given.\n\nLabels for relations\n$relation_defs\n\n"
        "Leave unrelated entities out. Reply with JSON shaped as " + RE_SHAPE
    )
    system_joint: str = (
        "You label clinical entities and relate them.\n\nLabels for entities\n$entity_defs\n\n"
        "Labels for relations\n$relation_defs\n\nReply with JSON shaped as " + JOINT_SHAPE
    )
    user_sentence: str = 'Sentence: "$sentence"'
    user_pair: str = 'Sentence: "$sentence"\n<e1> is a $subject_label\n<e2> is a $object_label'
    user_re: str = 'Given entities\n$entities\n\nSentence: "$sentence"'


def fill(template: str, ontology: Ontology, **slots: Column) -> Column:
    """A template as one ``concat``; the ontology slots become part of the literals."""
    known = {"entity_defs": ontology.entity_bullets(), "relation_defs": ontology.relation_bullets()}
    parts: list[Column] = []
    literal = ""
    for place, piece in enumerate(re.split(r"\$([a-z_]+)", template)):
        if place % 2 == 0:
            literal += piece
        elif piece in known:
            literal += known[piece]
        else:
            parts += [F.lit(literal), slots[piece]]
            literal = ""
    return F.concat(*parts, F.lit(literal))


def entity_list(entities: Column) -> Column:
    """One bullet per entity: id, label and quoted term."""
    line = lambda e: F.concat(F.lit("- "), e["entity_id"], F.lit(" ("), e["label"], F.lit('): "'), e["term"], F.lit('"'))
    return F.array_join(F.transform(entities, line), "\n")


def variant(task: str, re_mode: str) -> str:
    """``ner``, ``pair``, ``re`` or ``joint``; the relation mode only matters for relations alone."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; expected one of {list(TASKS)}")
    if re_mode not in RE_MODES:
        raise ValueError(f"unknown relation mode {re_mode!r}; expected one of {list(RE_MODES)}")
    if task == "re_only":
        return "pair" if re_mode == "pairwise" else "re"
    return "ner" if task == "ner_only" else "joint"


def system_prompt(task: str, re_mode: str, ontology: Ontology, templates: Templates = Templates()) -> Column:
    """The constant system message: a literal, so Parquet stores it once per page dictionary."""
    return fill(getattr(templates, f"system_{variant(task, re_mode)}"), ontology)


def gold_json(kind: str) -> Column:
    """The gold answer of a record, or of a labelled pair."""
    return {
        "ner": lambda: ner_json(F.col("entities")),
        "re": lambda: re_json(F.col("relations")),
        "joint": lambda: joint_json(F.col("entities"), F.col("relations")),
        "pair": lambda: pair_json(F.col("relation")),
    }[kind]()


def _sample_rows(docs: DataFrame, kind: str, ontology: Ontology) -> tuple[DataFrame, list, dict[str, Column]]:
    """Rows to render, their key columns and the columns behind the template slots."""
    if kind == "pair":
        rows = mark_pairs(label_pairs(entity_pairs(docs, ontology)))
        key = [*ORDER_KEY, *PAIR_POS, "doc_id", F.col("subject.entity_id").alias("subject_id"),
               F.col("object.entity_id").alias("object_id")]
        slots = {"sentence": F.col("marked"), "subject_label": F.col("subject.label"),
                 "object_label": F.col("object.label")}
        return rows, key, slots
    nowhere = [F.lit(-1).alias(p) for p in PAIR_POS]
    key = [*ORDER_KEY, *nowhere, "doc_id", F.lit("").alias("subject_id"), F.lit("").alias("object_id")]
    return docs, key, {"sentence": F.col("text"), "entities": entity_list(F.col("entities"))}


def causal_samples(docs, task, re_mode="global", ontology=None, templates=Templates()) -> DataFrame:
    """One ``text`` column: prompt, output boundary, gold answer."""
    ontology = ontology or Ontology.default()
    kind = variant(task, re_mode)
    rows, key, slots = _sample_rows(docs, kind, ontology)
    prompt = fill(getattr(templates, f"causal_{kind}"), ontology, **slots)
    return rows.select(*key, F.concat(prompt, F.lit(OUTPUT_MARKER), gold_json(kind)).alias("text"))


def instruction_samples(docs, task, re_mode="global", ontology=None, templates=Templates()) -> DataFrame:
    """``system``, ``user`` and ``assistant`` columns."""
    ontology = ontology or Ontology.default()
    kind = variant(task, re_mode)
    rows, key, slots = _sample_rows(docs, kind, ontology)
    user = {"pair": templates.user_pair, "re": templates.user_re}.get(kind, templates.user_sentence)
    return rows.select(
        *key,
        system_prompt(task, re_mode, ontology, templates).alias("system"),
        fill(user, ontology, **slots).alias("user"),
        gold_json(kind).alias("assistant"),
    )


SampleFormat = Callable[..., DataFrame]
_FORMATS: dict[str, SampleFormat] = {"causal": causal_samples, "instruction": instruction_samples}


def register_format(name: str, build: SampleFormat) -> None:
    """Add a sample format: a function of documents, task, relation mode, ontology and templates."""
    _FORMATS[name] = build


def build_samples(docs, format, task, re_mode="global", ontology=None, templates=Templates()) -> DataFrame:
    """Samples of any registered format."""
    if format not in _FORMATS:
        raise ValueError(f"unknown sample format {format!r}; expected one of {list(_FORMATS)}")
    return _FORMATS[format](docs, task, re_mode, ontology, templates)
