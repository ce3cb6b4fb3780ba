"""Rendered samples, token columns, ids, subsets and resume."""

import json
import math

import pytest
from conftest import record
from pyspark.sql import functions as F

from glossmill.ontology import Ontology
from glossmill.operators import ids, render, tokens
from glossmill.schemas import SAMPLE_ORDER
from glossmill.sources.jsonl import load_sources

RECORDS = [
    record("d1", "aspirin helps pain", [("T0", "Treatment", "aspirin", 0, 0), ("T1", "Problem", 'pa"in', 2, 2)], [("TrIP", "T0", "T1")]),
    record("d2", "không đau", lang="vi"),
]


@pytest.fixture
def docs(spark, lines_file):
    return load_sources(spark, [(lines_file(RECORDS), "auto")])


def by_doc(df):
    return {r.doc_id: r for r in df.collect()}


def test_definitions():
    ontology = Ontology({"A": "one", "B": "two"}, {"R": "rel"}, [("A", "B"), ("A", "B"), ("B", "B")])
    assert ontology.entity_bullets() == "- A: one\n- B: two"
    assert ontology.relation_bullets().split("\n") == ["- R: rel", "- NONE: No valid clinical relation exists between the entities"]
    assert ontology.objects_by_subject() == {"A": ["B"], "B": ["B"]}


@pytest.mark.parametrize("task,re_mode,gold", [
    ("ner_only", "pairwise", {"entities": [{"id": "T0", "label": "Treatment", "term": "aspirin"}, {"id": "T1", "label": "Problem", "term": 'pa"in'}]}),
    ("re_only", "global", {"relations": [{"label": "TrIP", "subject_id": "T0", "object_id": "T1"}]}),
])
def test_document_samples(docs, task, re_mode, gold):
    answer = json.dumps(gold, ensure_ascii=False)
    causal = by_doc(render.build_samples(docs, "causal", task, re_mode))
    chat = by_doc(render.build_samples(docs, "instruction", task, re_mode))
    assert causal["d1"].text.endswith("\n\n### Output:\n" + answer) and chat["d1"].assistant == answer
    assert 'Sentence: "aspirin helps pain"' in causal["d1"].text and 'Sentence: "không đau"' in chat["d2"].user
    assert (causal["d1"].subject_id, causal["d1"].object_id) == ("", "")
    assert chat["d1"].system == chat["d2"].system


def test_pair_samples_and_entity_list(docs):
    pair = render.build_samples(docs, "instruction", "re_only", "pairwise").collect()
    assert [(r.doc_id, r.subject_id, r.object_id, r.assistant) for r in pair] == [("d1", "T0", "T1", '{"relation": "TrIP"}')]
    assert "<e1> aspirin </e1> helps <e2> pain </e2>" in pair[0].user
    listed = by_doc(render.build_samples(docs, "instruction", "re_only", "global"))["d1"].user
    assert '- T0 (Treatment): "aspirin"\n- T1 (Problem): "pa"in"' in listed


def test_own_templates_and_formats(docs):
    mine = render.Templates(causal_ner="$entity_defs|$sentence")
    ontology = Ontology({"X": "y"}, {}, [])
    assert by_doc(render.build_samples(docs, "causal", "ner_only", ontology=ontology, templates=mine))["d2"].text == (
        '- X: y|không đau\n\n### Output:\n{"entities": []}'
    )
    render.register_format("ids", lambda docs, *_: docs.select("doc_id"))
    assert render.build_samples(docs, "ids", "joint").columns == ["doc_id"]
    for bad in (("xml", "joint", "global"), ("causal", "all", "global"), ("causal", "joint", "some")):
        with pytest.raises(ValueError):
            render.build_samples(docs, *bad)


@pytest.mark.parametrize("prompt,labels", [(0, [5, 6, 7]), (2, [-100, -100, 7]), (3, [-100] * 3), (9, [-100] * 3)])
def test_loss_labels(spark, prompt, labels):
    row = spark.createDataFrame([([5, 6, 7], prompt)], "ids array<int>, p int").select(tokens.loss_labels(F.col("ids"), F.col("p")).alias("l")).first()
    assert row.l == labels


def word_encoder():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def test_tokenize(spark, docs):
    df = spark.createDataFrame([("a bb ccc",), ("",)], "t string")
    rows = tokens.tokenize(df, "t", 2, word_encoder).orderBy("t").collect()
    assert [(r.input_ids, r.attention_mask) for r in rows] == [([], []), ([1, 2], [1, 1])]
    default = tokens.tokenize(df, "t", 2, keep=[]).collect()
    assert sorted(len(r.input_ids) for r in default) == [0, 2] and default[0].asDict().keys() == {"input_ids", "attention_mask"}
    samples = render.build_samples(docs, "instruction", "joint")
    for encoder in (None, word_encoder):
        for r in tokens.instruction_tokens(samples, ["doc_id"], 1024, encoder).collect():
            assert r.labels == [-100] * r.prompt_length + r.input_ids[r.prompt_length:] and len(r.input_ids) > r.prompt_length
        for r in tokens.instruction_tokens(samples, ["doc_id"], 5, encoder).collect():
            assert r.labels == [-100] * 5 and r.prompt_length > 5 and r.attention_mask == [1] * 5


def test_token_parts_equal_whole_text(docs):
    from glossmill.functions.chat import chat_full, chat_prompt

    samples = render.build_samples(docs, "instruction", "joint")
    whole = samples.select(
        "doc_id", tokens.hashed_ids(tokens.tokens(chat_full(F.col("system"), F.col("user"), F.col("assistant")))).alias("ids"),
        F.size(tokens.tokens(chat_prompt(F.col("system"), F.col("user")))).alias("n"))
    parts = by_doc(tokens.instruction_tokens(samples, ["doc_id"], 10_000))
    for r in whole.collect():
        assert parts[r.doc_id].input_ids == r.ids and parts[r.doc_id].prompt_length == r.n


def test_pad_batches(spark):
    df = spark.createDataFrame([(k, list(range(k % 4)), [9] * (k % 4)) for k in range(10)], "k int, input_ids array<int>, labels array<int>")
    rows = tokens.pad_batches(df, 3, pad_id=0, order=["k"]).orderBy("id").collect()
    for start in range(0, 10, 3):
        batch = rows[start:start + 3]
        width = max(r.k % 4 for r in batch)
        for r in batch:
            n = r.k % 4
            assert r.batch == start // 3
            assert r.input_ids == list(range(n)) + [0] * (width - n) and r.labels == [9] * n + [-100] * (width - n)


@pytest.mark.parametrize("partitions", [1, 8])
def test_dense_id_and_shards(spark, partitions):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(partitions)
    numbered = ids.with_dense_id(rows, ["k"]).orderBy("id").collect()
    assert [r.id for r in numbered] == list(range(1000)) and [r.k for r in numbered] == sorted(r.k for r in numbered)
    with_ids = ids.with_dense_id(rows, ["k"])
    parts = [sorted(r.id for r in ids.shard(with_ids, 3, i, 1000).collect()) for i in range(3)]
    assert [x for p in parts for x in p] == list(range(1000)) and all(len(p) in (333, 334) for p in parts)


@pytest.mark.parametrize("size,kept", [(0.2, 20), (5, 5), (1000, 100), (1, 100), (1.0, 100), (None, 100), (0.001, 1), (0, 1)])
def test_head_subset(spark, size, kept):
    rows = spark.range(100).select((F.col("id") % 3).alias("a"), (99 - F.col("id")).alias("b"), F.lit("x").alias("payload"))
    got = sorted((r.a, r.b) for r in ids.head_subset(rows, size, ["a", "b"]).collect())
    assert got == sorted((i % 3, 99 - i) for i in range(100))[:kept]
    assert ids.head_subset(rows.limit(0), size, ["a", "b"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000])
def test_step_budget(spark, n):
    r = ids.step_budget(spark.range(n), 8, 4, 3, 0.1).first()
    total = math.ceil(n / 32) * 3
    assert (r.n_samples, r.total_steps, r.warmup_steps) == (n, total, max(1, int(total * 0.1)))


def test_pending(spark):
    samples = spark.range(10).withColumnRenamed("id", "k")
    some = lambda *k: spark.createDataFrame([(i,) for i in k], "k long")
    left = lambda done: sorted(r.k for r in ids.pending(samples, done, ["k"]).collect())
    assert left(some()) == list(range(10)) and left(some(*range(10))) == []
    assert left(some(1, 5, 99)) == [0, 2, 3, 4, 6, 7, 8, 9]


def test_partition_count_does_not_matter(spark, lines_file):
    many = [record(f"d{k}", "aspirin helps pain", RECORDS[0]["entities"] and [("T0", "Treatment", "aspirin", 0, 0), ("T1", "Problem", "pain", 2, 2)]) for k in range(40)]
    path = lines_file(many)
    outputs = []
    for n in (1, 8):
        docs = load_sources(spark, [(path, "auto")]).repartition(n, "doc_id")
        rows = ids.with_dense_id(render.build_samples(docs, "causal", "re_only", "pairwise"), SAMPLE_ORDER).orderBy("id").collect()
        outputs.append([(r.id, r.doc_id, r.text) for r in rows])
    assert outputs[0] == outputs[1] and len(outputs[0]) == 40


@pytest.mark.parametrize("most", [1, 3, 5, 6, 7, 1024])
def test_clipped_text_has_that_many_tokens(spark, most):
    from glossmill.operators.tokens import clip_tokens, tokens

    text = "  one, two\n(three) $1 \\x four\n"
    row = spark.createDataFrame([(text,)], "t string").select(
        clip_tokens(F.col("t"), most).alias("clipped"), tokens(F.col("t")).alias("all"), tokens(clip_tokens(F.col("t"), most)).alias("left")).first()
    assert text.startswith(row.clipped) and row.left == row["all"][:most]
    assert row.clipped == text or len(row["all"]) > most


def test_prompts_are_clipped_before_the_model(spark):
    from glossmill.operators.inference import predict

    rows = spark.createDataFrame([(1, "a b c d"), (2, "a")], "id long, prompt string")
    echo = lambda: lambda prompts: prompts
    assert {r.id: r.raw_text for r in predict(rows, echo, keep=["id"], max_length=2).collect()} == {1: "a b", 2: "a"}


def test_clipping_reads_a_text_once_whatever_it_holds(spark):
    """Marks of control and private characters in a text are text; white space behind the last token goes, or stays with fewer."""
    texts = ["a \x01\x01 b c", " a  b \n", " a  b  c \n d", "", "  ", "é_1 ß,\x85ü", None, "x " * 70_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from glossmill.operators.tokens import clip_tokens
    once = df.select("i", clip_tokens(F.col("t"), 2).alias("c"))
    assert "replace" not in once._jdf.queryExecution().executedPlan().toString()
    got = [r.c for r in once.orderBy("i").collect()]
    assert got == ["a \x01", " a  b", " a  b", "", "  ", "é_1 ß", None, "x x"]
    assert df.select(clip_tokens(F.col("t"), 65_000).alias("c")).agg(F.max(F.length("c"))).first()[0] == 2 * 65_000 - 1
