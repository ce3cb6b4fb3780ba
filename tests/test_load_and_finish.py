"""From JSON lines to the final file, with damaged input, and what each step evaluates."""

import json
import os
from collections import Counter

import pytest
from conftest import record
from pyspark.sql import functions as F

from glossmill.operators import scoring
from glossmill.operators.ids import with_dense_id
from glossmill.operators.inference import predict, with_prompt
from glossmill.operators.render import build_samples
from glossmill.plans import workflow
from glossmill.schemas import ORDER_KEY, RECORD_KEY, SAMPLE_ORDER
from glossmill.sources.jsonl import load_report, load_sources, numbered_name, read_jsonl, with_order_key, write_jsonl

ENTITIES = [("T0", "Treatment", "aspirin", 0, 0), ("T1", "Problem", "pain", 2, 2)]
BAD = [
    json.dumps({"id": "a", "en_sentence_str": "x", "entities": [{"id": "T0"}, 1]}),
    json.dumps({"id": "b", "en_sentence_str": "x", "entities": "no"}),
    json.dumps({"id": "c", "en_sentence_str": "x", "relations": [[]]}), "{", "[1]", "",
]


def test_damaged_lines_do_not_become_documents(spark, lines_file):
    path = lines_file([record("ok", entities=ENTITIES), *BAD])
    docs = load_sources(spark, [(path, "auto"), (path + ".gone", "en")])
    assert [r.doc_id for r in docs.collect()] == ["ok"]
    report = {(r.source, r.reason): r.n for r in load_report(spark, [(path, "auto"), (path + ".gone", "en")]).collect()}
    assert report == {
        (path, "loaded"): 1, (path, "entities is not a list of objects"): 2, (path, "relations is not a list of objects"): 1,
        (path, "not a JSON object"): 2, (path + ".gone", "path not found"): 0,
    }


@pytest.mark.parametrize("given,kept", [
    (0, "T1"), (0.0, "T1"), (False, "T1"), (None, "T1"), ("", "T1"), ([], "T1"), ({}, "T1"), ("0", "0"), (10, "10"), (-0.0, "T1"),
])
def test_ends_that_are_nothing_fall_back(spark, lines_file, given, kept):
    line = {"id": "r", "en_sentence_str": 'a "subject_id":0} b', "entities": [{"id": i} for i in ("T0", "T1", "0", "10")],
            "relations": [{"label": "x", "subject_id": given, "head_idx": "T1", "object_id": "T0"}]}
    row = load_sources(spark, [(lines_file([line]), "auto")]).first()
    assert [tuple(r) for r in row.relations] == [("x", kept, "T0")] and row.text == line["en_sentence_str"]


def test_part_numbers_of_any_length_keep_their_order(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    names = {9: "part-00009-x.txt", 10001: "part-10001-x.txt", 100000: "part-100000-x.txt", 99999: "part-99999-x.txt"}
    for number, name in names.items():
        (folder / name).write_text(f"{number}\n")
    lines = with_dense_id(with_order_key(spark.read.text(str(folder)), 0), ORDER_KEY, "n").orderBy("n").collect()
    assert [int(r.value) for r in lines] == sorted(names)
    plain = spark.createDataFrame([("/a/b.jsonl",), ("/part-1/b.txt",)], "p string").select(numbered_name(F.col("p")).alias("p"))
    assert [r.p for r in plain.collect()] == ["/a/b.jsonl", "/part-1/b.txt"]


def counting(folder):
    """Maker of a generator that leaves a file for every load and every prompt."""
    def make():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def generate(prompts):
            for _ in prompts:
                open(f"{folder}/prompt-{uuid.uuid4().hex}", "w").close()
            return ['{"entities": []}' for _ in prompts]

        return generate

    return make


def seen(folder):
    return Counter(name.split("-")[0] for name in os.listdir(folder))


@pytest.fixture
def documents(spark, lines_file):
    rows = [record(f"d{k}", "aspirin helps pain", ENTITIES if k % 3 else [], [("TrIP", "T0", "T1")] if k % 3 == 1 else []) for k in range(12)]
    docs = load_sources(spark, [(lines_file(rows), "auto")])
    return spark.createDataFrame(docs.collect(), docs.schema)


@pytest.mark.parametrize("sink", ["dense_id", "jsonl"])
def test_a_model_is_asked_once_for_each_prompt(spark, documents, tmp_path, sink):
    folder = tmp_path / "calls"
    folder.mkdir()
    samples = with_prompt(build_samples(documents, "instruction", "ner_only"))
    answers = predict(samples, counting(str(folder)), 4, SAMPLE_ORDER)
    if sink == "dense_id":
        assert with_dense_id(answers).count() == 12
    else:
        write_jsonl(answers, f"{tmp_path}/out", ORDER_KEY, "raw_text")
    assert seen(folder)["prompt"] == 12


def test_a_model_is_loaded_once_in_each_worker(spark, documents, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    samples = with_prompt(build_samples(documents, "instruction", "ner_only"))
    assert predict(samples.repartition(12), counting(str(folder)), 4, SAMPLE_ORDER).count() == 12
    loads = [name.split("-")[1] for name in os.listdir(folder) if name.startswith("load")]
    assert len(loads) == len(set(loads))


def pair_model():
    def make():
        return lambda prompts: ['{"relation": "TrIP"}' for _ in prompts]
    return make


def test_from_lines_to_the_final_file(spark, documents, tmp_path):
    samples = build_samples(documents, "causal", "re_only", "pairwise")
    preds = workflow.run_inference(samples, pair_model(), f"{tmp_path}/preds", slices=3)
    assert set(ORDER_KEY) < set(preds.columns) and preds.count() == 8
    again = workflow.run_inference(samples, pair_model(), f"{tmp_path}/preds", slices=2)
    assert again.count() == 8
    scores = workflow.finish(preds, documents, f"{tmp_path}/final", "re_only", "pairwise", RECORD_KEY).first()
    assert (scores.re_tp, scores.re_fp, scores.re_fn) == (4, 4, 0)
    lines = with_dense_id(read_jsonl(spark, f"{tmp_path}/final"), ORDER_KEY, "n").orderBy("n").collect()
    answers = [json.loads(r.value)["relations"] for r in lines]
    assert [len(a) for a in answers] == [int(k % 3 > 0) for k in range(12)]


def test_one_answer_for_each_document(spark, documents, tmp_path):
    samples = build_samples(documents, "instruction", "ner_only")
    preds = workflow.run_inference(samples.filter("doc_id != 'd5'"), counting_free(), f"{tmp_path}/preds")
    workflow.finish(preds, documents, f"{tmp_path}/final", "ner_only")
    lines = with_dense_id(read_jsonl(spark, f"{tmp_path}/final"), ORDER_KEY, "n").orderBy("n").collect()
    assert len(lines) == 12 and ["error" in json.loads(r.value) for r in lines] == [k == 5 for k in range(12)]


def counting_free():
    def make():
        return lambda prompts: ['{"entities": []}' for _ in prompts]
    return make


def test_causal_rows_have_labels(documents):
    row = workflow.training_rows(documents, "causal", "ner_only").first()
    assert row.labels == row.input_ids and len(row.labels) > 0


def test_record_scores_equal_shared_scores_by_key(spark, documents):
    samples = build_samples(documents, "causal", "re_only", "pairwise")
    from glossmill.operators.inference import parse_predictions

    preds = parse_predictions(samples.withColumn("raw_text", F.lit('{"relation": "TrIP"}')))
    ours = scoring.evaluate(preds, documents, "re_only", "pairwise", RECORD_KEY).first()
    other = scoring.evaluate(preds, documents, "re_only", "pairwise", ["source_idx", "seq", "doc_id"]).first()
    assert ours == other


def test_scratch_tables_go_when_released(spark, documents):
    from glossmill.session import released, scratch_path, scratch_root, written

    kept, given = written(documents, "kept"), scratch_path(spark, "given")
    documents.write.parquet(given)
    released(spark, given)
    assert not os.path.exists(given) and kept.count() == 12
    with pytest.raises(ValueError):
        released(spark, "/somewhere/else")
    released(spark)
    assert not os.path.exists(scratch_root(spark))
