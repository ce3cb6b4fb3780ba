"""Prediction, resume, stream and sinks."""

import json

import pytest
from conftest import record
from pyspark.sql import functions as F

from glossmill.operators import ids, inference
from glossmill.operators.render import build_samples
from glossmill.plans import workflow
from glossmill.schemas import ORDER_KEY, SAMPLE_KEY
from glossmill.sources import jsonl
from glossmill.streaming.predict import predict_stream


def upper_generator():
    return lambda prompts: [json.dumps({"relation": p.split('Sentence: "')[-1].split('"')[0]}, ensure_ascii=False) for p in prompts]


def docs_of(spark, lines_file, n=10, name="in.jsonl"):
    return jsonl.load_sources(spark, [(lines_file([record(f"d{k}", f"text {k}") for k in range(n)], name), "auto")])


@pytest.mark.parametrize("format", ["causal", "instruction"])
def test_predict_and_parse(spark, lines_file, format):
    samples = inference.with_prompt(build_samples(docs_of(spark, lines_file), format, "ner_only"))
    out = inference.parse_predictions(inference.predict(samples, upper_generator, 3)).collect()
    assert {(r.doc_id, r.prediction.relation, r.malformed) for r in out} == {(f"d{k}", f"text {k}", False) for k in range(10)}


def test_generator_must_answer_every_prompt(spark, lines_file):
    samples = inference.with_prompt(build_samples(docs_of(spark, lines_file), "causal", "ner_only"))
    with pytest.raises(Exception, match="prompts gave"):
        inference.predict(samples, lambda: lambda prompts: prompts[:-1], 3).collect()


def test_parse_predictions(spark):
    texts = ['{"relation": "PIP"}', '```json\n{}\n```', "[1]", "5", "", '{"entities": [{"id": "T0", "label": "Test", "term": "x"}]}',
             '{\n  "relation":\t"a\\nb"\n}\n', '{"relation": "a"} trailing', '{"error": "x", "raw_text": "y"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    rows = inference.parse_predictions(df).orderBy("i").collect()
    for text, r in zip(texts, rows):
        try:
            value = json.loads(text)
        except ValueError:
            value = None
        good = isinstance(value, dict)
        assert r.malformed == (not good) and "\n" not in r.stored
        assert json.loads(r.stored) == (value if good else {"error": "Malformed JSON", "raw_text": text})


def counting_generator():
    return lambda prompts: ["{}" for _ in prompts]


@pytest.mark.parametrize("first", [0, 4, 10])
def test_resume_equals_full_run(spark, lines_file, tmp_path, first):
    docs = workflow.prepare_documents(spark, [(lines_file([record(f"d{k}", f"text {k}") for k in range(10)]), "auto")], str(tmp_path / "docs"))
    samples = build_samples(docs, "causal", "ner_only")
    target = str(tmp_path / "out")
    workflow.run_inference(ids.head_subset(samples, first) if first else samples.limit(0), upper_generator, target, 3)
    done = spark.read.parquet(target).count() if first else 0
    everything = workflow.run_inference(samples, upper_generator, target, 3, slices=3)
    assert done == first
    assert sorted(r.doc_id for r in everything.collect()) == sorted(f"d{k}" for k in range(10))
    assert everything.select(*SAMPLE_KEY).distinct().count() == 10


def test_stream_restart(spark, lines_file, tmp_path):
    source = tmp_path / "src"
    source.mkdir()

    def arrive(name, ids):
        (source / name).write_text("\n".join(json.dumps(record(i, f"t {i}")) for i in ids) + "\n")

    def run():
        query = predict_stream(spark, str(source), str(tmp_path / "dst"), str(tmp_path / "state"), counting_generator, batch_size=2)
        query.awaitTermination()
        assert query.exception() is None
        return sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "dst")).collect())

    arrive("a.jsonl", ["1", "2", "3"])
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]
    arrive("b.jsonl", ["4"])
    assert run() == ["1", "2", "3", "4"]
    rows = spark.read.parquet(str(tmp_path / "dst"))
    assert rows.select("source_idx", "seq").distinct().count() == 4
    # A crash between writing a micro-batch and committing it replays that micro-batch.
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == ["1", "2", "3", "4"]


def test_final_file_keeps_order(spark, tmp_path):
    rows = spark.range(500).select(F.col("id"), F.concat(F.lit('{"n": '), F.col("id"), F.lit("}")).alias("stored")).repartition(7)
    target = tmp_path / "final"
    jsonl.write_jsonl(rows, str(target), ["id"], "stored")
    text = "".join(p.read_text() for p in sorted(target.glob("part-*")))
    assert [json.loads(l)["n"] for l in text.splitlines()] == list(range(500))


def test_training_rows(spark, lines_file):
    docs = docs_of(spark, lines_file)
    causal = workflow.training_rows(docs, "causal", "ner_only", subset=3)
    assert causal.count() == 3 and {"input_ids", "attention_mask"} <= set(causal.columns)
    chat = workflow.training_rows(docs, subset=0.5).collect()
    assert len(chat) == 5 and all(len(r.labels) == len(r.input_ids) for r in chat)
    with pytest.raises(ValueError):
        workflow.training_rows(docs.limit(0))
    assert docs.select(*ORDER_KEY).distinct().count() == 10
