"""Generation that fails half-way, the caller's tokenizer, and what each asks for."""

import json
import os
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from conftest import record
from pyspark.sql import functions as F

from glossmill.operators.inference import predict, with_prompt
from glossmill.operators.plugins import MOST, Plugin, clipped
from glossmill.operators.render import build_samples
from glossmill.operators.tokens import clip_by_encoder, tokenize, with_prompt_length
from glossmill.plans import workflow
from glossmill.schemas import SAMPLE_KEY
from glossmill.sources.answers import chunks, opened, reachable, runs
from glossmill.sources.jsonl import load_sources


def failing_model(folder, on=None):
    """Notes every load and every prompt; fails once it sees the text ``on`` unless a file "mended" is there."""

    def make():
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def generate(prompts):
            for p in prompts:
                if on is not None and f'"{on}"' in p and not os.path.exists(f"{folder}/mended"):
                    raise RuntimeError("the model broke")
            for p in prompts:
                with open(f"{folder}/asked-{uuid.uuid4().hex}", "w") as out:
                    out.write(re.search(r'"(text \d+)"', p).group(1))
            return [json.dumps({"relation": re.search(r'"(text \d+)"', p).group(1)}) for p in prompts]

        return generate

    return make


def asked(folder):
    return Counter(open(f"{folder}/{name}").read() for name in os.listdir(folder) if name.startswith("asked"))


@pytest.fixture
def samples(spark, lines_file, tmp_path):
    docs = load_sources(spark, [(lines_file([record(f"d{k}", f"text {k}") for k in range(60)]), "auto")])
    docs.repartition(1).sortWithinPartitions("seq").write.parquet(f"{tmp_path}/docs")
    return build_samples(spark.read.parquet(f"{tmp_path}/docs"), "instruction", "ner_only")


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return str(folder)


def test_a_broken_run_keeps_every_finished_chunk(spark, samples, tmp_path, calls):
    target = f"{tmp_path}/out"
    model = failing_model(calls, on="text 41")
    with pytest.raises(Exception, match="the model broke"):
        workflow.run_inference(samples, model, target, batch_size=2, partitions=1, keep_every=10)
    first = asked(calls)
    kept = [r.raw_text for r in spark.read.parquet(target).collect()]
    assert sorted(json.loads(t)["relation"] for t in kept) == sorted(f"text {k}" for k in range(40))
    assert sum(first.values()) == 40  # the batch that broke answered nothing

    (Path(calls) / "mended").touch()
    everything = workflow.run_inference(samples, model, target, batch_size=2, partitions=1, keep_every=10)
    assert {r.doc_id: r.prediction.relation for r in everything.collect()} == {f"d{k}": f"text {k}" for k in range(60)}
    assert everything.select(*SAMPLE_KEY).distinct().count() == everything.count() == 60
    assert asked(calls) == Counter({f"text {k}": 1 for k in range(60)})
    report = {r.finished: r for r in runs(spark, target).collect()}
    assert report[True].asked == report[True].samples == 20 and len(report[True].files) == 2
    assert report[False].tasks == 0


def test_finished_tasks_survive_a_failed_job(spark, samples, tmp_path, calls):
    """Many tasks, one of which breaks: the others' files stay, whole, and no prompt of theirs is asked for again."""
    target, model = f"{tmp_path}/out", failing_model(calls, on="text 59")
    with pytest.raises(Exception, match="the model broke"):
        workflow.run_inference(samples.repartition(12, "doc_id"), model, target, batch_size=3, keep_every=1000)
    before = spark.read.schema("doc_id string").parquet(target).count()
    (Path(calls) / "mended").touch()
    assert workflow.run_inference(samples, model, target, batch_size=3).count() == 60
    counts = asked(calls)
    assert set(counts) == {f"text {k}" for k in range(60)}
    run = [r for r in runs(spark, target).collect() if r.finished]
    assert [r.asked for r in run] == [60 - before]


def test_a_second_attempt_of_a_task_asks_for_the_rest(spark, samples, tmp_path, calls):
    """The writer itself, called twice for one partition as Spark does after a lost executor."""
    from glossmill.sources import answers

    class Attempt:
        def __init__(self, number):
            self.number = number

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.number

    rows = pa.table({"seq": list(range(25)), "prompt": [f'"text {k}"' for k in range(25)]})
    model = failing_model(calls, on="text 13")
    job = answers.Job(f"{tmp_path}/out", "r", Plugin(model), 2, 5, None, None)
    writer, current = answers.AnswerWriter(job), answers.TaskContext.get
    try:
        answers.TaskContext.get = lambda: Attempt(1)
        with pytest.raises(RuntimeError):
            writer.write(iter(rows.to_batches()))
        assert sum(asked(calls).values()) == 12  # two chunks, and a batch of the third
        (Path(calls) / "mended").touch()
        answers.TaskContext.get = lambda: Attempt(2)
        done = writer.write(iter(rows.to_batches(max_chunksize=7)))
    finally:
        answers.TaskContext.get = current
    assert (done.samples, done.asked, len(done.files)) == (25, 15, 5)
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(25))
    assert not [f for f in os.listdir(f"{tmp_path}/out") if f.startswith(".") and not f.endswith(".crc")]


def test_answers_in_a_failed_write_are_not_seen(tmp_path):
    from glossmill.sources.answers import put

    store, folder = opened(str(tmp_path / "x"))

    def broken(out):
        out.write(b"half")
        raise OSError("disk")

    with pytest.raises(OSError):
        put(store, folder, "part-1.parquet", "1", broken)
    assert [f for f in os.listdir(folder) if not f.startswith(".")] == []


def test_without_python_storage_spark_writes_slices(spark, samples, tmp_path, calls, monkeypatch):
    monkeypatch.setattr(workflow, "reachable", lambda path: False)
    out = workflow.run_inference(samples, failing_model(calls), f"{tmp_path}/out", slices=3)
    assert out.count() == 60 and sum(asked(calls).values()) == 60
    assert reachable(f"file://{tmp_path}") and reachable(str(tmp_path)) and not reachable("nowhere://x/y")


def test_no_samples(spark, samples, tmp_path, calls):
    assert workflow.run_inference(samples.limit(0), failing_model(calls), f"{tmp_path}/out").count() == 0
    assert workflow.run_inference(samples, failing_model(calls), f"{tmp_path}/out").count() == 60


@pytest.mark.parametrize("sizes,size", [([], 4), ([0, 0], 4), ([3], 4), ([4], 4), ([9, 0, 1, 7], 4), ([1] * 9, 3)])
def test_chunks_have_one_size(sizes, size):
    rows = iter(range(sum(sizes)))
    batches = [pa.record_batch({"x": pa.array([next(rows) for _ in range(n)], pa.int64())}) for n in sizes]
    out = [t["x"].to_pylist() for t in chunks(iter(batches), size)]
    assert sum(out, []) == list(range(sum(sizes))) and all(len(t) == size for t in out[:-1]) and all(out)


# ---- the caller's tokenizer -------------------------------------------------------------------

def syllables(folder=None):
    """Maker of a tokenizer of three characters a token, white space included, which notes its loads."""

    def make():
        import uuid

        if folder:
            open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        class Syllables:
            def spans(self, texts):
                return [[(i, min(i + 3, len(t))) for i in range(0, len(t), 3)] for t in texts]

            def __call__(self, texts):
                return [[sum(map(ord, t[a:b])) for a, b in s] for t, s in zip(texts, self.spans(texts))]

        return Syllables()

    return make


def echo(folder):
    def make():
        def generate(prompts):
            for p in prompts:
                assert len(p) <= 30, p
            return [json.dumps({"relation": p}) for p in prompts]

        return generate

    return make


def test_prompts_are_cut_at_the_callers_tokens(spark, samples, tmp_path):
    """At exactly ten of its tokens, both when written durably and when streamed through."""
    whole = {r.doc_id: r.prompt for r in with_prompt(samples).select("doc_id", "prompt").collect()}
    durable = workflow.run_inference(samples, echo(""), f"{tmp_path}/out", max_length=10, make_encoder=syllables())
    lazy = predict(with_prompt(samples), echo(""), max_length=10, make_encoder=syllables())
    assert {r.doc_id: r.prediction.relation for r in durable.collect()} == {d: p[:30] for d, p in whole.items()}
    assert {r.doc_id: json.loads(r.raw_text)["relation"] for r in lazy.collect()} == {d: p[:30] for d, p in whole.items()}


def test_a_tokenizer_is_loaded_once_in_each_worker(spark, calls):
    """Over many tasks, two columns and two jobs."""
    rows = spark.range(200).select(F.concat(F.lit("some text "), "id").alias("t")).repartition(16)
    for _ in range(2):
        out = tokenize(with_prompt_length(rows, "t", syllables(calls)), "t", 4, syllables(calls))
        assert out.filter(F.size("input_ids") == 4).count() == 200
    loads = [name.split("-")[1] for name in os.listdir(calls) if name.startswith("load")]
    assert 1 <= len(loads) == len(set(loads))


def test_cut_texts_have_at_most_that_many_tokens(spark):
    texts = ["", None, "ab", "abc", "abcdefghij", "é" * 50, "  spaced  out  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (0, 1, 3):
        got = [r.c for r in df.select("i", clip_by_encoder(F.col("t"), most, syllables()).alias("c")).orderBy("i").collect()]
        assert got == [None if t is None else t[: 3 * most] for t in texts]


def test_an_encoder_without_spans_cannot_cut():
    with pytest.raises(TypeError, match="spans"):
        clipped(lambda texts: [[1] for _ in texts], ["abc"], 1)


def test_a_worker_keeps_few_plugins_and_the_last_used():
    made = []

    def maker(n):
        return lambda: made.append(n) or n

    plugins = [Plugin(maker(n)) for n in range(MOST)]
    assert [p.get() for p in plugins] == list(range(MOST)) and plugins[0].get() == 0
    assert Plugin(maker(99)).get() == 99  # 1 goes, not 0
    assert plugins[0].get() == 0 and made == [*range(MOST), 99]
    assert plugins[1].get() == 1 and made[-1] == 1


def test_a_tokenizer_file(spark):
    public = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    from glossmill.operators.plugins import FileEncoder

    path = public.path("byte_bpe_50k.json")
    texts = ["The patient, aged 54, was given aspirin.", "naïve café 東京", ""]
    plain = Tokenizer.from_file(path)
    encoder = FileEncoder(path)
    assert encoder(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    cut = clipped(encoder, texts, 5)
    assert cut[0] == texts[0][: plain.encode(texts[0], add_special_tokens=False).offsets[4][1]] and cut[2] == ""
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = tokenize(df, "t", 5, lambda: FileEncoder(path)).collect()
    assert [r.input_ids for r in rows] == [ids[:5] for ids in encoder(texts)]
