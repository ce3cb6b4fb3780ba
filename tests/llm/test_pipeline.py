"""Each stage of the pipeline against a plain model of what it has to do to its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import awkward, make_docs, sample  # noqa: F401
from pyspark.sql import functions as F
from test_other_operators import near_groups

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_quality_stage(spark, stages):
    """Labelled documents that were not learned from go or stay as their label says; nothing else about a row changes.

    On the larger table, since the smallest has eleven bad labels in all.
    """
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = set(ids(corpus_pipeline.good_quality(spark, docs, folder)))
    labels = docs.select("doc_id").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    fresh = [(r["doc_id"] in kept, r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(fresh) > 80 and sum(k == q for k, q in fresh) / len(fresh) > 0.93
    assert stages[1].exceptAll(stages[0]).count() == 0 and 0 < stages[1].count() < stages[0].count()


def test_near_dedup_stage(stages):
    """All pairs of fingerprints: the least document of each group stays, as it was."""
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted({least for _, _, least in near_groups(rows)})
    assert stages[2].exceptAll(stages[1]).count() == 0


def test_repeat_stage(stages):
    """All windows of the stage's length, counted as they stand in its input."""
    window, before = corpus_pipeline.REPEAT_BYTES, texts(stages[2])
    seen = Counter(t[i : i + window] for t in (x.encode() for x in before.values()) for i in range(len(t) - window + 1))
    expected = {}
    for doc_id, text in before.items():
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if seen[data[i : i + window]] > 1:
                gone[i : i + window] = True
        expected[doc_id] = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
    assert texts(stages[3]) == expected and expected != before
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_repeated_passages_of_over_fifty_words_go(spark, make_docs):
    """Whatever their words: of a passage in several documents nothing is left, and the text around it stays."""
    rng = np.random.default_rng(4)
    fresh = iter(range(10**6))
    own = lambda n: " ".join(f"own{next(fresh)}" for _ in range(n))
    passages = [" ".join("".join(rng.choice(list("abcdefghijklm"), rng.integers(3, most))) for _ in range(n)) for n, most in ((51, 7), (60, 9), (120, 12))]
    rows = [(10 * k + j, f"{own(40)}\n{p}\n{own(30)}") for k, p in enumerate(passages) for j in range(3)]
    out = texts(corpus_pipeline.without_repeats(spark, make_docs(rows), FOLDER))
    for doc_id, text in rows:
        before, passage, behind = text.split("\n")
        assert passage not in out[doc_id] and len(out[doc_id]) <= len(before) + len(behind) + 2
        assert before[:-8] in out[doc_id] and behind[8:] in out[doc_id]


def test_benchmark_stage(spark, stages):
    """No window of ten benchmark words is left, and all words that stood in none are."""
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    expected = {}
    for doc_id, text in texts(stages[3]).items():
        w = words(text)
        hit = {k for size in sizes for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for k in range(i, i + size)}
        expected[doc_id] = [x for k, x in enumerate(w) if k not in hit]
    assert {d: words(t) for d, t in texts(stages[4]).items()} == expected


def test_packing_stage_and_run(spark, stages):
    assert ids(stages[4]) == sorted(set(ids(stages[5])))
    rows = [(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert sorted(rows) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[5].collect())
    used = Counter()
    for r in stages[5].collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) <= 1 + 1.02 * sum(used.values()) / 2048


@pytest.mark.parametrize("number", range(5))
def test_awkward_rows_and_clashing_columns(spark, awkward, number):
    docs = awkward.withColumns({c: F.lit(7) for c in ("score", "kept", "spans", "row_k1", "stretches", "fp", "clean", "n_words")})
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, FOLDER)
    rows = out.collect()
    if number < 4:
        assert out.columns == docs.columns
        assert all(r["score"] == r["kept"] == r["row_k1"] == r["clean"] == 7 for r in rows)
    stage(spark, docs.limit(0), FOLDER).collect()
