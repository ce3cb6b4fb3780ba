"""Bounded samples, racing committers, very long texts and crowded index entries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import *  # noqa: F403
from pyspark.sql import functions as F

from glossmill.llm import byte_cnn, language_codes, simhash, token_rollups, windows
from glossmill.llm.components import components
from glossmill.llm.induced import suffix_dedup
from glossmill.llm.superkmers import substring_dedup

# Rollups


def changes(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer_version string, n_tokens long, sign int, n_docs string")


def test_one_of_two_racing_committers_wins(spark, tmp_path, monkeypatch):
    """Both have seen that the batch is not there; the second finds the commit file made and takes its folder back."""
    store = token_rollups.RollupStore(spark, f"{tmp_path}/store")
    assert store.commit("7", changes(spark, [("s", "en", "v", 5, 1, "x")]))
    plain, asked = store._files, []

    class Files:
        def __init__(self, real):
            self.real = real

        def exists(self, path):
            asked.append(path)
            return self.real.exists(path) if len(asked) > 1 else False

        def __getattr__(self, name):
            return getattr(self.real, name)

    def racing():
        path, files = plain()
        return path, Files(files)

    monkeypatch.setattr(store, "_files", racing)
    assert not store.commit("7", changes(spark, [("s", "en", "v", 5, 1, "x")]))
    monkeypatch.setattr(store, "_files", plain)
    assert len(asked) > 1 and len(store.committed()) == 1 and len(list((tmp_path / "store").glob("batch-*"))) == 1
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 5)]


def test_tokens_that_do_not_cancel_are_seen(spark, tmp_path):
    store = token_rollups.RollupStore(spark, f"{tmp_path}/store")
    store.commit("1", changes(spark, [("a", "en", "v", 5, 1, ""), ("b", "en", "v", 5, 1, "")]))
    store.commit("2", changes(spark, [("a", "en", "v", 5, -1, ""), ("b", "en", "v", 3, -1, "")]))
    assert [tuple(r) for r in store.totals().collect()] == [("b", "en", "v", 0, 2)]


def test_a_commit_has_no_step_in_one_task(spark, tmp_path, monkeypatch):
    """The sums leave as they were shuffled: by several tasks, if there is much of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_rollups.RollupStore(spark, f"{tmp_path}/store")
        store.commit("1", changes(spark, [(f"s{i}", "en", "v", 1, 1, "") for i in range(200)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "store").glob("batch-1-*/part-*.parquet"))) > 1 and store.totals().count() == 200


# Samples


def test_the_language_sample_is_bounded_in_all(make_docs):
    docs = make_docs([(k, f"text {k}", f"l{k % 400}", "s") for k in range(12_000)])
    few = language_codes.labelled_sample(docs, 300, 1000, 1 << 15).count()
    assert 800 < few < 1200
    many = language_codes.labelled_sample(docs.withColumn("lang", F.lit("en")), 300, 1000, 1 << 15).count()
    assert 230 < many < 370


def test_many_languages_are_learned(make_docs):
    """More of them than bits; the sample then has few texts of each."""
    rng = np.random.default_rng(2)
    alphabets = ["".join(rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:6]) for _ in range(70)]
    text = lambda k: " ".join("".join(rng.choice(list(alphabets[k]), 5)) for _ in range(40))
    docs = make_docs([(i, text(i % 70), f"l{i % 70}", "s") for i in range(1400)])
    rows = language_codes.languages(docs, most=700).filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.8


def test_the_quality_sample_is_met_from_both_sides(spark, make_docs):
    """Long, missing and repeated documents do not use up its places."""
    docs = make_docs([(i, "x" * (50_000 if i % 4 else 10) + str(i)) for i in range(800)] + [(i, f"again {i}") for i in range(0, 800, 4)])
    labels = spark.createDataFrame([(i, i % 8 // 4, 0) for i in range(1600)] * 2, "doc_id long, quality int, toxic int")
    rows = byte_cnn.labelled_sample(docs, labels, 30, 1 << 15).collect()
    assert Counter(r["quality"] for r in rows) == {0: 30, 1: 30} and len({r["doc_id"] for r in rows}) == 60
    assert all(r["text"] == f"again {r['doc_id']}" for r in rows)
    everything = byte_cnn.labelled_sample(docs, labels, 10**6, 1 << 15).collect()
    assert len(everything) == len({r["doc_id"] for r in everything}) > 100


# Very long texts


@pytest.mark.parametrize("block", [1, 7, 64])
def test_runs_of_any_block_cover_every_window_once(monkeypatch, block):
    """And give each window the minimiser that it has in one block."""
    units = np.random.default_rng(0).integers(0, 50, 900).astype(np.uint64)
    whole_first, whole_end, whole = windows.runs_of(units, 30, 8)
    monkeypatch.setattr(windows, "BLOCK", block)
    first, end, least = windows.runs_of(units, 30, 8)
    assert first[0] == 0 and end[-1] == 871 and (first[1:] == end[:-1]).all()
    assert (np.repeat(least, end - first) == np.repeat(whole, whole_end - whole_first)).all()


def test_bytes_repeated_far_inside_a_long_text(make_docs):
    """Beyond the first block of a text and across its border."""
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefghijklmnop"), 700_000))
    border = windows.BLOCK
    parts = [(600_000, 600_900), (border - 300, border + 250), (690_000, 690_399)]
    other = "|".join(long[a:b] for a, b in parts) + "|"
    out = {r["doc_id"]: r for r in suffix_dedup(make_docs([(1, long), (2, other)])).collect()}
    assert (out[1]["n_removed"], out[1]["n_spans"]) == (900 + 550, 2) and out[2]["n_removed"] == 900 + 550
    left = long[: border - 300] + long[border + 250 : 600_000] + long[600_900:]
    assert out[1]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_words_repeated_far_inside_a_long_text(make_docs):
    rng = np.random.default_rng(7)
    words = [f"{x:x}" for x in rng.integers(0, 10**9, 560_000)]
    border = windows.BLOCK
    parts = [(550_000, 550_100), (border - 20, border + 30), (540_000, 540_034)]
    other = [w for k, (a, b) in enumerate(parts) for w in [*words[a:b], f"end{k}"]]
    out = {r["doc_id"]: r for r in substring_dedup(make_docs([(1, " ".join(words)), (2, " ".join(other))])).collect()}
    assert out[1]["n_words"] == 560_000 and out[1]["n_removed"] == out[2]["n_removed"] == 150
    left = words[: border - 20] + words[border + 30 : 550_000] + words[550_100:]
    assert out[1]["kept_sha256"] == hashlib.sha256(" ".join(left).encode()).hexdigest()


# A crowded index entry


def test_an_entry_of_many_near_fingerprints(spark):
    """A thousand fingerprints that differ in ten bits of one half segment, so all share entries at both levels."""
    fps = spark.range(1 << 10).select(F.expr("shiftleft(id, 32)").alias("fp"))
    links = simhash.near_links(fps, crowd=64)
    assert components(links).filter("root = 0").count() == (1 << 10) - 1
