import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from glossmill.llm.fm_index import FMIndex, WaveletMatrix, decontaminate, op1_fm_index_decontamination
from llm_tables import awkward, make_docs, sample  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item) if item is not None else "")
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in windows}:
            for i in range(len(w) - size + 1):
                p = tuple(w[i : i + size])
                if p in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[p]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
TEST = "alpha Beta gamma-delta épsilon zeta eta theta iota kappa lambda mu nu"
DOCS = [
    (1, f"x {TEST.upper().replace('É', 'é')} y"), (2, "short item here"), (3, None), (4, ""), (5, TEST + " " + TEST),
    (6, "alpha beta gamma delta épsilon zeta eta theta iota"), (7, "Short-Item, HERE! twice short item here"), (8, "..."),
]
BENCH = [(1, TEST), (2, "short item here"), (12, "Short item here"), (3, None), (4, "!?"), (None, "twice")]


@pytest.mark.parametrize("more", [{}, {"block_bytes": 20, "shard_bytes": 40}])
def test_against_all_windows(spark, make_docs, more):
    found = decontaminate(make_docs(DOCS), spark.createDataFrame(BENCH, ITEMS), **more).select(COLUMNS)
    assert sorted(tuple(r) for r in found.collect()) == expected(DOCS, BENCH)


def test_clean_text_keeps_the_rest(spark, make_docs):
    found = decontaminate(make_docs(DOCS), spark.createDataFrame(BENCH, ITEMS), with_text=True)
    clean = {r["doc_id"]: r["clean"] for r in found.collect()}
    assert clean[1] == "x  y" and clean[4] == "" and clean[6] == DOCS[5][1]
    assert "source" in found.columns


def test_no_items_and_no_documents(spark, make_docs, awkward):
    none = spark.createDataFrame([], ITEMS)
    rows = [r.asDict() for r in decontaminate(awkward, none).collect()]
    assert len(rows) == 13 and not any(r["contaminated"] for r in rows)
    assert {r["items_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert decontaminate(make_docs([]), none).count() == 0


def test_query_on_the_whole_table(spark, sample):
    docs = [(r["doc_id"], r["text"]) for r in sample("documents").collect()]
    items = [(r["item_id"], r["text"]) for r in sample("benchmark").collect()]
    found = op1_fm_index_decontamination(spark, "/root/testdata/sf0.001").select(COLUMNS)
    assert sorted(tuple(r) for r in found.collect()) == expected(docs, items)


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = FMIndex(text, 5)
    for size in (1, 2, 3, 6):
        phrase = text[50 : 50 + size]
        lo, hi = index.search(phrase[None, :], np.array([size]))
        at = [i for i in range(401 - size + 1) if (text[i : i + size] == phrase).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == at


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 11, 300)
    matrix = WaveletMatrix(symbols, 11)
    for place in (0, 1, 63, 64, 65, 299, 300):
        ranks = matrix.rank(np.arange(11), np.full(11, place))
        assert ranks.tolist() == [int((symbols[:place] == s).sum()) for s in range(11)]
