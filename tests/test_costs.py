"""What is evaluated how often when documents and their pairs are made (F9, F10, F12), and that the short ways give the same rows."""

from pathlib import Path

import pytest
from conftest import record
from pyspark.sql import functions as F

from glossmill.functions.text import PY_WHITESPACE, words
from glossmill.ontology import Ontology
from glossmill.operators.pairs import entity_pairs
from glossmill.operators.standardize import mark_lines, parse_lines, without_empty_ends
from glossmill.sources.jsonl import load_sources

SMALL = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, *values):
    rows = [(0, "s", "auto", "", 0, n, v) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "source_idx int, source string, hint string, file string, block long, seq long, value string")


@pytest.mark.parametrize("parse", [parse_lines, mark_lines])
def test_a_line_is_searched_once_and_parsed_by_compiled_code(spark, parse):
    """The search for empty ends ran three times a line, and the parse was interpreted inside the generator."""
    text = plan(parse(lines(spark, "{}")))
    assert text.count("regexp_replace") == 1
    assert not any("from_json" in line for line in text.splitlines() if "Generate" in line)


def test_the_objects_of_a_subject_are_picked_once(spark, lines_file):
    """Spark's filter on empty lists picked them a second and a third time."""
    docs = load_sources(spark, [(lines_file([record("d", "a b", [("T0", "Test", "a", 0, 0), ("T1", "Problem", "b", 1, 1)])]), "auto")])
    for tasks in (None, 3):
        pairs = entity_pairs(docs, Ontology.default(), tasks=tasks)
        assert plan(pairs).count("lambdafunction((NOT (lambda") == 1
        assert [(r.subj_pos, r.obj_pos) for r in pairs.collect()] == [(0, 1)]


@pytest.mark.skipif(not SMALL.exists(), reason="tables not present")
@pytest.mark.parametrize("name", ["instruction_re_pairwise", "entity_markers", "causal_re_pairwise"])
def test_documents_used_once_are_not_written(spark, name):
    from __spark_entry__ import queries

    text = plan(queries()[name](spark, str(SMALL)))
    assert text.count("FileScan") == 1 and "/documents.parquet" in text and text.count("from_json") == 1


def test_words_of_any_white_space(spark):
    """Text without unusual characters is cut at its blanks; all other text as before."""
    texts = ["", " ", "a", " a b ", "a  b", "é ü ß", "ᙿ a", "中 文", "a​b c", "x~ !", None]
    texts += [f"a{c}b c" for c in PY_WHITESPACE] + [f"{c}a{c}{c}b {c}" for c in PY_WHITESPACE] + [f"{chr(c)} a" for c in range(1, 0x250)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in df.select("i", words(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [None if t is None else t.split() for t in texts]


def test_ends_that_are_not_given(spark):
    """Only lines with an end are searched; ends of any wrong type are still taken out."""
    given = ['{"relations":[{"subject_id":0,"object_id" : {} }]}', '{"object_id":false}', '{"id":0}', '{"subject_id":"0"}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r.v for r in df.select("i", without_empty_ends(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == ['{"relations":[{"subject_id":null,"object_id" : null }]}', '{"object_id":null}', *given[2:]]


def test_pairs_without_and_with_an_ontology(spark, lines_file):
    """Records without a pair drop out early; all others keep every pair, repeated labels and relations included."""
    ents = [("T0", "Problem", "a", 0, 0), ("T1", "UNKNOWN", "b", 1, 1), ("T2", "Problem", "c", 2, 2), ("T3", "Test", "d", 3, 3)]
    records = [record("none", "a b"), record("one", "a", ents[:1]), record("tests", "a d", [ents[3], ents[3]]), record("all", "a b c d", ents, [("PIP", "T0", "T2")])]
    docs = load_sources(spark, [(lines_file(records), "auto")])
    every = sorted((r.doc_id, r.subj_pos, r.obj_pos) for r in entity_pairs(docs).collect())
    assert every == [("all", i, j) for i in range(4) for j in range(4) if i != j] + [("tests", 0, 1), ("tests", 1, 0)]
    allowed = sorted((r.doc_id, r.subj_pos, r.obj_pos, len(r.subject_relations)) for r in entity_pairs(docs, Ontology.default()).collect())
    assert allowed == [("all", 0, 2, 1), ("all", 2, 0, 0), ("all", 3, 0, 0), ("all", 3, 2, 0)]


def test_marked_sentences_of_every_two_spans(spark):
    """Spans that lie apart are joined without a copy of the words per tag; all others as Python's list.insert does it."""
    from glossmill.functions.spans import insert_markers

    sentence = ["a", "b", "c", "d"]
    spans = [(s, e) for s in (-1, 0, 1, 3, 5) for e in (-1, 0, 2, 3, 4)]
    rows = [(n, sentence[:n], x, y) for n in (0, 1, 4) for x in spans for y in spans]
    span = "struct<start_token_idx:int,end_token_idx:int>"
    df = spark.createDataFrame(rows, f"n int, words array<string>, x {span}, y {span}")
    marked = df.select("*", insert_markers(F.col("words"), F.col("x"), F.col("y")).alias("m"))
    assert "concat_ws" in plan(marked)

    def expected(words, x, y):
        both = [(x, "<e1>", "</e1>"), (y, "<e2>", "</e2>")]
        for (start, end), opened, closed in both if x[0] >= y[0] else both[::-1]:
            if start >= 0 and end >= 0:
                words.insert(end + 1, closed)
                words.insert(start, opened)
        return " ".join(words)

    assert all(r.m == expected(list(r.words), tuple(r.x), tuple(r.y)) for r in marked.collect())
