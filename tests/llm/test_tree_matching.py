"""Simple tree matching against a plain recursive model, in blocks of any size, and pages that repeat."""

import random
import time

import pytest
from llm_tables import *  # noqa: F403
from pyspark.sql import functions as F, types as T

from glossmill.llm import wrapper_pages as wp


def random_tree(kind, rng, depth):
    label = ("div", rng.choice("abc"))
    node = wp.Slot(label) if kind is wp.Slot else wp.Row(label, [])
    below = [random_tree(kind, rng, depth - 1) for _ in range(rng.randint(0, 5) if depth else 0)]
    if kind is wp.Slot:
        node.children = below
    else:
        node.rows = below
    return node


def plain(slots, rows):
    """Most matched nodes of two ordered lists."""
    best = [[0] * (len(rows) + 1) for _ in range(len(slots) + 1)]
    for i, s in enumerate(slots):
        for j, r in enumerate(rows):
            pair = best[i][j] + 1 + plain(s.children, r.rows) if s.label == r.label else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], pair)
    return best[-1][-1]


def counted(pairs, slots, rows):
    """Number of matched nodes; every pair is of equal labels, from these lists, and in order."""
    places = [(next(i for i, x in enumerate(slots) if x is s), next(j for j, x in enumerate(rows) if x is r)) for s, r, _ in pairs]
    assert all(a < c and b < d for (a, b), (c, d) in zip(places, places[1:])) and all(s.label == r.label for s, r, _ in pairs)
    return sum(1 + counted(below, s.children, r.rows) for s, r, below in pairs)


@pytest.mark.parametrize("most", [1, 4, 30, 1 << 16])
@pytest.mark.parametrize("seed", range(8))
def test_matching_is_the_best_one(seed, most, monkeypatch):
    monkeypatch.setattr(wp, "MOST_PAIRS", most)
    rng = random.Random(seed)
    for _ in range(6):
        slots = [random_tree(wp.Slot, rng, 2) for _ in range(rng.randint(0, 9))]
        rows = [random_tree(wp.Row, rng, 2) for _ in range(rng.randint(0, 9))]
        score, pairs = wp.matching(slots, rows)
        assert score == plain(slots, rows) == counted(pairs, slots, rows)


def test_a_far_match_among_ten_thousand_unlike_siblings():
    slots = [wp.Slot(("p", f"a{i}")) for i in range(10_000)]
    rows = [wp.Row(("p", f"b{i}"), []) for i in range(10_000)]
    slots[10], rows[9990] = wp.Slot(("div", "same")), wp.Row(("div", "same"), [])
    began = time.time()
    score, pairs = wp.matching(slots, rows)
    assert score == 1 and [(s.label, r is rows[9990]) for s, r, _ in pairs] == [(("div", "same"), True)]
    assert time.time() - began < 60


def test_links_count_at_any_depth():
    page = lambda link: f"<p>Text that is no link at all.</p><div>{link}</div>"
    text = lambda html: "\n".join(wp.content(wp.induced([html])[0], 3))
    assert text(page("<a href='x'>Menu link text</a>")) == "Text that is no link at all."
    assert text(page("<a href='x'>" + "<span>" * 9 + "Menu link text" + "</span>" * 9 + "</a>")) == "Text that is no link at all."
    # An anchor is no link, a link ends the one before it and with the block it stands in, and what follows is text.
    assert text("<a name='top'><p>All of the text stands behind an anchor.") == "All of the text stands behind an anchor."
    assert text("<div><a href='x'>link<a href='y'>link</div><p>Text behind it.") == "Text behind it."


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_copies_of_a_page_are_read_once(spark):
    """Five thousand rows of one page stand in a group once, and each has its text."""
    page = lambda i: f"<title>{i}</title><p>Daily paper</p><article><p>Text {i}</p></article>"
    rows = [(1, "http://h/1", page(1))] * 5000 + [(i, f"http://h/{i}", page(i)) for i in range(2, 40)] + [(7, None, None)] * 3
    df = spark.createDataFrame(rows, PAGES)
    plan = wp.main_texts(df.withColumns({c: F.lit("x") for c in ("host", "page", "groups", "copies", "dealt", "text")}))
    out = plan.collect()
    assert len(out) == len(rows) and sum(r.page_id == 1 for r in out) == 5000
    assert {(r.page_id, r.url, r.text) for r in out} == {(i, f"http://h/{i}", f"Text {i}") for i in range(1, 40)} | {(7, None, "")}


def test_equal_pages_under_many_ids(spark):
    html = "<title>t</title><article><p>Same text</article>"
    df = spark.createDataFrame([(i, f"http://h/{i}", html) for i in range(300)], PAGES)
    assert {r.text for r in wp.main_texts(df).collect()} == {"Same text"}
