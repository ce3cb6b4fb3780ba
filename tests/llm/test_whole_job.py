"""Inputs on which an operator once did less than its whole job."""
from collections import Counter

import numpy as np

from glossmill.llm import fm_index, induced, outlier_rules, simhash, superkmers, wrapper_pages
from glossmill.llm.common import keyed
from llm_tables import awkward, make_docs, sample  # noqa: F401


# SimHash


def test_one_of_each_with_null_and_repeated_ids(make_docs):
    prose = lambda seed: " ".join(f"w{(seed * 7919 + i * i * (seed + 3)) % 1009}" for i in range(80))
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (None, prose(3)), (7, prose(4)), (7, prose(5)), (8, prose(5)),
            (9, prose(6)), (9, prose(6)), (None, prose(6)), (None, None), (7, "")]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE:
                group = [group[j] if g == group[i] else g for g in group]
    best = [min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)]
    kept = simhash.one_of_each(make_docs(rows)).collect()
    assert len(set(group)) == 7
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == Counter(best)
    left = {simhash.fingerprint((r["text"] or "").encode()) for r in kept}
    assert left == set(prints)


# Pages


def texts_of(*pages):
    return ["\n".join(wrapper_pages.content(tree, 3)) for tree in wrapper_pages.induced(list(pages))]


def test_articles_that_are_comments_or_cards_do_not_hide_the_body():
    body = "<div class='story'><p>The body of the page.</p></div>"
    assert texts_of(f"{body}<article class='comment'><p>first!</article>") == ["The body of the page."]
    assert texts_of(f"{body}<div class='related'><article><p>other</article></div>") == ["The body of the page."]
    assert "The body of the page." in texts_of(f"{body}<article class='card'><p>more</article>")[0]
    assert "The body of the page." in texts_of(f"{body}<article><p>a</article><article><p>b</article>")[0]


def test_named_parts_of_an_article_stay():
    page = "<article><h1>T</h1><h2 id='related-work'>Related</h2><p>x</p><section id='discussion'><p>y</p></section><div id='comments'>z</div></article>"
    assert texts_of(page) == ["T\nRelated\nx\ny"]
    assert texts_of("<article class='post tags-news'><p>Whole text.</article><p>out") == ["Whole text."]


def test_varying_slots_count_outside_the_article():
    pages = [f"<title>{i}</title><p>Daily paper</p><div class='lead'><p>Lead {i}</p></div><article><p>Text {i}</p></article>" for i in range(4)]
    assert texts_of(*pages) == [f"Lead {i}\nText {i}" for i in range(4)]
    assert texts_of(pages[0]) == ["Text 0"]


def test_form_around_the_page():
    assert texts_of("<form><div><p>The whole page stands in a form.</div></form><p>end") == ["The whole page stands in a form.\nend"]
    assert texts_of("<p>A page with a body of some length.<form><p>Your name</p><button>Send</button></form>") == ["A page with a body of some length."]


def test_deep_pages():
    deep = lambda text: f"<title>{text}</title>" + "<div>" * 5000 + f"<p>{text}<p>All rights reserved"
    assert texts_of(*map(deep, "abc")) == ["a", "b", "c"]


def test_long_lists_of_siblings():
    def page(name, n):
        return f"<title>{name}</title><ul><li>start</ul>" + "".join(f"<h2>{name} {i}</h2><p>text {name} {i}" for i in range(n)) + "<div>The same end</div>"

    blocks = lambda name, n: "\n".join(f"{name} {i}\ntext {name} {i}" for i in range(n))
    assert texts_of(page("a", 10000), page("b", 10000), page("c", 9500)) == [blocks("a", 10000), blocks("b", 10000), blocks("c", 9500)]


def test_blocks_of_unlike_siblings():
    """Nothing is lost where neither beginnings nor ends are equal."""
    tags = ["h2", "p", "div", "ul"]

    def page(name, step):
        return f"<title>{name}</title>" + "".join(f"<{tags[i * step % 7 % 4]}>{name} {i}</{tags[i * step % 7 % 4]}>" for i in range(1500))

    assert texts_of(*(page(n, k) for n, k in (("a", 1), ("b", 3), ("c", 5)))) == ["\n".join(f"{n} {i}" for i in range(1500)) for n in "abc"]


# Rows that repeat a document in full


def test_stretches_do_not_grow_with_the_copies(make_docs):
    text = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"word{i}" for i in range(250, 500))
    for find in (superkmers.repeated_word_stretches, induced.repeated_byte_stretches):
        most = lambda n: max(len(r["stretches"]) for r in find(keyed(make_docs([(1, text)] * n + [(2, other)]))).collect())
        assert most(40) == most(2) > 0


def test_hits_of_blocks_do_not_grow_with_the_copies(spark, make_docs, monkeypatch):
    seen, plain = [], fm_index.appended

    def watched(df, results, of_batches, drop=()):
        if "all_spans" in df.columns:
            seen.append(max(len(r["all_spans"]) for r in df.select("all_spans").collect()))
        return plain(df, results, of_batches, drop)

    monkeypatch.setattr(fm_index, "appended", watched)
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i}") for i in range(6)], "item_id long, text string")
    text = " and ".join(f"alpha{i} beta{i} gamma{i}" for i in range(6))
    rows = fm_index.decontaminate(make_docs([(1, text)] * 40), items, block_bytes=30).collect()
    assert seen == [6] and len(rows) == 40 and {(r["n_hit"], r["n_items"]) for r in rows} == {(18, 6)}


# Rules


def test_outliers_in_each_single_statistic(make_docs):
    rng = np.random.default_rng(5)
    word = lambda least=2, most=8: "".join(rng.choice(list("abcdefghij"), rng.integers(least, most)))
    words = lambda n, *sizes: [word(*sizes) for _ in range(n)]
    rows = [(i, " ".join(words(rng.integers(80, 200)))) for i in range(200)]
    for i in range(3):
        lines = [" ".join(words(2, 4, 8)) for _ in range(20)]
        once = words(20, 4, 8)
        planted = [
            " ".join(words(8000)), " ".join(words(120, 14, 18)), " ".join(words(120)) + " #" * 40,
            "\n".join(x for _ in range(5) for x in rng.permutation(lines)),
            " ".join(words(55, 4, 8) + once + words(3, 4, 8) + once),
        ]
        rows += [(1000 + 10 * i + k, text) for k, text in enumerate(planted)]
    found = {r["doc_id"]: r for r in outlier_rules.outlier_rules(make_docs(rows)).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert all(found[i]["kept"] for i in range(200))
    assert not [i for i, r in found.items() if i >= 1000 and r["kept"]]
