import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossmill.llm import byte_cnn, language_codes, outlier_rules, packing, simhash, token_rollups, wrapper_pages
from glossmill.llm.components import components
from glossmill.llm.token_ids import byte_bpe_50k, ids_of
from llm_tables import awkward, make_docs, sample  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# Token ids and packing


def test_ids_equal_the_tokenizers_library(sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [r["text"] for r in sample("documents").collect()] + ["", " ", "a  b\n\n c\t", "\x1f é🙂<|endoftext|> 's", "\xa0x  y"]
    for text in texts:
        assert ids_of(text, *byte_bpe_50k()).tolist() == other.encode(text, add_special_tokens=False).ids


def check_layout(rows, texts, capacity):
    ids = collections.defaultdict(list)
    for doc_id, text in texts:
        ids[doc_id].append([*ids_of(text, *byte_bpe_50k()).tolist(), 0])
    sequences, tokens = collections.defaultdict(list), collections.Counter()
    for r in rows:
        cut = [x[r["start"] : r["start"] + r["length"]] for x in ids[r["doc_id"]]]
        assert r["ids_crc32"] in [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
        assert r["length"] <= capacity and (r["piece"] == 0 or r["length"] == capacity)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {k: sum(map(len, v)) for k, v in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(tokens.values()) // capacity)


@pytest.mark.parametrize("more", [{}, {"most_items": 20, "fan_in": 2}])
def test_packing_round_trip(sample, more):
    docs = sample("documents")
    rows = packing.packed(packing.pieces(docs), **more).collect()
    used, least = check_layout(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert used <= least + (1 if not more else least // 10)


def test_packing_awkward_rows(awkward, make_docs):
    rows = packing.packed(packing.pieces(awkward.withColumnRenamed("lang", "length"))).collect()
    check_layout(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()], 2048)
    assert packing.packed(packing.pieces(make_docs([]))).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_takes_the_fullest_bin(seed):
    sizes = np.random.default_rng(seed).integers(1, 100, 60)
    spaces = []
    for size in sorted(sizes.tolist(), reverse=True):
        fitting = [s for s in spaces if s >= size]
        if fitting:
            spaces.remove(min(fitting))
        spaces.append((min(fitting) if fitting else 100) - size)
    bins = packing.best_fit(sizes, 100)
    assert sorted(100 - sum(sizes[i] for i in b) for b in bins) == sorted(spaces)


# SimHash


def near_groups(rows):
    prints = []
    for _, text in rows:
        w = SPACE.findall((text or "").translate(LOWER))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0] if r[0] is not None else -1, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group)), key=str)


@pytest.mark.parametrize("crowd", [1, 2048])
def test_near_duplicates_against_all_pairs(sample, awkward, crowd):
    docs = sample("documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    base = docs.filter("doc_id = 20").withColumn("text", F.concat("text", F.lit(" and more")))
    docs = docs.unionByName(base.withColumn("doc_id", F.lit(9999)))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = simhash.near_duplicates(docs, crowd=crowd).na.fill(-1, ["doc_id"]).select("doc_id", "fingerprint", "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == near_groups(rows)


def test_one_of_each_keeps_columns_and_one_row(awkward):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    groups = {g for _, _, g in near_groups([(r["doc_id"], r["text"]) for r in awkward.collect()])}
    assert kept.count() == len(groups) and {r["doc_id"] for r in kept.collect()} == groups


def test_crowded_entries_are_linked(spark):
    """A crowd around one fingerprint: all within one bit of it, so one component, by either index."""
    fps = spark.range(64).selectExpr("shiftleft(1L, cast(id as int)) as fp")
    links = simhash.near_links(fps.union(spark.sql("select 0L")), crowd=4)
    assert components(links).filter("node != root").count() == 64


def test_components_of_a_path_and_a_star(spark):
    path = spark.range(1, 60).selectExpr("id as a", "id + 1 as b")
    star = spark.range(201, 260).selectExpr("id as a", "200L as b")
    found = {r["node"]: r["root"] for r in components(path.union(star)).collect()}
    assert all(found[n] == 1 for n in range(2, 61)) and all(found[n] == 200 for n in range(201, 260))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Rules


def counts_of(text):
    w = SPACE.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat))


def test_rule_counts_against_plain_python(sample, awkward, make_docs):
    docs = sample("documents").select("doc_id", "text", "lang", "source").unionByName(awkward.select("doc_id", "text", "lang", "source"))
    rows = outlier_rules.outlier_rules(docs).collect()
    key = lambda i: -1 if i is None else i
    expect = sorted((key(r["doc_id"]), *counts_of(r["text"])) for r in docs.collect())
    assert sorted((key(r["doc_id"]), *(r[c] for c in outlier_rules.COUNTS)) for r in rows) == expect
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert outlier_rules.outlier_rules(make_docs([])).count() == 0


def test_outliers_go_and_clean_documents_stay(make_docs):
    rng = np.random.default_rng(0)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 8))) for _ in range(rng.integers(80, 200)))
    rows = [(i, prose()) for i in range(200)] + [(1000 + i, " | ".join(prose().split())) for i in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in outlier_rules.outlier_rules(make_docs(rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(20))


def test_rules_run_no_python(sample):
    plan = outlier_rules.outlier_rules(sample("documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Classifiers


def test_quality_on_held_out_labels(spark, sample):
    docs, labels = sample("documents"), sample("labels")
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = byte_cnn.quality_scores(wide, marks).join(marks, "doc_id").filter("held_out").collect()
    right = [(r["predicted"] == r["quality"]) for r in rows]
    assert len(right) > 80 and sum(right) / len(right) > 0.93
    again = byte_cnn.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in again} == {0.5} and len(again) == docs.count()


def test_quality_of_awkward_rows(awkward, sample):
    scored = byte_cnn.quality_scores(awkward.withColumnRenamed("lang", "score"), sample("labels")).collect()
    assert len(scored) == awkward.count() and all(0 <= r["score"] <= 1 for r in scored)
    same = [r["score"] for r in scored if r["doc_id"] in (1, 2)]
    assert same[0] == same[1]


def test_pooling_covers_the_last_byte():
    net = byte_cnn.fit([b"good", b"bad"], [1, 0], epochs=1)
    whole = b"a" * 100_000
    assert not np.allclose(net.pooled(whole), net.pooled(whole + b"!"))
    best, place = net.pooled_places(whole + b"!")
    assert np.allclose(best, net.pooled(whole + b"!")) and place.max() <= 100_001


def test_held_out_rows(spark):
    rows = spark.range(50).select("id", byte_cnn.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_language_on_held_out_documents(spark, make_docs, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in language_codes.languages(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    odd = {r["doc_id"]: r["lang_pred"] for r in language_codes.languages(awkward).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[4] == "en"
    none = language_codes.languages(make_docs([(1, "text", None, "s"), (2, "more", None, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


@pytest.mark.parametrize("languages", [2, 4, 6, 9, 30])
def test_codewords_are_apart(languages):
    code = language_codes.codewords(languages)
    apart = [(code[i] != code[j]).sum() for i in range(languages) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4)


# Rollups


def test_rollups_against_plain_sums(spark, tmp_path, make_docs):
    docs = make_docs([(1, "a b c"), (2, "d"), (3, None, None, None), (4, "e f", "fr", "t"), (4, "e f", "fr", "t")])
    counts = token_rollups.counted(docs, "v1")
    store = token_rollups.RollupStore(spark, f"{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("1", token_rollups.inserts(counts)) and not store.commit("1", token_rollups.inserts(counts))
    total = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}
    assert total() == {("s", "en", "v1"): (2, 4), (None, None, "v1"): (1, 0), ("t", "fr", "v1"): (2, 4)}
    old = counts.filter("doc_id = 1")
    assert store.commit("2", token_rollups.revisions(old, old.withColumn("n_tokens", F.lit(10))))
    assert store.commit("3", token_rollups.deletes(counts.filter("doc_id = 4")))
    assert store.commit("4", token_rollups.inserts(counts.limit(0)))
    assert total() == {("s", "en", "v1"): (2, 11), (None, None, "v1"): (1, 0)}


def test_unfinished_batch_does_not_count(spark, tmp_path, make_docs):
    store = token_rollups.RollupStore(spark, f"{tmp_path}/store")
    counts = token_rollups.counted(make_docs([(1, "a")]), "v1")
    token_rollups.inserts(counts).write.parquet(f"{tmp_path}/store/batch-9")
    (tmp_path / "store" / "batch-9" / "_SUCCESS").unlink()
    assert store.totals().count() == 0
    assert store.commit("9", token_rollups.inserts(counts)) and store.totals().first()["n_docs"] == 1


# Pages


def page(body, title):
    return f"<html><head><title>{title}</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def site():
    rows = []
    for i in range(6):
        body = (
            f"<div id='top'><p>Acme daily</p><p>{'x' * i}Issue {i}</p></div><nav><a href='/{i}'>link {i}</a></nav>"
            f"<div class='story'><h2>Story {i}</h2><p>Text &amp; more {i}<p>Second\n  line {i}<p>All rights reserved</div>"
            f"<div class='reader-comments'><p>first! {i}</div><footer>Foot {i}</footer>")
        rows.append((i, f"https://acme.example/{i}", page(body, f"t{i}")))
    return rows


def test_constant_nodes_are_template(spark, site):
    pages = spark.createDataFrame(site, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in wrapper_pages.main_texts(pages).collect()}
    assert found[2] == "xxIssue 2\nStory 2\nText & more 2\nSecond line 2"


def test_a_page_alone_is_judged_by_its_elements(spark, site):
    pages = spark.createDataFrame(site[:1], "page_id long, url string, html string")
    assert wrapper_pages.main_texts(pages).first()["text"] == "Acme daily\nIssue 0\nStory 0\nText & more 0\nSecond line 0\nAll rights reserved"


def test_awkward_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "http://h/", "plain <b>bold</b> text"), (4, "http://h/", "<p>a<br>b<p>c&nbsp; d &copy &am"),
        (5, "odd", "<article><h1>T</h1><p><b>x<br><p>y</article><p>out"), (5, "odd", "<article><h1>T</h1><p><b>x<br><p>y</article><p>out"),
        (6, "http://h/", "<div " * 50), (None, "http://h/", "</p></div>stray<script>never closed"),
        (7, "http://h/", "<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>"), (8, "http://h/", "<div>" * 300 + "deep"),
    ]
    found = wrapper_pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 10
    assert text[1] == text[2] == "" and text[3] == "plain bold text" and text[4] == "a\nb\nc d © &am"
    assert text[5] == "T\nx\ny" and text[None] == "stray" and text[7] == "a\nb\nc d\ne" and text[8] == "deep"


def test_whole_table_against_the_article_element(spark, sample):
    import html

    def article(page):
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:h1|p|br)>", inner))
        return "\n".join(b for b in blocks if b)

    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrapper_pages.op3_wrapper_main_text(spark, FOLDER).collect()}
    for r in sample("pages").collect():
        assert found[r["page_id"]] == (article(r["html"]), len(article(r["html"])))
