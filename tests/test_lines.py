"""The line source, the load in one pass, ids and batches, conversations, and a stream with state."""

import gzip
import json
import os
import random

import pytest
from conftest import record
from pyspark.sql import Row, functions as F

from glossmill.operators.conversations import conversations, pieces
from glossmill.operators.ids import head_subset, kth_key, range_of, with_aligned_id, with_dense_id
from glossmill.operators.tokens import pad_batches
from glossmill.plans import workflow
from glossmill.schemas import ORDER_KEY, RECORD_KEY
from glossmill.session import scratch_root
from glossmill.sources.jsonl import existing_sources, load_documents, load_into, load_lines, read_jsonl, write_jsonl
from glossmill.sources.lines import listing, lines_in, scan_lines
from glossmill.streaming.predict import batch_number, in_slices, predict_stream, running_scores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- lines and their keys ---------------------------------------------------------------------

def plain_lines(data):
    """(offset, line) of non-empty lines."""
    out, at = [], 0
    for line in data.replace(b"\r", b"\n").split(b"\n"):
        if line:
            out.append((at, line))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_every_line_belongs_to_one_split(seed, chunk, monkeypatch):
    """Random bytes with all kinds of line ends, cut anywhere, read in pieces of any size."""
    import io

    from glossmill.sources import lines

    monkeypatch.setattr(lines, "READ_BYTES", chunk)
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"x" * 20, "é".encode()]) for _ in range(rng.choice([0, 1, 5, 60])))
    for size in (1, 3, 10, 1000):
        found = []
        for begin in range(0, len(data), size):
            stream = io.BytesIO(data)
            stream.seek(max(begin - 1, 0))
            for places, bounds, held in lines_in(stream.read, begin, min(begin + size, len(data))):
                for place, a, b in zip(places.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    text = bytes(held[a:b]).rstrip(b"\r\n")
                    if text:
                        found.append((place, text))
        assert found == plain_lines(data)


@pytest.fixture
def files(tmp_path):
    """Three entries: a folder of two files, one file with a byte-order mark and odd line ends, and a compressed one."""
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "part-00002-x.txt").write_bytes(b"f2 a\nf2 b\n\n  \nf2 c")
    (tmp_path / "folder" / "part-00010-x.txt").write_bytes(b"f10 a\r\nf10 b\rf10 c\n" * 50)
    (tmp_path / "folder" / "_SUCCESS").write_bytes(b"hidden")
    (tmp_path / "odd.jsonl").write_bytes("﻿with mark\nzwölf Wörter\n".encode() + b"y" * 3000 + b"\n")
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(b"g1\ng2\n" * 100))
    return [(f"{tmp_path}/folder", "auto"), (f"{tmp_path}/odd.jsonl", "vi"), (f"{tmp_path}/gone.jsonl", "en"), (f"{tmp_path}/packed.txt.gz", "en")]


def test_keys_are_the_same_in_every_scan(spark, files):
    """Whatever the size of the splits; in order they are the lines in listed order."""
    scans = [
        [tuple(r) for r in scan_lines(spark, files, size).orderBy(*ORDER_KEY).select(*ORDER_KEY, "hint", "value").collect()]
        for size in (1 << 26, 4096, 100, 7)
    ]
    assert scans[0] == scans[1] == scans[2] == scans[3]
    values = [r[-1] for r in scans[0]]
    assert values[:3] == ["f2 a", "f2 b", "  "] and values[4:7] == ["f10 a", "f10 b", "f10 c"] and len(values) == 4 + 150 + 3 + 200
    assert values[154:156] == ["with mark", "zwölf Wörter"] and values[-1] == "g2"
    assert len({(r[0], r[3]) for r in scans[0]}) == len(values)
    assert [r[0] for r in scans[0]] == sorted(r[0] for r in scans[0]) and {r[0] for r in scans[0]} == {0, 1, 3}
    assert {r[0]: r[4] for r in scans[0]} == {0: "auto", 1: "vi", 3: "en"}


def test_large_inputs_are_read_by_many_tasks_and_small_ones_share_one(spark, files, tmp_path):
    big = tmp_path / "big.txt"
    big.write_bytes(b"some line of text\n" * 10_000)
    per_task = scan_lines(spark, [(str(big), "en")], 20_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 9 and max(r["count"] for r in per_task) < 1300
    assert scan_lines(spark, files).rdd.getNumPartitions() == 1


def test_ten_thousand_files_are_one_scan(spark, tmp_path):
    for k in range(10_000):
        if k % 100:
            with open(f"{tmp_path}/{k}.jsonl", "w") as out:
                out.write(f'{{"id": "{k}", "en_sentence_str": "t"}}\n')
    entries = [(f"{tmp_path}/{k}.jsonl", "auto") for k in range(10_000)]
    lines = load_lines(spark, entries)
    assert plan(lines).count("BatchScan") == 1 and "Union" not in plan(lines)
    rows = lines.select("source_idx", F.get_json_object("value", "$.id").alias("id"), "source").collect()
    assert len(rows) == 9900 and all(r.id == str(r.source_idx) and r.source == entries[r.source_idx][0] for r in rows)
    present, absent = existing_sources(spark, entries)
    assert len(absent) == 100 and len(present) == 9900


def test_listing(tmp_path):
    for name in ("a.txt", "b.txt", ".hidden.txt", "sub/c.txt", "sub/_d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda path: None if (f := listing([path])[0]) is None else [n.removeprefix(f"{tmp_path}/") for n, _ in f]
    assert names(f"{tmp_path}/a.txt") == ["a.txt"] and names(f"file://{tmp_path}/a.txt") == ["a.txt"]
    assert names(f"{tmp_path}/*.txt") == ["a.txt", "b.txt"] and names(f"{tmp_path}/s*") == ["sub/c.txt"]
    assert names(str(tmp_path)) == ["a.txt", "b.txt"] and names(f"{tmp_path}/none") is None and names(f"{tmp_path}/*.no") is None


def test_the_same_file_twice_is_two_sources(spark, lines_file):
    path = lines_file([record("a"), record("b")])
    rows = load_lines(spark, [(path, "en"), (path, "vi")]).select(*RECORD_KEY, "hint").collect()
    assert len(rows) == 4 and {(r.source_idx, r.hint) for r in rows} == {(0, "en"), (1, "vi")}
    with pytest.raises(ValueError):
        load_lines(spark, [(path, "fr")])


def test_stores_that_only_spark_reads(spark, files, monkeypatch):
    """The same lines, in the same order, by Spark's own reader."""
    from glossmill.sources import jsonl

    plain = [f for f in files if not f[0].endswith("odd.jsonl")]  # Spark's reader takes a lone carriage return as well
    ours = [(r.source_idx, r.hint, r.value) for r in load_lines(spark, plain).orderBy(*ORDER_KEY).collect()]
    present = existing_sources(spark, plain)
    monkeypatch.setattr(jsonl, "reachable", lambda path: False)
    theirs = load_lines(spark, plain)
    assert [(r.source_idx, r.hint, r.value) for r in theirs.orderBy(*ORDER_KEY).collect()] == ours and existing_sources(spark, plain) == present
    assert "BatchScan" not in plan(theirs)


# ---- the load report --------------------------------------------------------------------------

def test_the_report_comes_from_the_load_itself(spark, lines_file, tmp_path):
    """Counted by every source and reason, in the job that writes; the plan has one scan and one parse."""
    bad = ["{", "[1]", json.dumps({"id": "x", "entities": 5, "en_sentence_str": "t"})]
    one = lines_file([record("ok"), *bad, record("empty", "")], "one.jsonl")
    many = [(lines_file([record(f"d{k}-{i}") for i in range(k)] + ["no"] * (k % 3), f"{k}.jsonl"), "auto") for k in range(40)]
    entries = [(one, "auto"), (f"{one}.gone", "en"), *many]
    docs, report = load_documents(spark, entries, f"{tmp_path}/docs")
    expected = {(one, "loaded"): 2, (one, "not a JSON object"): 2, (one, "entities is not a list of objects"): 1, (f"{one}.gone", "path not found"): 0}
    expected |= {(p, "loaded"): k for k, (p, _) in enumerate(many) if k}
    expected |= {(p, "not a JSON object"): k % 3 for k, (p, _) in enumerate(many) if k % 3}
    assert {(r.source, r.reason): r.n for r in report.collect()} == expected
    assert docs.count() == 1 + sum(range(40)) and spark.read.parquet(f"{tmp_path}/docs").count() == docs.count()


def test_one_scan_and_one_parse(spark, lines_file, tmp_path):
    lines = load_lines(spark, [(lines_file([record("a"), "{"], f"{k}.jsonl"), "en") for k in range(3)])
    from glossmill.operators.standardize import mark_lines, standardize_parsed

    text = plan(standardize_parsed(mark_lines(lines).filter("reason is null").drop("reason")))
    assert text.count("from_json") == 1 and text.count("BatchScan") == 1 and "Exchange" not in text
    report = load_into(lines, f"{tmp_path}/out", ["a", "b", "c"]).collect()
    assert sorted(map(tuple, report)) == sorted((s, r, 1) for s in "abc" for r in ("loaded", "not a JSON object"))


def test_a_load_without_lines(spark, tmp_path):
    docs, report = load_documents(spark, [(f"{tmp_path}/none.jsonl", "en")], f"{tmp_path}/docs")
    assert docs.count() == 0 and [tuple(r) for r in report.collect()] == [(f"{tmp_path}/none.jsonl", "path not found", 0)]


# ---- ids, batches, subsets --------------------------------------------------------------------

def rows_of(spark, n, seed=1):
    rng = random.Random(seed)
    keys = rng.sample(range(10 * n), n) if n else []
    data = [(k % 3, None if k % 7 == 0 else f"k{k % 11}", k, "wide" * 50) for k in keys]
    return spark.createDataFrame(data, "a int, b string, c long, wide string"), sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_dense_ids_are_the_ranks(spark, n):
    df, expected = rows_of(spark, n)
    out = with_dense_id(df.repartition(5), ["a", "b", "c"]).collect()
    assert [tuple(r)[:4] for r in sorted(out, key=lambda r: r.id)] == expected and sorted(r.id for r in out) == list(range(n))


def test_wide_rows_move_once(spark):
    """One shuffle of the rows, whose ids do not depend on the borders drawn; one copy of them in the scratch folder."""
    df, _ = rows_of(spark, 2000)
    before = set(os.listdir(scratch_root(spark))) if os.path.exists(scratch_root(spark)) else set()
    out = with_dense_id(df, ["a", "b", "c"])
    assert plan(out).count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan(out)
    assert len(set(os.listdir(scratch_root(spark))) - before) == 1
    assert [r.id for r in out.orderBy("a", "b", "c").collect()] == list(range(2000))


@pytest.mark.parametrize("n,batch", [(0, 4), (3, 4), (1000, 7), (3000, 16)])
def test_batches_end_where_ranges_end(spark, n, batch):
    df, expected = rows_of(spark, n)
    out = with_aligned_id(df, ["a", "b", "c"], batch).collect()
    assert [(r.a, r.b, r.c, r.wide) for r in sorted(out, key=lambda r: r.id)] == expected
    ranges = {}
    for r in out:
        ranges.setdefault(r.id // batch, set()).add(r["_range"])
    assert all(len(x) == 1 for x in ranges.values()) and sorted(r.id for r in out) == list(range(n))
    assert n < 1000 or len(set.union(*ranges.values())) > 3


def test_padding_needs_one_shuffle_of_the_rows(spark):
    df, _ = rows_of(spark, 500)
    arrays = df.withColumn("input_ids", F.sequence(F.lit(1), F.lit(1) + F.col("c").cast("int") % 9)).withColumn("labels", F.col("input_ids"))
    out = pad_batches(arrays, 8, order=["a", "b", "c"])
    assert plan(out).count("Exchange hashpartitioning") == 1
    rows = out.collect()
    for b in range(-(-500 // 8)):
        batch = [r for r in rows if r.batch == b]
        assert {len(r.input_ids) for r in batch} == {max(1 + r.c % 9 for r in batch)}
        assert len(batch) == min(8, 500 - 8 * b) and all(len([x for x in r.labels if x != -100]) == r.c % 9 + 1 for r in batch)


def test_the_kth_key_is_found_without_a_sort(spark, monkeypatch):
    from glossmill.operators import ids

    monkeypatch.setattr(ids, "FEW", 40)
    df, expected = rows_of(spark, 3000)
    for k in (0, 1, 777, 2999):
        assert tuple(kth_key(df.select("a", "b", "c"), ["a", "b", "c"], k)) == expected[k][:3]
    subset = head_subset(df, 1234, ["a", "b", "c"])
    assert "Exchange" not in plan(subset) and sorted(r.c for r in subset.collect()) == sorted(r[2] for r in expected[:1234])


def test_the_final_file_leaves_no_copy(spark, tmp_path):
    before = set(os.listdir(scratch_root(spark))) if os.path.exists(scratch_root(spark)) else set()
    write_jsonl(spark.range(100).select("id", F.col("id").cast("string").alias("value")), f"{tmp_path}/out", ["id"])
    assert (set(os.listdir(scratch_root(spark))) if os.path.exists(scratch_root(spark)) else set()) <= before


# ---- conversations ----------------------------------------------------------------------------

TURNS = "conv_id long, turn int, role string, text string"


def chat(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2] is not None, x[2] or "")))


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_conversations_of_all_lengths(spark, size, monkeypatch):
    """One holds most turns and is spread over tasks; pieces of any size give the same texts."""
    from glossmill.operators import conversations as module

    rng = random.Random(3)
    turns = [(7, k, rng.choice(["user", "assistant"]), f"hot {k} é") for k in range(900)]
    turns += [(c, k, "user", f"turn {k}" * (k % 3)) for c in range(100, 160) for k in range(rng.randint(1, 5))]
    turns += [(1, None, "user", "no number"), (1, 1, None, "no role"), (1, 1, "user", None), (1, 1, "user", None), (None, 1, "user", "no conversation")]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).repartition(6).withColumn("rendered", F.lit("clash"))
    expected = {}
    for c, *rest in turns:
        expected.setdefault(c, []).append(tuple(rest))
    original = module.pieces
    monkeypatch.setattr(module, "pieces", lambda t, **names: original(t, size, **names))
    out = conversations(df).collect()
    assert {r.conv_id: (r.n_turns, r.rendered) for r in out} == {c: (len(t), chat(t)) for c, t in expected.items()} and len(out) == len(expected)
    tasks = original(df, size).filter("conv = 7").groupBy(F.spark_partition_id()).agg(F.sum("n_turns").alias("n")).collect()
    assert len(tasks) > 1 and max(t.n for t in tasks) < 600


def test_a_conversation_to_be_continued(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi")], TURNS)
    assert conversations(df, generation_prompt=True).first().rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert pieces(df.limit(0)).count() == 0 and conversations(df.limit(0)).count() == 0


# ---- a stream with state ----------------------------------------------------------------------

def noting(folder):
    def make():
        import uuid

        def generate(prompts):
            for _ in prompts:
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return ['{"entities": []}' for _ in prompts]

        return generate

    return make


def test_a_resent_line_is_not_generated_again(spark, tmp_path):
    source, calls = tmp_path / "src", tmp_path / "calls"
    source.mkdir()
    calls.mkdir()

    def run(*names):
        query = predict_stream(spark, str(source), f"{tmp_path}/dst", f"{tmp_path}/state", noting(str(calls)), batch_size=2,
                               files_per_trigger=1, resent_within="30 days", scores=f"{tmp_path}/scores")
        query.awaitTermination()
        assert query.exception() is None
        return sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/dst").collect())

    lines = [json.dumps(record(str(i), f"t {i}", [("T0", "Test", "t", 0, 0)])) for i in range(6)]
    (source / "a.jsonl").write_text("\n".join(lines[:3] + [f"  {lines[0]} "]) + "\n")
    (source / "b.jsonl").write_text("\n".join(lines[1:4]) + "\n")
    assert run() == ["0", "1", "2", "3"] and len(os.listdir(calls)) == 4
    (source / "c.jsonl").write_text("\n".join(lines) + "\n")
    os.utime(source / "c.jsonl", (1, 1))  # an old file that arrives late is not dropped
    assert run() == [str(i) for i in range(6)] and len(os.listdir(calls)) == 6
    assert run() == [str(i) for i in range(6)] and len(os.listdir(calls)) == 6
    scores = running_scores(spark, f"{tmp_path}/scores").first()
    assert (scores.ner_tp, scores.ner_fp, scores.ner_fn) == (0, 0, 6)


def test_prepared_documents_keep_their_keys(spark, lines_file, tmp_path):
    entries = [(lines_file([record(f"d{k}") for k in range(5)]), "auto")]
    one, two = (workflow.prepare_documents(spark, entries, f"{tmp_path}/{n}") for n in "ab")
    assert sorted(one.select("doc_id", *ORDER_KEY).collect()) == sorted(two.select("doc_id", *ORDER_KEY).collect())


def test_borders_are_looked_up_by_halving(spark):
    """Thousands of borders are one text in the plan, and a row's key is not compared with runs of them."""
    order = ["a", "b", "c"]
    df, expected = rows_of(spark, 3000)
    cuts = [Row(a=r[0], b=r[1], c=r[2]) for r in expected[1::2]]
    out = df.select(*order, range_of(df, order, cuts).alias("at"))
    assert "filter(" not in plan(out)
    assert [r["at"] for r in out.orderBy(*order).collect()] == [(i + 1) // 2 for i in range(3000)]


@pytest.mark.parametrize("kind", ["timestamp", "decimal(20,3)", "double", "float", "date", "binary", "boolean", "string", "smallint"])
def test_borders_of_any_type_keep_their_value(spark, kind):
    values = {"timestamp": "timestamp_micros(id * 1234567891)", "decimal(20,3)": "cast(id as decimal(20,3)) / 7", "double": "if(id = 3, double('NaN'), id / 7)",
              "date": "date_add(date'1969-12-01', cast(id as int))", "binary": "cast(char(id) as binary)", "boolean": "id % 2 = 0",
              "string": "concat('\"\\\\é\\n', char(32 + id), ' ')"}
    value = F.expr(values.get(kind, "id / 3"))
    df = spark.range(40).select(F.when(F.col("id") != 5, value).cast(kind).alias("k")).distinct()
    cuts = df.orderBy("k").collect()
    found = df.select("k", range_of(df, ["k"], cuts).alias("at")).orderBy("k").collect()
    assert [r["at"] for r in found] == list(range(1, len(cuts) + 1))


def test_compressed_lines_are_read_back_in_order(spark, tmp_path):
    """The ranges of a sorted write may be compressed: every reader, and a stream, gives the same lines."""
    lines = spark.range(2000).select(F.lit(0).alias("source_idx"), F.col("id").alias("seq"), F.concat(F.lit("line "), "id").alias("value"))
    path = f"{tmp_path}/packed"
    write_jsonl(lines.repartition(7), path, ["source_idx", "seq"], compression="gzip")
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
    for read in (scan_lines(spark, [(path, "auto")]), read_jsonl(spark, path)):
        assert [r.value for r in read.orderBy(*ORDER_KEY).collect()] == [f"line {i}" for i in range(2000)]


def empty_answers():
    return lambda prompts: ["{}" for _ in prompts]


def test_a_compressed_file_of_a_stream_is_worked_by_several_tasks(spark, tmp_path):
    """One task reads a compressed file; its lines are still parsed and answered by all of them, under the same keys."""
    source = tmp_path / "src"
    source.mkdir()
    for name, first in (("part-00000.gz", 0), ("part-00001.gz", 500)):
        with gzip.open(source / name, "wt", newline="") as f:
            for i in range(first, first + 500):
                f.write(f"\u00a0{json.dumps(record(str(i), f' t {i}'))}\t\n" if i % 3 else json.dumps(record(str(i), f"t {i}")) + "\n\n")
    query = predict_stream(spark, str(source), f"{tmp_path}/dst", f"{tmp_path}/state", empty_answers, documents=f"{tmp_path}/docs")
    query.awaitTermination()
    assert query.exception() is None
    docs, answers = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/dst")
    in_order = docs.orderBy(*ORDER_KEY).collect()
    assert [r.doc_id for r in in_order] == [str(i) for i in range(1000)]
    assert [r.text for r in in_order] == [f"t {i}" for i in range(1000)]
    assert sorted(r.doc_id for r in answers.collect()) == sorted(str(i) for i in range(1000))
    assert docs.join(answers, ["source_idx", "seq", "doc_id"]).count() == 1000
    # A line's key is its task's number and its place among the lines that task read, whichever slice it is in.
    assert sorted(r.seq >> 33 for r in in_order) == [0] * 500 + [1] * 500
    for place in (0, 1):
        rows = [r.seq & (1 << 33) - 1 for r in in_order if r.seq >> 33 == place]
        assert rows == sorted(set(rows))
    for folder, files in (("docs", 4), ("dst", 3)):  # by 4 cores; small files are read by fewer tasks
        sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/{folder}").groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) >= files and max(sizes) < 500


@pytest.mark.parametrize("tasks", [1, 2, 3, 8, 50])
def test_slices_hold_every_line_once(spark, tmp_path, tasks):
    spark.range(0, 1000, 1, 3).select(F.concat(F.lit("line "), "id").alias("value")).write.option("compression", "gzip").text(f"{tmp_path}/in")
    lines = spark.read.text(f"{tmp_path}/in").select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_metadata"))
    whole = lines.select(F.monotonically_increasing_id().alias("seq"), "value").collect()
    sliced = in_slices(lines, tasks)
    assert sorted((r.seq, r.value) for r in sliced.collect()) == sorted((r.seq, r.value) for r in whole)
    assert sliced.rdd.getNumPartitions() >= min(tasks, 8 * lines.rdd.getNumPartitions())


def test_micro_batches_share_their_generated_code(spark):
    lines = spark.range(3).select(F.concat(F.lit("x"), "id").alias("value"))
    code = []
    for n in (7, 4711):
        df = lines.select(batch_number(n).alias("source_idx"), "value")
        assert [r.source_idx for r in df.collect()] == [n] * 3
        parts = df._jdf.queryExecution().debug().codegenToSeq()
        code.append([parts.apply(i)._2() for i in range(parts.size())])
    assert code[0] and code[0] == code[1]
