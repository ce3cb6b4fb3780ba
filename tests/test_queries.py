"""Every registered query against its SQL on the smallest tables, and the shape of key plans."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SMALL = Path("/root/testdata/sf0.001")
QUICK = ["documents_std", "malformed_lines", "pair_labels", "causal_re_pairwise", "eval_joint", "eval_re_shared_id", "predict_stub", "loss_mask"]

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="tables not present")


def plain(rows):
    columns = sorted(rows.columns)
    return columns, sorted(zip(*[[None if pd.isna(v) else v for v in rows[c].tolist()] for c in columns]), key=repr)


def test_every_query_has_sql():
    from glossmill.plans.catalog import QUERIES

    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    assert plain(queries()[name](spark, str(SMALL)).toPandas()) == plain(db.execute(oracle_sql()[name]).df())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0].ner_tp > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_needed(spark):
    text = plan(queries()["word_tokens"](spark, str(SMALL)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["documents_std", "causal_joint", "instruction_ner", "loss_mask"])
def test_narrow_queries_shuffle_only_to_spread_the_scan(spark, name):
    text = plan(queries()[name](spark, str(SMALL)))
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") <= 1
    assert text.count("from_json") == 1


def test_pairs_are_made_once_and_none_to_be_dropped(spark):
    """Pair samples of unsaved documents: one scan, one parse, and no filter on labels above the second generator."""
    from glossmill.operators.render import build_samples
    from glossmill.plans.annotated import documents

    text = plan(build_samples(documents(spark, str(SMALL)), "causal", "re_only", "pairwise"))
    assert text.count("FileScan") == 1 and text.count("from_json") == 1
    assert "label" not in "".join(line for line in text.split("Generate explode(_objects")[0].splitlines() if "Filter" in line)


def test_integrity_needs_one_scan_and_no_join(spark):
    text = plan(queries()["relations_integrity"](spark, str(SMALL)))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_long_records_spread_their_pairs(spark):
    """Half of all pairs belong to one record, yet no task makes most of them."""
    from pyspark.sql import functions as F

    from glossmill.operators.pairs import entity_pairs
    from glossmill.schemas import ENTITY

    ents = [(f"T{k}", "Problem", "w", k, k) for k in range(200)]
    row = lambda n, e: (0, "", 0, n, f"d{n}", ["w"], e, [], len(e))
    docs = spark.createDataFrame(
        [row(0, ents)] + [row(n, ents[:9]) for n in range(1, 400)],
        "source_idx int, file string, block long, seq long, doc_id string, words array<string>, entities array<"
        + ENTITY.simpleString() + ">, relations array<struct<relation_type:string,subject_id:string,object_id:string>>, n_entities int",
    )
    pairs = entity_pairs(docs, tasks=8)
    per_task = [r["n"] for r in pairs.filter("seq = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 200 * 199 and len(per_task) > 1 and max(per_task) < 0.6 * sum(per_task)
