"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.llm.byte_cnn import quality_scores
from glossmill.llm.common import KEYS, set_aside, stored, table, with_text
from glossmill.llm.fm_index import CLEAN, REPORT, decontaminate
from glossmill.llm.induced import KEPT, RESULTS, suffix_dedup
from glossmill.llm.packing import packed, pieces
from glossmill.llm.simhash import one_of_each

#: Shortest repeated string that goes. Of the passages of over 50 words that stand in several documents, 400 bytes find
#: 61 % on sf0.1 after the near-dedup (851 of 2,159 are shorter), 300 find 97 %, 250 find 99.4 %; of the documents without
#: such a passage 250 touch 2.5 %, and take 0.8 % of their bytes.
REPEAT_BYTES = 250


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from those of them that are labelled."""
    docs, back = set_aside(docs, ["score", "held_out", "predicted"])
    return quality_scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*back)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    docs, back = set_aside(docs, [*KEYS, "row_nth"])
    return one_of_each(docs).select(*back)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur more than once. A text of nothing else is left empty."""
    docs, back = set_aside(docs, [*RESULTS, *KEPT, *KEYS, "stretches"])
    return with_text(suffix_dedup(docs, with_kept=True, window=REPEAT_BYTES).select(*docs.columns, "kept"), F.col("kept")).select(*back)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover."""
    docs, back = set_aside(docs, [*REPORT, *CLEAN, *KEYS, "all_spans", "all_items"])
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=True)
    return with_text(clean.select(*docs.columns, "clean"), F.col("clean")).select(*back)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, laid out in sequences."""
    return packed(pieces(docs))


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed_sequences),
]

#: SQL can express neither the classifier nor the packing. tests/llm/test_pipeline.py holds the near-dedup, repeat and
#: benchmark stages against plain models of all pairs and all windows, the classifier against labels, and the packing
#: against the least number of sequences.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
