"""The two jobs users run: preparing training rows, and resumable inference with scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.functions.jsontext import error_json
from glossmill.ontology import Ontology
from glossmill.operators import scoring
from glossmill.operators.ids import head_subset, pending
from glossmill.operators.inference import (
    SAMPLE_INFO, Generator, clipped_prompt, parse_predictions, predict, with_prompt,
)
from glossmill.operators.plugins import Plugin
from glossmill.operators.render import Templates, build_samples, variant
from glossmill.operators.tokens import MAX_LENGTH, Encoder, instruction_tokens, tokenize
from glossmill.schemas import ORDER_KEY, RECORD_KEY, SAMPLE_ORDER
from glossmill.session import released, scratch_path
from glossmill.sources.answers import KEEP_EVERY, Job, generate_into, reachable
from glossmill.sources.jsonl import load_documents, require_non_empty, write_jsonl, write_predictions


def prepare_documents(spark: SparkSession, entries: Iterable[tuple[str, str]], path: str) -> DataFrame:
    """Standardise all sources once and continue from the written table; ``load_documents`` reports on the load as well."""
    return load_documents(spark, entries, path)[0]


def training_rows(
    docs: DataFrame,
    format: str = "instruction",
    task: str = "joint",
    re_mode: str = "global",
    ontology: Ontology | None = None,
    templates: Templates = Templates(),
    max_len: int = MAX_LENGTH,
    make_encoder: Callable[[], Encoder] | None = None,
    subset: int | float | None = None,
) -> DataFrame:
    """Token rows in one narrow stage; ``subset`` keeps the first rows, as for an evaluation split."""
    samples = require_non_empty(build_samples(docs, format, task, re_mode, ontology, templates))
    samples = head_subset(samples, subset)
    if "system" in samples.columns:
        return instruction_tokens(samples, SAMPLE_ORDER, max_len, make_encoder)
    rows = tokenize(samples, "text", max_len, make_encoder, keep=SAMPLE_ORDER)
    return rows.withColumn("labels", F.col("input_ids"))  # all of a causal text is learned


def stored_answers(samples: DataFrame, path: str) -> DataFrame | None:
    """Keys and raw answers that earlier runs have written, or None."""
    spark = samples.sparkSession
    try:
        spark.read.format("text").load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.schema(samples.select(*SAMPLE_ORDER, *SAMPLE_INFO).schema.add("raw_text", "string")).parquet(path)


def run_inference(
    samples: DataFrame,
    make_generator: Callable[[], Generator],
    path: str,
    batch_size: int = 4,
    partitions: int | None = None,
    slices: int = 8,
    max_length: int | None = MAX_LENGTH,
    make_encoder: Callable[[], Encoder] | None = None,
    keep_every: int = KEEP_EVERY,
) -> DataFrame:
    """Generate what is still missing, and return all predictions with the order key of their samples.

    Run it again after a failure: every ``keep_every`` answers of a task are kept at once, and samples with a kept
    answer are skipped by key.  The missing prompts are found and rendered once, into a table that is read without a
    shuffle, by at most ``partitions`` tasks; ``sources.answers`` says how they write.  Prompts are cut to ``max_length``
    tokens, those of ``make_encoder`` if there is one.  Runs into one path have to follow each other: two at once would
    both ask for what is missing.

    Where Python cannot write to ``path``, Spark writes, which keeps the answers of a job as a whole; the run is cut
    into ``slices`` jobs over disjoint records then, and a failure costs one of them.
    """
    spark, keep = samples.sparkSession, [*SAMPLE_ORDER, *SAMPLE_INFO]
    done = stored_answers(samples, path)
    left = samples if done is None else pending(samples, done)
    todo = scratch_path(spark, "prompts")
    prompts = with_prompt(left).select(*keep, "prompt")
    try:
        if reachable(path):
            encoder = None if make_encoder is None else Plugin(make_encoder)
            prompt = F.col("prompt") if encoder else clipped_prompt(max_length, None)
            prompts.withColumn("prompt", prompt).write.parquet(todo)
            rows = spark.read.schema(prompts.schema).parquet(todo)
            job = Job(path, uuid.uuid4().hex, Plugin(make_generator), batch_size, keep_every, encoder, max_length)
            generate_into(rows.coalesce(partitions) if partitions else rows, job)
        else:
            slice_of = F.pmod(F.xxhash64(*RECORD_KEY), F.lit(slices)).alias("_slice")
            prompts = prompts.select("*", slice_of)
            prompts.write.partitionBy("_slice").parquet(todo)
            for number in range(slices):
                part = spark.read.schema(prompts.schema).parquet(todo).filter(F.col("_slice") == number)
                write_predictions(predict(part, make_generator, batch_size, keep, partitions, max_length, make_encoder), path)
    finally:
        released(spark, todo)
    return parse_predictions(stored_answers(samples, path))


def finish(preds: DataFrame, docs: DataFrame, path: str, task: str, re_mode: str = "global",
           key: list[str] | None = None) -> DataFrame:
    """Write the final lines, one for each document in document order, and return the scores.

    Pair answers are regrouped by record; a document without an answer has an empty list, or, where one answer was
    expected, the error object.
    """
    if variant(task, re_mode) == "pair":
        lines = scoring.prediction_lines(scoring.regroup_pairs(preds, docs))
    else:
        answers = docs.join(preds.select(*RECORD_KEY, "stored"), RECORD_KEY, "left")
        lines = answers.withColumn("value", F.coalesce("stored", error_json(F.lit(""))))
    write_jsonl(lines, path, ORDER_KEY)
    return scoring.evaluate(preds, docs, task, re_mode, key)
