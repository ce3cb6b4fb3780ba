"""Distributed generation with a caller's model, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from glossmill.functions.chat import causal_prompt, chat_prompt
from glossmill.functions.jsontext import error_json, strict_object
from glossmill.operators.plugins import Plugin
from glossmill.operators.tokens import Encoder, clip_by_encoder, clip_tokens
from glossmill.schemas import PREDICTED, SAMPLE_KEY
from glossmill.session import computed_once

Generator = Callable[[list[str]], list[str]]
SAMPLE_INFO = ["doc_id", "subject_id", "object_id"]


def with_prompt(samples: DataFrame) -> DataFrame:
    """Add what the generator sees: the open chat, or the causal text up to its boundary."""
    if "system" in samples.columns:
        return samples.withColumn("prompt", chat_prompt(F.col("system"), F.col("user")))
    return samples.withColumn("prompt", causal_prompt(F.col("text")))


def clipped_prompt(max_length: int | None, make_encoder: Callable[[], Encoder] | None) -> Column:
    """The prompt as a model of ``max_length`` tokens sees it: the caller's tokens, or else the default ones."""
    if max_length is None:
        return F.col("prompt")
    if make_encoder is not None:
        return clip_by_encoder(F.col("prompt"), max_length, make_encoder)
    return clip_tokens(F.col("prompt"), max_length)


def predict(
    samples: DataFrame,
    make_generator: Callable[[], Generator],
    batch_size: int = 4,
    keep: list[str] | None = None,
    partitions: int | None = None,
    max_length: int | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """``keep`` columns and the generated ``raw_text`` of every sample with a ``prompt``.

    ``make_generator`` runs once per Python worker process and returns a function from a list of prompts to a list of
    texts.  Columns in ``keep`` travel along, so gold answers kept here need no join when scoring.
    ``max_length`` cuts prompts to that many tokens, those of ``make_encoder`` if there is one.
    """
    keep = keep or [c for c in [*SAMPLE_KEY, *SAMPLE_INFO, "id"] if c in samples.columns]
    prompt = clipped_prompt(max_length, make_encoder)
    rows = samples.select(*keep, prompt.alias("prompt"))
    if partitions:
        rows = rows.repartition(partitions, *[c for c in SAMPLE_KEY if c in keep])
    model = Plugin(make_generator)
    schema = T.StructType([*samples.select(*keep).schema.fields, T.StructField("raw_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = model.get()
        for batch in batches:
            prompts = batch.column("prompt").to_pylist()
            texts: list[str] = []
            for start in range(0, len(prompts), batch_size):
                chunk = prompts[start:start + batch_size]
                answers = generate(chunk)
                if len(answers) != len(chunk):
                    raise ValueError(f"{len(chunk)} prompts gave {len(answers)} texts")
                texts.extend(answers)
            columns = [batch.column(c) for c in keep] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "raw_text"])

    return rows.mapInArrow(run, schema)


def parse_predictions(predictions: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Add ``prediction``, ``malformed`` and ``stored``, the one-line JSON kept on disk.

    The text must be exactly one JSON object: code fences or trailing words make it malformed, and an
    error object with the text is stored instead.  A line break in valid JSON is only ever layout.
    """
    parsed = computed_once(predictions, "prediction", strict_object(F.col(raw), PREDICTED))
    flagged = parsed.withColumn("malformed", F.col("prediction").isNull())
    one_line = F.trim(F.regexp_replace(F.col(raw), r"[\r\n\t]+", " "))
    stored = F.when(F.col("malformed"), error_json(F.coalesce(F.col(raw), F.lit("")))).otherwise(one_line)
    return flagged.withColumn("stored", stored)
