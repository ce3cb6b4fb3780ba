"""Incremental inference: new files in, predictions out, each line once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from glossmill.functions.text import strip
from glossmill.operators import scoring
from glossmill.operators.inference import SAMPLE_INFO, Generator, parse_predictions, predict, with_prompt
from glossmill.operators.render import build_samples
from glossmill.operators.standardize import standardize
from glossmill.operators.tokens import Encoder
from glossmill.schemas import ORDER_KEY, PAIR_POS
from glossmill.session import computed_once, released, scratch_path
from glossmill.sources.jsonl import check_hint, lines_of, with_order_key

#: How often a file of a micro-batch is read at most.
SLICES = 8
#: What a micro-batch writes: at the higher levels packing takes a third of the time of a write.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def first_arrivals(lines: DataFrame, within: str) -> DataFrame:
    """A stream of lines without those that came before, compared without the white space around them.

    The state store holds a digest of each line until ``within`` has passed since it came.  Time is the time of arrival,
    so no line is ever late, however old its file.
    """
    marked = lines.withColumn("arrived", F.current_timestamp()).withColumn("digest", F.sha2(strip(F.col("value")), 256))
    return marked.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["digest"]).drop("arrived", "digest")


def batch_number(batch_id: int) -> Column:
    """The number as a column of lines, worked out in the row: as a literal it would stand in the generated code, which
    each micro-batch would then compile anew."""
    return F.concat(F.lit(str(batch_id)), F.substring("value", 1, 0)).cast("int")


def in_slices(lines: DataFrame, tasks: int) -> DataFrame:
    """The lines of a scan with their ``seq``, made by up to ``SLICES`` times as many tasks if it has fewer than ``tasks``.

    A compressed file is read by one task.  Reading it again costs far less than parsing its lines, so several tasks read
    it and each keeps every so many-th line: nothing is shuffled, and a line has the key that one task would give it.
    The number of slices is a power of two, so the slice of a line depends on its place in its own task only.
    """
    numbered = lines.withColumn("seq", F.monotonically_increasing_id())
    n, slices = lines.rdd.getNumPartitions(), 1
    while n < tasks and slices < SLICES and n * slices < 2 * tasks:
        slices *= 2
    if slices == 1:
        return numbered
    parts = [numbered.filter(F.col("seq") % slices == i) for i in range(slices)]
    # What follows stays above the generator, in one plan; else it would be planned again for each slice.
    rows = reduce(DataFrame.unionAll, parts).withColumnRenamed("value", "_line")
    return computed_once(rows, "value", F.col("_line")).drop("_line")


def predict_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    make_generator: Callable[[], Generator],
    format: str = "instruction",
    task: str = "ner_only",
    re_mode: str = "global",
    hint: str = "auto",
    batch_size: int = 4,
    files_per_trigger: int = 1000,
    file_age: str = "36500d",
    documents: str | None = None,
    resent_within: str | None = None,
    scores: str | None = None,
    max_length: int | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
) -> StreamingQuery:
    """Process every file that has arrived since the last run and stop.

    The checkpoint fixes which files belong to which micro-batch, and a micro-batch owns one folder of
    the target that it replaces as a whole.  Running again, also after a failure half-way, therefore
    neither loses nor repeats a line.  A micro-batch counts as one source, which keeps keys unique; with
    ``documents`` its standardised documents are written there under the same keys, to score against.  A backlog is
    worked off in micro-batches of ``files_per_trigger`` files.

    With ``resent_within``, such as "30 days", a line that was sent again within that time after it first came is not
    generated again; the stream keeps a digest of each line for that long.  With ``scores``, each micro-batch writes
    its counts of right and wrong answers there; ``running_scores`` adds them up.
    """
    check_hint(hint)
    # Spark passes over files that are a week older than the newest one it has seen; here an old file may come late.
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", file_age)
    keep = [*ORDER_KEY, *PAIR_POS, *SAMPLE_INFO]

    def write_batch(lines: DataFrame, batch_id: int) -> None:
        if resent_within:  # read once, since state is kept by that run
            keyed = with_order_key(lines, batch_number(batch_id))
        else:
            keyed = with_order_key(in_slices(lines, spark.sparkContext.defaultParallelism), batch_number(batch_id), F.col("seq"))
        docs = standardize(lines_of(keyed, source, hint))
        copy = f"{documents}/batch={batch_id}" if documents else scratch_path(spark, "batch") if scores or resent_within else None
        if copy:  # a stream's batch is read once: state is kept by that run, and keys are fixed
            docs.write.mode("overwrite").options(**PACKED).parquet(copy)
            docs = spark.read.schema(docs.schema).parquet(copy)
        samples = with_prompt(build_samples(docs, format, task, re_mode))
        answers = parse_predictions(predict(samples, make_generator, batch_size, keep, None, max_length, make_encoder))
        path = f"{target}/batch={batch_id}"
        answers.write.mode("overwrite").options(**PACKED).parquet(path)
        if scores:
            answered = spark.read.schema(answers.schema).parquet(path)
            scoring.evaluate(answered, docs, task, re_mode).write.mode("overwrite").parquet(f"{scores}/batch={batch_id}")
        if copy and not documents:
            released(spark, copy)

    place = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_metadata")  # what the order key needs
    lines = reader.load(source).select("value", place)
    if resent_within:
        lines = first_arrivals(lines, resent_within)
    return (
        lines.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running_scores(spark: SparkSession, scores: str) -> DataFrame:
    """Scores over all micro-batches so far, from the sums of their counts."""
    rows = spark.read.parquet(scores).drop("batch")
    return scoring.total(rows)
