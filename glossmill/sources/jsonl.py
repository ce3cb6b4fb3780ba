"""JSON-lines sources and prediction sinks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from glossmill.functions.text import strip
from glossmill.operators.standardize import REASONS, mark_lines, standardize, standardize_parsed
from glossmill.schemas import LANGUAGE_HINTS, LINE, ORDER_KEY
from glossmill.session import released, scratch_path
from glossmill.sources.answers import reachable
from glossmill.sources.lines import SPLIT_BYTES, listing, scan_lines

REPORT = "source string, reason string, n bigint"


def check_hint(hint: str) -> str:
    if hint not in LANGUAGE_HINTS:
        raise ValueError(f"unsupported language {hint!r}; expected one of {list(LANGUAGE_HINTS)}")
    return hint


def numbered_name(path: Column) -> Column:
    """The path with its part number filled up to ten digits: Spark writes five, and more than 100,000 files have more."""
    number = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1)
    return F.when(number == "", path).otherwise(
        F.regexp_replace(path, F.lit(r"part-\d+([^/]*)$"), F.concat(F.lit("part-"), F.lpad(number, 10, "0"), F.lit("$1"))))


def with_order_key(lines: DataFrame, source_idx: int | Column, seq: Column | None = None) -> DataFrame:
    """Add the position of every line: source, file, file split, line within the scan (``seq`` if it is known already).

    Sorting by it restores the order of the files.  It belongs to one run of the scan, so write the
    rows once and use the stored key from then on.
    """
    return lines.select(
        F.lit(source_idx).alias("source_idx"),
        numbered_name(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.monotonically_increasing_id() if seq is None else seq).alias("seq"),
        "value",
    )


def trimmed(lines: DataFrame) -> DataFrame:
    """The lines without white space around them, and without those of nothing else.

    Trimming reads a line to its end, so a line that begins and ends as an object does is taken as it is.
    """
    value = F.col("value")
    bare = value.startswith("{") & value.endswith("}")
    return lines.withColumn("value", F.when(bare, value).otherwise(strip(value))).filter(value != "")


def lines_of(keyed: DataFrame, source: str, hint: str) -> DataFrame:
    """Trimmed, non-blank lines labelled with their source and language hint."""
    return trimmed(keyed.select("source_idx", F.lit(source).alias("source"), F.lit(hint).alias("hint"), "file", "block", "seq", "value"))


def read_jsonl(spark: SparkSession, path: str, source_idx: int = 0, hint: str = "auto") -> DataFrame:
    """Non-blank lines of a file, folder or pattern, with their order key."""
    check_hint(hint)
    return lines_of(with_order_key(spark.read.text(path), source_idx), path, hint)


def existing_sources(spark: SparkSession, entries: Iterable[tuple[str, str]]):
    """Split ``(path, hint)`` entries into those that exist and those that do not, by one listing where Python can list."""
    entries = [(path, check_hint(hint)) for path, hint in entries]
    if all(reachable(path) for path, _ in entries):
        there = [found is not None for found in listing([path for path, _ in entries])]
    else:
        there = [_exists(spark, path) for path, _ in entries]
    return [e for e, t in zip(entries, there) if t], [e for e, t in zip(entries, there) if not t]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def load_lines(spark: SparkSession, entries: Iterable[tuple[str, str]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All lines of all sources in listed order; an absent source contributes no rows.

    One scan for all of them, with keys that are the same in every scan.  Stores that only Spark's readers can open
    are read by those, with a scan for each source and keys that belong to one run of it.
    """
    entries = [(path, check_hint(hint)) for path, hint in entries]
    if all(reachable(path) for path, _ in entries):
        return trimmed(scan_lines(spark, entries, split_bytes))
    parts = [read_jsonl(spark, path, idx, hint) for idx, (path, hint) in enumerate(entries) if _exists(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LINE)


def load_sources(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> DataFrame:
    """Standardised documents of all sources."""
    return standardize(load_lines(spark, entries))


def mark_malformed(lines: DataFrame) -> DataFrame:
    """Add ``reason``, NULL for lines that hold exactly one JSON object with sound annotation lists."""
    return mark_lines(lines).drop("record")


def split_malformed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound lines, and the others with a reason."""
    marked = mark_malformed(lines)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def line_report(lines: DataFrame) -> DataFrame:
    """Lines of each source that load, and that do not by reason."""
    reason = F.coalesce("reason", F.lit("loaded")).alias("reason")
    return mark_malformed(lines).groupBy("source", reason).agg(F.count(F.lit(1)).alias("n"))


def load_report(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> DataFrame:
    """The same for listed sources, without loading them; one that does not exist has a row that says so."""
    entries = list(entries)
    _, absent = existing_sources(spark, entries)
    return line_report(load_lines(spark, entries)).unionByName(_missing(spark, absent))


def load_into(lines: DataFrame, path: str, sources: list[str]) -> DataFrame:
    """Write the documents of lines, and return what became of the lines, by source and reason.

    The counts come from the same job: they are observed between the parse and the filter that drops damaged lines. An
    observation is one row, so source and reason are counted as one number, by a histogram with a bin for each of them,
    which makes its counts exact.
    """
    outcomes = ["loaded", *REASONS]
    mark = F.array_position(F.array(*map(F.lit, REASONS)), F.coalesce("reason", F.lit("")))
    number = F.col("source_idx") * len(outcomes) + mark
    observed = Observation()
    counts = F.histogram_numeric(number.cast("double"), F.lit(max(2, len(sources) * len(outcomes)))).alias("counts")
    sound = mark_lines(lines).observe(observed, counts).filter(F.col("reason").isNull()).drop("reason")
    standardize_parsed(sound).write.mode("errorifexists").parquet(path)
    total: Counter[int] = Counter()
    for bin in observed.get["counts"] or []:
        total[round(bin["x"])] += round(bin["y"])
    rows = [(sources[n // len(outcomes)], outcomes[n % len(outcomes)], count) for n, count in sorted(total.items())]
    return lines.sparkSession.createDataFrame(rows, REPORT)


def load_documents(spark: SparkSession, entries: Iterable[tuple[str, str]], path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all sources, written to ``path`` and read back, and the report of the same load.

    Sources are read once and every line is parsed once.
    """
    entries = list(entries)
    _, absent = existing_sources(spark, entries)
    report = load_into(load_lines(spark, entries), path, [source for source, _ in entries])
    return spark.read.parquet(path), report.unionByName(_missing(spark, absent))


def _missing(spark: SparkSession, absent: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(path, "path not found", 0) for path, _ in absent], REPORT)


def source_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Documents per source; sum them for the total."""
    return docs.groupBy(*(by or ("source_idx", "source"))).agg(F.count(F.lit(1)).alias("n_docs"))


def require_non_empty(df: DataFrame, what: str = "training samples") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}: check that the configured paths exist and hold records")
    return df


# ---- predictions ------------------------------------------------------------------------------

def write_predictions(df: DataFrame, path: str) -> None:
    """Append predictions; Spark commits whole tasks, so a lost executor leaves no half-written rows."""
    df.write.mode("append").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Every appended part; sort by ``id`` only where the order is shown."""
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, value: str = "value", compression: str = "none") -> None:
    """One line per row; the part files, in the order of their numbers, hold the rows in ``order``.

    The rows are written first, since the sort reads its input twice, and deleted afterwards.  With a ``compression``,
    such as "gzip", which the readers here undo, each file is read by one task.
    """
    keys = order or ORDER_KEY
    spark, copy = df.sparkSession, scratch_path(df.sparkSession, "lines")
    lines = df.select(*keys, F.col(value).alias("_line"))
    try:
        lines.write.option("compression", "zstd").parquet(copy)
        rows = spark.read.schema(lines.schema).parquet(copy)
        rows.orderBy(*keys).select(F.col("_line").alias("value")).write.option("compression", compression).text(path)
    finally:
        released(spark, copy)
