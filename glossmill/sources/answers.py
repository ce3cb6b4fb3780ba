"""A durable sink for generation: the model is asked inside the writer, and every finished chunk of prompts is kept.

A Spark data source of its own (``answer_sink``). Each task deals its rows into chunks of ``keep_every`` prompts, and
puts a chunk's answers into one file as soon as they are there, under a name made of run, partition and chunk. The file
appears whole, by a rename. So

* a job that fails keeps all finished chunks, of finished tasks and of those that were cut off, and a later run is
  given only the samples that are in no file;
* a task that is tried again, on another machine too, finds the chunks of its earlier attempt and asks for the rest. A
  chunk holds the same samples in each attempt, since the input is a written table read without a shuffle; two
  attempts at once replace each other's file by an equal one.

The driver collects a message from each task and writes the run's manifest, also when the job failed: what each run
was given, asked for and kept. Files are opened by ``pyarrow.fs`` on the workers, which knows local and mounted
folders, HDFS and the large object stores; ``reachable`` tells whether it knows a path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from glossmill.operators.plugins import Plugin, clipped

SINK = "glossmill_answers"
RUNS = "_runs"
KEEP_EVERY = 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    try:
        opened(path)
        return True
    except (OSError, pa.ArrowException, ValueError):
        return False


def put(store: fs.FileSystem, folder: str, name: str, mark: str, write) -> None:
    """A file that appears whole: written under a hidden name first."""
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{mark}"
    with store.open_output_stream(hidden) as out:
        write(out)
    store.move(hidden, f"{folder}/{name}")


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of exactly ``size``, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= size:
            rest = size - n
            yield pa.Table.from_batches([*held, batch.slice(0, rest)])
            held, n, batch = [], 0, batch.slice(rest)
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Job:
    """What every task of a run needs to know."""

    path: str
    run: str
    model: Plugin
    batch_size: int
    keep_every: int
    encoder: Plugin | None
    max_length: int | None

    def answers(self, prompts: list[str]) -> Iterator[str]:
        """The model's texts for the prompts, cut first as the caller's tokenizer counts."""
        generate = self.model.get()
        for at in range(0, len(prompts), self.batch_size):
            part = prompts[at : at + self.batch_size]
            if self.encoder is not None and self.max_length is not None:
                part = clipped(self.encoder.get(), part, self.max_length)
            texts = generate(part)
            if len(texts) != len(part):
                raise ValueError(f"{len(part)} prompts gave {len(texts)} texts")
            yield from texts


@dataclass
class TaskDone(WriterCommitMessage):
    """A finished task's files, samples, and how many of them it had to ask the model for."""

    files: list[str] = field(default_factory=list)
    samples: int = 0
    asked: int = 0


class AnswerWriter(DataSourceArrowWriter):
    def __init__(self, job: Job):
        self.job = job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskDone:
        job, context, done = self.job, TaskContext.get(), TaskDone()
        store, folder = opened(job.path)
        for number, rows in enumerate(chunks(iterator, job.keep_every)):
            name = f"part-{context.partitionId():05d}-{job.run}-{number:05d}.parquet"
            if store.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
                texts = pa.array(job.answers(rows["prompt"].to_pylist()), pa.string())
                table = rows.drop_columns(["prompt"]).append_column("raw_text", texts)
                put(store, folder, name, str(context.taskAttemptId()), lambda out: pq.write_table(table, out))
                done.asked += rows.num_rows
            done.files.append(name)
            done.samples += rows.num_rows
        return done

    def commit(self, messages: list[TaskDone | None]) -> None:
        self._record(messages, True)

    def abort(self, messages: list[TaskDone | None]) -> None:
        """Nothing is taken back: a file holds whole answers whether its job succeeded or not."""
        self._record(messages, False)

    def _record(self, messages, finished: bool) -> None:
        tasks = [asdict(m) for m in messages if m is not None]
        record = {
            "run": self.job.run, "finished": finished, "tasks": len(tasks), "samples": sum(t["samples"] for t in tasks),
            "asked": sum(t["asked"] for t in tasks), "files": [f for t in tasks for f in t["files"]],
        }
        store, folder = opened(self.job.path)
        put(store, f"{folder}/{RUNS}", f"{self.job.run}.json", "new", lambda out: out.write(json.dumps(record).encode()))


def answer_sink(given: Job) -> type[DataSource]:
    """The data source of one run; it travels to the workers by value, with the caller's functions in it."""

    class AnswerSink(DataSource):
        job = given

        @classmethod
        def name(cls) -> str:
            return f"{SINK}_{given.run}"

        def writer(self, schema, overwrite: bool) -> AnswerWriter:
            return AnswerWriter(self.job)

    return AnswerSink


def generate_into(prompts: DataFrame, job: Job) -> None:
    """Ask for the ``prompt`` of every row and keep its other columns with the answer under ``job.path``."""
    sink = answer_sink(job)
    prompts.sparkSession.dataSource.register(sink)
    prompts.write.format(sink.name()).mode("append").save()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: one row for each run, with the tasks that finished, their samples, prompts asked, and files."""
    schema = "run string, finished boolean, tasks int, samples long, asked long, files array<string>"
    return spark.read.schema(schema).json(f"{path}/{RUNS}")
