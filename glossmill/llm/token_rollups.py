"""Token counts as rollups that batches of signed changes keep up to date.

A change adds (sign 1) or takes back (sign -1) one document's count under its source, language and tokenizer version.
A batch is summed to one row per group and committed as one folder of the store; totals are the sums over all
committed folders. A batch id commits once, also when two commit it at the same time: a second commit of it changes
nothing, and what a failed commit left behind does not count. A revised count is the old row taken back and the new one added, so totals never need the texts.

Null text: no tokens. Null source or language: a group of its own. Repeated rows count as often as they are there.
Empty batches commit and add nothing; totals of an empty store have no rows. Groups whose documents and tokens
have all been taken back are left out; one whose tokens do not cancel stays, also without documents, since its changes
contradict each other. A very long text is encoded in one piece in its row. Other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.llm.common import appended, column, stored, table
from glossmill.llm.token_ids import byte_bpe_50k, ids_of
from glossmill.session import scratch_path

GROUP = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, version: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version and n_tokens of each document."""
    path, pattern = vocabulary or byte_bpe_50k()

    def run(rows):
        for batch in rows:
            yield batch, {"n_tokens": [ids_of(t.as_py(), path, pattern).size for t in column(batch, "text")]}

    found = appended(docs.select("doc_id", "source", "lang", "text"), {"n_tokens": ("long", pa.int64())}, run)
    return found.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, "n_tokens", F.lit(1).alias("sign"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, "n_tokens", F.lit(-1).alias("sign"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old counts taken back, new ones added."""
    return deletes(before).unionByName(inserts(after))


class RollupStore:
    """Committed batches under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> list[str]:
        """Folders of the committed batches, as their commit files name them."""
        path, files = self._files()
        marks = files.globStatus(path(f"{self.path}/commit-*"))
        named = [self._read(files, m.getPath()) for m in marks or []]
        return sorted(f"{self.path}/{name}" for name in named if name)

    def _read(self, files, mark) -> str:
        stream = files.open(mark)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing done, if its id is there already.

        The sums are written to a folder of their own first. Making the batch's commit file, which names the folder, is
        one step that succeeds for one committer only; a folder that no commit file names does not count.
        """
        path, files = self._files()
        mark, folder = path(f"{self.path}/commit-{batch_id}"), f"batch-{batch_id}-{uuid.uuid4().hex}"
        if files.exists(mark):
            return False
        deltas = changes.groupBy(*GROUP).agg(
            F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        deltas.write.parquet(f"{self.path}/{folder}")
        try:
            stream = files.create(mark, False)
        except Py4JJavaError:  # someone else was faster
            if not files.exists(mark):
                raise
            files.delete(path(f"{self.path}/{folder}"), True)
            return False
        stream.write(bytearray(folder.encode()))
        stream.close()
        return True

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of every group in which they do not cancel."""
        folders = self.committed()
        deltas = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each sent twice: all documents in; those of low quality out; the toxic ones, which
    are still in, counted anew by a version that also counts the closing token."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = stored(counted(docs, "byte_bpe_50k"), "counts")
    low = labels.filter("quality = 0").select("doc_id").distinct()
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    again = first.join(toxic, "doc_id", "left_semi").join(low, "doc_id", "left_anti")
    closed = again.withColumns({"n_tokens": F.col("n_tokens") + 1, "tokenizer_version": F.lit("byte_bpe_50k+end")})
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    for batch_id, changes in (
        ("1-load", inserts(first)), ("2-low-quality", deletes(first.join(low, "doc_id", "left_semi"))),
        ("3-closing-token", revisions(again, closed)),
    ) * 2:
        store.commit(batch_id, changes)
    return store.totals()
