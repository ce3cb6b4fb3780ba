"""Substring dedup on words by super-k-mer partitioning.

Windows of consecutive words that share a minimiser travel as one packed string to the bucket of that minimiser,
where sorting finds the windows that occur more than once. A word is removed if such a window covers it.

A very long text is cut a block of windows at a time. Null text: no words. Fewer words than a window: nothing is removed. Rows that repeat a document count as copies of
it, so both lose what they share. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.common import appended, column, keyed, table
from glossmill.llm.windows import Units, merged, repeated_stretches, with_stretches

WINDOW = 35
GRAM = 10


class WordHashes(dict):
    """Hash of each word, kept until there are ``most`` of them."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_known = WordHashes()


def word_hashes(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    words = text.split()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)), words


def repeated_windows(runs: list[bytes], window: int) -> list[np.ndarray]:
    """Which windows of each run occur more than once among all of them.

    Words become dense numbers; ranks of 1, 2, 4, ... words give ranks of twice as many by sorting pairs, up to the
    window. Equal rank is equal words, without hashing.
    """
    numbers: dict[bytes, int] = {}
    pieces = [run.split(b" ") for run in runs]
    symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for p in pieces for w in p), np.int64)
    size, rank = 1, symbols
    while size < window:
        step = min(size, window - size)
        pair = rank[: rank.size - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    begin = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))[:-1]
    counts = [len(p) - window + 1 for p in pieces]
    places = np.concatenate([np.arange(b, b + c) for b, c in zip(begin.tolist(), counts)])
    _, inverse, times = np.unique(rank[places], return_inverse=True, return_counts=True)
    return np.split(times[inverse] > 1, np.cumsum(counts)[:-1])


WORDS = Units(word_hashes, lambda words, a, b: b" ".join(words[a:b]), word_hashes, repeated_windows)


def repeated_word_stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = 27,
                            crowd: int = 4096, shard_bytes: int = 2 << 20) -> DataFrame:
    """``keyed`` documents: key and stretches of word positions covered by repeated windows."""
    return repeated_stretches(docs, WORDS, window, gram, filter_bits, crowd, shard_bytes)


RESULTS = {
    "n_words": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "kept_sha256": ("string", pa.string()),
}
KEPT = {"kept": ("string", pa.string())}


def substring_dedup(docs: DataFrame, with_kept: bool = False, drop: tuple = (), **parameters) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if asked for, kept: the remaining words joined by one space."""

    def cut(rows):
        for batch in rows:
            out = []
            for value, stretches in zip(column(batch, "text").cast(pa.binary()), column(batch, "stretches").to_pylist()):
                words = (value.as_py() or b"").split()
                kept, at = [], 0
                for a, b in merged(stretches):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_kept else None))
            yield batch, {name: [r[i] for r in out] for i, name in enumerate((*RESULTS, *KEPT))}

    found = with_stretches(docs, repeated_word_stretches(keyed(docs), **parameters))
    return appended(found, {**RESULTS, **(KEPT if with_kept else {})}, cut, drop=("stretches", *drop))


def op8_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
