"""Substring dedup on bytes by suffix arrays.

Texts are cut into runs of windows that share a minimiser, so that equal windows meet in one shard. For each shard
the suffix array comes from induced sorting and the permuted common prefixes from its irreducible positions; a
window is repeated if it shares its whole length with a neighbour in the array.

A very long text is cut a block of windows at a time. Null text: empty. Texts shorter than a window are kept whole. Rows that repeat a document are copies of it, and all
lose what they share. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.common import appended, column, keyed, table
from glossmill.llm.suffixes import permuted_prefixes, suffix_array
from glossmill.llm.windows import Units, merged, mixed, repeated_stretches, with_stretches

WINDOW = 400
GRAM = 64
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def byte_hashes(text: bytes) -> tuple[np.ndarray, bytes]:
    return BYTE_HASH[np.frombuffer(text, np.uint8)], text


def repeated_windows(runs: list[bytes], window: int) -> list[np.ndarray]:
    """Which windows of each run occur more than once among all of them.

    The runs are joined with a separator that no byte equals, so a common prefix of a whole window lies inside runs.
    """
    lengths = np.array([len(r) for r in runs])
    begin = np.cumsum(lengths + 1) - lengths - 1
    text = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8).astype(np.int64) + 2
    text[begin + lengths] = 1
    text = np.append(text, 0)
    order = suffix_array(text, 258)
    common = permuted_prefixes(text, order)[order]
    long = common >= window
    repeated = np.zeros(text.size, bool)
    repeated[order[long]] = True
    repeated[order[np.flatnonzero(long) - 1]] = True
    return [repeated[b : b + n - window + 1] for b, n in zip(begin.tolist(), lengths.tolist())]


BYTES = Units(byte_hashes, lambda text, a, b: text[a:b], byte_hashes, repeated_windows)


def repeated_byte_stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = 27,
                            crowd: int = 4096, shard_bytes: int = 2 << 20) -> DataFrame:
    """``keyed`` documents: key and stretches of bytes covered by repeated windows."""
    return repeated_stretches(docs, BYTES, window, gram, filter_bits, crowd, shard_bytes)


RESULTS = {
    "n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()),
    "kept_sha256": ("string", pa.string()),
}
KEPT = {"kept": ("string", pa.string())}


def suffix_dedup(docs: DataFrame, with_kept: bool = False, drop: tuple = (), **parameters) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes as text.

    A code point of which a part is removed is not in the text; the digest is of the bytes as they are.
    """

    def cut(rows):
        for batch in rows:
            out = []
            for value, stretches in zip(column(batch, "text").cast(pa.binary()), column(batch, "stretches").to_pylist()):
                data = value.as_py() or b""
                spans = merged(stretches)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(),
                            left.decode(errors="ignore") if with_kept else None))
            yield batch, {name: [r[i] for r in out] for i, name in enumerate((*RESULTS, *KEPT))}

    found = with_stretches(docs, repeated_byte_stretches(keyed(docs), **parameters))
    return appended(found, {**RESULTS, **(KEPT if with_kept else {})}, cut, drop=("stretches", *drop))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
