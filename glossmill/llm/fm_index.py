"""Benchmark decontamination with an FM-index over each shard of the training texts.

The texts of a shard become one sequence of word numbers. Its Burrows-Wheeler transform, kept as a wavelet matrix,
answers backward search for all test phrases at once; rows found are walked to the nearest sampled suffix position
to locate them. Overlapping hits merge into spans, which ``clean`` leaves out of the text.

Words that no test phrase has are one symbol, and a row of them is kept once: no phrase can lie across it.

Null text: no words. Items without words have no phrase. A phrase that several items share counts for each. Repeated
documents are judged one by one. Empty tables: nothing is hit. A text is indexed whole, so memory follows the shard
or the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.llm.common import KEYS, appended, column, keyed, slices, stored, table, with_keys
from glossmill.llm.suffixes import doubled_suffix_array

WINDOW = 10
LOWERED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
END, OTHER, FIRST_WORD = 0, 1, 2
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWERED).split()


class BitRanks:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((bits.size // 64 + 1) * 64, np.uint8)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit of the symbol at a time."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, BitRanks, int]] = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            one = (symbols >> bit) & 1 == 1
            self.levels.append((bit, BitRanks(one), int(symbols.size - one.sum())))
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, ranks, zeros in self.levels:
            ones = ranks.ones(place)
            place = np.where((symbols >> bit) & 1 == 1, zeros + ones, place - ones)
        return place

    def rank(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbols, place) - self.start[symbols]

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.zeros(place.size, np.int64)
        for bit, ranks, zeros in self.levels:
            one, ones = ranks.get(place), ranks.ones(place)
            symbols |= one.astype(np.int64) << bit
            place = np.where(one, zeros + ones, place - ones)
        return symbols, place - self.start[symbols]


class FMIndex:
    """Backward search and sampled positions over symbols that end with a single 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = 8) -> None:
        order = doubled_suffix_array(symbols)
        self.size = symbols.size
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))[:-1]
        self.ranks = WaveletMatrix(symbols[order - 1], sigma)
        sampled = order % rate == 0
        self.sampled = BitRanks(sampled)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of each phrase (rows of ``phrases``, filled up behind ``lengths``)."""
        lo, hi = np.zeros(lengths.size, np.int64), np.full(lengths.size, self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            symbols = phrases[live, lengths[live] - 1 - step]
            lo[live] = self.smaller[symbols] + self.ranks.rank(symbols, lo[live])
            hi[live] = self.smaller[symbols] + self.ranks.rank(symbols, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row: walk left until a sampled one."""
        out = np.empty(rows.size, np.int64)
        live, steps = np.arange(rows.size), 0
        while live.size:
            known = self.sampled.get(rows)
            out[live[known]] = self.samples[self.sampled.ones(rows[known])] + steps
            live, rows, steps = live[~known], rows[~known], steps + 1
            symbols, rank = self.ranks.symbol_and_rank(rows)
            rows = self.smaller[symbols] + rank
        return out


class Phrases:
    """Distinct windows of test items as word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            n = [self.numbers.setdefault(w, len(self.numbers) + FIRST_WORD) for w in words_of(text)]
            for at in range(max(1, len(n) - window + 1)) if n else ():
                found[tuple(n[at : at + window])].add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for row, phrase in enumerate(found):
            self.symbols[row, : len(phrase)] = phrase
        self.sigma = len(self.numbers) + FIRST_WORD


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def search_shard(texts: list[bytes], phrases: Phrases, most_rows: int = 1 << 20) -> list[tuple[int, list, set[str]]]:
    """For each text: number of words, merged spans of hit words, items with a phrase in it."""
    known = phrases.numbers.get
    parts, places, counts = [], [], []
    for text in texts:
        words = words_of(text)
        symbols = np.fromiter(map(known, words, repeat(OTHER)), np.int64, len(words))
        kept = np.flatnonzero((symbols != OTHER) | (np.concatenate(([FIRST_WORD], symbols[:-1])) != OTHER))
        parts += [symbols[kept], [OTHER]]
        places += [kept, [0]]
        counts.append(len(words))
    begin = np.concatenate(([0], np.cumsum(counts)))
    sizes = [len(p) for p in parts[::2]]
    offset = np.repeat(begin[:-1], np.array(sizes) + 1)
    place = np.concatenate(places).astype(np.int64) + offset
    index = FMIndex(np.concatenate([*parts, [END]]).astype(np.int64), phrases.sigma)
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    hit = np.zeros(int(begin[-1]) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    found = np.flatnonzero(hi > lo)
    total = np.cumsum(hi[found] - lo[found])
    for at in range(0, int(total[-1]) if total.size else 0, most_rows):
        nth = np.arange(at, min(at + most_rows, int(total[-1])))
        which = np.searchsorted(total, nth, "right")
        phrase = found[which]
        word = place[index.locate(hi[phrase] - (total[which] - nth))]
        np.add.at(hit, word, 1)
        np.add.at(hit, word + phrases.lengths[phrase], -1)
        text = np.searchsorted(begin, word, "right") - 1
        for t, p in np.unique(np.stack((text, phrase), 1), axis=0).tolist():
            items[t] |= phrases.items[p]
    covered = np.cumsum(hit)[:-1] > 0
    return [
        (n, spans_of(covered[b : b + n]) if i else [], i) for b, n, i in zip(begin.tolist(), counts, items)
    ]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    words = [m.span() for m in WORD.finditer(text.translate(LOWERED))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


SPANS = (
    "array<struct<a:int,b:int>>", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
)
FOUND = {
    "n_words": ("long", pa.int64()), "spans": SPANS, "items": ("array<string>", pa.list_(pa.string())),
}
REPORT = {
    "n_words": ("long", pa.int64()), "n_hit": ("long", pa.int64()), "n_items": ("long", pa.int64()),
    "items_sha256": ("string", pa.string()), "contaminated": ("boolean", pa.bool_()),
}
CLEAN = {"clean": ("string", pa.string())}


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """Number of blocks of about ``block_bytes`` of test items' text, and the blocks, each made when it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").na.drop(subset=["text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return n, (
        Phrases([(r["item_id"], r["text"].encode()) for r in items.filter(F.col("block") == b).toLocalIterator()], window)
        for b in range(n)
    )


def _report(text: bytes, n: int, spans: list, items: set[str]) -> tuple:
    joined = ",".join(sorted(items)).encode()
    hit = sum(b - a for a, b in spans)
    return n, hit, len(items), hashlib.sha256(joined).hexdigest() if items else NO_ITEMS, hit > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False,
                  shard_bytes: int = 6 << 20, block_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, the clean text.

    One block of test items needs no shuffle. With more, each block is made, sent out, searched in a pass of its own and
    dropped again before the next, so that no memory grows with the benchmark; the documents that a pass hits are
    written, and these few rows are brought together by document.
    """
    results = {**REPORT, **(CLEAN if with_text else {})}
    count, blocks = phrase_blocks(benchmark, window, block_bytes)
    send = docs.sparkSession.sparkContext.broadcast

    def shards(rows, phrases):
        for batch in slices(rows, shard_bytes):
            texts = [t.as_py() or b"" for t in column(batch, "text").cast(pa.binary())]
            yield batch, texts, search_shard(texts, phrases)

    def answer(texts, found):
        rows = [_report(t, *f) for t, f in zip(texts, found)]
        out = {name: [r[i] for r in rows] for i, name in enumerate(REPORT)}
        if with_text:
            out["clean"] = [without(t, f[1]).decode() for t, f in zip(texts, found)]
        return out

    if count == 1:
        shared = send(next(blocks))

        def whole(rows):
            for batch, texts, found in shards(rows, shared.value):
                yield batch, answer(texts, found)

        return appended(docs, results, whole)

    def hits_of(block):
        def run(rows):
            for batch, _, found in shards(rows, block.value):
                hit = [i for i, f in enumerate(found) if f[2]]
                yield batch.take(pa.array(hit, pa.int64())), {
                    "n_words": [found[i][0] for i in hit], "items": [sorted(found[i][2]) for i in hit],
                    "spans": [[{"a": a, "b": b} for a, b in found[i][1]] for i in hit],
                }
        return appended(keyed(docs), FOUND, run).select(*KEYS, "spans", "items")

    hits = None
    for block in map(send, blocks):
        found = stored(hits_of(block), "hits")
        block.destroy()
        hits = found if hits is None else hits.unionByName(found)
    # Sets: rows that repeat a document in full share the key, and each brings the same answer of every block.
    hits = hits.groupBy(*KEYS).agg(
        F.flatten(F.collect_set("spans")).alias("all_spans"), F.flatten(F.collect_set("items")).alias("all_items")
    )
    joined = with_keys(docs.drop("all_spans", "all_items")).join(hits.hint("shuffle_hash"), KEYS, "left")

    def merge(rows):
        for batch in slices(rows, shard_bytes):
            texts = [t.as_py() or b"" for t in column(batch, "text").cast(pa.binary())]
            found = []
            for text, spans, items in zip(texts, column(batch, "all_spans").to_pylist(), column(batch, "all_items").to_pylist()):
                n = len(words_of(text))
                mask = np.zeros(n, bool)
                for s in spans or []:
                    mask[s["a"] : s["b"]] = True
                found.append((n, spans_of(mask), set(items or [])))
            yield batch, answer(texts, found)

    return appended(joined, results, merge).drop(*KEYS, "all_spans", "all_items")


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")
