"""Repeated windows against a plain count of all windows."""
import hashlib
from collections import Counter

import numpy as np
import pytest

from glossmill.llm.induced import suffix_dedup
from glossmill.llm.suffixes import doubled_suffix_array, permuted_prefixes, suffix_array
from glossmill.llm.superkmers import substring_dedup
from glossmill.llm.windows import runs_of
from llm_tables import awkward, make_docs, sample  # noqa: F401


def removed(units, window):
    """For each row, which of its units a repeated window covers."""
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        cover = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                cover[i : i + window] = True
        out.append(cover)
    return out


def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def words_expected(rows, window):
    units = [(t or "").encode().split() for _, t in rows]
    out = []
    for (doc_id, _), u, cover in zip(rows, units, removed(units, window)):
        kept = b" ".join(w for w, c in zip(u, cover) if not c)
        out.append((doc_id, len(u), int(cover.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def bytes_expected(rows, window):
    units = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), u, cover in zip(rows, units, removed(units, window)):
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        kept = bytes(b for b, c in zip(u, cover) if not c)
        out.append((doc_id, len(u), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60, n))
    shared = [draw(70), draw(40)]
    rows = [(i, f"{draw(rng.integers(0, 80))} {shared[i % 2] if i % 3 else ''} {draw(20)}") for i in range(30)]
    rows += [(100, "tick tock " * 60), (101, rows[3][1]), (102, rows[3][1].replace("w1 ", "v1 ")), (103, None), (104, "")]
    return rows


@pytest.mark.parametrize("crowd", [1, 4096])
def test_words_against_all_windows(make_docs, crowd):
    rows = passages(1)
    found = substring_dedup(make_docs(rows), window=12, gram=4, filter_bits=16, crowd=crowd, shard_bytes=500)
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept_sha256") == words_expected(rows, 12)


@pytest.mark.parametrize("crowd", [1, 4096])
def test_bytes_against_all_windows(make_docs, crowd):
    rows = passages(2)
    found = suffix_dedup(make_docs(rows), window=50, gram=16, filter_bits=16, crowd=crowd, shard_bytes=2000)
    assert by_row(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_expected(rows, 50)


def test_full_filter_loses_nothing(make_docs):
    """A filter of 8 bits lets nearly everything through; the result is the same."""
    rows = passages(3)
    found = substring_dedup(make_docs(rows), window=12, gram=4, filter_bits=15)
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept_sha256") == words_expected(rows, 12)


def test_awkward_rows_and_other_columns(awkward):
    rows = [(r["doc_id"] or 0, r["text"]) for r in awkward.collect()]
    words = substring_dedup(awkward.withColumnRenamed("lang", "n_removed"))
    assert by_row(words.na.fill(0, ["doc_id"]), "doc_id", "n_words", "n_removed", "kept_sha256") == words_expected(rows, 35)
    assert "source" in words.columns
    data = suffix_dedup(awkward.na.fill(0, ["doc_id"]).withColumnRenamed("lang", "stretches"), with_kept=True)
    assert by_row(data, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_expected(rows, 400)


def test_empty_table(make_docs):
    assert substring_dedup(make_docs([])).count() == 0
    assert suffix_dedup(make_docs([])).count() == 0


def test_cut_code_point_is_left_out(make_docs):
    rows = [(1, "é" * 30 + "end"), (2, "ü" + "é" * 29 + "x")]
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup(make_docs(rows), with_kept=True, window=9, gram=3).collect()}
    assert kept[1].endswith("end") and "é" * 10 not in kept[1]


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays_against_sorting(seed):
    rng = np.random.default_rng(seed)
    symbols = int(rng.choice([2, 3, 40]))
    text = rng.integers(1, symbols + 1, int(rng.integers(1, 150)))
    if seed % 4 == 0:
        text = np.tile(text, 3)
    text = np.append(text, 0)
    plain = text.tolist()
    order = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert suffix_array(text, symbols + 1).tolist() == order
    assert doubled_suffix_array(text).tolist() == order
    common = permuted_prefixes(text, np.array(order))
    for a, b in zip(order[1:], order):
        size = 0
        while plain[a + size : a + size + 1] == plain[b + size : b + size + 1] != []:
            size += 1
        assert common[a] == size


def test_runs_cover_every_window_once():
    units = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    first, end, _ = runs_of(units, 30, 8)
    assert first[0] == 0 and end[-1] == 471 and (first[1:] == end[:-1]).all()
