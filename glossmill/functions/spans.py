"""Marking the two entities of a pair inside a tokenised sentence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The tags around the subject and the object.
SUBJECT_TAGS = ("<e1>", "</e1>")
OBJECT_TAGS = ("<e2>", "</e2>")


def _put(tokens: Column, size: Column, position: Column, tag: Column) -> Column:
    """Insert at a 0-based position; a position past the end appends."""
    return F.array_insert(tokens, F.least(position, size) + 1, tag)


def _wrap(tokens: Column, size: Column, span: Column) -> Column:
    closed = _put(tokens, size, span["end"] + 1, span["close"])
    return _put(closed, size + 1, span["start"], span["open"])


def insert_markers(words: Column, subject: Column, obj: Column) -> Column:
    """The sentence with both entities tagged.

    ``subject`` and ``obj`` are structs with ``start_token_idx`` and ``end_token_idx``.  The span that
    starts later is tagged first so that the other indices stay valid, the subject first on a tie; a
    span with a negative index is left untagged.
    """

    def span(entity: Column, tags: tuple[str, str]) -> Column:
        return F.struct(
            entity["start_token_idx"].alias("start"), entity["end_token_idx"].alias("end"),
            F.lit(tags[0]).alias("open"), F.lit(tags[1]).alias("close"),
        )

    subj, other = span(subject, SUBJECT_TAGS), span(obj, OBJECT_TAGS)
    subject_later = subject["start_token_idx"] >= obj["start_token_idx"]
    first = F.when(subject_later, subj).otherwise(other)
    second = F.when(subject_later, other).otherwise(subj)

    size = F.size(words)
    skip_first = (first["start"] < 0) | (first["end"] < 0)
    skip_second = (second["start"] < 0) | (second["end"] < 0)
    tagged = F.when(skip_first, words).otherwise(_wrap(words, size, first))
    size_now = size + F.when(skip_first, 0).otherwise(2)
    both = F.when(skip_second, tagged).otherwise(_wrap(tagged, size_now, second))
    apart = (
        (second["start"] >= 0) & (second["start"] <= second["end"]) & (second["end"] < first["start"])
        & (first["start"] <= first["end"]) & (first["end"] < size)
    )
    return F.when(apart, _joined_apart(words, size, second, first)).otherwise(F.array_join(both, " "))


def _joined_apart(words: Column, size: Column, left: Column, right: Column) -> Column:
    """The same of two spans that lie in the sentence one behind the other: its pieces are joined without a copy per tag."""

    def piece(start: Column, end: Column) -> Column:
        return F.slice(words, start + 1, F.greatest(end - start, F.lit(0)))

    return F.concat_ws(
        " ", piece(F.lit(0), left["start"]), left["open"], piece(left["start"], left["end"] + 1), left["close"],
        piece(left["end"] + 1, right["start"]), right["open"], piece(right["start"], right["end"] + 1), right["close"],
        piece(right["end"] + 1, size),
    )
