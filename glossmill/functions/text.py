"""Whitespace, trimming and term matching that agree with Python's ``str`` methods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters str.split() and str.strip() count as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern.  The rare ones sit behind one range test, so that ordinary
# characters are told apart with two comparisons instead of one per whitespace character.
WS_RUN = (
    r"[\s\x1c-\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
)
# A character that may be white space other than a blank.  Text without one, and without two blanks in a row, is cut
# at its blanks, which needs no pattern.
UNCOMMON = r"[^ -~\u00a1-\u167f]"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(PY_WHITESPACE))


def words(col: Column) -> Column:
    """Whitespace tokens; an empty or blank string gives an empty array."""
    return split_words(strip(col))


def split_words(text: Column) -> Column:
    """The same of a text that is stripped already."""
    odd = text.contains("  ") | text.rlike(UNCOMMON)
    return F.when(text == "", F.array().cast("array<string>")).when(odd, F.split(text, WS_RUN)).otherwise(F.split(text, " "))


def normalize_term(col: Column) -> Column:
    """Lower case, trimmed, inner whitespace runs collapsed to one blank."""
    return F.regexp_replace(strip(F.lower(col)), WS_RUN, " ")


def padded_text(text: Column) -> Column:
    """The normalised text with a blank on both sides, to look terms up in: make it once for a text."""
    return F.concat(F.lit(" "), normalize_term(text), F.lit(" "))


def resolve_span(term: Column, text: Column) -> Column:
    """First case-insensitive whole-token match as ``struct<start, end>``, or (-1, -1)."""
    return span_in(term, padded_text(text))


def span_in(term: Column, hay: Column) -> Column:
    """The same in a ``padded_text``.

    Tokens hold no blanks, so a token-aligned match is a substring match of the two normalised texts
    with a blank on both sides, and the start index is the number of blanks before it.
    """
    needle = normalize_term(term)
    size = F.length(needle) - F.length(F.replace(needle, F.lit(" "), F.lit(""))) + 1

    def span(pair: Column) -> Column:
        head = F.substring(pair["hay"], F.lit(1), pair["at"])
        start = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1
        hit = (pair["at"] > 0) & (needle != "")
        return F.struct(
            F.when(hit, start).otherwise(F.lit(-1)).cast("int").alias("start"),
            F.when(hit, start + size - 1).otherwise(F.lit(-1)).cast("int").alias("end"),
        )

    padded = F.concat(F.lit(" "), needle, F.lit(" "))
    return bind(hay, lambda h: bind(F.struct(h.alias("hay"), F.position(padded, h).alias("at")), span))
