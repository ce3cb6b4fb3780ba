"""Whole conversations as ChatML text, from a table of turns."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from glossmill.functions.chat import chat_turn, open_turn
from glossmill.session import written

PIECE_BYTES = 8 << 20


def pieces(turns: DataFrame, piece_bytes: int = PIECE_BYTES, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Consecutive turns of a conversation rendered together: ``conv``, ``first`` (number of the first turn), ``part``
    (counts pieces that begin with the same number), ``n_turns``, ``rendered``, and ``whole`` where no other piece exists.

    The turns are dealt by ranges of conversation and number, so a conversation of any length is spread over tasks, and
    stream through them in order.  A task holds one piece: it ends with the conversation, with the task's range, or at
    about ``piece_bytes``.  Turns of equal number are ordered by role and text; a missing role or text is empty.
    """
    names = {"conv": conversation, "turn": turn, "role": role, "text": text}
    rows = turns.select(*(F.col(c).alias(name) for name, c in names.items()))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    rendered = chat_turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    schema = T.StructType([
        T.StructField("conv", rows.schema["conv"].dataType), T.StructField("first", rows.schema["turn"].dataType),
        T.StructField("part", T.IntegerType()), T.StructField("n_turns", T.LongType()), T.StructField("rendered", T.StringType()),
        T.StructField("whole", T.BooleanType()),
    ])
    return dealt.select("conv", "turn", rendered.alias("rendered")).mapInArrow(lambda batches: _joined(batches, piece_bytes), schema)


def _changes(keys: pa.Array) -> list[int]:
    """Places at which a value differs from the one before; nulls equal each other."""
    a, b = keys[1:], keys[:-1]
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return [i + 1 for i, d in enumerate(differ.to_pylist()) if d]


def _joined(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of rows (conversation, turn, text) that are in order.

    The texts of neighbouring rows lie behind each other in the batch, so a piece is cut out of it at once.
    """
    conv = first = None
    texts: list[memoryview | bytes] = []
    size = n = part = 0
    seen = 0  # conversations that have begun in this task

    def piece(ended: bool) -> tuple:
        return conv, first, part, n, b"".join(texts), ended and part == 0 and seen > 1

    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        convs, turns, text = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
        data, offsets = text.buffers()[2], pa.Array.from_buffers(pa.int32(), len(text) + 1, [None, text.buffers()[1]], offset=text.offset).to_pylist()
        cuts = [0, *_changes(convs), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            value = convs[a].as_py()
            if not seen or value != conv:
                if n:
                    out.append(piece(True))
                conv, texts, size, n, part, seen = value, [], 0, 0, 0, seen + 1
            at = a
            while at < b:  # as many rows as the piece has room for, one at least
                end = min(b, bisect_left(offsets, offsets[at] + piece_bytes - size, at + 1))
                if not n:
                    first = turns[at].as_py()
                texts.append(data[offsets[at] : offsets[end]].to_pybytes() if data else b"")
                size, n, at = size + offsets[end] - offsets[at], n + end - at, end
                if size >= piece_bytes:
                    out.append(piece(False))
                    texts, size, n, part = [], 0, 0, part + 1
        if out:
            yield _batch(out, convs.type, turns.type)
        last = convs.type, turns.type
    if n:
        yield _batch([piece(False)], *last)


def _batch(rows: list[tuple], conv: pa.DataType, turn: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, turn, pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    arrays[4] = arrays[4].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, ["conv", "first", "part", "n_turns", "rendered", "whole"])


def conversations(turns: DataFrame, generation_prompt: bool = False, conversation: str = "conv_id", **columns) -> DataFrame:
    """One row per conversation: its id, n_turns, and all its turns ``rendered`` in order.

    Only conversations cut by a range or by size, about one for each range, are put together in a second step; the others
    come out of the first.  A conversation longer than a string can be has to be read as ``pieces``.
    """
    table = written(pieces(turns, conversation=conversation, **columns), "pieces")
    done = table.filter("whole").select("conv", "n_turns", "rendered")
    parts = F.array_sort(F.collect_list(F.struct("first", "part", "rendered")))
    cut = table.filter("not whole").groupBy("conv").agg(
        F.sum("n_turns").alias("n_turns"), F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("rendered"))
    out = done.unionByName(cut)
    text: Column = F.concat("rendered", open_turn()) if generation_prompt else F.col("rendered")
    return out.select(F.col("conv").alias(conversation), "n_turns", text.alias("rendered"))
