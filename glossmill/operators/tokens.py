"""Token columns: ids, masks, prompt lengths, loss labels, padded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from glossmill.functions.chat import TURN_END, chat_full, chat_prompt, chat_turn, open_turn
from glossmill.operators.ids import with_aligned_id
from glossmill.operators.plugins import Plugin, clipped
from glossmill.schemas import SAMPLE_ORDER

# The label the loss skips.
IGNORE = -100
# Default tokens: runs of letters, digits and underscores, or any other single visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
VOCABULARY = 32_000
MAX_LENGTH = 1024

Encoder = Callable[[list[str]], list[list[int]]]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def clip_tokens(text: Column, most: int) -> Column:
    """The text up to the end of its token number ``most``, or all of it if it has fewer; read once, up to there."""
    first = rf"(?:\s*+(?:[\p{{L}}\p{{N}}_]++|[^\s\p{{L}}\p{{N}}_])){{{most}}}+"
    return F.regexp_extract(text, rf"^{first}|^(?s:.*+)", 0)


def hashed_ids(token_array: Column, vocabulary: int = VOCABULARY) -> Column:
    return F.transform(token_array, lambda t: F.pmod(F.xxhash64(t), F.lit(vocabulary)).cast("int"))


def encoder_udf(make_encoder: Callable[[], Encoder]):
    """A tokenizer of the caller as an Arrow batch function, made once per worker process.  A null text has no tokens."""
    plugin = Plugin(make_encoder)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = plugin.get()
        for texts in batches:
            yield pd.Series(encoder(["" if t is None else t for t in texts]), index=texts.index, dtype=object)

    return encode


def clip_by_encoder(text: Column, most: int, make_encoder: Callable[[], Encoder]) -> Column:
    """The text up to the end of its token number ``most``, as the caller's tokenizer counts; it has to tell spans."""
    plugin = Plugin(make_encoder)

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = plugin.get()
        for texts in batches:
            yield pd.Series(clipped(encoder, ["" if t is None else t for t in texts], most), index=texts.index, dtype=object).where(texts.notna(), None)

    return cut(text)


def tokenize(
    df: DataFrame,
    col: str,
    max_len: int = MAX_LENGTH,
    make_encoder: Callable[[], Encoder] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` of at most ``max_len`` tokens; ``keep`` drops the rest."""
    if make_encoder is None:
        ids = hashed_ids(F.slice(tokens(F.col(col)), 1, max_len))
    else:
        ids = F.slice(encoder_udf(make_encoder)(F.col(col)), 1, max_len)
    out = df.withColumn("input_ids", ids).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))
    )
    return out.select(*keep, "input_ids", "attention_mask") if keep is not None else out


def with_prompt_length(df: DataFrame, prompt: str, make_encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """Add the number of tokens of the prompt, not clipped to the maximum length."""
    if make_encoder is None:
        size = F.size(tokens(F.col(prompt)))
    else:
        size = F.size(encoder_udf(make_encoder)(F.col(prompt)))
    return df.withColumn("prompt_length", size)


def token_lengths(text: Column, max_len: int = MAX_LENGTH) -> Column:
    return F.least(F.size(tokens(text)), F.lit(max_len))


def loss_labels(ids: Column, prompt_length: Column) -> Column:
    """Labels: the ids with everything that belongs to the prompt masked out."""
    masked = F.greatest(F.least(prompt_length, F.size(ids)), F.lit(0))
    return F.concat(F.array_repeat(F.lit(IGNORE), masked), F.slice(ids, masked + 1, F.size(ids)))


def _token_parts(samples: DataFrame) -> tuple[Column, Column, Column]:
    """Default tokens of the system turn, the user turn with the opened answer, and the answer."""
    user = F.concat(chat_turn(F.lit("user"), F.col("user")), open_turn())
    return (
        tokens(chat_turn(F.lit("system"), F.col("system"))), tokens(user),
        tokens(F.concat(F.col("assistant"), F.lit(TURN_END))),
    )


def instruction_prompt_length(samples: DataFrame) -> DataFrame:
    """Add the number of default tokens before the answer."""
    system, user, _ = _token_parts(samples)
    return samples.withColumn("prompt_length", F.size(system) + F.size(user))


def instruction_tokens(
    samples: DataFrame,
    keep: list[str],
    max_len: int = MAX_LENGTH,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Token rows of instruction samples: ids, mask, prompt length and loss labels.

    The default tokens never span white space, and every chat turn ends in a line break, so each part
    is tokenised once; the constant system turn folds to a literal list.  A caller's encoder may merge
    across parts and gets the whole texts.
    """
    if make_encoder is None:
        system, user, answer = _token_parts(samples)
        parts = samples.select(*keep, system.alias("_system"), user.alias("_user"), answer.alias("_answer"))
        whole = F.concat("_system", "_user", "_answer")
        rows = parts.select(
            *keep, (F.size("_system") + F.size("_user")).alias("prompt_length"),
            hashed_ids(F.slice(whole, 1, max_len)).alias("input_ids"),
        ).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    else:
        chats = samples.select(
            *keep,
            chat_full(F.col("system"), F.col("user"), F.col("assistant")).alias("_full"),
            chat_prompt(F.col("system"), F.col("user")).alias("_prompt"),
        )
        rows = tokenize(with_prompt_length(chats, "_prompt", make_encoder), "_full", max_len, make_encoder)
    return rows.select(
        *keep, "input_ids", "attention_mask", "prompt_length",
        loss_labels(F.col("input_ids"), F.col("prompt_length")).alias("labels"),
    )


def _padded(array: str, width: Column, filler: int) -> Column:
    missing = F.greatest(width - F.size(array), F.lit(0))
    return F.concat(F.col(array), F.array_repeat(F.lit(filler), missing)).alias(array)


def pad_batches(rows: DataFrame, batch_size: int, pad_id: int = 0, id_col: str = "id",
                order: list[str] | None = None) -> DataFrame:
    """Consecutive rows in batches, every array padded to the longest of its batch.

    Rows without an id get one in ``order``.  They move once: the ranges they are ranked in end where batches end, so a
    batch is whole in its partition.  A batch is one window group and never holds more than ``batch_size`` rows.
    """
    ranked = id_col in rows.columns
    if not ranked:
        rows = with_aligned_id(rows, order or SAMPLE_ORDER, batch_size, id_col)
    fillers = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE}
    batch = F.floor(F.col(id_col) / batch_size).cast("bigint")
    group = ["batch"] if ranked else ["_range", "batch"]
    sized = rows.withColumn("batch", batch).withColumn("width", F.max(F.size("input_ids")).over(Window.partitionBy(*group)))
    others = [c for c in sized.columns if c not in fillers and c != "_range"]
    return sized.select(*others, *[_padded(c, F.col("width"), v) for c, v in fillers.items() if c in rows.columns])
