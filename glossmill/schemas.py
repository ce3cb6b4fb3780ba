"""Column names, key columns and nested types shared by every operator."""

from pyspark.sql import types as T

# Position of a record: which source, then file, file split and line within the scan.  Sorting by
# ORDER_KEY gives the order the lines were listed in; RECORD_KEY alone is unique.
ORDER_KEY = ["source_idx", "file", "block", "seq"]
RECORD_KEY = ["source_idx", "seq"]
# A sample is a record, or one entity pair of it; positions are -1 when the sample is the record.
PAIR_POS = ["subj_pos", "obj_pos"]
SAMPLE_ORDER = ORDER_KEY + PAIR_POS
SAMPLE_KEY = RECORD_KEY + PAIR_POS

LANGUAGES = ("en", "vi")
LANGUAGE_HINTS = ("auto",) + LANGUAGES


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


def _ints(*names):
    return [T.StructField(n, T.IntegerType()) for n in names]


# ---- raw JSON lines ---------------------------------------------------------------------------
RAW_ENTITY = T.StructType(
    _strings("id", "label", "en_term", "vi_term")
    + _ints("en_start_token_idx", "en_end_token_idx", "vi_start_token_idx", "vi_end_token_idx")
)
RAW_RELATION = T.StructType(_strings("label", "subject_id", "object_id", "head_idx", "tail_idx"))
RAW_RECORD = T.StructType(
    _strings("id", "en_sentence_str", "vi_sentence_str")
    + [
        T.StructField("entities", T.ArrayType(RAW_ENTITY)),
        T.StructField("relations", T.ArrayType(RAW_RELATION)),
    ]
)

# ---- standardised documents -------------------------------------------------------------------
ENTITY = T.StructType(_strings("entity_id", "label", "term") + _ints("start_token_idx", "end_token_idx"))
RELATION = T.StructType(_strings("relation_type", "subject_id", "object_id"))
LINE = T.StructType(
    [
        T.StructField("source_idx", T.IntegerType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("hint", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("block", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)

# ---- model output -----------------------------------------------------------------------------
PREDICTED = T.StructType(
    [
        T.StructField("entities", T.ArrayType(T.StructType(_strings("id", "label", "term")))),
        T.StructField("relations", T.ArrayType(T.StructType(_strings("label", "subject_id", "object_id")))),
    ]
    + _strings("relation")
)
