"""Writing JSON text with Python's default spacing, and reading it with Python's strictness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from glossmill.functions.text import bind, strip

# Short JSON escapes; the other control characters become \u00xx in lower-case hex.
SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_SEAL = "__seal__"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "maxStringLen": str(2**31 - 1)}


def quote(col: Column) -> Column:
    """A JSON string literal; non-ASCII text is kept as it is."""
    plain = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escape(char: Column) -> Column:
        out = F.when(char >= " ", char)
        for short, text in SHORT_ESCAPES.items():
            out = out.when(char == short, text)
        return out.otherwise(F.concat(F.lit("\\u00"), F.lower(F.hex(char))))

    spelled = F.array_join(F.transform(F.split(plain, ""), escape), "")
    body = F.when(col.rlike("[\\x00-\\x1f]"), spelled).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _object(**fields: Column) -> Column:
    parts: list[Column] = []
    for name, value in fields.items():
        parts += [F.lit((", " if parts else "{") + f'"{name}": '), quote(value)]
    return F.concat(*parts, F.lit("}"))


def _list(items: Column, render) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, render), ", "), F.lit("]"))


def _entity_items(entities: Column) -> Column:
    return _list(entities, lambda e: _object(id=e["entity_id"], label=e["label"], term=e["term"]))


def _relation_items(relations: Column) -> Column:
    return _list(
        relations,
        lambda r: _object(label=r["relation_type"], subject_id=r["subject_id"], object_id=r["object_id"]),
    )


def ner_json(entities: Column) -> Column:
    return F.concat(F.lit('{"entities": '), _entity_items(entities), F.lit("}"))


def re_json(relations: Column) -> Column:
    return F.concat(F.lit('{"relations": '), _relation_items(relations), F.lit("}"))


def joint_json(entities: Column, relations: Column) -> Column:
    return F.concat(
        F.lit('{"entities": '), _entity_items(entities),
        F.lit(', "relations": '), _relation_items(relations), F.lit("}"),
    )


def pair_json(label: Column) -> Column:
    return _object(relation=label)


def error_json(text: Column) -> Column:
    """The stored stand-in for a generation that is not JSON (fixed keys and message)."""
    return _object(error=F.lit("Malformed JSON"), raw_text=text)


def strict_object(text: Column, schema: T.StructType) -> Column:
    """``text`` as a struct, or NULL unless the whole of it is exactly one JSON object.

    Spark's JSON reader stops after the first value, so text behind it would go unseen.  The text is
    therefore read as the first element of a list whose second element repeats a hash of the text:
    both elements come back, and nothing else, only when the reader consumed all of it.
    """
    sealed = T.StructType(schema.fields + [T.StructField(_SEAL, T.LongType())])

    def read(given: Column) -> Column:
        seal = F.xxhash64(given)
        wrapped = F.concat(F.lit("["), given, F.lit(f',{{"{_SEAL}":'), seal.cast("string"), F.lit("}]"))
        return bind(
            F.from_json(wrapped, T.ArrayType(sealed), _STRICT),
            lambda p: F.when((F.size(p) == 2) & (F.get(p, F.lit(1))[_SEAL] == seal), F.get(p, F.lit(0))),
        )

    return bind(text, read)


def strict_object_stripped(text: Column, schema: T.StructType) -> Column:
    """As :func:`strict_object` after trimming Python whitespace."""
    return strict_object(strip(text), schema)
