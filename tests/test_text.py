"""Text, JSON and marker functions against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glossmill.functions import chat, jsontext, matching, spans, text
from glossmill.schemas import RAW_RECORD


def column(spark, values, type="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type}")


def in_order(df):
    return [r.out for r in df.orderBy("i").select("out").collect()]


def test_whitespace_is_pythons(spark):
    values = [f"a{chr(c)}b{chr(c)}" for c in range(1, 0x3101)] + ["", " ", "​", "  x   y "]
    df = column(spark, values)
    assert in_order(df.select("i", text.words(F.col("v")).alias("out"))) == [v.split() for v in values]
    assert in_order(df.select("i", text.strip(F.col("v")).alias("out"))) == [v.strip() for v in values]


def test_normalize_term(spark):
    values = ["  Moderate AS  ", "a 　B", "", "\t", "ĐAU  Đầu", "ΟΔΟΣ"]
    df = column(spark, values)
    assert in_order(df.select("i", text.normalize_term(F.col("v")).alias("out"))) == [" ".join(v.lower().split()) for v in values]


def first_place(term, sentence):
    """Words behind the first match of the padded term in the padded sentence."""
    padded = " " + " ".join(sentence.lower().split()) + " "
    term = " ".join(term.lower().split())
    before, found, _ = padded.partition(f" {term} ") if term else ("", "", "")
    return (before.count(" "), before.count(" ") + term.count(" ")) if found else (-1, -1)


def test_resolve_span(spark):
    rng = random.Random(7)
    words = ["a", "b", "aa", "A", "ab"]
    cases = [("moderate as", "patient with moderate AS and more"), ("", "a b"), ("a", ""), ("a b c", "a b"), ("b", "ab b")]
    for _ in range(400):
        cases.append((" ".join(rng.choices(words, k=rng.randint(0, 3))), "  ".join(rng.choices(words, k=rng.randint(0, 7)))))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, term string, sentence string")
    out = in_order(df.select("i", text.resolve_span(F.col("term"), F.col("sentence")).alias("out")))
    assert [tuple(o) for o in out] == [first_place(*c) for c in cases]


def test_quote_is_json_dumps(spark):
    values = ["".join(map(chr, range(0x80))), 'q " \\ /', "Đau đầu 😀", "", "\\u001f", "\x1f\x0b", "a\nb\tc\r\b\f"]
    out = in_order(column(spark, values).select("i", jsontext.quote(F.col("v")).alias("out")))
    assert out == [json.dumps(v, ensure_ascii=False) for v in values]


def test_gold_json_is_json_dumps(spark):
    ents = [("T0", "Problem", 'say "x"\n', 0, 1), ("T1", "Test", "đo", 2, 2)]
    rels = [("PIP", "T0", "T1")]
    df = spark.createDataFrame(
        [(0, ents, rels), (1, [], [])],
        "i int, e array<struct<entity_id:string,label:string,term:string,start_token_idx:int,end_token_idx:int>>,"
        "r array<struct<relation_type:string,subject_id:string,object_id:string>>",
    )
    dumps = lambda o: json.dumps(o, ensure_ascii=False)
    for row, (es, rs) in zip(
        df.select("i", jsontext.ner_json(F.col("e")).alias("n"), jsontext.re_json(F.col("r")).alias("r"),
                  jsontext.joint_json(F.col("e"), F.col("r")).alias("j"), jsontext.pair_json(F.lit("NONE")).alias("p")).orderBy("i").collect(),
        [(ents, rels), ([], [])],
    ):
        entities = [{"id": e[0], "label": e[1], "term": e[2]} for e in es]
        relations = [{"label": r[0], "subject_id": r[1], "object_id": r[2]} for r in rs]
        assert row.n == dumps({"entities": entities})
        assert row.r == dumps({"relations": relations})
        assert row.j == dumps({"entities": entities, "relations": relations})
        assert row.p == dumps({"relation": "NONE"})


STRICT = [
    '{"id":"a"}', '{"id":"a"} x', "[1]", "null", "NaN", '{"id":NaN}', '{"id":"a",}', "{'id':1}", '{"id":1,"id":2}',
    '{"id":01}', '  {"id":1}  ', "", '{"id":"\t"}', '{"id":"a"}//c', '{"id":"\\x"}', "5", '"s"', '{"id":"a"}],[{"id":"b"}',
    '{"id":"a"},{"id":"b"}', '{"id":"a"}{"id":"b"}', '{"id":"a"}]', '{"id":"a"', "{}", '{"x":{"y":[1,{"z":3}]},"id":"k"}',
    '```json\n{"id":1}\n```', '{"id":"a"}\n\n', '{id:"a"}', '{"id":"a"},{"__seal__":1}', '{"id":"a"},{"__seal__":1}],[{"id":"b"}',
]


@pytest.mark.parametrize("function", [jsontext.strict_object, jsontext.strict_object_stripped])
def test_strict_object(spark, function):
    def is_object(value):
        try:
            return isinstance(json.loads(value), dict)
        except ValueError:
            return False

    out = in_order(column(spark, STRICT).select("i", function(F.col("v"), RAW_RECORD).isNotNull().alias("out")))
    assert out == [is_object(v) for v in STRICT]


def woven(tokens, span, opening, closing):
    """Tokens with the tags that belong before each place, the end tag being placed first; past the end is the end."""
    close_at, open_at = min(span[1] + 1, len(tokens)), min(span[0], len(tokens) + 1)
    if open_at > close_at:  # it opens behind its end, which is there already and counts as a place
        order = [(close_at, closing), (open_at - 1, opening)]
    else:
        order = [(open_at, opening), (close_at, closing)]
    tags = {}
    for place, tag in order:
        tags.setdefault(place, []).append(tag)
    return [t for i in range(len(tokens) + 1) for t in (*tags.get(i, ()), *tokens[i:i + 1])]


def tagged(words, subject, obj):
    """The rule: the span that starts later is tagged first, the subject on a tie; a span with a negative end is not."""
    subject_first = subject[0] >= obj[0]
    for is_subject in (subject_first, not subject_first):
        span, name = (subject, "e1") if is_subject else (obj, "e2")
        if span[0] >= 0 and span[1] >= 0:
            words = woven(words, span, f"<{name}>", f"</{name}>")
    return " ".join(words)


def test_markers(spark):
    rng = random.Random(3)
    cases = [
        (["a", "b", "c", "d"], (0, 3), (1, 1)), (["w"], (0, 0), (0, 0)), (["a", "b"], (-1, 0), (1, 1)),
        (["a", "b"], (0, 9), (1, 1)), (["a", "b"], (0, 0), (1, -1)), (["a", "b", "c"], (0, 0), (1, 2)), ([], (0, 0), (0, 0)),
    ]
    for _ in range(600):
        cases.append(([f"w{k}" for k in range(rng.randint(0, 6))],
                      (rng.randint(-1, 7), rng.randint(-1, 7)), (rng.randint(-1, 7), rng.randint(-1, 7))))
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "i int, w array<string>, s struct<start_token_idx:int,end_token_idx:int>, o struct<start_token_idx:int,end_token_idx:int>",
    )
    out = in_order(df.select("i", spans.insert_markers(F.col("w"), F.col("s"), F.col("o")).alias("out")))
    assert out == [tagged(*c) for c in cases]
    assert out[0] == "<e1> a <e2> b </e2> </e1> c d"
    assert out[1] == "<e2> <e1> </e2> w </e1>"
    assert out[2] == "a <e2> b </e2>" and out[3] == "<e1> a <e2> b </e2> </e1>" and out[4] == "<e1> a </e1> b"


def test_round4_is_pythons_round(spark):
    rng = random.Random(5)
    values = [a / b for b in (1, 3, 7, 16, 32, 64, 160, 800, 20000, 32000) for a in range(0, b + 1, max(1, b // 40))]
    values += [rng.random() for _ in range(2000)] + [k / 20000 for k in range(1, 20000, 37)] + [0.0, 1.0, 0.12345, 0.00005]
    out = in_order(column(spark, values, "double").select("i", matching.round4(F.col("v")).alias("out")))
    assert out == [round(v, 4) for v in values]


def test_chat_text(spark):
    df = spark.createDataFrame([(0, "sys", "usr", "ans")], "i int, s string, u string, a string")
    row = df.select(
        chat.chat_full(F.col("s"), F.col("u"), F.col("a")).alias("full"),
        chat.chat_prompt(F.col("s"), F.col("u")).alias("prompt"),
        chat.causal_prompt(F.lit("in\n\n### Output:\n{} ### Output:\nx")).alias("cut"),
        chat.causal_prompt(F.lit("no boundary")).alias("uncut"),
    ).first()
    turns = [("system", "sys"), ("user", "usr"), ("assistant", "ans")]
    text_of = lambda ts: "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in ts)
    assert row.full == text_of(turns)
    assert row.prompt == text_of(turns[:2]) + "<|im_start|>assistant\n"
    assert row.cut == "in\n\n### Output:\n" and row.uncut == "no boundary### Output:\n"
    many = spark.createDataFrame([([("user", "a"), ("assistant", "b"), ("user", "c")],)], "m array<struct<role:string,content:string>>")
    assert many.select(chat.render_messages(F.col("m"), True).alias("t")).first().t == (
        text_of([("user", "a"), ("assistant", "b"), ("user", "c")]) + "<|im_start|>assistant\n"
    )
