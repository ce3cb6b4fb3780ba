"""Every operator as a query over the given tables: name -> function of (spark, table folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.functions.chat import causal_prompt, chat_full, chat_prompt, chat_turn
from glossmill.functions.jsontext import joint_json, ner_json, pair_json, re_json
from glossmill.functions.matching import pair_label
from glossmill.functions.text import normalize_term, words
from glossmill.ontology import Ontology
from glossmill.operators import scoring
from glossmill.operators.conversations import conversations
from glossmill.operators.ids import head_subset, pending, shard_of, step_budget, with_dense_id
from glossmill.operators.inference import parse_predictions, predict, with_prompt
from glossmill.operators.pairs import entity_pairs, mark_pairs
from glossmill.operators.render import build_samples, entity_list
from glossmill.operators.standardize import (
    clean_text, parse_lines, project_language, relation_endpoints, standardize, mentions_with_spans,
)
from glossmill.operators.tokens import (
    MAX_LENGTH, clip_by_encoder, clip_tokens, instruction_prompt_length, instruction_tokens, pad_batches, token_lengths, tokenize, tokens,
)
from glossmill.plans import annotated as A
from glossmill.plans.workflow import finish, run_inference
from glossmill.schemas import ORDER_KEY, PAIR_POS, RECORD_KEY, SAMPLE_KEY
from glossmill.session import scratch_path, written
from glossmill.sources.jsonl import (
    load_into, read_jsonl, read_predictions, source_counts, split_malformed, with_order_key, write_jsonl, write_predictions,
)
from glossmill.sources.lines import scan_lines
from glossmill.streaming.predict import predict_stream, running_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 7
BATCH = 16
DOC_ORDER = ["source_idx", "seq"]
SMALL_SPLIT = 1 << 18
CLIP = 8


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _docs(spark, sf):
    return A.documents(spark, sf)


def _stored(spark, sf):
    return A.stored_documents(spark, sf)


# ---- sources and sinks ------------------------------------------------------------------------

def _gold_lines(spark, sf):
    """Gold JSON of every document with its key."""
    docs = _docs(spark, sf)
    return docs.select(*ORDER_KEY, joint_json(F.col("entities"), F.col("relations")).alias("value"))


@query("jsonl_scan")
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "jsonl")
    write_jsonl(_gold_lines(spark, sf), path, DOC_ORDER)
    return read_jsonl(spark, path).select("value")


@query("malformed_lines")
def malformed_lines(spark, sf):
    _, bad = split_malformed(A.broken_lines(spark, sf))
    return bad.select("seq", "reason", F.length("value").alias("n_chars"))


@query("well_formed_lines")
def well_formed_lines(spark, sf):
    ok, _ = split_malformed(A.broken_lines(spark, sf))
    return ok.select("seq", F.length("value").alias("n_chars"))


@query("load_report")
def load_report(spark, sf):
    """Loaded and damaged lines of two sources by reason, observed while their documents are written."""
    lines = A.damaged_lines(spark, sf).unionByName(A.benchmark_lines(spark, sf))
    return load_into(lines, scratch_path(spark, "loaded"), ["documents", "benchmark"])


@query("union_sources")
def union_sources(spark, sf):
    both = A.raw_lines(spark, sf).unionByName(A.benchmark_lines(spark, sf))
    return standardize(both).select("source_idx", "source", "seq", "doc_id", "text")


@query("order_key")
def order_key(spark, sf):
    """Lines written in order, read back by many tasks, numbered by their order key."""
    path = scratch_path(spark, "ordered")
    write_jsonl(_docs(spark, sf).select(*DOC_ORDER, F.col("doc_id").alias("value")), path, DOC_ORDER)
    lines = scan_lines(spark, [(path, "auto")], SMALL_SPLIT)
    return with_dense_id(lines.drop("source", "hint"), ORDER_KEY, "line_no").select("line_no", F.col("value").alias("doc_id"))


@query("source_counts")
def count_by_source(spark, sf):
    both = A.raw_lines(spark, sf).unionByName(A.benchmark_lines(spark, sf))
    return source_counts(standardize(both), "source")


@query("pred_sink_roundtrip")
def pred_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "predictions")
    write_predictions(A.joint_predictions(_docs(spark, sf)), path)
    return read_predictions(spark, path).select("seq", "doc_id", "malformed", "stored")


@query("merge_parts")
def merge_parts(spark, sf):
    """Two appended parts read as one, then ordered by sample id."""
    path = scratch_path(spark, "parts")
    answers = with_dense_id(A.joint_predictions(_stored(spark, sf)), DOC_ORDER)
    for malformed in (False, True):
        write_predictions(answers.filter(F.col("malformed") == malformed), path)
    return read_predictions(spark, path).select("id", "doc_id", "stored").orderBy("id")


@query("final_jsonl")
def final_jsonl(spark, sf):
    """The final prediction file, read back line by line with line numbers."""
    path = scratch_path(spark, "final")
    write_jsonl(A.joint_predictions(_docs(spark, sf)), path, DOC_ORDER, "stored")
    lines = scan_lines(spark, [(path, "auto")])
    return with_dense_id(lines.drop("source", "hint"), ORDER_KEY, "line_no").select("line_no", "value")


@query("final_pairs")
def final_pairs(spark, sf):
    """The final file of a pairwise run: every document in order, those without an answer too."""
    docs, path = _stored(spark, sf), scratch_path(spark, "final")
    finish(A.pair_predictions(docs), docs, path, "re_only", "pairwise", RECORD_KEY)
    return with_dense_id(with_order_key(spark.read.text(path), 0), ORDER_KEY, "line_no").select("line_no", "value")


# ---- standardisation --------------------------------------------------------------------------

@query("language_detect")
def language_detect(spark, sf):
    return project_language(parse_lines(A.raw_lines(spark, sf))).select("seq", "language")


@query("language_mix")
def language_mix(spark, sf):
    lines = written(A.raw_lines(spark, sf), "lines")
    hinted = [lines.withColumn("hint", F.lit(h)) for h in ("auto", "en", "vi")]
    rows = clean_text(project_language(parse_lines(reduce(DataFrame.unionByName, hinted))))
    return rows.groupBy("hint", "language").agg(F.count(F.lit(1)).alias("n_docs"))


@query("language_projection")
def language_projection(spark, sf):
    docs = standardize(A.raw_lines(spark, sf, "vi"))
    return docs.select("seq", "language", "text", F.explode("entities").alias("e")).select(
        "seq", "language", "text", F.col("e.term").alias("term"), F.col("e.start_token_idx").alias("start_token_idx")
    )


@query("clean_text")
def clean_text_rows(spark, sf):
    return clean_text(project_language(parse_lines(A.raw_lines(spark, sf, "en")))).select("seq", "text")


@query("word_tokens")
def word_tokens(spark, sf):
    texts = A.table(spark, sf, "documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return texts


@query("entities")
def entities(spark, sf):
    return _docs(spark, sf).select("seq", F.posexplode("entities").alias("pos", "e")).select("seq", "pos", "e.*")


@query("relations")
def relations(spark, sf):
    return _docs(spark, sf).select("seq", F.posexplode("relations").alias("pos", "r")).select("seq", "pos", "r.*")


@query("relations_integrity")
def relations_integrity(spark, sf):
    """Raw against kept relations of each document, side by side in its row."""
    rows = standardize(A.raw_lines(spark, sf), n_raw=F.coalesce(F.size("record.relations"), F.lit(0)))
    return rows.select("seq", "n_raw", F.size("relations").alias("n_kept")).filter(F.col("n_raw") > 0)


@query("documents_std")
def documents_std(spark, sf):
    return _docs(spark, sf).select(
        "source_idx", "seq", "doc_id", "text", F.array_join("words", "|").alias("words"), "language", "n_entities",
        joint_json(F.col("entities"), F.col("relations")).alias("annotations"),
    )


@query("relation_endpoints")
def relation_ends(spark, sf):
    return relation_endpoints(_docs(spark, sf), "seq").select(
        "seq", "rel_pos", "relation_type",
        F.col("subject.term").alias("subject_term"), F.col("subject.label").alias("subject_label"),
        F.col("object.term").alias("object_term"), F.col("object.label").alias("object_label"),
    )


@query("resolve_span")
def resolve_span(spark, sf):
    """Every entity word and the word behind it, looked up in the sentence."""
    terms = F.transform("entities", lambda e: F.concat(
        F.lower(e["term"]), F.coalesce(F.concat(F.lit("  "), F.get(F.col("words"), e["start_token_idx"] + 1)), F.lit(" nowhere"))))
    return mentions_with_spans(_docs(spark, sf), terms, ["seq"]).select(
        "seq", "pos", F.col("span.start").alias("start_idx"), F.col("span.end").alias("end_idx")
    )


@query("normalize_term")
def normalize_terms(spark, sf):
    return A.sentences(spark, sf).select(
        "seq", normalize_term(F.concat(F.lit(" \t"), F.replace("sentence", F.lit(" "), F.lit("  ")))).alias("term")
    )


# ---- pairs ------------------------------------------------------------------------------------

def _pair_columns(*more):
    return ["seq", "subj_pos", "obj_pos", F.col("subject.entity_id").alias("subject_id"),
            F.col("object.entity_id").alias("object_id"), *more]


@query("valid_pairs")
def valid_pairs(spark, sf):
    rows = entity_pairs(_stored(spark, sf), Ontology.default())
    return rows.select(*_pair_columns(F.col("subject.label").alias("subject_label"), F.col("object.label").alias("object_label")))


@query("pair_labels")
def pair_labels(spark, sf):
    return A.pair_rows(_stored(spark, sf)).select("seq", "subj_pos", "obj_pos", "relation")


@query("entity_markers")
def entity_markers(spark, sf):
    """The subjects are sent out over many tasks first, as for few and long records."""
    pairs = entity_pairs(_docs(spark, sf), Ontology.default(), tasks=64)
    return mark_pairs(pairs).select("seq", "subj_pos", "obj_pos", "marked")


# ---- rendering --------------------------------------------------------------------------------

@query("entity_list")
def entity_list_text(spark, sf):
    return _docs(spark, sf).select("seq", entity_list(F.col("entities")).alias("entity_list"))


@query("gold_ner_json")
def gold_ner_json(spark, sf):
    return _docs(spark, sf).select("seq", ner_json(F.col("entities")).alias("gold"))


@query("gold_pair_json")
def gold_pair_json(spark, sf):
    return A.pair_rows(_stored(spark, sf)).select("seq", "subj_pos", "obj_pos", pair_json(F.col("relation")).alias("gold"))


@query("gold_re_json")
def gold_re_json(spark, sf):
    return _docs(spark, sf).select("seq", re_json(F.col("relations")).alias("gold"))


@query("gold_joint_json")
def gold_joint_json(spark, sf):
    return _gold_lines(spark, sf).select("seq", F.col("value").alias("gold"))


MODES = {
    "ner": ("ner_only", "global"), "re_pairwise": ("re_only", "pairwise"),
    "re_global": ("re_only", "global"), "joint": ("joint", "global"),
}


def _sample_query(format, task, re_mode):
    text = ["text"] if format == "causal" else ["system", "user", "assistant"]

    def run(spark, sf):
        samples = build_samples(_docs(spark, sf), format, task, re_mode)
        return samples.select("seq", *PAIR_POS, "doc_id", "subject_id", "object_id", *text)

    return run


for _format in ("causal", "instruction"):
    for _mode, (_task, _re_mode) in MODES.items():
        QUERIES[f"{_format}_{_mode}"] = _sample_query(_format, _task, _re_mode)


@query("samples_per_mode")
def samples_per_mode(spark, sf):
    docs = _stored(spark, sf)
    counts = [
        build_samples(docs, format, task, re_mode).agg(F.count(F.lit(1)).alias("n_samples")).select(
            F.lit(f"{format}/{mode}").alias("mode"), "n_samples"
        )
        for format in ("causal", "instruction") for mode, (task, re_mode) in MODES.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# ---- tokens -----------------------------------------------------------------------------------

def _instructions(spark, sf, mode="joint"):
    return build_samples(_docs(spark, sf), "instruction", *MODES[mode])


@query("chat_full")
def chat_full_text(spark, sf):
    rows = _instructions(spark, sf)
    return rows.select("seq", chat_full(F.col("system"), F.col("user"), F.col("assistant")).alias("chat"))


@query("chat_prompt")
def chat_prompt_text(spark, sf):
    return _instructions(spark, sf).select("seq", chat_prompt(F.col("system"), F.col("user")).alias("prompt"))



@query("chat_turns")
def chat_turns(spark, sf):
    """Turns of the conversations table, each rendered where it is."""
    turns = A.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", chat_turn(F.col("role"), F.col("text")).alias("rendered"))


@query("conversations")
def whole_conversations(spark, sf):
    """Every conversation as one text."""
    return conversations(A.table(spark, sf, "conversations"))


@query("causal_prompt")
def causal_prompts(spark, sf):
    rows = build_samples(_docs(spark, sf), "causal", *MODES["joint"])
    return rows.select("seq", causal_prompt(F.col("text")).alias("prompt"))


@query("token_lengths")
def token_length_rows(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"),
        token_lengths(F.col("text"), 1024).alias("n_kept"),
    )


@query("tokenized")
def tokenized(spark, sf):
    """Ids and mask of every sentence; the lengths are what another engine can check."""
    rows = tokenize(A.sentences(spark, sf).select("seq", "sentence"), "sentence", keep=["seq"])
    return rows.select("seq", F.size("input_ids").alias("n_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))


@query("encoder_ids")
def encoder_ids(spark, sf):
    """Ids by a tokenizer of the caller's, and every sentence cut behind its token number ``CLIP``."""
    rows = tokenize(A.sentences(spark, sf).select("seq", "sentence"), "sentence", make_encoder=A.word_encoder(), keep=["seq", "sentence"])
    return rows.select(
        "seq", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"),
        clip_by_encoder(F.col("sentence"), CLIP, A.word_encoder()).alias("clipped"),
    )


@query("prompt_lengths")
def prompt_lengths(spark, sf):
    return instruction_prompt_length(_instructions(spark, sf)).select("seq", "prompt_length")


@query("loss_mask")
def loss_mask(spark, sf):
    rows = instruction_tokens(_instructions(spark, sf), ["seq"])
    masked = F.size(F.filter("labels", lambda x: x == -100))
    return rows.select("seq", "prompt_length", masked.alias("n_masked"), (F.size("labels") - masked).alias("n_kept"))


@query("pad_batches")
def padded_batches(spark, sf):
    rows = tokenize(A.sentences(spark, sf).select("seq", "sentence"), "sentence", keep=["seq"])
    padded = pad_batches(rows.withColumn("labels", F.col("input_ids")), BATCH, order=["seq"])
    return padded.select(
        F.size(F.filter("labels", lambda x: x == -100)).alias("n_ignored"),
        "id", "seq", "batch", "width", F.size("input_ids").alias("n_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
    )


@query("eval_subset")
def eval_subset(spark, sf):
    return head_subset(_stored(spark, sf).select(*DOC_ORDER, "doc_id"), 0.2, DOC_ORDER).select("seq", "doc_id")


@query("step_budget")
def step_budget_rows(spark, sf):
    return step_budget(A.pair_rows(_stored(spark, sf)), 8, 4, 3, 0.1)


# ---- inference --------------------------------------------------------------------------------

@query("dense_id")
def dense_id(spark, sf):
    rows = A.pair_rows(_stored(spark, sf)).select("seq", "subj_pos", "obj_pos")
    return with_dense_id(rows, ["seq", "subj_pos", "obj_pos"])


@query("shards")
def shards(spark, sf):
    """Sentences per contiguous shard."""
    rows = with_dense_id(A.sentences(spark, sf).select("seq"), ["seq"])
    total = rows.count()
    return rows.groupBy(shard_of(SHARDS, total).alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("resume_pending")
def resume_pending(spark, sf):
    """Pair samples whose answer was not usable JSON are still to be done."""
    preds = A.pair_predictions(_stored(spark, sf))
    done = preds.filter(~F.col("malformed"))
    return pending(preds.select(*SAMPLE_KEY, "subject_id", "object_id"), done).select(
        "seq", "subj_pos", "obj_pos", "subject_id", "object_id"
    )


@query("clipped_prompts")
def clipped_prompts(spark, sf):
    """Prompts as a model with the default maximum length sees them."""
    prompts = with_prompt(_instructions(spark, sf))
    return prompts.select("seq", F.size(tokens(clip_tokens(F.col("prompt"), MAX_LENGTH))).alias("n_tokens"))


@query("predict_stub")
def predict_stub(spark, sf):
    samples = with_prompt(_instructions(spark, sf, "ner"))
    answers = parse_predictions(predict(samples, A.stub_model(), 16, ["seq"]))
    return answers.select("seq", "malformed", "stored")


@query("durable_predict")
def durable_predict(spark, sf):
    """Two runs of the durable job: for sentences with entities, then for all, which asks for the others only."""
    docs, path = _stored(spark, sf), scratch_path(spark, "answers")
    samples = build_samples(docs, "instruction", "ner_only")
    some = build_samples(docs.filter(F.col("n_entities") > 0), "instruction", "ner_only")
    run_inference(some, A.stub_model(), path, 16, max_length=None)
    return run_inference(samples, A.stub_model(), path, 16, max_length=None).select("seq", "malformed", "stored")


@query("parse_predictions")
def parse_predictions_rows(spark, sf):
    preds = A.joint_predictions(_docs(spark, sf))
    return preds.select(
        "seq", "malformed", "stored", F.coalesce(F.size("prediction.entities"), F.lit(0)).alias("n_entities"),
        F.coalesce(F.size("prediction.relations"), F.lit(0)).alias("n_relations"),
    )


@query("predict_stream")
def predict_stream_rows(spark, sf):
    """Raw lines written as files and run through the stream once."""
    source, target, state = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    write_jsonl(A.raw_lines(spark, sf), source, DOC_ORDER)
    run = predict_stream(spark, source, target, state, A.stub_model(), batch_size=16)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return spark.read.parquet(target).select("doc_id", "malformed", "stored")


@query("stream_scores")
def stream_scores(spark, sf):
    """Entity scores of what a stream wrote against the documents it wrote with it."""
    source, target, state, docs = (scratch_path(spark, f"scored-{n}") for n in ("in", "out", "state", "docs"))
    write_jsonl(A.raw_lines(spark, sf), source, DOC_ORDER, compression="gzip")
    run = predict_stream(spark, source, target, state, A.stub_model(), batch_size=16, files_per_trigger=3, documents=docs)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return scoring.evaluate(spark.read.parquet(target), spark.read.parquet(docs), "ner_only")


def _stream_twice(spark, sf):
    """Every line arrives twice, in files of two runs of a stream that keeps state: its answers and its scores."""
    source, target, state, scores = (scratch_path(spark, f"resent-{n}") for n in ("in", "out", "state", "scores"))
    for _ in range(2):
        A.raw_lines(spark, sf).select("value").write.mode("append").option("compression", "gzip").text(source)
        run = predict_stream(spark, source, target, state, A.stub_model(), batch_size=16, resent_within="30 days", scores=scores)
        run.awaitTermination()
        if run.exception() is not None:
            raise run.exception()
    return target, scores


@query("stream_resent")
def stream_resent(spark, sf):
    """Lines that are sent again are answered once."""
    return spark.read.parquet(_stream_twice(spark, sf)[0]).select("doc_id", "malformed", "stored")


@query("stream_running_scores")
def stream_running_scores(spark, sf):
    """The sums of what the micro-batches scored."""
    return running_scores(spark, _stream_twice(spark, sf)[1])


# ---- scoring ----------------------------------------------------------------------------------

@query("regroup_pairs")
def regroup_pairs(spark, sf):
    docs = _stored(spark, sf)
    grouped = scoring.prediction_lines(scoring.regroup_pairs(A.pair_predictions(docs), docs))
    return grouped.select("seq", "doc_id", F.size("predicted").alias("n_relations"), "value")


@query("regroup_shared_id")
def regroup_shared_id(spark, sf):
    """Answers of all sentences of a document gathered under the document's id."""
    by_document = F.split_part("doc_id", F.lit("-"), F.lit(1))
    docs = _stored(spark, sf)
    preds = A.pair_predictions(docs).withColumn("doc_id", by_document)
    numbered = with_dense_id(preds.select("seq", *PAIR_POS, "doc_id", "subject_id", "object_id", "prediction"), ["seq", *PAIR_POS])
    return scoring.relations_by_doc_id(numbered, docs.select(by_document.alias("doc_id")))


@query("align_predictions")
def align_predictions(spark, sf):
    """Usable predictions against documents with entities: both sides have rows of their own."""
    docs = _stored(spark, sf)
    preds = A.joint_predictions(docs).filter(~F.col("malformed")).select("source_idx", "seq", "stored")
    gold = docs.filter(F.col("n_entities") > 0).select("source_idx", "seq", "n_entities")
    return scoring.unmatched_counts(scoring.align(preds, gold))


def _sorted_set(col):
    return F.array_join(F.array_sort(col), " ")


@query("ner_sets")
def ner_sets(spark, sf):
    preds = scoring.with_prediction_sets(A.joint_predictions(_docs(spark, sf)))
    return preds.select("seq", F.size("pred_ner").alias("n_keys"), _sorted_set("pred_ner").alias("keys"))


@query("re_sets")
def re_sets(spark, sf):
    preds = scoring.with_prediction_sets(A.joint_predictions(_docs(spark, sf)))
    return preds.select("seq", F.size("pred_re").alias("n_keys"), _sorted_set("pred_re").alias("keys"))


@query("ner_f1")
def ner_f1(spark, sf):
    docs = _stored(spark, sf)
    return scoring.evaluate(A.joint_predictions(docs), docs, "ner_only")


@query("re_f1")
def re_f1(spark, sf):
    docs = _stored(spark, sf)
    return scoring.evaluate(A.joint_predictions(docs), docs, "re_only", "global")


@query("re_f1_pairwise")
def re_f1_pairwise(spark, sf):
    """One label per pair; the gold label travels with the answer, so nothing is joined."""
    preds = A.pair_predictions(_stored(spark, sf))
    aligned = preds.select(pair_label(F.col("prediction")).alias("pred_re"), F.col("relation").alias("gold_re"))
    return scoring.re_metrics(aligned, pairwise=True)


@query("eval_joint")
def eval_joint(spark, sf):
    docs = _stored(spark, sf)
    return scoring.evaluate(A.joint_predictions(docs), docs, "joint")


@query("eval_re_pairwise")
def eval_re_pairwise(spark, sf):
    docs = _stored(spark, sf)
    return scoring.evaluate(A.pair_predictions(docs), docs, "re_only", "pairwise", RECORD_KEY)


@query("eval_re_shared_id")
def eval_re_shared_id(spark, sf):
    """As above with one id for all sentences of a document: each is scored against all answers."""
    docs = _stored(spark, sf)
    by_document = F.split_part("doc_id", F.lit("-"), F.lit(1))
    preds = A.pair_predictions(docs).withColumn("doc_id", by_document)
    return scoring.evaluate(preds, docs.withColumn("doc_id", by_document), "re_only", "pairwise")
