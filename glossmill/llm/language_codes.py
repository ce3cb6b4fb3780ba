"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (one to three bytes, ASCII in
lower case) says which half of the languages a text belongs to. Decoding takes the codeword with the least loss, each
bit weighted by how well its classifier separates. A small gap to the next codeword marks the text as ambiguous.

Only texts of known language whose crc32(doc_id as text) mod 3 is not 1 are learned from, about ``per_language`` of
each, about ``most`` in all and of at most ``longest`` bytes, so that the fit does not grow with the number of languages;
every text, however long, is judged whole. Codewords at equal loss: the first language in order. Null texts and texts without a letter are ``und``
with score 0, as are all texts if nothing can be learned. With one language all other texts are that one, with score
1. Repeated rows get equal results. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.llm.byte_cnn import fitted_in_task, held_out
from glossmill.llm.common import appended, column, stored, table

SLOTS = 1 << 12
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def ngram_vector(text: bytes) -> np.ndarray:
    """Square roots of hashed n-gram counts, of length one."""
    b = np.frombuffer(text.translate(LOWERED), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E37) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] + b[2:] * np.uint32(0xC2B2AE35)
    slots = np.concatenate((b, (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20),
                            (three ^ (three >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(20)))
    counts = np.sqrt(np.bincount(slots, minlength=SLOTS).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def codewords(languages: int, most_bits: int = 63, seed: int = 5) -> np.ndarray:
    """-1/1 rows, one for each language: all ways to halve them, or the best of some random ways."""
    if languages < 2:
        return np.zeros((languages, 0))
    if 2 ** (languages - 1) - 1 <= most_bits:
        ways = np.arange(1, 2 ** (languages - 1))
        # The last language is always on the -1 side, so no way is the opposite of another.
        return np.where((ways >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    rng, best, widest = np.random.default_rng(seed), None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, most_bits))
        agree = code @ code.T - 2 * most_bits * np.eye(languages)
        if -agree.max() > widest or best is None:
            best, widest = code, -agree.max()
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray  # language x bit
    filters: np.ndarray  # slot x bit
    trust: np.ndarray  # weight of each bit

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """Language, probability among the codewords, gap to the next in loss."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, float("inf")
        margin = ngram_vector(text) @ self.filters
        loss = np.log1p(np.exp(-4 * self.code * margin)) @ self.trust
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1 / share.sum()), float(loss[order[1]] - loss[order[0]])


def fit(texts: list[bytes], langs: list[str], ridge: float = 0.05) -> Codes:
    """Regularised least squares for each bit, solved over the sample."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    x = np.stack([ngram_vector(t) for t in texts]) if texts else np.zeros((0, SLOTS), np.float32)
    y = code[[languages.index(lang) for lang in langs]] if texts else code
    kernel = (x @ x.T).astype(np.float64)
    # Leaving one out in closed form shows how far each bit can be trusted.
    inverse = np.linalg.inv(kernel + ridge * np.eye(len(texts)))
    dual = inverse @ y
    without = y - dual / np.diag(inverse)[:, None]
    right = np.clip((without * y > 0).mean(axis=0), 0.5, 1 - 1e-3) if y.size else np.zeros(code.shape[1])
    trust = np.log(right / (1 - right)) if y.size else right
    return Codes(languages, code, (x.T @ dual).astype(np.float32), trust / max(trust.mean(), 1e-9) if trust.size else trust)


def labelled_sample(docs: DataFrame, per_language: int, most: int, longest: int) -> DataFrame:
    """doc_id, text and lang of about ``per_language`` texts each, and about ``most`` in all, drawn by a hash of doc_id.

    The same in every run. With more languages than share ``most`` at ``per_language`` each, all get fewer alike.
    """
    usable = docs.select("doc_id", "text", "lang").filter(
        "doc_id is not null and lang is not null and text is not null").filter(~held_out()).filter(F.octet_length("text") <= longest)
    # One number for each language; the sample is bounded by its share, not by a sort of each language's texts.
    sizes = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    wanted = min(float(per_language), most / max(sizes.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return usable.join(sizes, "lang").filter(draw * F.col("size") < wanted).select("doc_id", "text", "lang")


def languages(docs: DataFrame, per_language: int = 300, longest: int = 1 << 15, gap: float = 1.0, most: int = 4096) -> DataFrame:
    """docs with held_out, lang_pred, score and ambiguous."""
    sample = labelled_sample(docs, per_language, most, longest)
    codes = fitted_in_task(sample, ["doc_id", "text", "lang"], lambda rows: fit([r[1].encode() for r in rows], [r[2] for r in rows]))
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    results = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "ambiguous": ("boolean", pa.bool_())}

    def run(rows):
        codes = shared.value
        for batch in rows:
            out = []
            for value in column(batch, "text"):
                text = value.as_py()
                if not codes.languages or text is None or not LETTER.search(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                lang, score, ahead = codes.judge(text.encode())
                out.append((lang, score, ahead < gap))
            yield batch, {name: [r[i] for r in out] for i, name in enumerate(results)}

    return appended(docs, results, run).withColumn("held_out", held_out())


def op10_output_codes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
