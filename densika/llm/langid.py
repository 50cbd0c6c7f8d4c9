"""Language identification by error-correcting output codes (operator 5).

Every language has a codeword; for each of its bits a binary classifier of hashed byte trigrams tells the languages whose
bit is 1 from the others, by the mean log-odds of a text's trigrams. Decoding takes the language whose codeword has the
least logistic loss under these margins; the score is its share under exp(-loss), and texts whose two best codewords
are within AMBIGUOUS of one another are flagged.

Learning reads a sample: about PER_LANGUAGE labelled texts of every language, or all where it has fewer, chosen by a hash of
their id, each whole; it grows with the number of languages only. Trigrams are counted on the executors, and each batch
sends at most 2^BITS counts a language. Predicting is one pass over the whole texts, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; a null id is passed through; a null
language is not learned from; rows that share an id are judged one by one; with one learned language every text with a
letter is of that language, with none it is ``und``; ties go to the first language in alphabetical order; an empty table
gives an empty table; only id, text and language are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.common import LOWER, keep_rows, map_batches, remembered

BITS = 14
PER_LANGUAGE = 400
#: A margin is the mean log-odds of a text's trigrams times SHARPNESS, or less for texts of few trigrams.
SHARPNESS, FEW = 12.0, 24.0
#: The shares of the two nearest codewords of an ambiguous text differ by less; so the second has a twentieth at least.
AMBIGUOUS = 0.9
UNDETERMINED = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: A-Z lower-cased; everything in ASCII that isn't a letter is a space.
FOLD = np.array([LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
SCHEMA = "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean"


def has_letter(data: bytes | None) -> bool:
    return bool(data) and (ASCII_LETTER.search(data) is not None or any(map(str.isalpha, data.decode("utf-8", "replace"))))


def trigrams(data: bytes) -> np.ndarray:
    """Counts of the hashed trigrams of a text and the spaces around it."""
    x = FOLD[np.frombuffer(b"  %b " % data, np.uint8)].astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    live = code[code != 0x202020]
    return np.bincount((live * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 5 languages, else the best of some random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = range(1, 1 << (n - 1))
        return np.array([[1.0 if s >> i & 1 else -1.0 for s in splits] for i in range(n)])
    width, best, code = 8 * math.ceil(math.log2(n)), -1, None
    for seed in range(64):
        tried = np.random.default_rng(seed).choice([-1.0, 1.0], (n, width))
        apart = (width - tried @ tried.T + 2 * width * np.eye(n)).min()
        if apart > best and (np.abs(tried.sum(0)) < n).all():
            best, code = apart, tried
    if code is None:
        raise ValueError("no code has bits that split the languages")
    return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # bits x trigrams

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """The loss of each codeword for each row of trigram counts."""
        n = counts.sum(1, keepdims=True)
        mean = (counts @ self.odds.T) / np.maximum(n, 1)
        margin = SHARPNESS * mean * np.minimum(1, np.sqrt(n / FEW))
        return sum(np.logaddexp(0, -margin[:, b, None] * self.code[None, :, b]) for b in range(self.code.shape[1]))


def fit(totals: dict[str, np.ndarray]) -> Model:
    """A model from the trigram counts of each language."""
    languages = sorted(totals)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((1, 1 << BITS)))
    code = codewords(len(languages))
    share = np.array([totals[x] / max(1, totals[x].sum()) for x in languages])
    odds = []
    for bit in code.T:
        ones, zeros = share[bit > 0], share[bit < 0]
        if len(ones) and len(zeros):
            floor = 1e-6
            odds.append(np.log((ones.mean(0) + floor) / (zeros.mean(0) + floor)))
        else:
            odds.append(np.ones(1 << BITS))
    return Model(languages, code, np.array(odds, np.float32))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learns: Column | None = None) -> Model:
    """A model from the labelled rows, of those for which learns holds (an expression of the column id)."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.lit(True) if learns is None else learns))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    most = (1 << 31) - 1
    share = F.floor(F.least(F.lit(1.0), F.lit(float(PER_LANGUAGE)) / F.col("n")) * F.lit(most))
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(most))
    sample = rows.join(F.broadcast(counts), "lang").where(draw <= share).select("lang", "text").repartition("lang")

    def counted(batch: dict[str, list]) -> dict[str, object]:
        found: dict[bytes, np.ndarray] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            found[lang] = found.get(lang, 0) + trigrams(text)
        return {
            "lang": pa.array([x.decode() for x in found], pa.string()),
            "counts": pa.array([x.astype("<i8").tobytes() for x in found.values()], pa.binary()),
        }

    totals: dict[str, np.ndarray] = {}
    for r in map_batches(sample, "lang string, counts binary", counted).toLocalIterator():
        totals[r["lang"]] = totals.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    return fit(totals)


def told(model: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, list[str | None], np.ndarray]:
    """For each text its language, the score, the second choice and whether the two are close."""
    first, second = [UNDETERMINED] * len(texts), [None] * len(texts)
    score, close = np.zeros(len(texts)), np.zeros(len(texts), bool)
    usable = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
    for at in range(0, len(usable), 256):
        some = usable[at : at + 256]
        loss = model.losses(np.array([trigrams(texts[k]) for k in some], np.float32))
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.argsort(loss, 1, kind="stable")
        for k, s, o in zip(some, share, order, strict=True):
            first[k], score[k] = model.languages[o[0]], s[o[0]]
            if len(o) > 1:
                second[k], close[k] = model.languages[o[1]], s[o[0]] - s[o[1]] < AMBIGUOUS
    return first, score, second, close


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every row, its score, the second choice and whether the two are close."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: dict[str, list]) -> dict[str, object]:
        remembered("languages")
        first, score, second, close = told(shared.value, rows["text"])
        return {
            "doc_id": pa.array(rows["id"], pa.int64()), "lang_pred": pa.array(first, pa.string()), "score": score,
            "runner_up": pa.array(second, pa.string()), "ambiguous": close,
        }

    return map_batches(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), SCHEMA, batch)


def drop_undetermined(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs without the rows whose language can't be told or scores less than that."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[bytes | None]) -> list[bool]:
        remembered("languages")
        first, score, *_ = told(shared.value, texts)
        return [lang != UNDETERMINED and s >= least for lang, s in zip(first, score, strict=True)]

    return keep_rows(docs, text_col, keep)
