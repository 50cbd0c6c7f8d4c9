"""Toxicity by class-conditional Kneser-Ney models (operator 2).

Two models, of toxic and of ordinary labelled texts, predict each byte of a word from the ORDER - 1 before it (the space
before the word counts). With c the counts of one class, t(h) the number of bytes that follow h in it and D < 1 a discount,

    P(b | h) = (max(c(h b) - D, 0) + D t(h) S(b | shorter h)) / c(h)

where S is shared: interpolated Kneser-Ney over continuation counts of both classes, with a discount for each order from
its counts of counts, down to all bytes alike. So a rare expression gets the same estimate from both. As toxic texts consist
of ordinary words for the most part, a word's probability in a toxic text is a mixture, (1 - m) P_ordinary + m P_toxic; its
log ratio to P_ordinary is summed over all words and divided by their number (plus a few words of ratio 0, so short
texts aren't judged by one word), and a logistic curve makes it a score. Every word counts; none is cut off.

Both models are counted on two thirds of the sample, each line once for each class, so copies weigh nothing. D, m, the number of
added words and the curve are those that fit the last third best.

Learning reads a bounded sample of the labelled rows: at most ``sample`` texts of each class, the first by a hash of
their id, each whole. n-grams are counted on the executors; the driver gets the distinct ones, and fails if there are more
than MAX_GRAMS rather than drop any. Scoring is one pass over the whole texts, without a shuffle; the models are broadcast.

Defined results: null and empty texts, and those without letters, score EMPTY, below the threshold; a null id is passed
through and never learned from; rows that share an id are scored one by one, and the first of their texts in order is
learned from; labels that repeat an id count as toxic if any of them does; null labels are not learned from; without labels of both classes every score is EMPTY; an empty
table gives an empty table; only id, text and the label are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.common import LOWER, cut, keep_rows, map_batches, remembered

THRESHOLD = 0.3
EMPTY = 0.01
SAMPLE = 4000
ORDER = 5
#: What is tried: discounts of a class's counts, shares of toxic words, and words of ratio 0 that a text gets.
DISCOUNTS, MIXED, ADDED = (0.5, 0.75, 0.9), (0.005, 0.01, 0.02, 0.05, 0.1), (0, 20, 50, 100)
#: The most n-grams that learning takes: about 600 MB on the driver.
MAX_GRAMS = 1 << 21
MEMO_WORDS = 300_000
#: A-Z lower-cased, ASCII marks and digits to spaces.
LETTERS = bytes(32 if chr(b) in string.punctuation + string.digits else LOWER[b] for b in range(256))
SCHEMA = "doc_id long, score double, predicted int, log_ratio double, n_words long"


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(LETTERS).split()


def grams(word: bytes) -> Iterable[bytes]:
    """Each byte of a word and the space after it, with what precedes it; the space before a word counts."""
    s = b" %b " % word
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


@dataclass
class Models:
    """log P_toxic - log P_ordinary of n-grams that were counted, and of contexts before all other bytes."""

    ratio: dict[bytes, float]
    context: dict[bytes, float]
    mixed: float = MIXED[0]
    added: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    name: str = field(default_factory=lambda: f"toxicity {uuid.uuid4().hex}")

    def word(self, word: bytes) -> float:
        """log P_toxic - log P_ordinary of a word."""
        ratio, context = self.ratio, self.context
        return sum(x if (x := ratio.get(g)) is not None else context.get(g[:-1], 0.0) for g in grams(word))

    def mixture(self, ratio: float, mixed: float | None = None) -> float:
        """The log ratio of a word's probability in toxic texts, which are ordinary words for the most part."""
        return math.log1p((self.mixed if mixed is None else mixed) * math.expm1(min(ratio, 300.0)))

    def text(self, data: bytes | None) -> tuple[float, int]:
        """The sum of the words' log ratios, and the number of words."""
        own, memo = words(data), remembered(self.name)
        total = []
        for w in own:
            if (r := memo.get(w)) is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                r = memo[w] = self.mixture(self.word(w))
            total.append(r)
        return math.fsum(total), len(own)

    def scores(self, ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(n), EMPTY)
        logit = self.slope * ratio / np.maximum(n + self.added, 1.0) + self.offset
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), EMPTY)


def discount(counts: Iterable[int]) -> float:
    """n1 / (n1 + 2 n2) of the counts that are 1 and 2, as far as it can be told."""
    few = Counter(c for c in counts if c < 3)
    return min(max(few[1] / (few[1] + 2 * few[2]), 0.1), 0.9) if few else 0.5


class Shared:
    """Kneser-Ney over what both classes have: of how many longer n-grams an n-gram is the end."""

    def __init__(self, counted: Iterable[bytes]):
        by_length: list[set[bytes]] = [set() for _ in range(ORDER + 2)]
        for g in counted:
            by_length[len(g)].add(g)
        self.ends: list[Counter[bytes]] = [Counter() for _ in range(ORDER + 1)]
        for n in range(ORDER, 1, -1):
            shorter = self.ends[n - 1]
            shorter.update(g[1:] for g in by_length[n])
            by_length[n - 1] |= shorter.keys()
        self.discounts = [discount(c.values()) for c in self.ends]
        self.total, self.kinds = Counter(), Counter()
        for counts in self.ends:
            for g, c in counts.items():
                self.total[g[:-1]] += c
                self.kinds[g[:-1]] += 1
        self.memo: dict[bytes, float] = {}

    def p(self, g: bytes) -> float:
        """S of the last byte after those before it."""
        if not g:
            return 1 / 256
        if g not in self.memo:
            t, d, low = self.total.get(g[:-1], 0), self.discounts[len(g)], self.p(g[1:])
            self.memo[g] = (max(self.ends[len(g)].get(g, 0) - d, 0) + d * self.kinds[g[:-1]] * low) / t if t else low
        return self.memo[g]


def kneser_ney(counts: dict[bytes, tuple[float, float]], shared: Shared, d: float) -> Models:
    """Models from counts of n-grams in ordinary and in toxic texts, and a discount."""
    total: dict[bytes, np.ndarray] = {}
    for g, c in counts.items():
        row = total.setdefault(g[:-1], np.zeros((2, 2)))
        row[0] += c
        row[1] += np.minimum(c, d)
    left = {h: [a / n if n else 1.0 for n, a in r.T.tolist()] for h, r in total.items()}
    total = {h: r[0].tolist() for h, r in total.items()}
    context = {h: math.log(b / a) for h, (a, b) in left.items()}
    ratio = {}
    for g, c in counts.items():
        h, s = g[:-1], shared.p(g[1:])
        p = [max(x - d, 0) / n + b * s if n else s for x, n, b in zip(c, total[h], left[h], strict=True)]
        ratio[g] = math.log(p[1] / p[0])
    return Models(ratio, context)


def fit_curve(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """The logistic curve with the least loss, and that loss."""
    scale = x.std() + 1e-9
    rows, beta = np.stack([x / scale, np.ones_like(x)]), np.zeros(2)

    def loss_of(beta: np.ndarray) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(beta @ rows, -30, 30)))
        q = np.clip(p, 1e-6, 1 - 1e-6)
        return float(-(weight * np.where(toxic, np.log(q), np.log(1 - q))).mean() + 5e-3 * (beta @ beta) / len(x)), p

    loss, p = loss_of(beta)
    for _ in range(100):  # Newton's method with a small ridge; a step that doesn't help is halved
        gradient = rows @ (weight * (p - toxic)) + 1e-2 * beta
        hessian = (rows * (weight * p * (1 - p))) @ rows.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() > 1e-6:
            better, q = loss_of(beta - step)
            if better < loss:
                break
            step = step / 2
        else:
            break
        beta, loss, p = beta - step, better, q
    return float(beta[0] / scale), float(beta[1]), loss


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learns: Column | None, sample: int) -> Models:
    """Models from the labelled rows, of those for which learns holds (an expression of the column id)."""
    marked = labels.select(labels[id_col].cast("long").alias("id"), (labels[label_col] == 1).cast("int").alias("toxic"))
    marked = marked.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (F.lit(True) if learns is None else learns))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Models({}, {})
    order = F.xxhash64("id", F.lit("toxicity"))
    sampled = [tuple(r) for x in (0, 1) for r in marked.where(F.col("toxic") == x).orderBy(order, "id").limit(sample).collect()]
    chosen = docs.sparkSession.createDataFrame(sampled, "id long, toxic int").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    texts = cut(texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "part").agg(F.min("text").alias("text")))

    def counted(rows: dict[str, list]) -> dict[str, object]:
        remembered("toxicity sample")  # what other operators left in the worker goes before models come
        found: dict[tuple[bytes, int], int] = Counter()
        for line, toxic in zip(rows["line"], rows["toxic"], strict=True):
            found.update((g, toxic) for w in words(line) for g in grams(w))
        return {
            "gram": pa.array([g for g, _ in found], pa.binary()),
            "ordinary": pa.array([n * (1 - x) for (_, x), n in found.items()], pa.int64()),
            "toxic": pa.array([n * x for (_, x), n in found.items()], pa.int64()),
        }

    lines = texts.where(F.col("part") > 0).select("toxic", F.explode(F.split("text", "\n")).alias("line")).distinct()
    found = map_batches(lines, "gram binary, ordinary long, toxic long", counted)
    found = found.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    counts = {bytes(r["gram"]): (r["ordinary"], r["toxic"]) for r in found.limit(MAX_GRAMS + 1).collect()}
    if len(counts) > MAX_GRAMS:
        raise ValueError(f"the sample has more than {MAX_GRAMS} n-grams; take a smaller one")
    shared = Shared(counts)
    tried = [kneser_ney(counts, shared, d) for d in DISCOUNTS]

    def measured(rows: dict[str, list]) -> dict[str, object]:
        remembered("toxicity sample")
        sums, n = [], []
        for text in rows["text"]:
            own = Counter(words(text))
            ratios = [([m.word(w) for w in own], m) for m in tried]
            sums.append([math.fsum(k * m.mixture(r, x) for r, k in zip(rs, own.values(), strict=True)) for rs, m in ratios for x in MIXED])
            n.append(own.total())
        columns = {"id": (rows["id"], pa.int64()), "toxic": (rows["toxic"], pa.int32()), "sums": (sums, pa.list_(pa.float64())), "n": (n, pa.int64())}
        return {name: pa.array(x, kind) for name, (x, kind) in columns.items()}

    rest = map_batches(texts.where(F.col("part") == 0).select("id", "toxic", "text"), "id long, toxic int, sums array<double>, n long", measured)
    rest = sorted(rest.collect(), key=lambda r: r["id"])
    toxic, words_in = np.array([r["toxic"] == 1 for r in rest], bool), np.array([r["n"] for r in rest], np.float64)
    if not toxic.any() or toxic.all():
        return tried[0]
    sums, prior = np.array([r["sums"] for r in rest]), n[1] / (n[0] + n[1])
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))  # classes weigh as they do among all labels
    best = np.inf
    for (k, (models, mixed)), added in product(enumerate(product(tried, MIXED)), ADDED):
        slope, offset, loss = fit_curve(sums[:, k] / np.maximum(words_in + added, 1), toxic, weight)
        if loss < best:
            best, chosen_models = loss, models
            fitted = dict(mixed=mixed, added=float(added), slope=slope, offset=offset)
    return replace(chosen_models, **fitted)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The score of every row, and 1 where it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def batch(rows: dict[str, list]) -> dict[str, object]:
        own = shared.value
        ratio, n = np.array([own.text(t) for t in rows["text"]], np.float64).T
        s = own.scores(ratio, n)
        return {
            "doc_id": pa.array(rows["id"], pa.int64()), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32),
            "log_ratio": ratio, "n_words": n.astype(np.int64),
        }

    return map_batches(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), SCHEMA, batch)


def drop_toxic(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def keep(texts: list[bytes | None]) -> list[bool]:
        ratio, n = np.array([shared.value.text(t) for t in texts], np.float64).T
        return (shared.value.scores(ratio, n) < THRESHOLD).tolist()

    return keep_rows(docs, text_col, keep)
