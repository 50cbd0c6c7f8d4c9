"""Language models, toxicity and languages against plain Python and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from densika.llm import common, langid, lm, toxicity
from densika.llm.common import held_out, mixed
from tests.llm.conftest import prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fold(key, modulus):
    return None if key is None else zlib.crc32(str(key).encode()) % modulus


def base_scores(documents, modulus=5, out=1):
    counts = Counter()
    for key, text in documents:
        if fold(key, modulus) != out:
            counts.update([*words(text), ("end",)])
    n, v = sum(counts.values()), len(counts)
    result = []
    for key, text in documents:
        own = [*words(text), ("end",)]
        score = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        result.append((key is None, key or 0, len(own), sum(counts[t] > 0 for t in own), n, round(score, 6)))
    return sorted(result)


@pytest.mark.parametrize("head", [lm.HEAD, 20, 0])
def test_base_scores_are_exact(docs, head):
    """Whether all words are broadcast, some or none: the join finds the rest."""
    model, tail = lm.learn(docs.where(~held_out("doc_id", 5, 1)), head=head)
    found = lm.score(docs, model, tail).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == base_scores([(r[0], r[1]) for r in rows()])
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in found)


def test_nothing_to_learn_or_to_score(docs, none):
    model, tail = lm.learn(none)
    assert all((r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0) for r in lm.score(docs, model, tail).collect())
    model, tail = lm.learn(docs)
    assert lm.score(none, model, tail).count() == 0


def test_context_helps_on_held_out_texts(spark):
    rng = random.Random(4)
    after = {f"w{k}": [f"w{rng.randrange(60)}" for _ in range(3)] for k in range(60)}

    def text():
        w, out = "w0", []
        for _ in range(150):
            out.append(w)
            w = rng.choice(after[w])
        return " ".join(out)

    df = spark.createDataFrame([(k, text()) for k in range(120)], "doc_id long, text string")
    model, tail = lm.learn(df.where(~held_out("doc_id", 5, 1)))
    found = lm.score(df, model, tail).withColumn("held_out", held_out("doc_id", 5, 1)).where("held_out")
    total = found.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert total["s"] / total["n"] > total["b"] / total["n"] + 0.5


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(0)
    keys = np.sort(np.unique(rng.integers(0, 1 << 64, 20_000, np.uint64)))
    counts = rng.geometric(0.3, len(keys)).astype(np.int64) ** 2
    ends = lm.dealt(keys, 16)
    table = lm.Filter([lm.segment(keys[a:b], counts[a:b], 16) for a, b in zip(ends[:-1], ends[1:], strict=True)] * 2, 16)
    most = np.full(len(keys), len(lm.LEVELS))
    level, true = table.level(keys, most), np.searchsorted(lm.LEVELS, counts, "right")
    assert (level >= true).all() and (level > true).mean() < 0.06
    other = rng.integers(0, 1 << 64, 20_000, np.uint64)
    assert (table.level(other, most[:1].repeat(20_000)) > 0).mean() < 0.03
    assert (table.level(keys, np.minimum(true, 2)) == np.minimum(true, 2)).all()


def test_keys_tell_their_contexts():
    u, v = np.random.default_rng(1).integers(0, 1 << 64, (2, 1000), np.uint64)
    assert (lm.unmixed(mixed(u)) == u).all()
    assert (lm.contexts_of(lm.pair_keys(u, v)) == u & lm.CONTEXT).all()
    assert len(set(lm.pair_keys(u, v).tolist())) == len(set(lm.probed(lm.pair_keys(u, v), 16, 0).tolist())) == 1000


def plain_model(texts):
    """The model of lm without hashes and filter: P(w | the token before), counts quantised as there."""
    counts, after = Counter(), {}
    for text in texts:
        own = ["<start>", *words(text), "<end>"]
        for n in (1, 2):
            for k in range(n - 1, len(own)):
                if n > 1 or k:
                    counts[tuple(own[k - n + 1 : k + 1])] += 1
                    after.setdefault(tuple(own[k - n + 1 : k]), set()).add(own[k])
    n, v = sum(c for g, c in counts.items() if len(g) == 1), len(after.get((), ()))
    counts["<start>",] = exact = len(texts)

    def low(c):
        return max((int(x) for x in lm.LEVELS if x <= c), default=0)

    def high(c):
        return min(int(x) for x in lm.LEVELS if x > c) - 1

    def p(h, w):
        if not h:
            return (low(counts[w,]) + 0.5) / (n + 0.5 * (v + 1))
        rest = p(h[1:], w)
        if not counts[h]:
            return rest
        most = exact if h == ("<start>",) else high(counts[h])
        return (max(low(counts[*h, w]) - lm.DISCOUNT, 0) + lm.DISCOUNT * low(len(after[h])) * rest) / most

    def score(text):
        own = ["<start>", *words(text), "<end>"]
        return sum(math.log10(p((own[k - 1],), own[k])) for k in range(1, len(own)))

    return p, score


@pytest.mark.parametrize("most", [lm.MAX_FILTER_BYTES, 500])
def test_scores_are_those_of_the_plain_model(spark, most):
    """With a filter too large for false positives; broadcast, and joined."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 60), 30) for _ in range(80)]
    learned, df = texts[:50] + texts[:5], spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, tail = lm.learn(spark.createDataFrame([(x,) for x in learned], "text string"), max_filter_bytes=most, head=20, bits_per_entry=4096)
    assert (model.bits is None) == (most == 500)
    plain = plain_model(learned)[1]
    for r in lm.score(df, model, tail).collect():
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-9)


def test_plain_model_sums_to_one_at_most():
    rng = random.Random(3)
    learned = [prose(rng, rng.randint(0, 60), 30) for _ in range(50)]
    p, _ = plain_model(learned)
    every = sorted({w for t in learned for w in words(t)}) + ["<end>"]
    for h in [(), ("<start>",), *((w,) for w in every[:-1]), ("new",)]:
        assert 0.3 < sum(p(h, w) for w in [*every, "unseen"]) <= 1 + 1e-9


def test_levels_of_any_filter_size_tell_known_from_new(spark):
    """A filter of few bits has more false positives, which raise counts; nothing that was counted is lost."""
    rng = random.Random(6)
    texts = [prose(rng, 80, 200) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for bits in (4, 12, 256):
        model, tail = lm.learn(df, bits_per_entry=bits)
        found[bits] = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), r["score"] / r["n_tokens"]) for r in lm.score(df, model, tail).collect())
    assert [x[:3] for x in found[4]] == [x[:3] for x in found[12]] == [x[:3] for x in found[256]]
    assert all(abs(x[3] - y[3]) < 0.1 for x, y in zip(found[12], found[256], strict=True))


def test_filter_too_large_to_broadcast_loses_nothing(spark, docs, monkeypatch):
    """All pairs stay in the filter at any bound, and its segments give the same scores by a join."""
    monkeypatch.setattr(lm, "COUNT_TOKENS", 1000)
    found = []
    for most in (lm.MAX_FILTER_BYTES, 500):
        model, tail = lm.learn(docs.where(~held_out("doc_id", 5, 1)), max_filter_bytes=most, head=20)
        rows_ = lm.score(docs, model, tail).collect()
        found.append(sorted(tuple((x is None, x if isinstance(x, int) else round(x or 0, 9)) for x in r) for r in rows_))
    assert found[0] == found[1] and len(found[0]) == len(rows()) and model.bits is None


def test_probabilities_sum_to_one_at_most(spark):
    """Over all words and one for unseen ones, after any context, with a filter too large for false positives."""
    rng = random.Random(9)
    texts = [prose(rng, 60, 200) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = [*sorted({w for t in texts for w in words(t)}), "unseen", None]
    scorer = lm.Scorer(lm.learn(df, bits_per_entry=4096)[0])
    for context in [None, *every[:-1:8], "unseen"]:
        some = [" ".join(x for x in (context, w) if x).encode() for w in every]
        flat, begin = next(lm.tokens_of(some))
        p = scorer.probabilities(flat, begin)[1]
        assert 0.2 < p[begin - np.arange(len(begin)) + int(context is not None)].sum() <= 1 + 1e-9


def test_words_are_hashed_alike_everywhere(monkeypatch):
    rng = random.Random(0)
    texts = ["".join(rng.choice("abAB \n\té#") for _ in range(rng.randint(0, 40))).encode() for _ in range(200)] + [None, b"", b"  ", b"x" * 100]
    seen = {}
    for size in (1 << 19, 16):
        monkeypatch.setattr(lm, "SCORE_BYTES", size)
        row = 0
        for flat, begin in lm.tokens_of(texts):
            for at, end in zip(begin, [*begin[1:], len(flat)], strict=True):
                own = words((texts[row] or b"").decode())
                row += 1
                assert flat[at] == lm.START and flat[end - 1] == lm.END and end - at == len(own) + 2
                assert all(seen.setdefault(w, int(h)) == int(h) for w, h in zip(own, flat[at + 1 : end - 1], strict=True))
        assert row == len(texts)
    assert len(set(seen.values())) == len(seen)


def toxic_corpus(spark, n=400):
    rng = random.Random(5)
    out = []
    for k in range(n):
        text = prose(rng, rng.randint(20, 150), 300, stem="word")
        toxic = k % 4 == 0
        if toxic:
            own = text.split()
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "moron,", "scum.", "SCUM"]))
            text = " ".join(own)
        out.append((k, text, int(toxic)))
    df = spark.createDataFrame(out, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxic_texts_are_found(spark):
    docs, labels = toxic_corpus(spark)
    models = toxicity.learn(docs, labels, "doc_id", "text", "toxic", ~held_out("id", 4, 2), toxicity.SAMPLE)
    found = toxicity.score(docs, models).join(labels, "doc_id").withColumn("held_out", held_out("doc_id", 4, 2)).where("held_out").collect()
    assert len(found) > 60 and sum(r["predicted"] == r["toxic"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, models).collect()}
    assert kept == {r["doc_id"] for r in toxicity.score(docs, models).where("predicted = 0").collect()}


def test_learning_gives_up_what_workers_hold(spark, docs, monkeypatch):
    """A worker that has packed texts holds a memo of words, which must not stay while models are fitted."""
    ran, plain = spark.sparkContext.accumulator(0), toxicity.map_batches

    def watched(df, schema, fn):
        def run(rows):
            common.remembered("left over")
            found = fn(rows)
            assert "left over" not in common._HELD
            ran.add(1)
            return found

        return plain(df, schema, run)

    monkeypatch.setattr(toxicity, "map_batches", watched)
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, "doc_id", "text", "toxic", None, 100).slope
    assert ran.value >= 2


def test_toxicity_of_odd_documents(spark, docs, none):
    _, labels = toxic_corpus(spark, 40)
    odd = labels.unionAll(spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 1), (9999, 0)], "doc_id long, toxic int"))
    models = toxicity.learn(docs, odd, "doc_id", "text", "toxic", None, 100)
    found = toxicity.score(docs, models).collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["score"] == toxicity.EMPTY for r in found if r["n_words"] == 0)
    assert toxicity.score(none, models).count() == 0 and toxicity.drop_toxic(none, models).count() == 0
    unlearned = toxicity.learn(none, labels, "doc_id", "text", "toxic", None, 100)
    assert {r["score"] for r in toxicity.score(docs, unlearned).collect()} == {toxicity.EMPTY}
    one_class = toxicity.learn(docs, labels.where("toxic = 0"), "doc_id", "text", "toxic", None, 100)
    assert {r["score"] for r in toxicity.score(docs, one_class).collect()} == {toxicity.EMPTY}


def plain_kneser_ney(ordinary, toxic, d):
    """P(byte | bytes before, class) by the definition, from lists of words."""
    order = toxicity.ORDER
    counts = [Counter(g for w in words_ for g in toxicity.grams(w)) for words_ in (ordinary, toxic)]
    longer = {n: {g for c in counts for g in c if len(g) == n} for n in range(1, order + 1)}
    for n in range(order, 1, -1):
        longer[n - 1] |= {g[1:] for g in longer[n]}
    every = [bytes([b]) for b in range(256)]

    def ends(g):
        return sum(x[1:] == g for x in longer[len(g) + 1]) if len(g) < order else 0

    table = {g: ends(g) for n in range(1, order) for g in longer[n]}
    discounts = {}
    for n in range(1, order):
        few = Counter(c for g, c in table.items() if len(g) == n and 0 < c < 3)
        discounts[n] = min(max(few[1] / (few[1] + 2 * few[2]), 0.1), 0.9) if few else 0.5

    def shared(h, b):
        after = [c for g, c in table.items() if len(g) == len(h) + 1 and g[:-1] == h and c]
        low = shared(h[1:], b) if h else 1 / 256
        if not after:
            return low
        dn = discounts[len(h) + 1]
        return (max(table.get(h + b, 0) - dn, 0) + dn * len(after) * low) / sum(after)

    def p(h, b, kind):
        own = {g: c for g, c in counts[kind].items() if g[:-1] == h}
        low = shared(h[1:], b)
        return (max(own.get(h + b, 0) - d, 0) + sum(min(c, d) for c in own.values()) * low) / sum(own.values()) if own else low

    return p, every


def test_kneser_ney_is_the_plain_one_and_sums_to_one():
    rng = random.Random(2)
    make = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    ordinary, toxic = make[:45] * 2 + make[20:40], make[40:]
    counts = {}
    for kind, some in enumerate((ordinary, toxic)):
        for w in some:
            for g in toxicity.grams(w):
                counts.setdefault(g, [0, 0])[kind] += 1
    for d in toxicity.DISCOUNTS:
        models = toxicity.kneser_ney(counts, toxicity.Shared(counts), d)
        p, every = plain_kneser_ney(ordinary, toxic, d)
        for h in [b" ", b" a", b" ab", b"abcd", b" abc", b"zz", *sorted({g[:-1] for g in counts})[::9]]:
            for kind in (0, 1):
                assert sum(p(h, b, kind) for b in every) == pytest.approx(1)
        for w in [*make[::7], b"abcdabcd", b"xyz", b"a", b"ddda"]:
            plain = sum(math.log(p(g[:-1], g[-1:], 1) / p(g[:-1], g[-1:], 0)) for g in toxicity.grams(w))
            assert models.word(w) == pytest.approx(plain, abs=1e-9)


def test_score_is_that_of_the_plain_models(spark):
    """From the texts on: what learn() chose, with plain Python around it. No word is left out of the sum."""
    docs, labels = toxic_corpus(spark, 80)
    models = toxicity.learn(docs, labels, "doc_id", "text", "toxic", None, 1000)
    assert models.slope > 0 and models.mixed in toxicity.MIXED and models.added in toxicity.ADDED
    for r in toxicity.score(docs.withColumnRenamed("doc_id", "id"), models, "id").join(docs, "doc_id").collect():
        ratios = [models.word(w) for w in toxicity.words(r["text"].encode())]
        total = sum(math.log(1 - models.mixed + models.mixed * math.exp(x)) for x in ratios)
        assert r["n_words"] == len(ratios) and r["log_ratio"] == pytest.approx(total)
        logit = models.slope * total / (len(ratios) + models.added) + models.offset
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_too_many_n_grams_are_no_small_loss(spark, monkeypatch):
    docs, labels = toxic_corpus(spark, 40)
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 10)
    with pytest.raises(ValueError, match="n-grams"):
        toxicity.learn(docs, labels, "doc_id", "text", "toxic", None, 100)


ALPHABETS = {"aa": "abcdefgh ", "bb": "ijklmnop ", "cc": "qrstuvwx ", "dd": "aeiouxyz ", "ee": "bdfhjlnp ", "ff": "cgkosw àé ", "gg": "γδεζηθ "}


def language_corpus(spark, languages, n=60):
    rng = random.Random(8)
    out = []
    for k in range(n * len(languages)):
        lang = languages[k % len(languages)]
        out.append((k, "".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(30, 300))), lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string")


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_languages_are_told(spark, n):
    docs = language_corpus(spark, list(ALPHABETS)[:n])
    model = langid.learn(docs, "doc_id", "text", "lang", ~held_out("id", 3, 1))
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held_out", held_out("doc_id", 3, 1)).where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.drop_undetermined(docs, model, least=0.0).count() == docs.count()


def test_rare_languages_keep_their_sample(spark, monkeypatch):
    """However many languages there are, and however frequent the others."""
    often = spark.range(88_000).selectExpr("id", "concat('often', id % 22) AS lang")
    rare = spark.range(100_000, 104_800).selectExpr("id", "concat('rare', id % 240) AS lang")
    monkeypatch.setattr(langid, "fit", lambda totals: totals)
    totals = langid.learn(often.unionAll(rare).withColumn("text", F.lit("abc")), "id", "text", "lang")
    rows_ = {lang: x.sum() / langid.trigrams(b"abc").sum() for lang, x in totals.items()}
    assert len(rows_) == 262 and {n for lang, n in rows_.items() if lang.startswith("rare")} == {20}
    assert all(300 < n < 500 for lang, n in rows_.items() if lang.startswith("often"))


@pytest.mark.parametrize("n", [2, 3, 5, 6, 16, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1.0, 1.0}
    assert all(1 <= (column > 0).sum() < n for column in code.T)


def plain_decoding(model, text):
    """Language, score, second language and flag of one text, from its trigrams one by one."""
    data = b"  " + bytes(int(langid.FOLD[b]) for b in text.encode()) + b" "
    grams = [data[k : k + 3] for k in range(len(data) - 2)]
    codes = [((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS) for g in grams if g != b"   "]
    losses = []
    for k in range(len(model.languages)):
        loss = 0.0
        for bit in range(model.code.shape[1]):
            mean = sum(float(model.odds[bit][c]) for c in codes) / max(1, len(codes))
            margin = langid.SHARPNESS * mean * min(1, math.sqrt(len(codes) / langid.FEW))
            loss += math.log1p(math.exp(-margin * model.code[k][bit]))
        losses.append(loss)
    order = sorted(range(len(losses)), key=lambda k: (losses[k], k))
    share = [math.exp(min(losses) - x) for x in losses]
    first, second = order[0], order[1]
    total = sum(share)
    return model.languages[first], share[first] / total, model.languages[second], (share[first] - share[second]) / total < langid.AMBIGUOUS


@pytest.mark.parametrize("n", [3, 7])
def test_decoding_is_the_plain_one(spark, n):
    """The nearest codeword by loss; texts in two languages are flagged, texts in one aren't."""
    languages = list(ALPHABETS)[:n]
    docs = language_corpus(spark, languages)
    model = langid.learn(docs, "doc_id", "text", "lang")
    rng = random.Random(1)

    def text(lang, size):
        return "".join(rng.choice(ALPHABETS[lang]) for _ in range(size))

    mixed_texts = [" ".join(w for k in range(60) for w in (text("aa", 5), text("bb", 5))) for _ in range(10)]
    texts = [*(text(x, size) for x in languages for size in (1, 4, 30, 200)), *mixed_texts, "a", "q! 1"]
    first, score, second, close = langid.told(model, [t.encode() for t in texts])
    for k, t in enumerate(texts):
        if first[k] != langid.UNDETERMINED:
            lang, own, other, near = plain_decoding(model, t)
            assert (first[k], bool(close[k])) == (lang, near) and score[k] == pytest.approx(own, abs=1e-3)
            assert second[k] == other or own > 0.999  # others may be equally far
    flagged = dict(zip(texts, close, strict=True))
    assert not any(flagged[t] for t in texts if len(t) == 200)
    assert n > 5 or any(flagged[t] for t in mixed_texts)  # of more languages, a mixture may be near one codeword


def test_languages_of_odd_documents(spark, docs, none):
    model = langid.learn(docs, "doc_id", "text", "lang")
    found = langid.predict(docs, model).collect()
    assert len(found) == len(rows()) and {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    letterless = sum(not any(c.isalpha() for c in r[1] or "") for r in rows())
    assert sum(r["lang_pred"] == "und" for r in found) == letterless and all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(none, "doc_id", "text", "lang")).collect()} == {"und"}


def test_learning_reads_neither_held_out_rows_nor_labels(spark):
    docs = language_corpus(spark, ["aa", "bb"])
    swapped = docs.withColumn("lang", F.when(held_out("doc_id", 3, 1), F.lit("zz")).otherwise(F.col("lang")))
    a = langid.learn(docs, "doc_id", "text", "lang", ~held_out("id", 3, 1))
    b = langid.learn(swapped, "doc_id", "text", "lang", ~held_out("id", 3, 1))
    assert a.languages == b.languages == ["aa", "bb"] and np.array_equal(a.odds, b.odds)
