"""The pipeline's stages one by one against brute force, and the whole run."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import distinct_rows, prose
from tests.llm.test_copies import brute_components, brute_repeats
from tests.llm.test_text_operators import pieces_are_right

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    stems = {"en": "word", "de": "wort", "fr": "mot", "es": "pala"}
    passage = prose(rng, 60, 9000, "passage")
    out = []
    for k in range(400):
        lang = list(stems)[k % 4]
        text = prose(rng, rng.randint(20, 90), 300, stems[lang])
        if k % 5 == 0:
            own = text.split()
            for _ in range(5):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "moron", "scum"]))
            text = " ".join(own)
        if k in (33, 34, 121):
            text = text + " " + passage
        if k in (50, 51):
            text = "12345 !!! 6789"
        out.append((k, text, lang, "src", len(text)))
    out += [(500 + k, out[k][1], out[k][2], "copy", out[k][4]) for k in (1, 2, 3)]
    near = out[101][1].split()
    near[-1] = "other"
    out.append((600, " ".join(near), out[101][2], "near", 1))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "passages", "packing"]


def test_run(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        tables[name] = (before, docs)
        if name != "packing":
            assert docs.columns == COLUMNS and dict(docs.dtypes) == dict(before.dtypes)
    rows = {n: ({r["doc_id"]: r for r in a.collect()}, {r["doc_id"]: r for r in b.collect()} if n != "packing" else b.collect()) for n, (a, b) in tables.items()}

    before, after = rows["toxicity"]
    toxic = {k for k in before if k < 400 and k % 5 == 0}
    assert len(toxic & set(after)) <= 3 and len(set(before) - toxic - set(after)) <= 8
    assert all(after[k] == before[k] for k in after)

    before, after = rows["language"]
    assert set(before) - set(after) == {50, 51} & set(before) and all(after[k] == before[k] for k in after)

    before, after = rows["near_duplicates"]
    _, component = brute_components([(k, r["text"]) for k, r in before.items()], 5, 80)
    assert set(after) == {k for k in before if component[k] == k} and all(after[k] == before[k] for k in after)
    assert not {501, 502, 503} & set(after)

    before, after = rows["passages"]
    assert set(after) == set(before)
    removed = {r[1]: r[3] for r in brute_repeats([(k, r["text"]) for k, r in before.items()], 50)}
    assert all(len(before[k]["text"].encode()) - len(after[k]["text"].encode()) == removed[k] for k in after)
    assert all(after[k]["n_chars"] == len(after[k]["text"]) for k in after)
    assert sum("passage" in r["text"] for r in after.values()) < sum("passage" in r["text"] for r in before.values()) or removed == {}

    before, found = rows["packing"]
    pieces_are_right(found, [(k, r["text"]) for k, r in before.items()])
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    tokens = Counter()
    for r in whole:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == {key(r)[0] for r in found} and sum(tokens.values()) == sum(r["length"] for r in found)


def test_odd_documents(spark, folder):
    """Nulls, empty and long texts, extra columns with clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, span_key string, gone_id string, id string"
    odd = spark.createDataFrame([(*r[:5], "x", "x", "x", "x") for r in distinct_rows()] + [(None, None, None, None, None, None, None, None, None)], schema)
    for df in (odd, odd.limit(0)):
        n = df.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, df, folder)
            assert found.columns == df.columns and found.count() <= n
            if name == "passages":
                assert found.count() == n
        corpus_pipeline.STAGES[-1][1](spark, df, folder).count()


def test_tokens_are_those_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert library.get_vocab_size() == 49408
