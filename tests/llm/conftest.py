import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, score string, row_key string, n string, bucket string, component string, kept string"
LONG = 60_000


def prose(rng, n, vocabulary=400, stem="w"):
    return " ".join(f"{stem}{min(int(rng.paretovariate(0.7)), vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def texts():
    """Texts of every odd kind: null, empty, blank, short, long, repeated, near copies, other scripts."""
    rng = random.Random(17)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(25)]
    near = base[0].split()
    near[30] = "changed"
    out = [*base, None, "", " \t\n\x0b", "one", "two words", "ONE", "a b c", "12 34 !?", base[1], base[1], base[2].upper(), " ".join(near)]
    out += [base[3] + " " + base[4][:300], "Ünïcödé ß Σας 漢字 👍🏽 é́ <|endoftext|> it's", prose(rng, LONG // 5), ("ab " * 2000).strip(), base[5][:49], base[5][:50]]
    return out


def rows():
    """Documents of these texts with null and repeated ids, repeated rows, null languages and clashing extra columns."""
    extra = ("x", "x", "x", "x", "x", "x", "x", "x")
    out = [(k, t, ("en", "de", None)[k % 3], None if k % 5 == 0 else "src", None if t is None else len(t), *extra) for k, t in enumerate(texts())]
    out += [out[7], (None, out[8][1], "en", "src", 1, *extra), (9, "another text under an id that was there before", "de", "src", 1, *extra)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def distinct_rows():
    """The same without repeated and missing ids."""
    seen, out = set(), []
    for r in rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@pytest.fixture(scope="session")
def plain(spark):
    return spark.createDataFrame(distinct_rows(), SCHEMA).repartition(3).cache()
