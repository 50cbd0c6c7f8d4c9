"""BPE, packing and quality rules against the tokenizers library and plain Python."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from densika.llm import bpe, packing, quality_rules
from tests.llm.conftest import distinct_rows, rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    ENCODER = bpe.Encoder(f.read())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abAB .,!'<|>éÉ́ßİΣς漢 \n\t12", max_size=60)))
def test_encoder_equals_the_library(text):
    assert ENCODER.encode(text) == library_ids(text)
    assert ENCODER.decode(library_ids(text)) == LIBRARY.decode(library_ids(text), skip_special_tokens=False)


def test_added_tokens_are_found_first():
    for text in ("a<|endoftext|>b", "<|STARTOFTEXT|>", "<|startoftext|><|endoftext|>", "<|endoftext|"):
        assert ENCODER.encode(text) == library_ids(text)


def test_merges_skip_stale_entries():
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40)))
        assert ENCODER.encode(word) == library_ids(word)


def test_memo_forgets_without_a_change(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 4)
    small = bpe.Encoder(open(PATH, encoding="utf-8").read())
    text = "one two. three four five! one two. six, seven three four one"
    assert small.encode(text) == small.encode(text) == library_ids(text)


def test_words_not_met_lately_take_little_memory():
    words = {b"%d" % (k * k): bytes(4 * (k % 5)) for k in range(20_000)} | {b"": b"none"}
    held = bpe.Frozen(words)
    assert all(held.get(k) == v for k, v in words.items())
    assert held.get(b"absent") is held.get(b"2") is bpe.Frozen({}).get(b"") is None
    size = sum(map(sys.getsizeof, (held.data, held.first, held.starts)))
    assert 2 * size < sys.getsizeof(words) + sum(map(sys.getsizeof, [*words, *words.values()]))


def test_a_full_memo_is_frozen(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 200)
    small, rng = bpe.Encoder(open(PATH, encoding="utf-8").read()), random.Random(3)
    for _ in range(40):
        text = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}{rng.choice(['', ',', '.', 'é', '漢'])}" for _ in range(100))
        assert small.encode(text) == library_ids(text)
        assert isinstance(small.older, bpe.Frozen) and len(small) <= 102


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, StopIteration)):
        bpe.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_round_trip_of_odd_documents(spark, docs, none):
    import hashlib

    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, PATH).collect())
    expected = []
    for r in rows():
        ids = library_ids(r[1])
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append((r[0] is None, r[0] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.round_trip(none, PATH).count() == 0


def test_encode_and_decode_tables(spark, plain, none):
    encoded = bpe.encode(plain, PATH)
    texts = {r[0]: r[1] for r in distinct_rows()}
    assert all(r["ids"] == library_ids(texts[r["doc_id"]]) for r in encoded.collect())
    assert all(r["text"] == LIBRARY.decode(library_ids(texts[r["doc_id"]]), skip_special_tokens=False) for r in bpe.decode(encoded, PATH).collect())
    assert bpe.encode(none, PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["text"] == ""


def pieces_are_right(found, documents):
    """Every id of every document lies in exactly one piece, windows are full and gapless, and ids agree."""
    ids = {}
    for key, text in documents:
        ids.setdefault(key, []).append(np.array([*library_ids(text), 2], "<u4"))
    cover = Counter()
    for r in found:
        fits = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert fits
        cover[r["doc_id"]] += r["length"]
    assert all(cover[k] == sum(map(len, v)) for k, v in ids.items())
    windows = {}
    for r in found:
        windows.setdefault(r["sequence_id"], []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        at = 0
        for r in w:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # no padding: each size is a power of two


def test_packing_of_odd_documents(docs, none):
    pieces_are_right(packing.pack(docs, PATH).collect(), [(r[0], r[1]) for r in rows()])
    assert packing.pack(none, PATH).count() == 0


def test_packing_over_several_pools(plain):
    found = packing.pack(plain.coalesce(1), PATH, with_ids=True, pool_tokens=3000).collect()
    pieces_are_right(found, [(r[0], r[1]) for r in distinct_rows()])
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_windows(sizes):
    pieces = [(n, k, (k, b"", n), 0) for k, n in enumerate(sizes)]
    full, left = packing.windows(pieces, packing.TIERS)
    full += packing.binary_windows(left)
    taken = Counter()
    for tier, window in full:
        assert sum(p[0] for p in window) == tier and tier & (tier - 1) == 0
        for length, k, _, start in window:
            taken.update((k, t) for t in (start, start + length - 1))
    assert sum(t for t, _ in full) == sum(sizes)


def test_step_groups_are_balanced():
    sizes = [4096] * 100 + [512] * 333 + [1024] * 77
    groups = packing.balanced(sizes, 1 << 15)
    totals = Counter()
    for s, g in zip(sizes, groups, strict=True):
        totals[g] += s
    assert max(totals.values()) - min(totals.values()) <= 512


def base_of(text):
    """The agreed figures by the plainest means."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = sum(any(0 <= i <= len(words) - 3 and grams[tuple(words[i : i + 3])] > 1 for i in (k - 2, k - 1, k)) for k in range(len(words)))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, repeats, n < 50 or 100 * repeats > 50 * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é#", "\n", "<d>", " ", "\x0b"]), max_size=40).map(" ".join))
def test_base_figures(text):
    assert quality_rules.judge(text, 0.5)[:6] == base_of(text)


def test_quality_of_odd_documents(docs, none):
    found = quality_rules.quality(docs).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
    assert got == sorted((r[0] is None, r[0] or 0, *base_of(r[1])) for r in rows())
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_rules.quality(none).count() == 0


def test_line_rules():
    def rule(line):
        return quality_rules.line_failure(line, quality_rules.WORD.findall(line))

    assert rule("Home | About | Contact | Blog") == "navigation"
    assert rule("All rights reserved.") == "boilerplate"
    assert rule("on### the%%% dog***") == "symbols"
    assert rule("BUY NOW!! TODAY ONLY!!") == "capitals"
    assert rule("sting sting sting sting sting now.") == "stutter"
    assert rule("no end of a sentence here") == "punctuation"
    assert rule("Home. Products Cart Contact") == "punctuation"
    assert rule("One sentence. " + "And words of another one that is cut off " * 3) is None
    for line in ("Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés.", "© 2020 Somebody Inc.", "See www.somewhere.org."):
        assert rule(line) == "boilerplate"
    assert rule("A plain sentence, with words. And one more!\" ") is None


def test_clean_documents_stay_and_junk_goes():
    rng = random.Random(2)
    clean = "\n".join(" ".join("".join(rng.choice("aeionrst") for _ in range(6)) for _ in range(9)) + "." for k in range(20))
    junk = "\n".join(f"item{k} | menu{k} | page{k} | link{k} | more{k}" for k in range(20))
    assert quality_rules.judge(clean, 0.5)[6] is True
    assert quality_rules.judge(junk, 0.5)[6] is False
    judged = quality_rules.judge(clean + "\nCopyright 2020 all rights reserved.", 0.5)
    assert judged[6] and judged[10] == clean and judged[9] == hashlib.sha256(clean.encode()).hexdigest()


def test_nothing_is_shuffled(docs):
    for df in (bpe.round_trip(docs, PATH), packing.pack(docs, PATH), quality_rules.quality(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan and "Sort" not in plan
    assert F
