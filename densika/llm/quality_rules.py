"""Line-first cleaning of documents by rules (operator 10).

Every line of a text is judged on its own: whether it ends as a sentence does (or is long and has sentences), as navigation, as boilerplate (legal and
site phrases in the four languages of the corpus, and marks that no language needs), by symbols, capitals, stuttering words and
as a repeat of an earlier line. Lines that fail are removed; a document that loses more than
``max_lost`` of its words is rejected. Nothing is shuffled: the operator is one pass over the texts.

Defined results: a null or empty text has no words, so it is base_failed and rejected; a null id is passed through; rows
that share an id are judged one by one; a text of any length is judged whole; an empty table gives an empty table; only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from densika.llm.common import map_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$")
SEPARATORS = frozenset("|>»•·/")
SMALL, CAPITAL = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
PHRASES = {
    "en": r"all rights reserved|copyright|licen[sc]ed under|general public license|privacy policy|terms of (?:use|service)|sign up|log ?in(?:[^a-z]|$)|subscribe|click here|read more|share this",
    "de": r"alle rechte vorbehalten|urheberrecht|lizenziert unter|datenschutzerkl|nutzungsbedingungen|impressum|anmelden|abonnieren|hier klicken|weiterlesen|mehr lesen",
    "es": r"todos los derechos reservados|bajo (?:la )?licencia|aviso legal|privacidad|condiciones de uso|suscr[ií]b|haga clic|haz clic|leer m[aá]s|iniciar sesi[oó]n",
    "fr": r"tous droits r[eé]serv[eé]s|sous licence|mentions l[eé]gales|confidentialit[eé]|conditions d'utilisation|s'abonner|cliquez ici|lire la suite|se connecter",
    "": r"cookies?(?:[^a-z]|$)|javascript|©|®|https?://|www\.|[a-z0-9._-]+@[a-z0-9-]+\.[a-z]",
}
BOILERPLATE = re.compile("|".join(PHRASES.values()), re.IGNORECASE)
#: A line of boilerplate has at most so many words; a line of more is prose if a sentence ends anywhere in it.
BOILERPLATE_WORDS = 25

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long, clean_sha256 string, clean_text string"
)


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are found twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # the product of three numbers would not fit in 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
        _, windows = np.unique(np.stack([pairs[:-1], ids[2:]]), axis=1, return_inverse=True)
        windows = windows.ravel()
    else:
        windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= often
    return int(covered.sum())


def line_failure(line: str, words: list[str]) -> str | None:
    """The rule that a line with words breaks, if any."""
    n = len(words)
    if n > 1 and sum(w in SEPARATORS for w in words) * 3 >= n:
        return "navigation"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    if len(SYMBOLS.findall(line)) * 2 >= n:
        return "symbols"
    if n >= 3 and CAPITAL.search(line) and not SMALL.search(line):
        return "capitals"
    if n >= 4 and 3 * sum(a == b for a, b in zip(words, words[1:], strict=False)) >= n:
        return "stutter"
    if not (SENTENCE_END.search(line) or (n > BOILERPLATE_WORDS and SENTENCE.search(line))):
        return "punctuation"
    return None


def judge(text: str, max_lost: float) -> tuple:
    """All of a row's columns but the id."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dups = removed = lost = 0
    kept = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dups += again
        if again or line_failure(line, own):
            removed += 1
            lost += len(own)
        else:
            kept.append(line)
    n, repeats = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    good = not failed and lost <= max_lost * n
    clean = "\n".join(kept)
    sha = hashlib.sha256(clean.encode()).hexdigest()
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), dups, repeats, failed, good, removed, lost, sha, clean


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """The figures and the verdict on each document, and its text without the lines that failed."""
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def batch(rows: dict[str, list]) -> dict[str, object]:
        out = [judge(t.decode("utf-8", "replace") if t else "", max_lost) for t in rows["text"]]
        columns = [pa.array(rows["id"], pa.int64())]
        for k, kind in enumerate([pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()] * 2):
            columns.append(pa.array([x[k] for x in out] if k < 10 or with_text else [None] * len(out), kind))
        return dict(zip(names, columns, strict=True))

    return map_batches(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), SCHEMA, batch)
