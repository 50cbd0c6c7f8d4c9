"""BPE encoding and decoding (operator 3).

A word's symbols form a doubly linked list; a priority queue holds the ranks of the merges that its neighbours allow.
The lowest rank (leftmost first) is taken, entries whose symbols have changed meanwhile are skipped, and the two new
neighbour pairs are pushed. Decoding looks every id up in the table of vocabulary strings and concatenates them.

The vocabulary file (its path is a parameter) is read on the driver, checked against MAX_VOCABULARY_BYTES and broadcast;
a worker keeps the encoder, and the ids of at most MEMO_WORDS words that it has met, between tasks; the half not met lately
is held in a few arrays rather than a dict. Nothing is shuffled.

Defined results: null and empty texts have no ids and decode to the empty string; a null id column value is passed
through; rows that share an id are encoded one by one; texts of any length are encoded whole; an empty table gives an
empty table; columns other than id and text are not read. The strings of added tokens are matched in the raw text first
and are one id each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from densika.llm.common import LOWER, map_batches, remembered

MAX_VOCABULARY_BYTES = 64 << 20
MEMO_WORDS = 1_600_000
END = "</w>"
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Fixed by the vocabulary file's pre-tokenizer, and checked against it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below it, regex and the tokenizers library agree on every character.
PLAIN = "\u0250"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Frozen:
    """A read-only map of bytes to bytes, by buckets of their hash, in a few arrays; it takes less than half of a dict's memory."""

    def __init__(self, words: dict[bytes, bytes]):
        n = len(words)
        self.mask = (1 << max(n - 1, 1).bit_length()) - 1
        bucket = np.fromiter(map(hash, words), np.int64, n) & self.mask
        order = np.argsort(bucket, kind="stable")
        first = np.cumsum(np.bincount(bucket + 1, minlength=self.mask + 2))
        both = [x for pair in words.items() for x in pair]
        order = np.stack([2 * order, 2 * order + 1], 1).ravel()
        ends = np.cumsum(np.fromiter(map(len, both), np.int64, 2 * n)[order])
        self.data = b"".join(b"".join([both[k] for k in order[at : at + 4096].tolist()]) for at in range(0, 2 * n, 4096))
        self.first, self.starts = array("I", first.astype("I").tobytes()), array("Q", b"\0" * 8 + ends.astype("Q").tobytes())

    def get(self, key: bytes) -> bytes | None:
        bucket, starts, data = hash(key) & self.mask, self.starts, self.data
        for i in range(2 * self.first[bucket], 2 * self.first[bucket + 1], 2):
            if data[starts[i] : (at := starts[i + 1])] == key:
                return data[at : starts[i + 2]]
        return None


class Encoder(dict):
    """Maps a chunk of a text (UTF-8 bytes without white space) to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.older = Frozen({})
        spec = json.loads(vocabulary)
        model = spec["model"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or pattern != PATTERN or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find = regex.compile(PATTERN).findall
        # only its rules for normalizing and splitting are used, so it goes without words
        self.rules = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.packed = {k: int(k).to_bytes(4, "little") for k in {*self.ids.values(), *self.added.values()}}
        size = max(self.packed) + 1
        self.strings = [""] * size
        for s, k in [*self.ids.items(), *self.added.items()]:
            self.strings[k] = s

    def merged(self, symbols: list[str]) -> list[str]:
        """What is left of a word's symbols, a character for each byte, when no merge applies any more."""
        symbols[-1] += END
        n, rank = len(symbols), self.rank
        if n == 1:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s is not None]

    def plain(self, text: str) -> bytes:
        """The packed ids of a text in which no added token is looked for."""
        if text.isascii() or max(text) < PLAIN:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
            words = [[self.alphabet[b] for b in word.encode()] for word in self.find(text)]
        else:  # which letters there are depends on the version of Unicode, so the file's own rules split the text
            words = [list(w) for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text)) if w]
        return b"".join(self.packed[self.ids[s]] for word in words for s in self.merged(word) if s in self.ids)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= MEMO_WORDS // 2:  # words not met again since the last time are forgotten
            self.older = Frozen(self)
            self.clear()
        if (out := self.older.get(chunk)) is not None:
            self[chunk] = out
            return out
        if len(chunk) > 1 and chunk[-1] in b".,!" and chunk[-2] in ALNUM:  # a word and one mark, which is a word of its own
            again = chunk[:-1] in self
            out = self[chunk[:-1]] + self[chunk[-1:]]
            if not again:
                return out
        else:
            out = self.plain(chunk.decode("utf-8", "replace"))
        self[chunk] = out
        return out

    def pack(self, data: bytes) -> bytes:
        """The packed ids of a whole text in UTF-8."""
        if b"<|" in data and self.split.search(text := data.decode("utf-8", "replace")):
            out, at = [], 0
            for m in self.split.finditer(text):
                out += [self.pack(text[at : m.start()].encode()), self.packed[self.added[m[0]]]]
                at = m.end()
            return b"".join([*out, self.pack(text[at:].encode())])
        # Combining marks may compose with capitals otherwise than with small letters; without any, A-Z can go first.
        if b"\xcc" not in data and b"\xcd" not in data:
            data = data.translate(LOWER)
        return b"".join(map(self.__getitem__, data.split()))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.pack((text or "").encode()), "<u4").tolist()

    def decode(self, ids: list[int], separator: str = " ") -> str:
        """The vocabulary strings of the ids. A vocabulary without a decoder puts a space between them."""
        return separator.join(map(self.strings.__getitem__, ids))


class Shared:
    """A vocabulary for workers: broadcast once, made into an encoder once in each worker."""

    def __init__(self, spark, path: str, kind: type = Encoder):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if len(text) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
        self.key = f"{kind.__name__} {hashlib.sha256(text.encode()).hexdigest()}"
        self.kind, self.text = kind, spark.sparkContext.broadcast(text)

    def get(self) -> Encoder:
        return remembered(self.key, lambda: self.kind(self.text.value))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each text: id, ids array<int>."""
    shared = Shared(docs.sparkSession, path)

    def batch(rows: dict[str, list]) -> dict[str, object]:
        pack = shared.get().pack
        packed = [np.frombuffer(pack(t or b""), "<u4") for t in rows["text"]]
        ends = np.cumsum([0, *map(len, packed)]).astype(np.int32)
        values = pa.array(np.concatenate(packed).astype(np.int32))
        return {"doc_id": pa.array(rows["id"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), values)}

    return map_batches(columns(docs, id_col, text_col), "doc_id long, ids array<int>", batch)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The decoded text of each array of ids; a null array decodes to the empty string."""
    shared = Shared(encoded.sparkSession, path)

    def batch(rows: dict[str, list]) -> dict[str, object]:
        text = shared.get().decode
        return {"doc_id": pa.array(rows["id"], pa.int64()), "text": pa.array([text(x or []) for x in rows["ids"]], pa.string())}

    narrow = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return map_batches(narrow, "doc_id long, text string", batch)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; returns digests of the ids and of the decoded text, not the texts."""
    shared = Shared(docs.sparkSession, path)

    def batch(rows: dict[str, list]) -> dict[str, object]:
        encoder = shared.get()
        out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        for key, data in zip(rows["id"], rows["text"], strict=True):
            packed = encoder.pack(data or b"")
            text = encoder.decode(np.frombuffer(packed, "<u4").tolist())
            row = (key, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(data or b""))
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        return {k: pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in out.items()}

    return map_batches(columns(docs, id_col, text_col), SCHEMA, batch)


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
