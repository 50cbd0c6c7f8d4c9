"""Language-model scoring with a log-frequency Bloom filter (operator 1).

Counts of words and pairs, and of how many different words follow a word, are quantised to the levels 1, 2, 3, ..., 20, 22, 24,
... (a tenth apart). What reached a level is in the Bloom filter under that level and all below, so probing for levels until
the highest is found gives a lower bound of its count; the next level is an upper one. The model is absolute discounting,
interpolated from pairs to words, and takes all its counts from such probes:

    P(w | v) = (max(c(v w) - D, 0) + D t(v) P(w)) / c(v),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

with D = DISCOUNT and t(v) the number of words that follow v. c(v w) and t(v) are lower bounds and the context's count c(v) is
an upper one, so false positives aside (one key in a hundred) the sum over w is at most 1. The base score alone takes exact counts, as it must.

Scale: tokens are counted in each task before the shuffle, and sorted hashes travel in blocks, one for each bucket of the
hash space; a bucket makes its segment of the filter, so no key is hot and buckets grow in number with the input. How
many words follow another is summed in a second shuffle of a bucket's distinct pairs. The filter holds everything, so its
size follows the input. It is broadcast while it takes at most MAX_FILTER_BYTES; a larger one stays in its segments: the
distinct words and pairs of about COUNT_TOKENS tokens of text at a time go to the segments by bucket, and levels come back.
Both ways give the same scores. Exact word counts are broadcast for at most HEAD words, the most frequent. The filter tells
which others are new; the rest are looked up by a shuffled join on (row, word) with their frequency in the row.
Words are known by 64-bit hashes; two among n words agree with a probability of about n^2 / 2^65. A pair is known by 36 bits
of its first word and 28 of its second; the filter takes 41 bits of a hash beside those that tell its bucket.

Defined results: null and empty texts have one token, the end; a row without an id is learned from and not held out;
rows that share an id are scored one by one; texts of any length are scored whole; with nothing to learn from N and V are 0
and every word is as likely as any; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.llm.common import LOWER, cut, lists, mixed, pack, pack_parts, remembered, slices, unpack

#: Bits of the filter for each entry; an entry sets PROBES bits of one 64-bit word.
BITS_PER_ENTRY, PROBES = 12, 4
#: The largest filter that is broadcast.
MAX_FILTER_BYTES = 16 << 20
HEAD = 1 << 20
DISCOUNT = 0.85
#: Tokens that are counted together, bytes of text that are scored together, and keys that are looked up together.
COUNT_TOKENS, SCORE_BYTES, LOOKED_UP = 1 << 21, 1 << 19, 1 << 16
END = xxhash.xxh3_64_intdigest(b"\n end")
START = xxhash.xxh3_64_intdigest(b"\n start")
U = np.uint64


def levels() -> np.ndarray:
    out = [1, 2, 3]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 11 // 10))
    return np.array(out, np.int64)


LEVELS = levels()
#: The bits of a word's hash that its pairs are known by, and what makes keys of followers differ from those of words.
CONTEXT, FOLLOWED = U((1 << 64) - (1 << 28)), U(0x510E527FADE682D1)


def unmixed(x: np.ndarray) -> np.ndarray:
    """What mixed() made x from."""
    x = x ^ (x >> U(31)) ^ (x >> U(62))
    x = x * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U(27)) ^ (x >> U(54))
    x = x * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = x ^ (x >> U(30)) ^ (x >> U(60))
    return x - U(0x9E3779B97F4A7C15)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of words and the words after them."""
    return mixed((v & CONTEXT) | (w >> U(36)))


def contexts_of(pairs: np.ndarray) -> np.ndarray:
    """What pair_keys() took of the first words."""
    return unmixed(pairs) & CONTEXT


def probed(keys: np.ndarray, buckets: int, known: int) -> np.ndarray:
    """What the filter knows a key by: 41 bits beside those that tell its bucket, or the key of a word's followers."""
    unused = U(max(0, 24 - buckets.bit_length()))
    return mixed((keys & CONTEXT) ^ FOLLOWED) if known else keys >> unused << unused


WHITE = re.compile(rb"[\x20\x09-\x0D]")
IS_WHITE = np.array([WHITE.match(bytes([b])) is not None for b in range(256)])
_random = np.random.default_rng(20240501)
#: A random number for each byte; A-Z have those of a-z.
BYTE = _random.integers(0, 1 << 63, 256, U)[np.frombuffer(LOWER, np.uint8)]
BASE = 0xD6E8FEB86659FD93


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, factor, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def hashes_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and where it begins. A word's bytes are the coefficients of a polynomial."""
    x = np.frombuffer(data + b" ", np.uint8)
    white = IS_WHITE[x]
    inside = np.concatenate([[False], ~white])
    first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & white)
    up, down = powers(1 << (len(x) - 1).bit_length())
    total = np.zeros(len(x) + 1, U)
    np.cumsum(BYTE[x] * up[: len(x)], out=total[1:])
    return mixed((total[last] - total[first]) * down[first] + (last - first).astype(U)), first


def tokens_of(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of some texts, START before and END after each text, and where the texts begin in them.

    Texts are joined up to about SCORE_BYTES; longer ones are cut at white space first, never within a word.
    """
    held: list[bytes] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])])[:-1]
        h, at = hashes_of(b"\n".join(held))
        n = np.diff(np.append(np.searchsorted(at, starts), len(h)))
        return framed(h, n)

    for data in texts:
        data = data or b""
        if len(data) > SCORE_BYTES:
            if held:
                yield joined()
                held, size = [], 0
            parts, at = [], 0
            while at < len(data):
                cut_at = WHITE.search(data, min(len(data), at + SCORE_BYTES))
                end = cut_at.start() if cut_at else len(data)
                parts.append(hashes_of(data[at:end])[0])
                at = end
            h = np.concatenate(parts)
            yield framed(h, np.array([len(h)]))
            continue
        held.append(data)
        size += len(data)
        if size >= SCORE_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def framed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(n + 2)])[:-1]
    out = np.empty(len(h) + 2 * len(n), U)
    words = np.ones(len(out), bool)
    words[first] = words[first + n + 1] = False
    out[words], out[first], out[first + n + 1] = h, START, END
    return out, first


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


@cache
def masks() -> np.ndarray:
    """4,096 words of PROBES bits each."""
    random = np.random.default_rng(20240502)
    return np.array([sum(1 << int(b) for b in random.choice(64, PROBES, replace=False)) for _ in range(1 << 12)], U)


def probes(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """What places an entry in its segment, and the bits that it sets there."""
    g = mixed(keys ^ np.asarray(level).astype(U) * U(0x632BE59BD9B4E019))
    return g, masks()[(g & U(4095)).astype(np.int64)]


def place(g: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    """A number under size (less than 2^32), by the upper half of g."""
    return (g >> U(32)) * size >> U(32)


def segment(keys: np.ndarray, counts: np.ndarray, buckets: int, known: int = 0, bits_per_entry: int = BITS_PER_ENTRY) -> bytes:
    """One bucket's part of the filter. Levels up to known are taken for granted and not kept."""
    keys = probed(keys, buckets, known)
    level = np.searchsorted(LEVELS, counts, "right")
    size = max(1, -(-int(np.maximum(level - known, 0).sum()) * bits_per_entry // 64))
    words = np.zeros(size, U)
    for at in range(known + 1, int(level.max(initial=0)) + 1):
        g, bits = probes(keys[level >= at], at)
        np.bitwise_or.at(words, place(g, U(size)), bits)
    return words.astype("<u8").tobytes()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The upper bits of keys, so sorted keys lie in the order of their buckets; buckets is a power of two above 1."""
    return (keys >> U(65 - buckets.bit_length())).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted keys begin and end."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))


class Filter:
    """Segments of counts, then as many of followers, a power of two of each; a key's upper bits tell its bucket.

    A filter of one bucket's segments has that bucket only.
    """

    def __init__(self, segments: list[bytes], buckets: int):
        self.buckets, self.alone = buckets, len(segments) == 2
        self.size = np.array([len(s) // 8 for s in segments], U)
        self.start = np.concatenate([[U(0)], np.cumsum(self.size)[:-1]]).astype(U)
        self.words = np.frombuffer(b"".join(segments), "<u8")

    def level(self, keys: np.ndarray, most: np.ndarray, known: int = 0) -> np.ndarray:
        """The highest level of each key, at most so high: levels are doubled while they are found, then bisected.

        Which levels are probed doesn't depend on most, but where it is reached, probing ends. known is 0 for counts and 1 for
        followers, which are at least 1.
        """
        low = np.minimum(most, known).astype(np.int64)
        for at in range(0, len(keys), LOOKED_UP):
            self.fill(low[at : at + LOOKED_UP], keys[at : at + LOOKED_UP], most[at : at + LOOKED_UP], known)
        return low

    def fill(self, low: np.ndarray, keys: np.ndarray, most: np.ndarray, known: int) -> None:
        """As level(), of keys that fit in a processor's cache."""
        live = np.flatnonzero(most > known)
        bucket = np.full(len(live), known) if self.alone else bucket_of(keys[live], self.buckets) + known * self.buckets
        key, size, start, most = probed(keys[live], self.buckets, known), self.size[bucket], self.start[bucket], most[live].astype(np.int16)
        a, b = np.full(len(live), known, np.int16), np.full(len(live), len(LEVELS) + 1, np.int16)  # found, and not found
        growing = np.ones(len(live), bool)
        while len(live):
            at = np.where(growing, np.minimum(np.maximum(2 * a, 1), b - 1), (a + b) >> 1)
            g, bits = probes(key, at)
            found = (self.words[(start + place(g, size)).astype(np.int64)] & bits) == bits
            a, b = np.where(found, at, a), np.where(found, b, at)
            growing &= found
            on = (b - a > 1) & (a < most)
            ended = np.flatnonzero(~on)
            low[live[ended]] = np.minimum(a[ended], most[ended])
            on = np.flatnonzero(on)
            live, key, size, start, a, b, most, growing = (x[on] for x in (live, key, size, start, a, b, most, growing))


class Answers:
    """Levels that the segments gave, by sorted key: of words, pairs and followers of words; in the place of a filter."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, levels: list[np.ndarray]):
        self.words, self.pairs, self.levels = words, pairs, levels

    def level(self, keys: np.ndarray, most: np.ndarray, known: int = 0, pairs: bool = False) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, np.int64)
        return np.minimum(self.levels[2 if known else int(pairs)][np.searchsorted(self.pairs if pairs else self.words, keys)], most)


BLOCKS = "bucket int, words binary, pairs binary"
FOUND = "bucket int, words binary, counts binary, bits binary, followers binary"
SEGMENTS = "bucket int, words binary, counts binary, bits binary, follower_bits binary"


def expressions(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts and the keys of the pairs that end in them; ends are words, starts aren't."""
    w = np.flatnonzero(flat != U(START))
    return flat[w], pair_keys(flat[w - 1], flat[w])


def packed(keys: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """For each bucket its sorted keys as differences, which are small, and their counts, less than 2^32 each; None where it has none."""
    apart = np.diff(keys, prepend=U(0))
    full = ends[:-1] < ends[1:]
    apart[ends[:-1][full]] = keys[ends[:-1][full]]
    return [x if ok else None for x, ok in zip(pack_parts(ends, apart, counts.astype("<u4")), full.tolist(), strict=True)]


def unpacked_all(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x, "<u8", "<u4") for x in blobs if x]
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([np.cumsum(d, dtype=U) for d, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)


def count_blocks(buckets: int):
    """Counts what is in about COUNT_TOKENS tokens at a time; a row for each bucket that it touches."""

    def flush(flat: np.ndarray) -> pa.RecordBatch:
        columns, live = [], np.zeros(buckets, bool)
        for keys in expressions(flat):
            keys, counts = run_lengths(keys)
            ends = dealt(keys, buckets)
            live |= np.diff(ends) > 0
            columns.append(packed(keys, counts, ends))
        some = np.flatnonzero(live).tolist()
        arrays = [pa.array(some, pa.int32()), *(pa.array([c[k] for k in some], pa.binary()) for c in columns)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("counts")
        held, size = [], 0
        for batch in slices(batches):
            for flat, _ in tokens_of(lists(batch)["text"]):
                held.append(flat)
                size += len(flat)
                if size >= COUNT_TOKENS:
                    yield flush(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield flush(np.concatenate(held))

    return run


def count_bucket(buckets: int, bits_per_entry: int):
    """Sums a bucket's blocks and makes its segment of the filter; a row more for each bucket of the first words of its pairs."""

    def run(table: pa.Table) -> pa.Table:
        remembered("counts")
        (words, counts), (pairs, times) = (summed(*unpacked_all(table[c].to_pylist())) for c in ("words", "pairs"))
        bits = segment(np.concatenate([words, pairs]), np.concatenate([counts, times]), buckets, 0, bits_per_entry)
        rows = [(table["bucket"][0].as_py(), words.tobytes(), counts.astype("<i8").tobytes(), bits, None)]
        keys, n = run_lengths(contexts_of(pairs))
        rows += [(k, None, None, None, x) for k, x in enumerate(packed(keys, n, dealt(keys, buckets))) if x]
        fields = zip([x.split()[0] for x in FOUND.split(", ")], [pa.int32()] + [pa.binary()] * 4, zip(*rows, strict=True), strict=True)
        return pa.table({name: pa.array(column, kind) for name, kind, column in fields})

    return run


def count_followers(table: pa.Table, buckets: int, bits_per_entry: int) -> pa.Table:
    """A bucket's row with its segment of followers, from the row of count_bucket() and the contexts that came to it."""
    remembered("counts")
    bits = segment(*summed(*unpacked_all(table["followers"].to_pylist())), buckets, 1, bits_per_entry)
    own = [next((x for x in table[c].to_pylist() if x is not None), b"") for c in ("words", "counts", "bits")]
    row = [table["bucket"][0].as_py(), *own[:2], own[2] or bytes(8), bits]
    fields = zip([x.split()[0] for x in SEGMENTS.split(", ")], [pa.int32()] + [pa.binary()] * 4, row, strict=True)
    return pa.table({name: pa.array([x], kind) for name, kind, x in fields})


def unpacked(df: DataFrame, schema: str, **columns: str) -> DataFrame:
    """Rows of numbers from columns of packed 64-bit integers."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(columns[n])[row].as_py(), "<i8")) for n in names], names)

    return df.select(*set(columns.values())).mapInArrow(run, schema)


class Model:
    """What the workers need: the filter, the most frequent words with exact counts, and the numbers of tokens, words and texts.

    A filter that is too large to broadcast is None; its segments are a table by bucket, which stays on the driver.
    """

    def __init__(self, bits: Filter | None, head: np.ndarray, head_counts: np.ndarray, n: int, v: int, texts: int, buckets: int, segments: DataFrame | None):
        self.buckets, self.segments = buckets, segments
        self.bits, self.head, self.head_counts = bits, head, head_counts
        self.n, self.v, self.texts = n, v, texts
        self.z = n + 0.5 * (v + 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"segments": None}


def learn(docs: DataFrame, text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, head: int = HEAD, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[Model, DataFrame]:
    """The model of the texts, and the counts of the words that are not in its head: h long, c long."""
    texts = docs.select(docs[text_col].alias("text"))
    buckets = 1 << (max(16, 4 * texts.rdd.getNumPartitions()) - 1).bit_length()
    blocks = texts.mapInArrow(count_blocks(buckets), BLOCKS)
    counted = blocks.groupBy("bucket").applyInArrow(count_bucket(buckets, bits_per_entry), FOUND).groupBy("bucket")
    found = cut(counted.applyInArrow(lambda t: count_followers(t, buckets, bits_per_entry), SEGMENTS))
    words = unpacked(found, "h long, c long", h="words", c="counts")
    end = F.sum(F.when(F.col("h") == F.lit(END - (1 << 64) if END >> 63 else END), F.col("c"))).alias("end")
    exponent = F.floor(F.log2("c")).cast("int").alias("e")
    histogram = words.groupBy(exponent).agg(F.count("*").alias("v"), F.sum("c").alias("n"), end).collect()
    n, v, ends = (sum(r[x] or 0 for r in histogram) for x in ("n", "v", "end"))
    exponent, taken = 64, 0
    for r in sorted(histogram, key=lambda r: -r["e"]):
        if taken + r["v"] > head:
            break
        exponent, taken = r["e"], taken + r["v"]
    least = 1 << exponent if exponent < 63 else (1 << 62)
    if taken == v:
        least = 0
    most = words.where(F.col("c") >= least).toArrow()
    h, c = most["h"].to_numpy().view(np.uint64), most["c"].to_numpy()
    order = np.argsort(h)
    segments, bits = found.select("bucket", "bits", "follower_bits"), None
    if (segments.agg(F.sum(F.length("bits") + F.length("follower_bits"))).first()[0] or 0) <= max_filter_bytes:
        own = [bytes(8)] * (2 * buckets)
        for r in segments.toLocalIterator():
            own[r["bucket"]], own[buckets + r["bucket"]] = bytes(r["bits"]), bytes(r["follower_bits"])
        bits = Filter(own, buckets)
    return Model(bits, h[order], c[order], n, v, ends, buckets, segments), words.where(F.col("c") < least)


class Scorer:
    """A model with its frequent words in a hash table; one for each worker and model."""

    def __init__(self, model: Model):
        self.model = model
        slots = 1 << max(4, (2 * len(model.head)).bit_length())
        self.mask = U(slots - 1)
        self.slot = np.full(slots, -1, np.int64)
        #: Levels of the words of the head, by probes when they are first met.
        self.levels = np.full(len(model.head), -1, np.int64)
        left = np.arange(len(model.head))
        at = mixed(model.head) & self.mask
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several that meet in a slot, one stays
            missed = self.slot[at] != left
            left, at = left[missed], (at[missed] + U(1)) & self.mask

    def in_head(self, h: np.ndarray) -> np.ndarray:
        """The places of words in the head, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.model.head):
            return out
        left, at = np.arange(len(h)), mixed(h) & self.mask
        while len(left):
            found = self.slot[at]
            hit = (found >= 0) & (self.model.head[found] == h[left])
            out[left[hit]] = found[hit]
            on = (found >= 0) & ~hit
            left, at = left[on], (at[on] + U(1)) & self.mask
        return out

    def word_levels(self, h: np.ndarray, head: np.ndarray, bits: Filter | Answers) -> np.ndarray:
        """Levels of words by probes; those of the head are probed once."""
        every = len(LEVELS)
        if isinstance(bits, Answers):
            return bits.level(h, np.full(len(h), every))
        out = np.empty(len(h), np.int64)
        inside = head >= 0
        new = run_lengths(head[inside][self.levels[head[inside]] < 0])[0]
        self.levels[new] = bits.level(self.model.head[new], np.full(len(new), every))
        out[inside] = self.levels[head[inside]]
        out[~inside] = bits.level(h[~inside], np.full(int((~inside).sum()), every))
        return out

    def probabilities(self, flat: np.ndarray, begin: np.ndarray, bits: Answers | None = None) -> tuple[np.ndarray, ...]:
        """The places of words and ENDs; the model's probability of each, its exact count or -1, and whether it is new.

        Texts are given as START, words and END one after another; begin has the places of START.
        """
        m = self.model
        bits = bits or m.bits
        is_start = np.zeros(len(flat), bool)
        is_start[begin] = True
        w = np.flatnonzero(~is_start)
        head = self.in_head(flat[w])
        own = self.word_levels(flat[w], head, bits)
        low, up = np.concatenate([[0], LEVELS]), np.concatenate([[0], LEVELS[1:] - 1, LEVELS[-1:] * 2])
        p = (low[own] + 0.5) / m.z

        # the words before; starts of texts are counted exactly
        first = is_start[w - 1]
        level = np.empty(len(w), np.int64)
        level[~first] = own[np.flatnonzero(~first) - 1]
        level[first] = np.searchsorted(LEVELS, m.texts, "right")
        live = np.flatnonzero(level > 0)
        v, level = flat[w[live] - 1], level[live]
        pairs, most = pair_keys(v, flat[w[live]]), np.minimum(level, own[live])
        both = low[bits.level(pairs, most, pairs=True) if isinstance(bits, Answers) else bits.level(pairs, most)]
        kinds = low[np.maximum(bits.level(v, level, 1), 1)]
        p[live] = (np.maximum(both - DISCOUNT, 0) + DISCOUNT * kinds * p[live]) / np.where(first[live], m.texts, up[level])
        return w, p, np.where(head >= 0, m.head_counts[head] if len(m.head) else -1, -1), own == 0

    def batch(self, keys: list, ids: list, flat: np.ndarray, begin: np.ndarray, bits: Answers | None = None) -> pa.RecordBatch:
        """Scores texts as in probabilities()."""
        w, p, count, new = self.probabilities(flat, begin, bits)
        first = begin - np.arange(len(begin))  # where texts begin without their STARTs
        own = (count >= 0) | new  # the filter has no false negatives
        base = np.where(own, np.log10((np.maximum(count, 0) + 0.5) / self.model.z), 0.0)
        n = np.diff(np.append(begin, len(flat))) - 1
        row, other = np.repeat(np.arange(len(n)), n), np.flatnonzero(~own)
        tail, times = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        if len(other):
            tail, times = np.unique(np.stack([row[other], flat[w[other]].view(np.int64)]), axis=1, return_counts=True)
        ends = np.searchsorted(tail[0], np.arange(len(n) + 1)).astype(np.int32)
        return pa.RecordBatch.from_pydict({
            "key": pa.array(keys, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "n_tokens": n.astype(np.int64),
            "known": np.add.reduceat((own & ~new).astype(np.int64), first), "base": np.add.reduceat(base, first),
            "score": np.add.reduceat(np.log10(p), first),
            "h": pa.ListArray.from_arrays(pa.array(ends), pa.array(tail[1])),
            "n": pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
        })


ROWS = "key long, doc_id long, n_tokens long, known long, base double, score double, h array<long>, n array<long>"


TEXTS = "chunk long, tokens binary, words binary, begin binary, keys array<long>, ids array<long>"
ASKED = "chunk long, bucket int, words binary, pairs binary"
TOLD = "chunk long, bucket int, levels binary, sizes array<long>"


def chunks(tokens: int):
    """A row for the texts of about so many tokens: which of its words each token is."""

    def chunk(keys: list, ids: list, flats: list[np.ndarray], begins: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(flats)
        starts = np.cumsum([0, *map(len, flats)])[:-1]
        begin = np.concatenate([b + s for b, s in zip(begins, starts, strict=True)])
        words = run_lengths(flat)[0]
        row = keys[0], pack(np.searchsorted(words, flat).astype("<u4")), pack(np.diff(words, prepend=U(0))), pack(begin.astype("<u4")), keys, ids
        kinds = pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in TEXTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("questions")
        held: tuple[list, list, list, list] = [], [], [], []
        size = 0
        for batch in slices(batches):
            columns, at = lists(batch), 0
            for flat, begin in tokens_of(columns["text"]):
                some = slice(at, at + len(begin))
                at += len(begin)
                held[0].extend(columns["key"][some])
                held[1].extend(columns["id"][some])
                held[2].append(flat)
                held[3].append(begin)
                size += len(flat)
                if size >= tokens:
                    yield chunk(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield chunk(*held)

    return run


def unchunked(tokens: bytes, words: bytes, begin: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Texts as START, words and END one after another, and the places of START."""
    return np.cumsum(unpack(words, "<u8")[0], dtype=U)[unpack(tokens, "<u4")[0]], unpack(begin, "<u4")[0].astype(np.int64)


def questions(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that some texts need, starts too, and the pairs; each once, in order."""
    return run_lengths(flat)[0], run_lengths(expressions(flat)[1])[0]


def ask(buckets: int):
    """A row for each bucket that a chunk's words and pairs lie in, with what the filter knows them by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("questions")
        for batch in batches:
            for chunk, *texts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tokens", "words", "begin")), strict=True):
                asked = []
                for keys in questions(unchunked(*texts)[0]):
                    asked.append(packed(probed(keys, buckets, 0), np.zeros(len(keys), np.int64), dealt(keys, buckets)))
                live = [b for b in range(buckets) if asked[0][b] or asked[1][b]]
                columns = [pa.array([chunk] * len(live), pa.int64()), pa.array(live, pa.int32())]
                columns += [pa.array([x[b] for b in live], pa.binary()) for x in asked]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ASKED.split(", ")])

    return run


def answer(asked: pa.Table, bits: pa.Table, buckets: int) -> pa.Table:
    """The levels that a bucket's segments have for the words and pairs that it is asked, and for the followers of the words."""
    remembered("answers")
    table = Filter([bits["bits"][0].as_py(), bits["follower_bits"][0].as_py()] if bits.num_rows else [bytes(8)] * 2, buckets)
    levels, sizes, most = [], [], len(LEVELS)
    for blobs in zip(asked["words"].to_pylist(), asked["pairs"].to_pylist(), strict=True):
        words, pairs = (unpacked_all([x])[0] for x in blobs)
        found = [table.level(x, np.full(len(x), most), known) for x, known in ((words, 0), (pairs, 0), (words, 1))]
        levels.append(pack(np.concatenate(found).astype("<u2")))
        sizes.append([len(words), len(pairs)])
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "levels": pa.array(levels, pa.binary()), "sizes": pa.array(sizes, pa.list_(pa.int64()))})


def score_told(scorer: Scorer, texts: pa.Table, told: pa.Table, tokens: int) -> pa.Table:
    """Scores the texts of a chunk by the levels that came back, about so many tokens at a time."""
    row = texts.to_pylist()[0]
    flat, begin = unchunked(row["tokens"], row["words"], row["begin"])
    levels: list[list[np.ndarray]] = [[], [], []]
    for r in sorted(told.select(["bucket", "levels", "sizes"]).to_pylist(), key=lambda r: r["bucket"]):
        found, (words, pairs) = unpack(r["levels"], "<u2")[0].astype(np.int64), r["sizes"]
        for k, x in enumerate(np.split(found, [words, words + pairs])):
            levels[k].append(x)
    bits, out = Answers(*questions(flat), [np.concatenate(x) for x in levels]), []
    first = np.flatnonzero(np.diff(begin // tokens, prepend=-1))
    for a, b in zip(first, [*first[1:], len(begin)], strict=True):
        end = begin[b] if b < len(begin) else len(flat)
        out.append(scorer.batch(row["keys"][a:b], row["ids"][a:b], flat[begin[a] : end], begin[a:b] - begin[a], bits))
    return pa.Table.from_batches(out)


def score(docs: DataFrame, model: Model, tail: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = f"scorer {uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("key"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = remembered(name, lambda: Scorer(shared.value))
        for batch in slices(batches):
            columns, at = lists(batch), 0
            for flat, begin in tokens_of(columns["text"]):
                some = slice(at, at + len(begin))
                yield scorer.batch(columns["key"][some], columns["id"][some], flat, begin)
                at += len(begin)

    tokens, buckets = COUNT_TOKENS, model.buckets

    def run_told(texts: pa.Table, told: pa.Table) -> pa.Table:
        return score_told(remembered(name, lambda: Scorer(shared.value)), texts, told, max(1, tokens // 16))

    if model.bits is None:
        texts = cut(rows.mapInArrow(chunks(tokens), TEXTS))
        asked = texts.select("chunk", "tokens", "words", "begin").mapInArrow(ask(buckets), ASKED).groupBy("bucket")
        told = cut(asked.cogroup(model.segments.groupBy("bucket")).applyInArrow(lambda a, b: answer(a, b, buckets), TOLD))
        scored = cut(texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run_told, ROWS))
    else:
        scored = cut(rows.mapInArrow(run, ROWS))
    far = scored.select("key", F.explode(F.arrays_zip("h", "n")).alias("t")).select("key", "t.h", "t.n")
    c = F.coalesce("c", F.lit(0))
    far = far.join(tail, "h", "left").groupBy("key").agg(
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(model.z))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("also"),
    )
    return scored.drop("h", "n").join(far, "key", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
