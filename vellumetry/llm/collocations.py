"""Phrase collocations: phrases counted in HAT-tries, scored by their weakest cut.

A task numbers the words it meets and counts phrases in a shallow trie over those numbers, whose leaves are hash
containers: the rest of a phrase, packed, with its count.  A container that grows past BURST becomes a node with a container
for each next word.  When the trie holds MOST_HELD phrases, its largest subtrees leave whole, as sorted runs, until half is
left.  A run leaves as one row for each partition of prefixes (a hash of up to three first words), and partitions are merged.

Three passes, as no phrase is more frequent than its parts: words; pairs of words that are frequent by themselves; phrases
of three words and more of which all pairs are frequent.  What is frequent goes to the tasks as a filter of
MOST_BITS bits at most (2 MB for each 2^24), that may take rare words or pairs for frequent ones and never the reverse: it
saves work, and the exact bound is put to the merged counts.

Defined cases: null text has no words; null lang is "und"; repeated rows count again; equal scores and counts are ordered by
the phrase's bytes; of equally weak cuts the first counts; an empty table gives an empty table; other columns aren't
read.  Arithmetic is in decimals of 38 digits: 1000 * a * n may have so many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.llm.common import dropped, small_batches, written

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Phrases of a container before it bursts and of a trie before subtrees leave it; words that a task numbers before it begins
#: anew, and counts at once; bytes of a text that are split at once; bits of a filter a member, at most, and its probes;
#: partitions of prefixes, four times Spark's for shuffles at least.
BURST, MOST_HELD, MOST_WORDS, AT_ONCE, WINDOW, BITS_EACH, MOST_BITS, PROBES, PARTS = 4096, 1_000_000, 500_000, 1_500_000, 1 << 20, 16, 1 << 27, 4, 1024
#: Ends of pieces, and white space inside them; upper case becomes lower case.  0xFF never occurs in UTF-8.
END = 0xFF
TABLE = bytes(END if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with b"\\xff" where a piece ends, a window at a time."""
    raw = text.translate(TABLE)
    a = 0
    while a < len(raw):
        b = a + WINDOW
        if b < len(raw):
            cut = max(raw.rfind(b" ", a, b), raw.rfind(b"\xff", a, b))
            if cut < a:  # a word longer than the window stays whole
                ends = [x for x in (raw.find(b" ", b), raw.find(b"\xff", b)) if x >= 0]
                cut = min(ends, default=len(raw) - 1)
            b = cut + 1
        # of what bytes.split takes for space, only the space is left
        yield raw[a:b].replace(b"\xff", b" \xff ").split()
        a = b


def digest(seed: int, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=seed)


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * M1
    return h ^ h >> np.uint64(29)


def pair_digests(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a) * M2 + mixed(b ^ M2)


def slots(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES places in a filter of `bits` bits, a power of two, for each digest."""
    h, step = mixed(h), mixed(h ^ M1) | np.uint64(1)
    for k in range(PROBES):
        yield h + np.uint64(k) * step & np.uint64(bits - 1)


class Filter:
    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    def has(self, h: np.ndarray) -> np.ndarray:
        held = np.arange(len(h))
        for k in range(PROBES):  # most are ruled out by the first
            *_, at = (x for _, x in zip(range(k + 1), slots(h[held], self.bits), strict=False))
            held = held[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        out = np.zeros(len(h), bool)
        out[held] = True
        return out


def filter_of(frequent: DataFrame) -> Filter:
    """A filter of phrases (lang, phrase) of one or two words.  Its bits are put together by Spark; MOST_BITS at most come
    to the driver and go to the tasks."""
    bits = max(64, min(MOST_BITS, 1 << (BITS_EACH * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [p.encode().split(b" ") for p in b.column("phrase").to_pylist()]
            seeds = map(seed_of, b.column("lang").to_pylist())
            each = [[digest(seed, w) for w in ws] for seed, ws in zip(seeds, words, strict=True)]
            h = [np.array([e[k] for e in each], np.uint64) for k in range(len(each[0]) if each else 1)]
            at = np.unique(np.concatenate(list(slots(h[0] if len(h) == 1 else pair_digests(*h), bits))))
            group, begin = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(value.view(np.int64))], names=["at", "value"])

    words = np.zeros(bits // 64, np.uint64)
    found = frequent.select("lang", "phrase").mapInArrow(run, "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value")).toArrow()
    words[found["at"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return Filter(words)


class Numbers(dict):
    """A task's numbers of one language's words, from 0 on; -1 for the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({bytes([END]): -1})
        self.seed, self.words, self.digests, self.kept = seed_of(lang), [], [], np.empty(0, bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def figures(self, kept: Filter | None) -> tuple[np.ndarray, np.ndarray]:
        """The digests of all words so far, and which of them the filter has."""
        new = np.fromiter((digest(self.seed, w) for w in self.words[len(self.kept) :]), np.uint64)
        if len(new):
            self.digests = np.concatenate([np.array(self.digests, np.uint64), new])
            self.kept = np.concatenate([self.kept, kept.has(new) if kept else np.ones(len(new), bool)])
        return self.digests, self.kept


class Trie:
    """Counts of phrases, tuples of numbers: the first number leads to a container or a node, the rest is packed, four bytes a
    number.  A container is a dict from packed rests to counts; a node is a list of one dict from numbers to either."""

    def __init__(self):
        self.top: dict[int, dict | list] = {}
        self.sizes: dict[int, int] = {}
        self.held = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """rows: different phrases of one length, two words or more, sorted."""
        rests = np.ascontiguousarray(rows[:, 1:].astype(">i4")).view(f"V{4 * (rows.shape[1] - 1)}")[:, 0].tolist()
        counts = counts.tolist()
        begins = np.flatnonzero(np.diff(rows[:, 0], prepend=-1)).tolist()
        for first, a, b in zip(rows[begins, 0].tolist(), begins, [*begins[1:], len(rests)], strict=True):
            place = self.top.get(first)
            if place is None:
                place = self.top[first] = {}
                self.sizes[first] = 0
            if type(place) is list:
                new = sum(self._put(place, rest, n) for rest, n in zip(rests[a:b], counts[a:b], strict=True))
            else:
                before = len(place)
                for rest, n in zip(rests[a:b], counts[a:b], strict=True):
                    place[rest] = place.get(rest, 0) + n
                new = len(place) - before
                if len(place) > BURST and len(rest) > 4:
                    self.top[first] = self._burst(place)
            self.sizes[first] += new
            self.held += new

    def _put(self, node: list, rest: bytes, n: int) -> int:
        """1 if the phrase is new."""
        while True:
            key = int.from_bytes(rest[:4], "big") if rest else -1
            rest, holder = rest[4:], node[0]
            node = holder.get(key)
            if type(node) is not list:
                break
        if node is None:
            node = holder[key] = {}
        before = len(node)
        node[rest] = node.get(rest, 0) + n
        if len(node) > BURST and len(rest) > 4:
            holder[key] = self._burst(node)
        return len(node) - before

    @staticmethod
    def _burst(container: dict[bytes, int]) -> list:
        node: dict[int, dict] = {}
        for rest, n in container.items():
            node.setdefault(int.from_bytes(rest[:4], "big") if rest else -1, {})[rest[4:]] = n
        return [node]

    def taken(self, most: int) -> Iterator[list[tuple[bytes, int]]]:
        """The largest subtrees, each as a sorted run (packed phrase, count), until at most `most` phrases are left."""

        def walk(place: dict | list, before: bytes) -> Iterator[tuple[bytes, int]]:
            if type(place) is list:
                for key in sorted(place[0]):
                    yield from walk(place[0][key], before + (key.to_bytes(4, "big") if key >= 0 else b""))
            else:
                for rest in sorted(place):
                    yield before + rest, place[rest]

        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.held <= most:
                return
            self.held -= self.sizes.pop(first)
            yield list(walk(self.top.pop(first), first.to_bytes(4, "big")))


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of equally long columns of numbers, sorted, and how often each occurs."""
    key = columns[0]
    for c in columns[1:]:
        _, first, key, counts = np.unique(key << 32 | c, return_index=True, return_inverse=True, return_counts=True)
    return np.stack([c[first] for c in columns], 1), counts


def packed(lang: str, words: np.ndarray, digests: np.ndarray, phrases: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Phrases (rows of numbers) of one length as a row for each partition of prefixes: joined by line ends, and their counts."""
    h = digests[phrases[:, 0]]
    for k in range(1, min(3, phrases.shape[1])):
        h = pair_digests(h, digests[phrases[:, k]])
    part = (mixed(h) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    phrases, part, counts = phrases[order], part[order], counts[order]
    text = words[phrases[:, 0]]
    for k in range(1, phrases.shape[1]):
        text = text + b" " + words[phrases[:, k]]
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*begins[1:].tolist(), len(part)]
    text = text.tolist()
    blocks = pa.array([b"\n".join(text[a:b]) for a, b in zip(begins.tolist(), ends, strict=True)], pa.string())
    held = pa.ListArray.from_arrays(pa.array([*begins.tolist(), len(part)], pa.int32()), pa.array(counts, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks), pa.string()), pa.array(part[begins]), blocks, held], names=["lang", "part", "block", "counts"])


RUNS = "lang string, part int, block string, counts array<bigint>"


def counter(kept: Filter | None, pairs: Filter | None, lengths: range, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of phrases of these lengths, as RUNS: of words that `kept` has, and of pairs that `pairs` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[Numbers, Trie]] = {}
        texts: dict[str, list[np.ndarray]] = {}
        single: dict[str, np.ndarray] = {}

        def leaving(lang: str, most: int) -> Iterator[pa.RecordBatch]:
            numbers, trie = state[lang]
            digests, _ = numbers.figures(kept)
            words = np.array([*numbers.words, None], object)[:-1]
            if lang in single:
                at = np.flatnonzero(single[lang])
                if len(at):
                    yield packed(lang, words, digests, at[:, None], single.pop(lang)[at], parts)
                return
            run: list[tuple[bytes, int]] = []

            def out() -> Iterator[pa.RecordBatch]:
                size = np.array([len(p) for p, _ in run])
                counts = np.array([n for _, n in run], np.int64)
                for k in np.unique(size).tolist():
                    at = np.flatnonzero(size == k)
                    ids = np.frombuffer(b"".join([run[i][0] for i in at.tolist()]), ">i4").reshape(-1, k // 4).astype(np.int64)
                    yield packed(lang, words, digests, ids, counts[at], parts)
                run.clear()

            for subtree in trie.taken(most):
                run += subtree
                if len(run) > 300_000:
                    yield from out()
            if run:
                yield from out()

        def count(lang: str, ids: np.ndarray) -> None:
            numbers, trie = state[lang]
            if lengths.start == 1:
                n = np.bincount(ids[ids >= 0], minlength=len(numbers.words))
                if lang in single:
                    n[: len(single[lang])] += single[lang]
                single[lang] = n
                return
            h, frequent = numbers.figures(kept)
            good = np.append(frequent, False)[ids]  # -1 is the last
            good = good[:-1] & good[1:]
            if pairs is not None and good.any():
                at = np.flatnonzero(good)
                good[at] = pairs.has(pair_digests(h[ids[at]], h[ids[at + 1]]))
            first_pairs = good
            for k in range(2, lengths.stop):
                if k > 2:
                    good = good[:-1] & first_pairs[k - 2 :]
                at = np.flatnonzero(good)
                if k >= lengths.start and len(at):
                    trie.add(*distinct_rows([ids[at + i] for i in range(k)]))

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, some in texts.items():
                count(lang, np.concatenate(some))
                if state[lang][1].held > MOST_HELD:
                    yield from leaving(lang, MOST_HELD // 2)
            texts.clear()
            if sum(len(numbers) for numbers, _ in state.values()) > MOST_WORDS:
                for lang in list(state):
                    yield from leaving(lang, 0)
                    del state[lang]

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if lang not in state:
                    state[lang] = Numbers(lang), Trie()
                numbers, held = state[lang][0], texts.setdefault(lang, [])
                for some in tokens(text.as_py()):
                    if len(some) > 1:
                        held.append(np.array(itemgetter(*some)(numbers), np.int64))
                    elif some:
                        held.append(np.array([numbers[some[0]]]))
                    size += len(some)
                held.append(np.array([-1]))
                if size > AT_ONCE:
                    yield from counted()
                    size = 0
        yield from counted()
        for lang in list(state):
            yield from leaving(lang, 0)

    return run


def merged(runs: DataFrame) -> DataFrame:
    """Runs dealt by the partition of prefixes and merged there: lang, phrase, n."""
    dealt = runs.repartition("lang", "part")
    each = dealt.select("lang", "part", F.inline(F.arrays_zip(F.split("block", "\n").alias("phrase"), F.col("counts").alias("n"))))
    return each.groupBy("lang", "part", "phrase").agg(F.sum("n").alias("n")).drop("part")


def phrase_counts(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases of up to `longest` words that occur `least` times or more in a language, and
    (lang, n), the number of all its words."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    parts = max(PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def counts(lengths: range, *filters) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, pairs = (f.value if f else None for f in (*filters, None, None)[:2])
            yield from counter(kept, pairs, lengths, parts)(batches)

        return merged(docs.mapInArrow(run, RUNS))

    words = written(counts(range(1, 2)), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = [written(words.where(F.col("n") >= least), "phrases")]
    dropped(words)
    shared = [spark.sparkContext.broadcast(filter_of(found[0]))]
    for lengths in (range(2, min(3, longest + 1)), range(3, longest + 1)):
        if len(lengths):
            found.append(written(counts(lengths, *shared).where(F.col("n") >= least), "phrases"))
            if lengths.start == 2:
                shared.append(spark.sparkContext.broadcast(filter_of(found[1])))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = written(every.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), F.col("n").alias("f")), "frequent")
    dropped(*found)
    return every, totals


def scored(frequent: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one with `share` percent of their
    occurrences, or more, holds."""
    phrases = frequent.where("k >= 2")
    # a longer phrase that holds this one and has the share is reached by steps of one word, each of which has it
    word = F.split("phrase", " ")
    inner = phrases.where("k >= 3").select("lang", F.explode(F.array(F.array_join(F.slice(word, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("k") - 1), " "))).alias("phrase"), "f")
    top = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(top, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * f")

    cut = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(word, F.lit(1), i), " ").alias("head"), F.array_join(F.slice(word, i + 1, F.col("k") - i), " ").alias("tail")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (big("a") * big("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), big("l") * big("r"))
    weakest = F.min(F.struct(score.alias("score"), "i", "l", "r")).alias("w")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), weakest).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(documents: DataFrame, first: int = FIRST, least: int = LEAST, share: int = 100, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` best of each language."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored(*phrase_counts(documents, least, longest), share).withColumn("rank", place).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
