"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes picks cut points from the content alone, so an insertion moves no cut
further than its neighbourhood: a position is a cut if its hash has SHIFT zero top bits and no other such position
lies within the SHORTEST bytes before it.  Longer stretches are cut at the least hash of each next LONGEST bytes, so that
text of low variety falls into step as well.

A passage is a stretch of LEAST_WORDS words that a document of smaller id has as well, with the same characters from its
first word to its last; a span is a union of passages that overlap.  Chunks are deduplicated by digest: those of two
documents or more mark where passages can lie, with BEFORE and AFTER bytes around them, as far as cuts may differ at a
passage's ends.  Of these stretches alone every passage is digested (96 bits), from each word on, so that one document holds
the whole of it, and meets the smallest document that has it.  No text is sent to another document's.

Whole copies are told by their digest first: all but the smallest id of a text are one span, and only that one is cut.  The
chunks' digests go to the tasks as a filter of MOST_BITS bits at most, which may take a chunk for shared and never the
reverse.  Per digest only the smallest and the largest doc_id are kept, by partial aggregation; passages then join them, in a
join that adaptive execution can split where a passage is in very many documents.

Defined cases: null text, or null doc_id, has no passages; repeats inside one document are left alone; the document of
the smallest id keeps a passage; rows that repeat a doc_id are one document, of their greatest text, and without_spans cuts
that text alone; an empty table gives no spans; extra columns are not read, and without_spans carries them, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import dropped, few, fresh, map_columns, small_batches, written

SHIFT, SHORTEST, LONGEST, LEAST_WORDS, SEED, BEFORE, AFTER = 4, 12, 64, 51, 7, 128, 64
#: Bits of the filter of shared chunks, each and at most, and its probes.
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 27, 3
#: Of the polynomial that digests stretches, modulo 2^64 (odd, with its inverse), and of the second one.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The ends of the chunks of some bytes, the last one included."""
    n = len(data)
    h = gear[data]
    for k in (1, 2, 4, 8):  # hash of 2k bytes from two of k: h[i] = sum of gear[data[i - j]] << j
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k) if n > k else 0
        h = longer
    at = np.flatnonzero(h >> np.uint32(32 - SHIFT) == 0) + 1
    at = at[np.diff(at, prepend=-SHORTEST) >= SHORTEST]
    at = np.concatenate([at[at < n], [n]])
    gaps = np.diff(at, prepend=0)
    more = []
    for k in np.flatnonzero(gaps > LONGEST).tolist():
        b = int(at[k])
        a = b - int(gaps[k])
        while b - a > LONGEST:
            window = h[a + SHORTEST - 1 : a + LONGEST]
            a += LONGEST - int(window[::-1].argmin())  # the last position of the least hash
            more.append(a)
    if more:
        at = np.sort(np.concatenate([at, more]))
    return at


def chunked(raw: bytes, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and digests of the chunks of some bytes."""
    ends = cuts(np.frombuffer(raw, np.uint8), gear)
    digest, begins = xxhash.xxh3_64_intdigest, [0, *ends[:-1].tolist()]
    return ends, np.fromiter((digest(raw[a:b]) for a, b in zip(begins, ends.tolist(), strict=True)), np.uint64, len(ends))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, doc_id: each document's different chunks."""
    gear = gear_table()
    for batch in batches:
        size, out, ids = 0, [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if raw := text.as_py():
                out.append(np.unique(chunked(raw, gear)[1]).view(np.int64))
                ids.append(np.full(len(out[-1]), doc, np.int64))
                size += len(out[-1])
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids))], names=["digest", "doc_id"])
                size, out, ids = 0, [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids))], names=["digest", "doc_id"])


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES places in a filter of `bits` bits, a power of two."""
    for k in range(PROBES):
        yield (h * np.uint64(BASE) >> np.uint64(17 * k)) + h & np.uint64(bits - 1)


def filter_of(shared: DataFrame) -> np.ndarray:
    """A filter of digests as 64-bit words, put together by Spark; MOST_BITS bits at most come to the driver."""
    bits = max(64, min(MOST_BITS, 1 << (BITS_EACH * shared.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate([*_places(b.column(0).to_numpy().view(np.uint64), bits)]))
            group, begin = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(value.view(np.int64))], names=["at", "value"])

    words = np.zeros(bits // 64, np.uint64)
    found = shared.select("digest").mapInArrow(run, "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value")).toArrow()
    words[found["at"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return words


def held(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _places(h, 64 * len(words)):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the one after its last."""
    gap = np.concatenate([[True], SPACE[data], [True]])
    edge = np.diff(gap.astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def stretches(raw: bytes, shared: np.ndarray, gear: np.ndarray, least_words: int) -> list[tuple[int, int, bytes]]:
    """(first word, first character, bytes) of where passages can lie: whole words in and around shared chunks, `least_words` at least."""
    ends, digests = chunked(raw, gear)
    found = held(digests, shared)
    if not found.any():
        return []
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    a = np.maximum(0, np.concatenate([[0], ends])[first] - BEFORE)
    b = np.minimum(len(raw), ends[last] + AFTER)
    # those that touch are one
    new = np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]])
    a, b = a[new], np.maximum.reduceat(b, np.flatnonzero(new))
    begins, stops = word_bounds(data)
    i, j = np.searchsorted(begins, a), np.searchsorted(stops, b, "right")
    long = j - i >= least_words
    if not long.any():
        return []
    chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return [(x, int(chars[begins[x]]), raw[begins[x] : stops[y - 1]]) for x, y in zip(i[long].tolist(), j[long].tolist(), strict=True)]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse's, modulo 2^64, for k below n."""

    def one(b: int) -> np.ndarray:
        factors = np.full(n, b, np.uint64)
        factors[:1] = 1
        return np.multiply.accumulate(factors)

    return one(base), one(pow(base, -1, 1 << 64))


def passages(raw: bytes, least_words: int) -> tuple[np.ndarray, ...]:
    """digest, check, start, end (characters): each run of least_words words."""
    data = np.frombuffer(raw, np.uint8)
    begins, stops = word_bounds(data)
    a, b = begins[: len(begins) - least_words + 1], stops[least_words - 1 :]
    out = []
    for base in (BASE, OTHER_BASE):
        up, down = _powers(base, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        h = (sums[b] - sums[a]) * down[a] if len(a) else np.empty(0, np.uint64)
        h = (h ^ h >> np.uint64(32)) * np.uint64(OTHER_BASE)
        out.append(h ^ h >> np.uint64(29))
    chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), chars[a], chars[b]


PASSAGES = "digest long, more int, doc_id long, word long, span_start long, span_end long"


def _passages(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PASSAGES.split(", ")]
        for batch in batches:
            out, size = [], 0

            def whole(out: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

            for doc, word, char, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "word", "start", "raw")), strict=True):
                digest, more, a, b = passages(raw, least_words)
                n = len(digest)
                out.append((digest, more, np.full(n, doc, np.int64), word + np.arange(n), char + a, char + b))
                size += n
                if size > 200_000:
                    yield whole(out)
                    out, size = [], 0
            if out:
                yield whole(out)

    return run


def _united(least_words: int):
    """Spans from passages that come by document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # doc, key, start, end, first word, last word, owners
        names = [x.split()[0] for x in SPANS.split(", ")]

        def row(s: list) -> tuple:
            best = min(s[6].items(), key=lambda x: (-x[1], x[0]))
            return s[0], s[2], s[3], s[5] - s[4] + 1, best[0], s[1]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            out = []
            for doc, key, word, a, b, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is not None and open_[0] == doc and a < open_[3]:
                    open_[3], open_[5] = max(open_[3], b), max(open_[5], word + least_words - 1)
                    open_[6][owner] += 1
                else:
                    if open_ is not None:
                        out.append(row(open_))
                    open_ = [doc, key, a, b, word, word + least_words - 1, Counter([owner])]
            if out:
                yield batch_of(out)
        if open_ is not None:
            yield batch_of([row(open_)])

    return run


SPANS = "doc_id long, span_start long, span_end long, n_words long, source_doc_id long, text_key long"


def one_text(documents: DataFrame) -> DataFrame:
    """doc_id, text, text_key: the greatest text of each doc_id.  Texts are shuffled for ids that repeat only."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    several = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    if not several.isEmpty():
        one = docs.join(few(several), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        docs = docs.join(few(several), "doc_id", "left_anti").unionByName(one)
    return docs.withColumn("text_key", F.xxhash64("text"))


def repeated_spans(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, span_start, span_end (characters), n_words, source_doc_id, text_key: passages that documents of smaller id have.
    The source is the document that most passages of the span have as their smallest, of several the smallest; of a whole copy
    it is the smallest copy."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = one_text(documents)
    keyed = docs.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("other_key"))
    first = keyed.groupBy("text_key", "other_key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    first = written(first, "first-copies")  # as below, for a text that very many documents have
    copies = written(keyed.join(first, ["text_key", "other_key"]).where("doc_id > source").select("doc_id", "source"), "copies")

    def whole(rows):
        for (text,) in rows:
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            begins, stops = word_bounds(data)
            n = len(begins)
            yield (n, len(raw[: begins[0]].decode()), len(raw[: stops[-1]].decode())) if n else (0, 0, 0)

    equal = map_columns(docs.join(few(copies), "doc_id"), ["text"], ["doc_id", "source", "text_key"], lambda: whole, "n_words long, span_start long, span_end long")
    equal = equal.where(F.col("n_words") >= least_words).select("doc_id", "span_start", "span_end", "n_words", F.col("source").alias("source_doc_id"), "text_key")

    apart = docs.join(few(copies.select("doc_id")), "doc_id", "left_anti")
    chunks = apart.select("doc_id", "text").mapInArrow(_chunks, "digest long, doc_id long")
    shared = chunks.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("digest")
    shared = written(shared, "shared-chunks")
    words = spark.sparkContext.broadcast(filter_of(shared))
    dropped(shared)

    def find():
        gear = gear_table()
        return lambda rows: (([{"word": w, "start": c, "raw": r} for w, c, r in stretches(t.encode(), words.value, gear, least_words)],) for (t,) in rows)

    some = map_columns(apart, ["text"], ["doc_id", "text_key"], find, "found array<struct<word:bigint,start:bigint,raw:binary>>")
    some = written(some.select("doc_id", "text_key", F.inline("found")), "stretches")
    every = some.select("doc_id", "word", "start", "raw").mapInArrow(_passages(least_words), PASSAGES)
    owners = every.groupBy("digest", "more").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owners = written(owners, "passage-owners")  # a join of two plain tables is one that adaptive execution can split
    met = every.join(owners, ["digest", "more"]).where("doc_id > owner").select("doc_id", F.lit(0).cast("long").alias("key"), "word", "span_start", "span_end", "owner")
    spans = met.repartition("doc_id").sortWithinPartitions("doc_id", "word").mapInArrow(_united(least_words), SPANS).drop("text_key")
    keys = some.select("doc_id", "text_key").distinct()
    return spans.join(keys, "doc_id").select(*equal.columns).unionByName(equal)


def without_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents with the spans cut out of text.  Documents without spans keep their text as it is."""
    gone, key, doc = (fresh(documents.columns, c) for c in ("gone_spans", "gone_key", "gone_doc"))
    by_doc = spans.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias(gone))
    joined = documents.join(by_doc, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")

    def cut(text: str | None, gone: list | None) -> str | None:
        if text is None or not gone:
            return text
        out, at = [], 0
        for s in gone:
            out.append(text[at : s["span_start"]])
            at = s["span_end"]
        return "".join([*out, text[at:]])

    names = documents.columns
    kept = map_columns(joined, ["text", gone], [c for c in names if c != "text"], lambda: lambda rows: ((cut(t, g),) for t, g in rows), "text string")
    return kept.select(*names)
