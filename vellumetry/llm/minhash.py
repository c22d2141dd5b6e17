"""Near-duplicate documents by MinHash: universal hash minima, banding, signature verification, exact confirmation.

A document's set is its distinct five-word shingles.  Documents with equal sets form a class; one member stands for
it, so a group of exact copies costs one signature however large it is.  BANDS bands of ROWS minima propose pairs
(a pair at 0.75 is missed with probability (1 - 0.75^4)^32, below 6e-6), pairs whose signatures agree too little go, and
the rest are confirmed on the full sets.  Components come from alternating large-star and small-star.

Pairs inside a block are never all listed: see common.links_in_blocks.

Defined cases: null or empty text and text of white space have an empty set, n_shingles 0, and link with nothing;
fewer than five words form one shingle of the whole sequence; repeated rows of a doc_id share its component, with other
texts too, but for rows without words; columns besides doc_id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import connected_components, links_in_blocks, map_columns, small_batches, written

WORDS, BANDS, ROWS, SEED = 5, 32, 4, 20_261
#: Signature positions, of BANDS * ROWS, that must agree: half, six standard deviations below what 0.75 gives.
LEAST_AGREEING = 64
#: So many ids (8 bytes each) at most are broadcast to pick documents; more are joined by shuffling.
MOST_BROADCAST = 1_000_000
_MEMO = 500_000


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, memo: _Words) -> np.ndarray:
    """The sorted 64-bit hashes of the document's distinct shingles."""
    words = (text or "").encode().lower().split()  # bytes: exactly A-Z and the six ASCII white-space characters
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(WORDS, n)
    h = codes[: n - width + 1].copy()
    for k in range(1, width):
        h = _mixed(h) + codes[k : n - width + 1 + k]
    return np.unique(_mixed(h + np.uint64(width)))


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal (multiply-shift) hash over the set."""
    x = s & np.uint64(0xFFFFFFFF) ^ s >> np.uint64(32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(x), 512):
        v = x[k : k + 512, None] * a
        v += b
        v >>= np.uint64(32)
        np.minimum(out, v.min(0), out=out)
    return out


def block_keys(m: np.ndarray) -> np.ndarray:
    """A key for each band, the band's number included."""
    rows = m.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mixed(h) + rows[:, k]
    return _mixed(h).view(np.int64)


def signatures(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key, signature, blocks.  One narrow pass."""

    def make():
        import xxhash

        draw = np.random.Generator(np.random.PCG64(SEED))
        a = draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        memo = _Words()

        def one(t: str | None) -> tuple:
            s = shingles(t, memo)
            if not len(s):
                return 0, None, None, None
            m = minima(s, a, b)
            return len(s), xxhash.xxh3_128_digest(s.tobytes()), m.astype(np.uint32).tobytes(), block_keys(m).tolist()

        return lambda rows: (one(t) for (t,) in rows)

    small_batches(documents.sparkSession)
    return map_columns(documents, [text], ["doc_id"], make, "n_shingles long, set_key binary, signature binary, blocks array<long>")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
        near = pa.array((left == right).sum(1) >= LEAST_AGREEING)
        yield batch.select(["a", "b"]).filter(near)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, last, last_set = _Words(), None, None
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
            if a != last:
                last, last_set = a, shingles(ta.as_py(), memo)
            other = shingles(tb.as_py(), memo)
            both = len(np.intersect1d(last_set, other, assume_unique=True))
            keep.append(100 * both >= 75 * (len(last_set) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def only(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents with these ids."""
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    return documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")


def with_texts(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ta and tb to pairs (a, b) of doc_ids.  Only texts that pairs need are shuffled, if their ids are few enough
    to broadcast; else documents and ids meet in a shuffle join."""
    texts = only(documents, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")


def verifier(reps: DataFrame, documents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def verify(pairs: DataFrame) -> DataFrame:
        sig = reps.select("rep", "signature")
        both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
        both = both.join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
        near = written(both.mapInArrow(_agreeing, "a long, b long"), "near")
        return with_texts(near, documents).mapInArrow(_confirmed, "a long, b long")

    return verify


#: Words of an odd sketch: whether a set has an odd number of elements in each of 64 * SKETCH classes.
SKETCH = 32
#: Of two linked sets the intersection is at least 3/7 of the sum of the sizes, and at most either size or the number
#: of elements of one that any other set has.  Then at most 1/7 of the sum is in one set only, and each of those flips
#: one bit of the odd sketches, so these differ in no more bits.
POSSIBLE = "7 * least(lx.shared, ly.shared) >= 3 * (lx.size + ly.size) and coalesce(7 * (" + " + ".join(f"bit_count(lx.o{k} ^ ly.o{k})" for k in range(SKETCH)) + ") <= lx.size + ly.size, true)"


def odd_sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_figures(documents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For links_in_blocks: of each node's shingles, how many there are, how many any other of the nodes has, and their odd
    sketch.  A node that stands for several texts has the least size, the greatest count and no sketch."""

    def make():
        memo = _Words()

        def one(t: str | None) -> tuple:
            s = shingles(t, memo)
            return len(s), s.view(np.int64).tolist(), odd_sketch(s).tolist()

        return lambda rows: (one(t) for (t,) in rows)

    def limits(nodes: DataFrame) -> DataFrame:
        texts = only(documents, nodes.withColumnRenamed("node", "doc_id")).dropDuplicates(["doc_id", "text"])
        each = written(map_columns(texts, ["text"], ["doc_id"], make, "size long, elements array<long>, odd array<long>").withColumnRenamed("doc_id", "node"), "elements")
        one = each.select("node", F.explode("elements").alias("element"))
        common = one.groupBy("element").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("element", F.lit(1).alias("shared"))
        shared = one.join(written(common, "shared"), "element").groupBy("node").agg(F.count("*").alias("shared"))
        whole = each.groupBy("node").agg(F.min("size").alias("size"), F.when(F.count("*") == 1, F.first("odd")).alias("odd"))
        return whole.join(shared, "node", "left").select("node", F.struct("size", F.coalesce("shared", F.lit(0)).alias("shared"), *(F.col("odd")[k].alias(f"o{k}") for k in range(SKETCH))).alias("limit"))

    return limits


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents(doc_id, text)."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(documents), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("blocks").alias("blocks"))
    reps = written(classes, "classes")
    members = reps.select(F.explode("blocks").alias("block"), F.col("rep").alias("node"))
    found, _ = links_in_blocks(members, verifier(reps, documents), set_figures(documents), POSSIBLE)
    # a doc_id that repeats with another text is still one document: it ties the classes of its texts together
    key = F.xxhash64("set_key")
    several = signed.where("set_key is not null").groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x < y").select("doc_id")
    several = written(several.join(signed, "doc_id").join(reps.select("set_key", "rep"), "set_key").select("doc_id", "rep"), "several-texts")
    if not several.isEmpty():
        ties = several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(ties))
    of_class = reps.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("class_component"))
    of_class = written(of_class, "class-components")
    joined = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    return components(documents).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns; repeated rows of a doc_id
    stay together.  Dropped ids are joined by broadcast if they are few enough, so that texts aren't shuffled."""
    gone = written(near_duplicates(documents).where("not kept").select("doc_id").distinct(), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
