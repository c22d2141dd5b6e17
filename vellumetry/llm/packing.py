"""Vector best-fit packing of tokenized documents into sequences.

Only documents longer than a sequence are cut.  The pieces, a few numbers each, are dealt at random into groups of
bounded size, and each group is packed by itself: longest piece first, into the open bin that fits it best under three
capacities (tokens, documents, attention cost).  A group leaves at most a few part-filled bins, so with groups of
thousands of pieces the loss against one global packing is small, and no task grows with the data.

Defined cases: null or empty text is a document of its end token only; repeated rows are packed each; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm import bpe
from vellumetry.llm.common import small_batches, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces in a group, packed by one task.
GROUP = 16_384


class Counter:
    """Ids of whole texts with a byte-level vocabulary, end token included.

    The compiled merger takes the file's own vocabulary; texts that its pattern engine gives up on (very long runs of
    one kind) go through the streaming encoder.
    """

    def __init__(self, path: str, end: int):
        import tiktoken

        self.v = bpe.vocabulary(path)
        if self.v.decoder != "ByteLevel" or self.v.suffix:
            raise ValueError(f"{path}: a byte-level vocabulary is needed")
        if any(a >= b for a, b in itertools.pairwise(self.v.made)):  # the merger merges by id
            raise ValueError(f"{path}: ids in the order of the merges are needed")
        ranks = {self.v.raw[i]: i for t, i in ((t, i) for i, t in self.v.tokens.items()) if t not in self.v.added}
        self.fast = tiktoken.Encoding("packing", pat_str=bpe.BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self.v.added)
        self.slow = bpe.Encoder(path)
        self.end = np.array([end], dtype="<u4")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return self.end
        try:
            found = self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            found = np.frombuffer(self.slow.encode(text), "<u4")
        return np.concatenate([found.astype("<u4", copy=False), self.end])


def cut_pieces(df: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """The pieces of each document: whole if it fits, else of exactly `capacity` tokens but for a shorter first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, end)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = counter.ids(text.as_py())
                n = len(ids)
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_attention: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.  Longest first; among the open bins that can take a piece under every capacity, the
    one whose residual vector, each part relative to its capacity, has the greatest dot product with the piece's demand
    subtracted last, that is the least weighted residual norm afterwards.  A bin that no remaining piece fits is closed.
    """
    order = np.argsort(-lengths, kind="stable")
    total = np.array([capacity, max_documents, max_attention], dtype=float)
    weight = np.array([1.0, 1e-3, 1e-3]) / total  # tokens decide; the others break ties
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((64, 3))  # residual capacities of the open bins
    name = np.empty(64, np.int64)
    n_open = made = 0
    shortest = int(lengths.min()) if len(lengths) else 0
    for k in order.tolist():
        x = int(lengths[k])
        need = np.array([x, 1.0, float(x) * x])
        at = -1
        if n_open:
            room = left[:n_open]
            fits = (room >= need).all(1)
            if fits.any():
                norm = (((room - need) * weight) ** 2).sum(1)
                norm[~fits] = np.inf
                at = int(norm.argmin())
        if at < 0:
            if x > capacity:
                raise ValueError(f"a piece of {x} tokens doesn't fit into {capacity}")
            if n_open == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            left[n_open], name[n_open] = total, made
            at, n_open, made = n_open, n_open + 1, made + 1
        bins[k], offsets[k] = name[at], capacity - int(left[at, 0])
        left[at] -= need
        if left[at, 0] < shortest or left[at, 1] < 1:
            n_open -= 1
            left[at], name[at] = left[n_open], name[n_open]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 1024, max_documents: int | None = None, max_attention: int | None = None, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset.  pieces: as from cut_pieces, written, as they are counted first.

    max_documents and max_attention (the sum of squared lengths in a sequence) default to what the token capacity
    implies, and then bind nothing.
    """
    most_documents = max_documents or capacity
    most_attention = max_attention or capacity * capacity
    groups = max(1, -(-pieces.count() // group))

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group"]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, most_documents, most_attention)
        bins += key[0].as_py() << 32
        return table.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, PACKED)


def pack_documents(df: DataFrame, path: str, capacity: int = 1024, end: int = 2, max_documents: int | None = None, max_attention: int | None = None) -> DataFrame:
    return pack(written(cut_pieces(df, path, capacity, end), "pieces"), capacity, max_documents, max_attention)
