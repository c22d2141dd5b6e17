"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components, scaled and rounded down, are integer weights of terms; a component of weight 0 is no term.  The
candidates of a block are kept as postings by term.  A query's terms are taken one after another: each scatters its
weight times the posted weights into a dense array of scores, for a batch of queries at once.  A partial selection keeps
the best k of a block, and the blocks' results are merged by a ranked window, which Spark limits before its shuffle.

Queries and candidates are dealt by a hash of the id into blocks of bounded size; a task takes one block of queries and one of
candidates.  Block sizes affect speed only: no candidate is skipped.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate, nor do
rows without a vec_id; an empty vector scores 0 with all; a shorter vector lacks the further terms; rows that repeat a
vec_id are one vector, the greatest; scores beyond 64 bits count as the end of the range; ties go to the smaller
vec_id; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.llm.common import written

#: Most candidates and queries of a block, the least of a block of candidates, and the queries that are summed at once.
MOST_CANDIDATES, MOST_QUERIES, LEAST_CANDIDATES, BATCH = 16_384, 16_384, 512, 64
LONG = np.iinfo(np.int64)


def weights(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers, Python's where those don't reach."""
    w = np.floor(scale * v)
    return w.astype(np.int64) if not len(w) or np.abs(w).max() < 2.0**62 else np.array([math.floor(x) for x in w.tolist()], object)


def _terms(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Usable vectors as their terms (unsigned 32-bit numbers) and weights: 16-bit integers, 64-bit ones, or text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and np.isfinite(scale * x).all():
                        w = weights(x, scale)
                        at = np.flatnonzero(w != 0)
                        w = w[at]
                        kind = "t" if w.dtype == object else "s" if not len(w) or np.abs(w).max() < 1 << 15 else "l"
                        raw = " ".join(map(str, w)).encode() if kind == "t" else w.astype("<i2" if kind == "s" else "<i8").tobytes()
                        out.append((i, at.astype("<u4").tobytes(), kind, raw))
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names=["vec_id", "terms", "kind", "raw"])

    return run


def _postings(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, weight) of all terms of the rows, by term, then row."""
    terms = [np.frombuffer(r["terms"], "<u4") for r in rows]
    of = {"s": lambda b: np.frombuffer(b, "<i2").astype(np.int64), "l": lambda b: np.frombuffer(b, "<i8"), "t": lambda b: np.array([int(x) for x in b.split()], object)}
    weight = [of[r["kind"]](r["raw"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
    term = np.concatenate([*terms, np.empty(0, np.uint32)]).astype(np.int64)
    weight = np.concatenate([*weight, np.empty(0, np.int64)])
    order = np.argsort(term, kind="stable")
    return term[order], row[order], weight[order]


def best(queries: list[dict], candidates: list[dict], k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k highest scores of each query among the candidates, which are sorted by vec_id."""
    term, slot, weight = _postings(candidates)
    names, begins = np.unique(term, return_index=True)
    ends = np.append(begins[1:], len(term))
    place = dict(zip(names.tolist(), range(len(names)), strict=True))
    ids = np.array([c["vec_id"] for c in candidates], np.int64)
    out: list[tuple[int, int, int]] = []
    for first in range(0, len(queries), BATCH):
        batch = queries[first : first + BATCH]
        q_term, q_row, q_weight = _postings(batch)
        # a score is at most the largest sum of a query's weights times the largest posted weight
        sums = np.zeros(len(batch), object)
        np.add.at(sums, q_row, np.abs(q_weight).astype(object))
        bound = int(max(sums, default=0)) * int(np.abs(weight).max(initial=0) if weight.dtype != object else max(map(abs, weight), default=0))
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
        scores, product = (np.zeros((len(candidates), len(batch)), kind) for _ in range(2))
        held, cuts = np.unique(q_term, return_index=True)
        for t, a, b in zip(held.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(q_term)], strict=True):
            if (p := place.get(t)) is None:
                continue
            rows, columns = slot[begins[p] : ends[p]], q_row[a:b]
            posted, asked = weight[begins[p] : ends[p]].astype(kind), q_weight[a:b].astype(kind)
            if 4 * len(rows) * len(columns) < scores.size:
                scores[np.ix_(rows, columns)] += posted[:, None] * asked[None, :]
            else:  # a term of most rows: straight through, zeros included, is faster than by places
                down, across = np.zeros(len(scores), kind), np.zeros(len(batch), kind)
                down[rows], across[columns] = posted, asked
                np.multiply(down[:, None], across[None, :], out=product)
                scores += product
        if kind is object:
            scores = np.clip(scores, LONG.min, LONG.max).astype(np.int64)
        for j, q in enumerate(batch):
            s = scores[:, j]
            others = ids != q["vec_id"]
            s, own = s[others], ids[others]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
                at = np.concatenate([above, equal[: k - len(above)]])
                s, own = s[at], own[at]
            out += zip([q["vec_id"]] * len(s), own.tolist(), s.tolist(), strict=True)
    return out


def _searched(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        queries = [r for r in rows if r["is_query"]]
        candidates = sorted((r for r in rows if not r["is_query"]), key=lambda r: r["vec_id"])
        columns = list(zip(*best(queries, candidates, k), strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_scores(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, most_candidates: int = MOST_CANDIDATES, most_queries: int = MOST_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query against all other vectors.  is_query: over
    vec_id."""
    one = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = one.where(usable).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    held = written(one.mapInArrow(_terms(scale), "vec_id long, terms binary, kind string, raw binary"), "terms")
    n, n_queries = held.agg(F.count("*"), F.count_if(is_query)).first()
    parts = max(-(-n // most_candidates), min(32, -(-n // LEAST_CANDIDATES)), 1)
    query_parts = max(1, -(-n_queries // most_queries))

    def dealt(rows: DataFrame, own: int, other: int, role: bool, seed: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(own))
        unit = (lambda p: p * F.lit(parts) + mine) if not role else (lambda p: mine * F.lit(parts) + p)
        return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(other - 1)), unit)).alias("unit"), F.lit(role).alias("is_query"), "vec_id", "terms", "kind", "raw")

    units = dealt(held, parts, query_parts, False, 1).union(dealt(held.where(is_query), query_parts, parts, True, 2))
    found = units.groupBy("unit").applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
