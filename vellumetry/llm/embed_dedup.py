"""Near-duplicate vectors: an exact metric range join on the angle.

Pivots partition the vectors: a vector's home cell is that of the pivot most like it.  If y is homed in cell c and x in
cell h, and the two are within the radius, the triangle inequality gives angle(x, c) <= angle(x, h) + 2 * radius, and
the bisecting hyperplane x.h - x.c <= chord * |h - c|; a vector is sent to every cell that passes both, so no pair
within the radius is lost.  Cells are cut into blocks of bounded size, and each pair of blocks is one independent task
of matrix products in double precision.  A task returns counts and a spanning forest of its links, never its pairs.

Pivots are a sample of at most MOST_PIVOTS vectors; they affect speed only.  In data without clusters in many
dimensions no metric pruning is possible, and the work tends to all pairs of blocks, each still bounded in memory.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing; shorter
vectors count as padded with zeros; rows that repeat a vec_id are one vector (its greatest
embedding), rows without a vec_id one row that links with nothing and isn't kept; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import connected_components, written

BLOCK, MOST_PIVOTS = 4096, 256


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    m = np.zeros((len(raw), dim))
    for k, r in enumerate(raw):
        v = np.frombuffer(r, "<f8")
        m[k, : len(v)] = v
    if len(raw):
        m /= np.abs(m).max(1, keepdims=True)  # no overflow of squares
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes."""
    for batch in batches:
        ids, raw = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if v.is_valid and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    raw.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "v"])


def _spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the labels of linked rows i and j, in place: each gets the least label, until nothing changes."""
    while True:
        low = np.minimum(labels[i], labels[j])
        before_i, before_j = labels[i], labels[j]
        if (before_i == before_j).all():
            return
        np.minimum.at(labels, before_i, low)
        np.minimum.at(labels, before_j, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def compare(ids: np.ndarray, m: np.ndarray, first: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows [0, first) and rows [first, n), or among all rows if same: counts and forest labels."""
    n = len(ids)
    counts, labels = np.zeros(n, np.int64), np.arange(n)
    right = 0 if same else first
    for k in range(0, n if same else first, 512):
        end = min(k + 512, n if same else first)
        start = k if same else right
        hit = m[k:end] @ m[start:].T >= threshold
        i, j = np.nonzero(hit)
        i, j = i + k, j + start
        if same:
            i, j = i[i < j], j[i < j]
        counts += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        _spanning(labels, i, j)
    return counts, labels


def links(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) of linked vectors, and edges (a, b) that span the components of the links."""
    one = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    packed = written(one.mapInArrow(_packed, "vec_id long, v binary"), "vectors")
    total, longest = packed.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    dim = (longest or 8) // 8
    few = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(MOST_PIVOTS, math.isqrt(max(total, 1)) // 8))).collect()
    pivots = _matrix([bytes(r.v) for r in few], dim)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    radius, chord = math.acos(threshold), math.sqrt(2 - 2 * threshold)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = (_matrix(b.column(1).to_pylist(), dim) @ pivots.T).argmax(1) if len(b) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home, pa.int32())], names=["vec_id", "v", "home"])

    homed = written(packed.mapInArrow(homes, "vec_id long, v binary, home int"), "homes")
    parts = np.ones(max(1, len(pivots)), np.int64)
    for r in homed.groupBy("home").count().collect():  # as many rows as pivots
        parts[r["home"]] = -(-r["count"] // block)
    begins = np.concatenate([[0], np.cumsum(parts)])
    blocks = int(begins[-1])
    cell_of = np.repeat(np.arange(len(parts)), parts)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of blocks that a vector takes part in."""
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                like = _matrix(part.column("v").to_pylist(), dim) @ pivots.T
                home = part.column("home").to_numpy()
                own = np.take_along_axis(like, home[:, None].astype(np.int64), 1)
                angle = np.arccos(np.clip(like, -1, 1))
                near = angle <= np.take_along_axis(angle, home[:, None].astype(np.int64), 1) + 2 * radius + 1e-7
                near &= own - like <= chord * apart[home] + 1e-7
                mine = begins[home] + part.column("part").to_numpy()
                row, other = np.nonzero(near[:, cell_of])
                low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
                units = pa.array(low * blocks + high, pa.int64())
                yield pa.RecordBatch.from_arrays([units, pa.array(mine[row] == low), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row))], names=["unit", "low", "vec_id", "v"])

    def matched(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by([("low", "descending"), ("vec_id", "ascending")])
        ids = table["vec_id"].to_numpy()
        first = int(np.count_nonzero(table["low"].to_numpy(zero_copy_only=False)))
        same = key[0].as_py() // blocks == key[0].as_py() % blocks
        counts, labels = compare(ids, _matrix(table["v"].to_pylist(), dim), first, same, threshold)
        hit = counts > 0
        return pa.table({"vec_id": ids[hit], "n_links": counts[hit], "root": ids[labels[hit]]})

    home_part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("home") + 1)).cast("int")
    spread = homed.withColumn("part", home_part).mapInArrow(sent, "unit long, low boolean, vec_id long, v binary")
    found = written(spread.groupBy("unit").applyInArrow(matched, "vec_id long, n_links long, root long"), "matches")
    return found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")), found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    counts, edges = links(vectors, threshold)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = ids.join(counts, "vec_id", "left").join(connected_components(edges).withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
