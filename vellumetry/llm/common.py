"""Shared plumbing: shared-folder tables, Arrow maps, connected components, link search in blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []
#: Blocks with more than one node (16 bytes each) are broadcast up to so many, counted first; more are joined by shuffling.
MOST_BROADCAST = 1_000_000
#: Rounds of stars before the pairs that are left are met.  Affects speed only.
MOST_STARS = 5


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a folder of our own where it is unset and Spark is local, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="vellumetry-"))
    return _OWN_FOLDER[0]


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vellumetry-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that no result still reads."""
    for df in tables:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            if "/vellumetry-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_columns(df: DataFrame, inputs: list[str], keep: list[str], make: Callable[[], Callable[..., Iterable[tuple]]], added: str) -> DataFrame:
    """Append columns computed in Python, row by row inside Arrow batches.

    make() runs once per task and returns f(rows of inputs) -> rows of the added columns, one for one and lazily;
    results leave in batches of about 16 MB at most.  keep: columns carried over unread.
    """
    from pyspark.sql.types import StructType

    fields = StructType([df.schema[c] for c in keep]).fieldNames()
    extra = StructType.fromDDL(added)
    schema = StructType([df.schema[c] for c in fields] + list(extra.fields))
    arrow = _arrow_types(extra)
    names = keep + extra.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            start, size, out = 0, 0, []
            for row in f(rows):
                out.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
                if size > 16_000_000:
                    yield _batch(batch, keep, start, out, arrow, names)
                    start, size, out = start + len(out), 0, []
            if out:
                yield _batch(batch, keep, start, out, arrow, names)

    columns = list(dict.fromkeys(keep + inputs))
    return df.select(*columns).mapInArrow(run, schema)


def _arrow_types(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _batch(batch: pa.RecordBatch, keep: list[str], start: int, out: list[tuple], arrow: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    carried = [batch.column(c).slice(start, len(out)) for c in keep]
    made = [pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), arrow, strict=True)]
    return pa.RecordBatch.from_arrays(carried + made, names=names)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of links (a, b): node, component (its smallest node).  Nodes without links don't appear.

    Alternating large-star and small-star.  An edge is kept as (hi, lo), lo < hi.  The minimum of a node's smaller
    neighbours comes from one partial aggregate; edges then join it, so no task holds the neighbours of a hub.  Each
    round is written to the shared folder.  Self-links, nulls and repeats are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    e = written(e, "edges")
    while True:
        # large-star: each edge (hi, lo) hangs hi below the smallest neighbour of lo
        low = e.groupBy("hi").agg(F.min("lo").alias("m"))
        up = low.select(F.col("hi").alias("lo"), "m")
        large = e.join(up, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        large = written(large, "large")
        # small-star: all smaller neighbours of a node, and the node, hang below its smallest one
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        both = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*")
        small = written(both.where("hi <> lo").distinct(), "small")
        dropped(e, large)
        e = small
        # done when each node has one edge and no edge's low end hangs below another node
        roots = e.select(F.col("lo").alias("hi")).distinct()
        repeated = e.groupBy("hi").count().where("count > 1").select("hi")
        if e.join(roots, "hi", "left_semi").select("hi").union(repeated).isEmpty():
            tops = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return written(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(tops), "components")


def fresh(taken: list[str], name: str) -> str:
    """name, or name with underscores, that no column of taken has (columns compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def few(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most MOST_BROADCAST rows, counted here; else as it is, for a shuffle join.
    For narrow tables only (a few numbers a row)."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def links_in_blocks(members: DataFrame, verify: Callable[[DataFrame], DataFrame], limits: Callable[[DataFrame], DataFrame] | None = None, possible: str = "true", prepare: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the links among nodes that share a block, without listing the pairs of a block.

    members: (block, node), repeats allowed.  prepare: called once with the nodes (node) that share a block.  verify:
    candidate pairs (a, b), a < b -> those that are links.
    1. Star: the nodes of a block against its smallest node.  2. Stars of other centres, at most MOST_STARS: in blocks
    of several components the node that shares the most blocks, which of a group of copies is the one nearest their
    origin, against the nodes of other components; then the same for the best node outside the largest component.
    3. What is then still apart inside a block: the nodes outside the block's largest component against the block's
    nodes of other components.  Pairs inside one component can't change a component, so nothing is lost.  Stars end
    sooner where what is left is already linear in the blocks' sizes, or where a round leaves over nine tenths of it.
    limits: nodes still apart (node) -> figures of theirs (node, limit, a struct); possible: SQL over the limits lx and
    ly of two nodes, false only where the two can't be a link; such pairs never become rows.  Returns (node, component)
    and the links found.
    """
    first = members.groupBy("block").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    first = written(first.select("block", "a"), "blocks")
    shared = written(members.join(few(first), "block").distinct(), "shared")
    if prepare:
        prepare(shared.select("node").distinct())
    links = written(verify(shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()), "links")
    found = connected_components(links)

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        out = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
        dropped(found)
        return out

    own = before_apart = shared.select("block", "node")
    limit, before = None, float("inf")
    for round_ in range(MOST_STARS + 1):
        placed = own.join(found, "node", "left").select("block", "node", *(["limit", "rank"] if limit else []), F.coalesce("component", "node").alias("c"))
        placed = written(placed, "own")
        sizes = placed.groupBy("block", "c").agg(F.count("*").alias("n"))
        split = sizes.groupBy("block").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        split = written(split.select("block", F.col("most.c").alias("largest"), "n", ((F.col("n") - F.col("most.n")) * F.col("n")).alias("open")), "split")
        apart = placed.join(split.select("block", "largest"), "block").withColumn("in_largest", F.col("c") == F.col("largest")).drop("largest")
        if limit is None:
            rank = apart.groupBy("node").agg(F.count("*").alias("rank"))
            nodes = None if limits is None else written(rank.select("node"), "apart-nodes")
            limit = rank.withColumn("limit", F.lit(0)) if limits is None else rank.join(limits(nodes), "node")
            apart = apart.join(limit, "node")
        apart = written(apart, "apart")
        left, size = split.agg(F.sum("open"), F.sum("n")).first()
        dropped(placed, split, before_apart)
        before_apart = apart
        if nodes is not None:
            dropped(nodes)
            nodes = None
        if not left:
            dropped(first, apart)
            return found, links
        if left <= 4 * size or left > 0.9 * before or round_ == MOST_STARS:
            break
        before = left
        order = F.struct("rank", (-F.col("node")).alias("least"))
        best = F.max(order if round_ == 0 else F.when(~F.col("in_largest"), order))
        centre = apart.groupBy("block").agg(best.alias("best")).select("block", (-F.col("best.least")).alias("x"))
        centre = centre.join(apart.select("block", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("limit").alias("lx")), ["block", "x"])
        pairs = apart.withColumnRenamed("limit", "ly").join(centre, "block").where(f"c <> cx and ({possible})")
        more = written(verify(pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()), "links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = joined(found, more)
        own = apart.select("block", "node", "limit", "rank")
    few_nodes = apart.where("not in_largest").select("block", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("limit").alias("lx"))
    rest = few_nodes.join(apart.withColumnRenamed("limit", "ly"), "block").where(f"c <> cx and (in_largest or x < node) and ({possible})")
    more = written(verify(rest.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()), "links")
    dropped(first, apart)
    links = links.unionByName(more)
    if not more.isEmpty():
        found = joined(found, more)
    return found, links


def no_nulls(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
