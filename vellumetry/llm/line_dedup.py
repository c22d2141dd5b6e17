"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Equal lines form a class at once.  Lines of LEAST_CHARS characters or more are also joined when their edit distance is
at most TAU: cut into TAU + 1 segments, two such lines share one whole segment, at places that their lengths bound.
Each line probes the indexes of its own length and of the lengths down to TAU less, at the multi-match-aware start
positions, which for TAU = 2 gives twelve keys a line, its own segments among them.  Lines that share a key are
verified by a banded bit-parallel edit distance; classes are the components of what is confirmed.  Every line but the first
of its class (smallest doc_id, then place) is removed.  Lines without a visible character stay.

Defined cases: null text stays null and has no lines; empty text stays empty; lines are compared without spaces at
their ends; ties go to the smaller place; repeated rows of a doc_id count as one document whose lines repeat: both
rows lose the same lines; an empty table gives an empty table; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import MOST_BROADCAST, dropped, few, fresh, links_in_blocks, written

TAU, LEAST_CHARS = 2, 32
#: A pair takes a small part of a millisecond to verify, far more than its bytes tell.
PAIRS_IN_A_TASK = 2000


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, place, line: the lines that have a visible character, without spaces at their ends."""
    out = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return out.select("doc_id", "place", F.trim("line").alias("line")).where(F.col("line").rlike(r"\S"))


def with_segment_keys(lines: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Add blocks to lines (line, size): keys of the segments that a line may share with lines at most tau shorter, or,
    being that one, with longer ones; null for lines of fewer than least_chars characters.

    A line of length L is cut into tau + 1 segments, the longer ones last.  Against an indexed length L = size - d,
    segment i (from 1) starting at p is probed from max(p - (i - 1), p + d - (tau + 1 - i)) to min(p + (i - 1),
    p + d + (tau + 1 - i)).  The line is cut once into a window for each i that holds all its probes.
    """
    parts = tau + 1
    size = F.col("size")
    # whole numbers first, in columns of their own: one method of generated code with all of it is too long to be compiled
    of = {f"_b{i}": F.greatest(F.lit(1), F.floor(size * (i - 1) / parts).cast("int") - 2 * tau - 1) for i in range(1, parts + 1)}
    for d in range(tau + 1):
        short = F.floor((size - d) / parts).cast("int")
        of |= {f"_s{d}": short, f"_n{d}": parts - (size - d - short * parts)}  # so many segments, the first ones, aren't longer
    windows = {f"_w{i}": F.substring("line", F.col(f"_b{i}"), F.floor(size / parts).cast("int") + 4 * tau + 5) for i in range(1, parts + 1)}
    keys = []
    for d in range(tau + 1):
        short, n = F.col(f"_s{d}"), F.col(f"_n{d}")
        for i in range(1, parts + 1):
            start = short * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - n) + 2 - F.col(f"_b{i}")
            width = short + (F.lit(i) > n).cast("int")
            for shift in range(max(-(i - 1), d - (parts - i)), min(i - 1, d + parts - i) + 1):
                keys.append(F.xxhash64((size - d) * parts + i, F.substring(F.col(f"_w{i}"), start + shift, width)))
    return lines.withColumns(of).withColumns(windows).withColumn("blocks", F.when(size >= least_chars, F.array(*keys))).drop(*of, *windows)


def within_edits(a: Column, b: Column, tau: int = TAU) -> Column:
    """True if the edit distance of two strings is at most tau: Hyyrö's banded bit-parallel recurrence.

    A word holds the band's 2 * tau + 1 diagonals and one more below as a guard; it moves one pattern character with each
    text character.  The pattern is the longer string.  Until the band meets the pattern's end the distance follows
    the lowest diagonal, from there the last row.
    """
    pattern = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b)
    text = F.when(F.char_length(a) >= F.char_length(b), b).otherwise(a)
    width = 2 * tau + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    long = lambda n: F.lit(n).cast("long")
    characters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    edge = F.array_repeat(F.lit(""), tau + 1)
    around, n = F.concat(edge, characters(pattern), edge), F.char_length(text)

    # bit k of an element: the text's character j equals the pattern's character j - tau - 1 + k, from 0
    marks = F.transform(F.sequence(F.lit(1), n), lambda _: long(0))
    for k in reversed(range(width)):
        same = F.zip_with(characters(text), F.slice(around, F.lit(k + 1), n), lambda x, y: F.when(x == y, long(1)).otherwise(long(0)))
        marks = F.zip_with(marks, same, lambda m, e: F.shiftleft(m, 1).bitwiseOR(e))
    marks = F.when(n > 0, marks).otherwise(F.array().cast("array<bigint>"))

    def step(s: Column, eq: Column) -> Column:
        d0 = ((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(full)
        hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))).bitwiseAND(full)
        hn = d0.bitwiseAND(s["vp"])
        last = F.call_function("shiftleft", long(1), s["left"] + tau)  # the bit of the last row's character
        along = F.when(hp.bitwiseAND(last) != 0, 1).when(hn.bitwiseAND(last) != 0, -1).otherwise(0)
        dist = s["dist"] + F.when(s["left"] > tau, (d0.bitwiseAND(top) == 0).cast("int")).otherwise(along)
        half = F.shiftright(d0, 1)
        vp = hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(full)
        done = F.struct((s["left"] - 1).alias("left"), vp.alias("vp"), half.bitwiseAND(hp).alias("vn"), dist.alias("dist"))
        return F.when(s["dist"] > 2 * tau, s).otherwise(done)  # at most tau of it can be won back at the end

    begin = F.struct(F.char_length(pattern).alias("left"), long(full & ~((1 << (tau + 1)) - 1)).alias("vp"), long(0).alias("vn"), F.lit(tau).alias("dist"))
    walked = F.aggregate(marks, begin, step)
    return (F.abs(F.char_length(a) - F.char_length(b)) <= tau) & (walked["dist"] <= tau)


def common_start(a: Column, b: Column) -> Column:
    """So many first characters of two strings are equal: the greatest such multiple of 8, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(3, 21))))
    more = lambda p, s: (p + s <= F.least(F.char_length(a), F.char_length(b))) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(more(p, s), p + s).otherwise(p))


def without_common_ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cut what two strings share at their ends, which changes no edit distance."""
    for _ in range(2):
        pairs = pairs.withColumn("_p", common_start(F.col(a), F.col(b)))
        pairs = pairs.withColumns({c: F.reverse(F.substring(F.col(c), F.col("_p") + 1, F.char_length(c))) for c in (a, b)})
    return pairs.drop("_p")


def parities(line: Column) -> Column:
    """Two words of 64 bits: for each of 64 classes of bigrams, and of characters, whether the line has an odd number of
    them.  One edit takes away at most two bigrams and brings at most two, so it flips at most four bits of the first
    word; of the second it flips at most two.  The last character counts as a bigram of its own."""
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    bit = lambda *of: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(*of), F.lit(64)))
    odd = lambda bits: F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseXOR(b))
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.lit(0), F.size(chars) - 1)), lambda x, y: bit(x, F.coalesce(y, F.lit(""))))
    return F.struct(odd(pairs).alias("bigrams"), odd(F.transform(chars, lambda x: bit(x))).alias("letters"))


def possible(tau: int) -> str:
    """Over the figures lx and ly of two lines: false only where they are more than tau edits apart."""
    flips = lambda which, most: f"coalesce(bit_count(lx.parity.{which} ^ ly.parity.{which}) <= {most}, true)"
    return f"abs(lx.size - ly.size) <= {tau} and {flips('letters', 2 * tau)} and {flips('bigrams', 4 * tau)}"


class LinePairs:
    """What links_in_blocks asks of lines: the texts of those that share a block, fetched once, and from them the
    verification of pairs and the figures that rule pairs out (size and parities, these null where an id
    stands for two lines)."""

    def __init__(self, documents: DataFrame, keyed: DataFrame, tau: int):
        self.documents, self.keyed, self.tau = documents, keyed, tau
        self.spent: list[DataFrame] = []

    def free(self) -> None:
        """Delete the tables of the pairs verified last; their links have been written by now."""
        dropped(*self.spent)
        self.spent = []

    def prepare(self, nodes: DataFrame) -> None:
        """One line of each digest is read again, from the first document that has it."""
        nodes = written(nodes.withColumnRenamed("node", "lid"), "line-nodes")
        wanted = self.keyed.join(few(nodes), "lid", "left_semi")
        holders = written(wanted.groupBy("lid", "digest").agg(F.min("doc_id").alias("doc_id")), "line-holders")
        held = self.documents.join(few(holders.select("doc_id").distinct()), "doc_id", "left_semi")
        texts = identified(lines(held)).join(few(holders), ["lid", "digest", "doc_id"], "left_semi")
        texts = texts.groupBy("lid", "digest").agg(F.first("line").alias("line"))
        self.texts = written(texts.select("lid", "line", F.char_length("line").alias("size"), parities(F.col("line")).alias("parity")), "line-texts")
        dropped(nodes, holders)

    def verify(self, pairs: DataFrame) -> DataFrame:
        self.free()
        figures = self.texts.select("lid", F.struct("size", "parity").alias("l"))
        both = pairs.join(figures.toDF("b", "lb"), "b").join(figures.toDF("a", "la"), "a").where(possible(self.tau).replace("lx.", "la.").replace("ly.", "lb."))
        pairs = written(both.select("a", "b").distinct(), "line-pairs")
        tasks = 1 + pairs.count() // PAIRS_IN_A_TASK
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct(), "line-ids")
        texts = self.texts.select("lid", "line").join(few(ids), "lid", "left_semi")
        both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
        # written: a filter pushed below the cutting would repeat it at each mention of a string
        short = written(without_common_ends(both.select("a", "b", "ta", "tb").repartition(tasks), "ta", "tb"), "line-cores")
        dropped(pairs, ids)
        self.spent = [short]
        return short.where(within_edits(F.col("ta"), F.col("tb"), self.tau)).select("a", "b").distinct()

    def limits(self, nodes: DataFrame) -> DataFrame:
        each = self.texts.join(nodes.withColumnRenamed("node", "lid"), "lid", "left_semi")
        one = each.groupBy("lid").agg(F.min("size").alias("size"), F.min("parity").alias("parity"), F.count("*").alias("n"))
        return one.select(F.col("lid").alias("node"), F.struct("size", F.when(F.col("n") == 1, F.col("parity")).alias("parity")).alias("limit"))


def identified(every: DataFrame) -> DataFrame:
    """Add lid, which names a line in blocks and links, and digest; the two together tell lines apart."""
    return every.withColumns({"lid": F.xxhash64("line"), "digest": F.xxhash64(F.lit(1), "line")})


def repeated_lines(documents: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, place: the lines to remove."""
    documents = documents.select("doc_id", "text")
    every = identified(lines(documents)).withColumn("size", F.char_length("line"))
    keyed = written(with_segment_keys(every, tau, least_chars).select("doc_id", "place", "lid", "digest", "blocks"), "lines")
    pairs = LinePairs(documents, keyed, tau)
    members = keyed.where("blocks is not null").select(F.explode("blocks").alias("block"), F.col("lid").alias("node"))
    found, _ = links_in_blocks(members, pairs.verify, pairs.limits, possible(tau), pairs.prepare)
    pairs.free()
    dropped(pairs.texts)
    first = keyed.groupBy("lid", "digest").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    classed = written(first.join(few(found.withColumnRenamed("node", "lid")), "lid", "left").where("n > 1 or component is not null"), "line-classes")
    near = classed.where("component is not null").groupBy("component").agg(F.min("first").alias("class_first"))
    near = written(near, "near-lines")
    kept = classed.join(few(near), "component", "left").select("lid", "digest", F.coalesce("class_first", "first").alias("kept"))
    kept = written(kept, "kept-lines")
    gone = keyed.select("doc_id", "place", "lid", "digest").join(few(kept), ["lid", "digest"])
    gone = written(gone.where("struct(doc_id, place) <> kept").select("doc_id", "place"), "gone-lines")
    dropped(keyed, classed, near, kept, found)
    return gone


def without_repeats(documents: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS) -> DataFrame:
    """documents with the repeated lines cut out of text, and n_removed (long); a column n_removed is replaced."""
    names = [c for c in documents.columns if c.lower() != "n_removed"]
    places, doc = fresh(names, "gone_places"), fresh(names, "gone_doc")
    lost = repeated_lines(documents, tau, least_chars)
    gone = written(lost.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("place").alias(places)), "gone-places")
    dropped(lost)
    n, cells = gone.agg(F.count("*"), F.sum(F.size(places))).first()
    joined = documents.join(F.broadcast(gone) if n + (cells or 0) <= 4 * MOST_BROADCAST else gone, F.col("doc_id") == F.col(doc), "left")
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(places))
    # the split text is bound once, as the element of an array: a lambda computes anew what it mentions
    text = F.transform(F.array(F.split("text", "\n", -1)), lambda p: F.array_join(F.transform(stay(p), lambda i: p[i]), "\n"))[0]
    return joined.select(
        *(F.when(F.col(places).isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(c) for c in names),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_removed"),
    )
