"""Spelling variants by search schemes over a bidirectional FM-index of the delimited vocabulary.

Two words one edit apart agree on the first half of either or on the second half: the one error lies in the other half.
So each word goes to two blocks, one for the hash of its first three letters and one, reversed, for that of its last
three (halves have three letters at least).  A block's text is its words between delimiters.  Intervals of
suffix ranks are kept for the text and for the reversed text, and one step narrows both: a query's first half is
matched exactly from its end to the delimiter before it, then the match is extended to the right across the second half,
with one letter replaced, put in or left out.  A word that a path ends at, delimiter included, is near.

The index of a block counts by binary search in the places of each letter.  Blocks hold about BLOCK words; three letters that
MOST words share are cut into parts, and each part's words are searched in each part's index, so that no block grows.

Defined cases: null text has no words; repeated rows count again; a null doc_id gives the text "null" to the checksum; an
empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import dropped, small_batches, written

LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Letters that blocks are dealt by; words of a block, and of three letters before they are cut into parts; queries searched
#: at once; words that a task counts before it passes them on; characters of a text that are read at once.
KEY, BLOCK, MOST, AT_ONCE, MOST_COUNTED, WINDOW = 3, 32_768, 65_536, 8192, 200_000, 1 << 20
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def runs(text: str) -> Iterator[str]:
    """The maximal runs of letters, A-Z lower-cased.  Only runs of one window of the text are held at once."""
    if len(text) <= WINDOW:
        yield from RUN.findall(text.encode().lower().decode())
    else:
        for m in RUN.finditer(text):
            yield m[0].encode().lower().decode()


def slipped(doc_id: object, word: str) -> str:
    """The word, one letter less where the checksum says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % SLIP:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words, counts = list(held), list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc = "null" if doc is None else doc
            for word, n in Counter(runs(text or "")).items():
                word = slipped(doc, word)
                if len(word) >= LEAST_LETTERS:
                    held[word] += n
            if len(held) >= MOST_COUNTED:
                yield out()
    if held:
        yield out()


def vocabulary(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of LEAST_LETTERS letters or more that occur `least` times or more."""
    small_batches(documents.sparkSession)
    counts = documents.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Ranks:
    """A cyclic text's rotations in order, and where each symbol comes before them (Burrows and Wheeler's transform)."""

    def __init__(self, text: np.ndarray, order: bool = False):
        n = len(text)
        rank, step, places = text.astype(np.int64), 1, None
        while True:
            key = rank * (n + 1) + np.roll(rank, -step)
            places = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[places] = np.cumsum(np.diff(key[places], prepend=key[places[0]]) != 0)
            rank, step = new, step * 2
            if rank[places[-1]] == n - 1 or step >= 2 * n:
                break
        before = text[places - 1].astype(np.int64)
        by_symbol = np.argsort(before, kind="stable")
        self.n, self.keys, self.places = n, before[by_symbol] * n + by_symbol, places if order else None

    def narrowed(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The border `at` of an interval of ranks after the match is extended by the symbol."""
        return np.searchsorted(self.keys, symbol * self.n + at)


class Index:
    """The bidirectional index of some distinct words, as arrays of letters above 0."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words), np.uint8)
        self.symbols = np.unique(text)  # the delimiter is the first
        self.code = np.full(256, len(self.symbols), np.int64)  # letters that no word has: never found
        self.code[self.symbols] = np.arange(len(self.symbols))
        text = self.code[text]
        self.n, self.every = len(text), np.arange(len(self.symbols))
        self.forward, self.backward = _Ranks(text), _Ranks(text[::-1], True)
        self.word_at = np.cumsum(text == 0) - 1

    def extended(self, ranks: _Ranks, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after each symbol: a row an interval, a column a symbol."""
        return tuple(ranks.narrowed(self.every[None, :], at[:, None]) for at in (low, high))

    def near(self, queries: list[bytes], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of indexed words that agree on the query's first `half` letters and differ by one edit after."""
        flat = self.code[np.frombuffer(b"\0".join(queries) + b"\0", np.uint8)]
        size = np.array([len(q) for q in queries])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])

        # the first half, from its end to the delimiter: the forward ranks narrow, the backward ones follow
        low, high, other = np.zeros(len(queries), np.int64), np.full(len(queries), self.n), np.zeros(len(queries), np.int64)
        live = np.arange(len(queries))
        for step in range(int(half.max(initial=0)) + 1):
            now = live[half[live] >= step]
            symbol = np.where(half[now] == step, 0, flat[begin[now] + np.maximum(half[now] - 1 - step, 0)])
            lows, highs = self.extended(self.forward, low[now], high[now])
            known = symbol < len(self.symbols)
            pick = (np.arange(len(now)), np.where(known, symbol, 0))
            smaller = np.cumsum(highs - lows, 1)[pick] - (highs - lows)[pick]
            other[now] += smaller
            low[now], high[now] = lows[pick], np.where(known, highs[pick], lows[pick])
            live = live[high[live] > low[live]]
        # rightwards, over the backward ranks alone
        q, low, high = live, other[live], other[live] + (high - low)[live]
        at = begin[q] + half[q]
        one = [np.empty(0, np.int64)] * 4  # query, place in flat, low, high: paths with their error behind them
        found_q, found_w = [], []
        while len(q) or len(one[0]):
            # what has its error behind it goes on exactly
            oq, oat, olow, ohigh = one
            symbol = flat[oat]
            olow, ohigh = self.backward.narrowed(symbol, olow), self.backward.narrowed(symbol, ohigh)
            alive = ohigh > olow
            done = alive & (symbol == 0)
            found_q.append(oq[done])
            found_w.append(self.word_at[(self.n - 2 - self.backward.places[olow[done]]) % self.n])
            alive &= symbol != 0
            paths = [(oq[alive], oat[alive] + 1, olow[alive], ohigh[alive])]
            # an error here: a letter put in, replaced, or left out
            symbol = flat[at]
            lows, highs = self.extended(self.backward, low, high)
            lows, highs = lows[:, 1:], highs[:, 1:]
            i, c = np.nonzero(highs > lows)
            c += 1
            into = (lows[i, c - 1], highs[i, c - 1])
            paths.append((q[i], at[i], *into))
            replaced = (symbol[i] != 0) & (c != symbol[i])
            paths.append((q[i][replaced], at[i][replaced] + 1, into[0][replaced], into[1][replaced]))
            inside = symbol != 0
            paths.append((q[inside], at[inside] + 1, low[inside], high[inside]))
            # or none
            q, at, low, high, symbol = q[inside], at[inside], low[inside], high[inside], symbol[inside]
            low, high = self.backward.narrowed(symbol, low), self.backward.narrowed(symbol, high)
            alive = high > low
            q, at, low, high = q[alive], at[alive] + 1, low[alive], high[alive]
            one = [np.concatenate(x) for x in zip(*paths, strict=True)]
            if len(one[0]) > 16 * len(queries):  # paths that meet, as in a run of one letter, go on as one
                same = np.unique(np.stack(one), axis=1)
                one = list(same)
        return np.concatenate([*found_q, np.empty(0, np.int64)]), np.concatenate([*found_w, np.empty(0, np.int64)])


def _matched(key: tuple, table: pa.Table) -> pa.Table:
    """The near words of a block.  Words are reversed where the block is of last letters."""
    reverse = key[0].as_py() % 2 == 1
    turned = lambda w: w.encode("latin-1")[:: -1 if reverse else 1]
    part = {role: table.filter(pc.equal(table["is_query"], role)) for role in (True, False)}
    index_words, index_n = part[False]["word"].to_pylist(), part[False]["n"].to_numpy()
    words, n = part[True]["word"].to_pylist(), part[True]["n"].to_numpy()
    out = []
    if index_words and words:
        index = Index([turned(w) for w in index_words])
        for a in range(0, len(words), AT_ONCE):
            some = [turned(w) for w in words[a : a + AT_ONCE]]
            size = np.array([len(w) for w in some])
            q, w = index.near(some, size - size // 2 if reverse else size // 2)
            pairs = np.unique(np.stack([q + a, w]), axis=1)
            out += zip([words[x] for x in pairs[0]], n[pairs[0]].tolist(), [index_words[x] for x in pairs[1]], index_n[pairs[1]].tolist(), strict=True)
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """word, n, near, near_n: each word (distinct, of LEAST_LETTERS letters up to U+00FF) with each word one edit apart."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit(1).alias("side"), F.substring("word", -KEY, KEY).alias("key")))
    keyed = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.side", "e.key")
    total = words.count()
    hot = written(keyed.groupBy("side", "key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("side", "key", F.ceil(F.col("c") / most).alias("parts")), "hot-letters")
    # at most 2 * total / most rows
    keyed = keyed.join(F.broadcast(hot) if total <= most * 100_000 else hot, ["side", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    bucket = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(-(-total // block) or 1))).otherwise(F.xxhash64("key"))
    mine = F.pmod(F.xxhash64("word"), F.col("parts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    roles = F.flatten(F.transform(others, lambda p: F.array(F.struct(F.lit(False).alias("is_query"), mine.alias("i"), p.alias("j")), F.struct(F.lit(True).alias("is_query"), p.alias("i"), mine.alias("j")))))
    dealt = keyed.select("side", bucket.alias("bucket"), "word", "n", F.explode(roles).alias("r"))
    # two keys, cut or not, may share a unit's name: then they share a unit, which loses nothing
    unit = F.shiftleft(F.xxhash64("bucket", "r.i", "r.j"), 1).bitwiseOR(F.col("side"))
    return dealt.select(unit.alias("unit"), "r.is_query", "word", "n").groupBy("unit").applyInArrow(_matched, "word string, n long, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word of each chain of forms (word, form), by doubling steps."""
    at = written(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        dropped(at)
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def variants(documents: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = written(vocabulary(documents, least), "vocabulary")
    pairs = written(near_pairs(words), "near-words")
    top = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("near"))).alias("best"))
    found = words.join(top, "word", "left")
    taken = -F.col("best.least") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.least")).alias("form_n")), "forms")
    dropped(words, pairs)
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
