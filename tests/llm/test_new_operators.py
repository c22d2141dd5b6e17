"""Top-k search, spelling variants and collocations against plain loops."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.llm import collocations, queries, spelling, topk

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_top(rows, k=20, every=20):
    whole = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i].append(v)
    held = {i: [math.floor(64 * x) for x in max(vs)] for i, vs in whole.items()}
    out = []
    for q in held:
        if q % every == 0:
            score = lambda c: min(max(sum(a * b for a, b in zip(held[q], held[c])), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
            scores = sorted((-score(c), c) for c in held if c != q)[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def top(df, **of):
    return sorted(map(tuple, topk.top_scores(df, F.col("vec_id") % 20 == 0, **of).collect()))


def test_top_scores_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_top_scores(spark, sf).select("query_id", "rank", "vec_id", "score").collect())) == plain_top(rows)


@pytest.mark.parametrize("blocks", [(16, 8), (1000, 1000)])
def test_top_scores_of_odd_vectors(spark, blocks):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, 0.02, -0.5, 0.25, 3.0]) for _ in range(rng.choice([0, 3, 6]))]) for i in range(70)]
    rows += [(i, [1.0, 0.5]) for i in range(100, 140)]  # ties, more than k
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf"), 1.0]), (None, [1.0]), (280, [1e300, 1.0]), (281, [-1e300]), (282, [1e9, 2.0]), (-20, [2.0])]
    rows += [(0, [0.5]), (20, [9.0, 9.0])]  # repeated ids
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert top(df, k=20, most_candidates=blocks[0], most_queries=blocks[1]) == plain_top(rows)


def test_top_scores_of_few_and_none(spark):
    assert top(spark.createDataFrame([], VECTORS)) == []
    df = spark.createDataFrame([(20, [1.0], 0), (7, [2.0], 0)], VECTORS).withColumn("rank", F.lit(3)).withColumn("unit", F.lit(1))
    assert top(df) == [(20, 1, 7, 64 * 128)]


# ---- spelling


def plain_words(rows, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(words):
    near, by_gap = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            by_gap[w[:k], w[k:]].add(w)
            if k < len(w):
                by_gap[w[:k], w[k + 1 :]].add(w)
    for group in by_gap.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def found_variants(df, **of):
    return sorted(map(tuple, spelling.variants(df, **of).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_spelling_variants_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op11_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == plain_variants(plain_words(rows)) and any(r[1] for r in got)


def test_spelling_variants_of_odd_texts(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("ab") for _ in range(7)) for _ in range(40)] + ["Étranger", "étranger", "a" * 60, "a" * 61, "a" * 62, "colour", "colours", "color", "x" * 6]
    texts = [(i, " ".join(rng.choice(bases).upper() if rng.random() < 0.3 else rng.choice(bases) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows = [*texts, *texts[:20], (None, "colours colours, colours"), (None, None), (900, ""), (901, "under" * 30_000 + " colour" * 2000), (902, "colour" + "é" * 3)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert found_variants(df) == plain_variants(plain_words(rows))


def test_spelling_variants_of_nothing(spark):
    assert found_variants(spark.createDataFrame([], "doc_id long, text string")) == []
    assert found_variants(spark.createDataFrame([(1, "some words")], "doc_id long, text string")) == []


def test_near_words_of_hot_letters(spark):
    """Letters that many words share are cut into parts, searched in each other's index."""
    rng = random.Random(8)
    words = {"pre" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(300)} | {"".join(rng.choice("xyz") for _ in range(6)) for _ in range(200)}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(df, block=64, most=40).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# ---- collocations


def plain_collocations(rows, first=2000, least=100, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    held = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in held.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= share * f[lang, p[i : i + k]]:
                    gone.add((lang, p[i : i + k]))
    out = defaultdict(list)
    for (lang, p), a in held.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, rank, *r[3:]) for lang, rs in out.items() for rank, r in enumerate(sorted(rs)[:first], 1))


def found_collocations(df, **of):
    return sorted(map(tuple, collocations.collocations(df, **of).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_collocations_of_the_table(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_collocations(spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain_collocations(rows) and len(got) > 5
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert found_collocations(df, least=6, first=300) == plain_collocations(rows, 300, 6)


@pytest.mark.parametrize("small", [False, True])
def test_collocations_of_odd_texts(spark, monkeypatch, small):
    """Also with tries that burst and spill, words that are numbered anew, windows inside words, and filters that take all."""
    if small:
        for name, value in (("BURST", 4), ("MOST_HELD", 20), ("MOST_WORDS", 12), ("AT_ONCE", 40), ("WINDOW", 7), ("MOST_BITS", 64)):
            monkeypatch.setattr(collocations, name, value)
    rng = random.Random(4)
    words = ["a", "B", "b", "Été", "été", "x y", "\x00", "\x1c", "new", "york", "long" * 9]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", " ,", "  "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), some(rng.randrange(60))) for _ in range(150)]
    rows += rows[:30] + [("en", None), ("en", ""), ("fr", "one two. three"), ("en", "new york new york " * 400), (None, ".,;")]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, n int, phrase string, k int")
    for of in ({"least": 3}, {"least": 8, "first": 7}, {"least": 5, "share": 60}):
        assert found_collocations(df, **of) == plain_collocations(rows, of.get("first", 2000), of["least"], of.get("share", 100))


def test_collocations_of_nothing(spark):
    assert found_collocations(spark.createDataFrame([], "lang string, text string")) == []


def test_scores_are_exact_past_64_bits(spark):
    a, n, l, r = 9_007_199_254_740_993, 1_000_000_000_000_007, 9_007_199_254_740_997, 9_007_199_254_740_999
    frequent = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, l), ("en", "q", 1, r)], "lang string, phrase string, k int, f long")
    got = collocations.scored(frequent, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got.score == 1000 * a * n // (l * r)


def test_trie_bursts_and_leaves_whole_subtrees(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 3)
    rng = np.random.default_rng(2)
    trie, want = collocations.Trie(), Counter()
    for _ in range(30):
        k = int(rng.integers(2, 6))
        rows, counts = np.unique(rng.integers(0, 4, (20, k)), axis=0, return_counts=True)
        trie.add(rows, counts)
        want.update({tuple(r): c for r, c in zip(rows.tolist(), counts.tolist())})
    runs = list(trie.taken(0))
    assert trie.held == 0 and all(run == sorted(run) or len(run) == 1 for run in runs)
    got = Counter({tuple(np.frombuffer(p, ">i4").tolist()): n for run in runs for p, n in run})
    assert got == want and sum(map(len, runs)) == len(want)
