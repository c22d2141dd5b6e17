"""Near-duplicate operators against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.llm import common, embed_dedup, line_dedup, minhash, substring

DOCS = "doc_id long, text string"


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def brute_sets(docs):
    out = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def check_minhash(spark, docs):
    sets = brute_sets(docs)
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = minhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    return want


def variants(rnd, n, words=60, edits=3):
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 4) + rnd.choice("xyz") for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = f"w{rnd.random()}"
        out.append(" ".join(copy))
    return out


def test_minhash_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(3)
    docs += [(10_000 + k, t) for k, t in enumerate(variants(rnd, 40) + variants(rnd, 40, edits=5) + variants(rnd, 20, words=6, edits=1))]
    docs += [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "one two"), (20_004, "ONE  two"), (20_005, "été été"), (20_006, "ÉTÉ ÉTÉ"), (20_007, "one two\x1fthree")]
    want = check_minhash(spark, docs)
    assert want[20_004] == 20_003 and want[20_001] == 20_001
    assert len(set(want.values())) < len(docs) - 50


def test_minhash_of_an_empty_table_and_of_repeated_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], DOCS)
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert minhash.keep_first(twice.withColumn("signature", F.lit(1))).count() == 2
    other = spark.createDataFrame([(5, "a b c d e f"), (5, "g h i j k l"), (7, "g h i j k l"), (1, "a b c d e f"), (8, "x y"), (5, None)], DOCS)
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(other).collect()) == [(1, 1), (5, 1), (5, 1), (5, 5), (7, 1), (8, 8)]


def test_minhash_of_a_hot_block_meets_few_pairs(spark, monkeypatch):
    """400 documents that share three quarters of their shingles and are no links: almost no pair is met."""
    rnd = random.Random(2)
    common = [f"c{k}" for k in range(300)]
    docs = [(k, " ".join(common + [f"u{rnd.random()}" for _ in range(80)])) for k in range(400)]
    met = []
    agreeing = minhash.verifier

    def counting(reps, documents):
        verify = agreeing(reps, documents)

        def counted(pairs):
            met.append(pairs.count())
            return verify(pairs)

        return counted

    monkeypatch.setattr(minhash, "verifier", counting)
    got = minhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert all(r.kept for r in got) and len(got) == 400 and 0 < sum(met) < 4000


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    want = components({x for p in links for x in p}, links)
    got = common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {i: c for i, c in want.items() if i in linked}
    assert len({r.node for r in got}) == len(got)


def test_links_in_blocks_bridges_through_members_that_miss_the_first(spark):
    # in one block 1 links with 2 only, 3 with 4, 2 with 3: the star at 1 alone would lose 3 and 4
    near = {(1, 2), (2, 3), (3, 4)}
    good = spark.createDataFrame(sorted(near), "a long, b long")
    members = spark.createDataFrame([(7, k) for k in (1, 2, 3, 4, 5)], "block long, node long")
    found, _ = common.links_in_blocks(members, lambda pairs: pairs.join(good, ["a", "b"], "left_semi"))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("seed", range(3))
def test_links_in_blocks_match_all_pairs(spark, monkeypatch, seed):
    """Nodes on a line, linked when near, in blocks larger than what a star can reach; members repeated."""
    rnd = random.Random(seed)
    where = {k: rnd.random() for k in range(120)}
    members = [(b, k) for k in where for b in range(4) if rnd.random() < 0.6] * 2
    blocks = {b: {k for c, k in members if c == b} for b in range(4)}
    near = sorted({(a, b) for k in blocks.values() for a in k for b in k if a < b and abs(where[a] - where[b]) < 0.01})
    good = spark.createDataFrame(near, "a long, b long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.join(good, ["a", "b"], "left_semi")

    found, _ = common.links_in_blocks(spark.createDataFrame(members, "block long, node long"), verify)
    linked = {x for p in near for x in p}
    want = components(linked, near)
    assert {r.node: r.component for r in found.collect()} == want and len(asked) > 2


def test_embeddings_match_brute_force(spark, sf, monkeypatch):
    base = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:200]
    rnd = np.random.default_rng(5)
    dim = len(base[0][1])
    rows = list(base)
    for k in range(60):
        rows.append((5_000 + k, (np.array(base[k % 7][1]) + rnd.normal(size=dim) * 0.035).tolist()))
    rows += [(9_000, None), (9_001, [0.0] * dim), (9_002, [float("nan")] * dim), (9_003, [1.0] * (dim - 1) + [None]), (9_004, []), (9_005, (3e30 * np.array(base[0][1])).tolist()), (9_006, [float("inf")] * dim)]
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ok = {i: np.array(v, np.float32).astype(float) for i, v in ok.items()}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95]
    want = components([i for i, _ in rows], links)
    for block in (4096, 16):  # one block, and many
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        counts, edges = embed_dedup.links(df, block=block)
        n = {r.vec_id: r.n_links for r in counts.collect()}
        assert n == {i: c for i in ok if (c := sum(i in p for p in links))}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (n.get(i, 0), want[i], want[i] == i) for i, _ in rows}
    assert len(links) > 60
    assert embed_dedup.near_duplicates(df.where("false")).collect() == []
    unnamed = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.n_links, r.component_id or 0, r.kept) for r in embed_dedup.near_duplicates(unnamed).collect()) == [(0, 0, False), (0, 1, True)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, s, n, alphabet="abcé"):
    s = list(s)
    for _ in range(n):
        kind, at = rnd.randrange(3), rnd.randrange(len(s) + 1)
        if kind == 0:
            s.insert(at, rnd.choice(alphabet))
        elif s and at < len(s):
            s[at : at + 1] = [rnd.choice(alphabet)] if kind == 1 else []
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rnd = random.Random(tau)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc"), ("abcabcabc" * 9, "abcabcabc" * 9 + "ab")]
    for _ in range(1500):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 40)))
        pairs.append((a, edited(rnd, a, rnd.randint(0, tau + 2))))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: r.near for r in df.select("k", line_dedup.within_edits(F.col("a"), F.col("b"), tau).alias("near")).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == (distance(a, b) <= tau), (a, b)


def test_parities_bound_the_distance(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(400):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 60)))
        n = rnd.randint(0, 3)
        rows.append((k, a, edited(rnd, a, n) or "a", n))
    df = spark.createDataFrame(rows, "k int, a string, b string, n int").withColumns({"x": line_dedup.parities(F.col("a")), "y": line_dedup.parities(F.col("b"))})
    flips = df.select("n", *(F.expr(f"bit_count(x.{c} ^ y.{c})").alias(c) for c in ("bigrams", "letters"))).collect()
    assert all(r.bigrams <= 4 * r.n and r.letters <= 2 * r.n for r in flips)


def brute_lines(docs):
    """doc_id -> text with all lines but the first of each class removed."""
    lines = [(i, k, line.strip(" ")) for i, t in sorted(docs, key=lambda d: d[0]) if t for k, line in enumerate(t.split("\n")) if re.search(r"[^ \t\n\x0B\f\r]", line.strip(" "))]
    names = sorted({x for *_, x in lines})
    long = [n for n in names if len(n) >= line_dedup.LEAST_CHARS]
    number = {n: k for k, n in enumerate(names)}
    links = [(number[a], number[b]) for n, a in enumerate(long) for b in long[n + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    klass = components(range(len(names)), links)
    seen, out = set(), {i: (t.split("\n") if t is not None else None) for i, t in docs}
    for i, k, x in lines:
        c = klass[number[x]]
        if c in seen:
            out[i][k] = None
        seen.add(c)
    return {i: None if t is None else "\n".join(x for x in t if x is not None) for i, t in out.items()}, len(links)


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(30, 50))).strip() for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 5))]
        docs.append((i, "\n".join([*parts, rnd.choice(["", "short", " short ", "\t"])])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, base[0]), (104, "x" * 5000 + "y"), (105, "x" * 5000 + "z")]
    want, n = brute_lines(docs)
    assert n > 20
    names = "n_removed string, place int, gone_places int, line string"
    df = spark.createDataFrame([(i, t, "e", 1, 2, "l") for i, t in docs], f"{DOCS}, {names}")
    got = line_dedup.without_repeats(df)
    assert got.columns == ["doc_id", "text", "place", "gone_places", "line", "n_removed"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want and {(r.place, r.gone_places, r.line) for r in rows} == {(1, 2, "l")}
    lost = {i: len(t.split("\n")) - len(want[i].split("\n")) for i, t in docs if t and want[i]}
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in lost} == lost
    twice = line_dedup.without_repeats(df.unionAll(df)).collect()  # rows of one doc_id lose the same lines
    assert sorted((r.doc_id, r.text or "") for r in twice) == sorted((i, t or "") for i, t in [*want.items()] * 2)
    assert line_dedup.without_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_repeated_passages(spark, sf):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    clean = [(i, text(rnd.randint(1, 400))) for i in range(50)]
    hit = [(100 + i, f"{text(rnd.randint(3, 60))} {passage} {text(rnd.randint(3, 60))}") for i in range(30)]
    inner = [(200, " ".join([passage[::-1]] * 4)), (201, None), (202, ""), (203, "é" * 3000)]
    df = spark.createDataFrame(clean + hit + inner, DOCS)
    spans = substring.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == set(range(101, 130))
    texts = dict(clean + hit + inner)
    assert all(texts[r.doc_id][r.span_start : r.span_end].strip() in passage and r.source_doc_id == 100 for r in spans)
    clashing = df.selectExpr("*", "1 as gone_spans", "2 as span_start")
    cut_rows = substring.without_spans(clashing, spark.createDataFrame(spans)).collect()
    assert {(r.gone_spans, r.span_start) for r in cut_rows} == {(1, 2)}
    cut = {r.doc_id: r.text for r in cut_rows}
    assert cut[100] == texts[100] and cut[201] is None and len(cut[101]) < len(texts[101]) - 150
    assert substring.repeated_spans(df.where("false")).collect() == []


def test_cuts_resist_shifts():
    gear = substring.gear_table()
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, 5000, dtype=np.uint8)
    moved = np.concatenate([data[:1000], np.frombuffer(b"inserted", np.uint8), data[1000:]])
    a, b = set(substring.cuts(data, gear).tolist()), set(substring.cuts(moved, gear).tolist())
    assert {x for x in a if x < 980} == {x for x in b if x < 980}
    assert {x + 8 for x in a if x > 1100} == {x for x in b if x > 1108}
    assert np.diff(sorted(b), prepend=0).max() <= substring.LONGEST


@pytest.mark.parametrize("low_variety", [False, True])
def test_passages_just_over_the_bound(spark, low_variety):
    """Passages of 51 words, or of 100 that mostly repeat one word, between unrelated contexts: all are found, whole."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    rows, where = [], {}
    for k in range(300):
        common = word()
        passage = " ".join(common if low_variety and rnd.random() < 0.8 else word() for _ in range(100 if low_variety else 51))
        for doc in (k, 1000 + k):
            before, after = (" ".join(word() for _ in range(60)) for _ in range(2))
            rows.append((doc, f"{before} {passage} {after}"))
            where[doc] = (len(before) + 1, len(before) + 1 + len(passage))
    found = {r.doc_id: r for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(1000, 1300) if k not in found] == [] and min(found) == 1000
    texts = dict(rows)
    for k, r in found.items():
        assert r.span_start <= where[k][0] and r.span_end >= where[k][1] and r.source_doc_id == k - 1000
        assert texts[k][r.span_start : r.span_end] in texts[k - 1000]


def plain_spans(rows, least=51):
    """Unions of overlapping stretches of 51 words that a document of smaller id has, character by character."""
    texts, owner, out = {}, {}, []
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = max(texts.get(i, t), t)
    for i in sorted(texts):
        t, spans, own = texts[i], [], []
        words = [m.span() for m in re.finditer("[^\\t-\\r ]+", t)]
        for j in range(len(words) - least + 1):
            a, b = words[j][0], words[j + least - 1][1]
            own.append(t[a:b])
            if t[a:b] in owner:
                if spans and a < spans[-1][1]:
                    spans[-1][1:3] = [b, j + least]
                    spans[-1][4].append(owner[t[a:b]])
                else:
                    spans.append([a, b, j + least, j, [owner[t[a:b]]]])
        for p in own:
            owner.setdefault(p, i)
        copied = min(x for x in texts if texts[x] == t)  # of a whole copy the source is the smallest one
        out += [(i, a, b, end - first, copied if copied < i else min(set(o), key=lambda x: (-o.count(x), x))) for a, b, end, first, o in spans]
    return sorted(out)


def found_spans(df):
    return sorted(tuple(r)[:5] for r in substring.repeated_spans(df).collect())


def test_passages_of_the_table_match_plain_loops(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_spans([(r.doc_id, r.text) for r in df.collect()])
    assert found_spans(df) == want and want


def test_passages_match_plain_loops(spark):
    """Passages one after another from different documents, cut short, in copies, under one doc_id, across line ends."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijé") for _ in range(rnd.randint(1, 9)))
    text = lambda n: "".join(word() + rnd.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))
    parts = [text(n) for n in (24, 24, 24, 40, 50, 51, 52, 60, 90, 200)]
    rows = [(i, parts[i]) for i in range(3)] + [(3, parts[0] + parts[1] + parts[2])]  # nothing whole: 24 words from each
    rows += [(10 + i, text(rnd.randint(0, 80)) + p + text(rnd.randint(0, 80))) for i, p in enumerate(parts)]
    rows += [(40 + i, "".join(text(rnd.randint(0, 9)) + rnd.choice(parts) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[10:30])] + [(300 + i, f"\n {t} ") for i, (_, t) in enumerate(rows[10:20])]
    rows += [(5, text(70)), (5, "z" + text(70)), (400, rows[-1][1]), (None, parts[9]), (401, None), (402, " \n"), (403, ""), rows[12], rows[12]]
    rows += [(404, rows[-9][1] + parts[9]), (405, "a " * 3000), (406, "b " + "a " * 3000), (407, "word" * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, digest int, word int")
    want = plain_spans(rows)
    assert found_spans(df) == want and not any(r[0] == 3 for r in want)
    assert found_spans(df.where("false")) == []


def test_repeated_doc_ids_are_cut_where_the_span_lies(spark):
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(60))
    df = spark.createDataFrame([(1, passage), (2, "zz " + passage), (2, "a" * 500), (2, "zz " + passage)], DOCS)
    cut = substring.without_spans(df, substring.repeated_spans(df)).collect()
    assert sorted((r.doc_id, r.text) for r in cut) == [(1, passage), (2, "a" * 500), (2, "zz "), (2, "zz ")]


def test_passages_of_few_words_take_linear_time(spark):
    """Two texts of one repeated word."""
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([(1, "la " * n), (2, "x " + "la " * n)], DOCS)
        began = time.time()
        (span,) = substring.repeated_spans(df).collect()
        took.append(time.time() - began)
        assert (span.doc_id, span.span_start, span.n_words) == (2, 2, n)
    assert took[1] < 6 * took[0]
