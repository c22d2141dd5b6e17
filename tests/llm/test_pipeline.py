"""The corpus pipeline, stage by stage, against plain Python."""

import random

import pytest

import corpus_pipeline as cp
from vellumetry.llm import packing, pii, quality, queries
from tests.llm.test_dedup import brute_lines, brute_sets, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, gone_places int"


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    line = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    shared = line(12)
    texts = [line(90) for _ in range(30)]
    docs = [(k, f"{t}\n{shared}\nmail u{k}@b.cc") for k, t in enumerate(texts)]
    docs += [(100 + k, t + " more\n" + line(12)) for k, t in enumerate(texts[:8])]
    docs += [(200, None), (201, ""), (202, "same words " * 200), (203, "too few")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 1, 2) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_and_the_whole(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = cp.quality_rules(spark, docs, made)
    # too few labels for a level, so the base rule alone decides
    want = {i: t for i, t in texts.items() if (f := quality.features(t))[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    assert good.columns == docs.columns and {r.doc_id: r.text for r in good.collect()} == want

    once = cp.dedup_lines(spark, good, made)
    lines, _ = brute_lines(list(want.items()))
    want = {i: t for i, t in lines.items() if t.strip()}
    rows = once.collect()
    assert once.columns == docs.columns and {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows) and any(len(t) < len(texts[i]) for i, t in want.items())

    apart = cp.minhash_dedup(spark, once, made)
    sets = brute_sets(list(want.items()))
    links = [(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    first = components(sorted(sets), links)
    want = {i: t for i, t in want.items() if first[i] == i}
    assert links and {r.doc_id: r.text for r in apart.collect()} == want

    masked = cp.personal_data(spark, apart, made)
    want = {i: pii.masked(t) for i, t in want.items()}
    assert masked.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in masked.collect()} == {i: (t, len(t)) for i, t in want.items()}
    assert sum("<EMAIL>" in t for t in want.values()) >= 30 - len(links)

    packed = cp.best_fit_packing(spark, masked, made).collect()
    counter = packing.Counter(queries.tokenizer("byte_bpe_50k.json"), 2)
    assert {r.doc_id: r.length for r in packed} == {i: len(counter.ids(t)) for i, t in want.items()}
    assert {r.doc_id for r in cp.run(spark, made).collect()} == set(want)


def test_an_empty_corpus(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, made)
        assert out.count() == 0
        docs = docs if "sequence_id" in out.columns else out
