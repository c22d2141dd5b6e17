"""The defined cases that other tests don't reach: repeated and null keys, empty tables, clashing names, very long texts, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.llm import bpe, chat, embed_dedup, html_extract, line_dedup, minhash, packing, pii, quality, queries

BPE, PACK = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def test_pages_without_a_url_are_a_host_and_hosts_of_one_page_rest_on_the_page(spark):
    box = "<html><body><div class=top>Welcome</div><article><p>Story {0}.</p></article></body></html>"
    plain = "<html><body><div class=top>Hello there</div><div><p>Story {0}.</p></div></body></html>"
    rows = [(k, None, plain.format(k)) for k in range(5)] + [(10 + k, f"http://h{k}.example/", box.format(k)) for k in range(30)]
    got = {r.page_id: r.text for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(5)] == [f"Story {k}." for k in range(5)] and all(got[10 + k] == f"Story {k}." for k in range(30))


def test_a_repeated_vec_id_is_its_greatest_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, None), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, False)], key=repr)


def test_long_messages_and_other_columns(spark):
    long = "[INST] <\\s> é" * 40_000
    rows = [(1, 0, "user", long, 7, "x"), (1, 1, "assistant", long, 7, "x"), (1, 1, "assistant", long, 7, "x")]
    (row,) = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree_id int, message string")).collect()
    assert row.n_turns == 3 and row.loss_chars == 2 * len(long) and row.formatted_chars > 3 * len(long)


def test_bpe_of_repeated_rows_clashing_names_and_nothing(spark):
    df = spark.createDataFrame([(1, "some words", 9, "old"), (1, "some words", 9, "old"), (2, None, 9, "old")], "doc_id long, text string, token_ids int, decoded string")
    rows = sorted(map(tuple, bpe.digests(df, BPE).collect()))
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2][:2] == (2, 0)
    assert bpe.digests(df.where("false"), BPE).collect() == []
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    want = library.decode(library.encode("some words", add_special_tokens=False).ids, skip_special_tokens=False)
    assert sorted(r.decoded for r in bpe.decode_ids(bpe.encode_texts(df, BPE), BPE).collect()) == ["", want, want]


def test_minhash_of_a_very_long_text(spark):
    long = " ".join(f"word{k % 7919}x{k // 7919}" for k in range(120_000))
    rows = [(1, long), (2, long + " more words at the end"), (3, " ".join(long.split()[:60_000])), (4, "x" * 2_000_000), (5, "x" * 2_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (119_996, 1), 2: (120_001, 1), 3: (59_996, 3), 4: (1, 4), 5: (1, 4)}


def test_packing_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c"), (None, None), (3, "same text"), (3, "same text"), (4, "long " * 3000)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), PACK).collect()
    from tokenizers import Tokenizer

    size = lambda text: len(Tokenizer.from_file(PACK).encode(text, add_special_tokens=False).ids) + 1
    assert sorted((r.doc_id is None, r.piece, r.length) for r in got if r.doc_id != 4) == sorted([(True, 0, size("a b c")), (True, 0, 1), *[(False, 0, size("same text"))] * 2])
    spans = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, p, _) in zip(spans, spans[1:]):
        assert p == (o + n if s == t else 0)
    assert all(o + n <= 1024 for _, o, n in spans) and spans[0][1] == 0


def plain_best_fit(lengths, capacity, most_documents, most_attention):
    """Each piece, longest first, against all bins: the least weighted residual norm, of equal ones any."""
    bins, where = [], [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        x = lengths[k]
        room = [(b, capacity - sum(b) - x, most_documents - len(b) - 1, most_attention - sum(y * y for y in b) - x * x) for b in bins]
        fits = [((t / capacity) ** 2 + (1e-3 * d / most_documents) ** 2 + (1e-3 * a / most_attention) ** 2, n) for n, (_, t, d, a) in enumerate(room) if min(t, d, a) >= 0]
        at = min(fits)[1] if fits else len(bins)
        if at == len(bins):
            bins.append([])
        bins[at].append(x)
        where[k] = at
    return bins, where


@pytest.mark.parametrize("most_documents, most_attention", [(1000, 10**6), (6, 10**6), (1000, 3000), (5, 2500)])
def test_best_fit_matches_plain_loops(most_documents, most_attention):
    rng = np.random.default_rng(most_documents + most_attention)
    for n in (0, 1, 40, 150):
        lengths = rng.integers(1, 50, n)
        bins, offsets = packing.best_fit(lengths, 100, most_documents, most_attention)
        want, _ = plain_best_fit(lengths.tolist(), 100, most_documents, most_attention)
        got = [sorted(lengths[bins == b].tolist()) for b in np.unique(bins)]
        assert sorted(got) == sorted(sorted(b) for b in want)
        for b in np.unique(bins):
            at = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][at]) - lengths[bins == b][at] == offsets[bins == b][at]).all()


def test_personal_data_of_repeated_rows_clashing_names_and_nothing(spark):
    text = "write to a.b@c.de or +49 30 1234567"
    df = spark.createDataFrame([(1, text, 5, "q"), (1, text, 5, "q"), (2, None, 5, "q")], "doc_id long, text string, n_email int, base string")
    rows = sorted(map(tuple, pii.digests(df).collect()))
    assert len(rows) == 3 and rows[0] == rows[1] and rows[0][1:5] == (1, 0, 0, 1) and rows[2][1:5] == (0, 0, 0, 0)
    assert pii.digests(df.where("false")).collect() == []
    masked = pii.mask(df).collect()
    assert {(r.n_email, r.base) for r in masked} == {(5, "q")} and sum("a.b@c.de" in (r.text or "") for r in masked) == 0


def test_line_ties_go_to_the_smaller_place(spark):
    line = "This line of some length stands here twice and then again."
    rows = [(2, f"{line}\nown two\n{line}"), (1, f"own one\n{line[:-1]}!\n{line}")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (f"own one\n{line[:-1]}!", 1), 2: ("own two", 2)}


def test_several_labels_of_a_document_count_each(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(k, "en", text) for k in range(50)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k % 50, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    assert quality.thresholds(quality.with_features(docs, keep=["doc_id", "lang"]), labels).count() == 1
    assert quality.thresholds(quality.with_features(docs, keep=["doc_id", "lang"]), labels.where("doc_id < 5")).count() == 0
    assert quality.verdicts(docs, labels).where("kept").count() == 50
    assert quality.verdicts(docs.withColumn("lang", F.lit(None).cast("string")), labels).where("kept").count() == 50
