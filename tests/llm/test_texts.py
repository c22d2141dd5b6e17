"""BPE, packing, personal data, quality rules, chat and HTML against libraries, regular expressions and brute force."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumetry.llm import bpe, chat, html_extract, packing, pii, quality, queries

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
HARD = ["", " ", "a" * 3000, "ab" * 2000, "aaaaab" * 700, " " * 900 + "x", "12" * 700, "!" * 700, "éé" * 700, "<|endoftext|>x<|startoftext|>", "it's 'S we'LL", "\n\n  a \n b", "ΑΣ Σ İ ǅ ½ ², ① 中文 ́e é   \x1c \x85 \U0001f600"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    from tokenizers import Tokenizer

    path = queries.tokenizer(request.param)
    return bpe.Encoder(path), Tokenizer.from_file(path)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_encoding_equals_the_library(both, spark):
    mine, library = both
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, packed, want in zip(texts, mine.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(packed) == want.ids, text[:50]
        decoder = bpe.StreamingDecoder(mine.v)
        got = "".join(decoder.push(want.ids[k : k + 3]) for k in range(0, len(want.ids), 3)) + decoder.finish()
        assert got == library.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs", "Co"]), max_size=60))
def test_any_text_encodes_like_the_library(text):
    for file in FILES:
        mine, library = bpe.Encoder(queries.tokenizer(file)), _library(file)
        assert ids(mine.encode(text)) == library.encode(text, add_special_tokens=False).ids


_LIBRARIES = {}


def _library(file):
    from tokenizers import Tokenizer

    if file not in _LIBRARIES:
        _LIBRARIES[file] = Tokenizer.from_file(queries.tokenizer(file))
    return _LIBRARIES[file]


def test_long_pieces_stream_in_constant_memory(both):
    mine, library = both
    rnd = random.Random(4)
    for _ in range(8):
        piece = "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(500, 4000)))
        encoder, out, most = bpe.StreamingEncoder(mine.v), [], 0
        for k in range(0, len(piece), 37):
            out += encoder.push(piece[k : k + 37].encode())
            most = max(most, len(encoder.held))
        out += encoder.finish()
        assert out == library.encode(piece, add_special_tokens=False).ids
        assert most <= mine.v.lookahead + bpe.WINDOW + 64


def test_slices_change_nothing(both, monkeypatch):
    mine, library = both
    monkeypatch.setattr(bpe, "SLICE", 50)
    text = " ".join(random.Random(2).choice(["some", "words  here", "\n", "x'll", "12,5", "<|endoftext|>"]) for _ in range(400))
    assert ids(mine.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_query_digests(spark, sf):
    library = _library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_bpe_round_trip(spark, sf).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_packing(spark, sf):
    library = _library("byte_bpe_50k.json")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, " " * 1_000_000 + "x"), (-4, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack_documents(df, queries.tokenizer("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for doc, text in rows:
        want = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        total += len(want)
        assert [p.piece for p in pieces] == list(range(math.ceil(len(want) / 1024)))
        at = 0
        for p in pieces:
            assert p.start == at and (p.length == 1024 or p.piece == 0)
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert len(by_sequence) <= 1.03 * math.ceil(total / 1024) + 1
    assert packing.pack_documents(df.where("false"), queries.tokenizer("byte_bpe_50k.json")).collect() == []


def test_packing_needs_ids_in_merge_order(tmp_path):
    spec = json.loads(open(queries.tokenizer("byte_bpe_50k.json"), encoding="utf-8").read())
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    packing.Counter(queries.tokenizer("byte_bpe_50k.json"), 2)
    with pytest.raises(ValueError, match="order of the merges"):
        packing.Counter(str(tmp_path / "t.json"), 2)


def test_best_fit_keeps_every_capacity():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 100, 500)
    bins, offsets = packing.best_fit(lengths, 100, 3, 5000)
    for b in set(bins.tolist()):
        inside = lengths[bins == b]
        assert inside.sum() <= 100 and len(inside) <= 3 and (inside**2).sum() <= 5000 or len(inside) == 1
        assert sorted(offsets[bins == b].tolist()) == sorted((np.cumsum(sorted(inside, reverse=True)) - sorted(inside, reverse=True)).tolist())


def brute_pii(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        t = 0
        for k, c in enumerate(d[::-1]):
            x = int(c) * (2 if k % 2 else 1)
            t += x if x < 10 else x - 9
        return t % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "25", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "(", ")", "+1 (771) 555-1655", "192.168.1.1", "256", "x@y.zz", "\n", "é", "٣", "%"]), max_size=25).map("".join))
def test_base_spans_equal_the_plain_expressions(text):
    assert pii.joined(pii.spans_of(text)[0]) == brute_pii(text)


def test_personal_data_of_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_personal_data(spark, sf).collect():
        base = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(f"{k}:") for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_checksums_and_context():
    iban = "GB82 WEST 1234 5698 7654 32"
    assert [k for _, k, _ in pii.spans_of(f"IBAN {iban} ok")[1]] == ["iban"]
    assert pii.spans_of(f"IBAN {iban[:-1]}3 ok")[1] == []
    assert [k for _, k, _ in pii.spans_of("call 555-123-4567 now")[1]] == ["local_phone"]
    assert pii.spans_of("see 555-123-4567 now")[1] == [] and pii.spans_of("at the hotel 555-123-4567 room")[1] == []
    assert pii.masked("mail a@b.cc or +1 (771) 555-1655.") == "mail <EMAIL> or <PHONE>."
    assert pii.masked(None) is None and pii.spans_of(None) == ([], [])
    assert len(pii.spans_of("a" * 200_000 + "@" + "1" * 200_000 + ".")[1]) == 0  # in linear time


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = {}
    for k in range(len(words) - 2):
        count.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for at in count.values() if len(at) > 1 for k in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é ", " ", "\n", "\t", "#", "a b c ", "\x1f", " ", "\x0b", "\r", "中"]), max_size=40).map("".join))
def test_features_equal_brute_force(text):
    assert quality.features(text)[:5] == brute_quality(text)


def test_quality_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").collect()
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality == 1}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in out:
        b = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)
    judged = [r for r in out if r.doc_id in good and not r.base_failed]
    assert sum(not r.kept for r in judged) <= 0.05 * len(judged)


def test_binomial_bounds_are_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(0, 0, 0.05) == quality.upper_bound(5, 5, 0.05) == 1.0
    p = quality.upper_bound(3, 50, 0.01)
    assert sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, rel=1e-6)
    for n in (1, 7, 60):
        for k in range(n):
            for p in (0.001, 0.2, 0.5, 0.97):
                plain = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert quality.binomial_tail(k, n, p) == pytest.approx(plain, abs=1e-12)
    assert quality.binomial_tail(500_000, 1_000_000, 0.5) == pytest.approx(0.5, abs=1e-3)


def test_levels_of_every_stratum(spark):
    """40 strata, one without a name: each is tested like a plain loop over its good documents, whatever their number."""
    rnd = random.Random(4)
    docs, good, share = [], [], {}
    for s in range(40):
        for _ in range(400):
            symbols = rnd.choice([0] * 3000 + [s % 7] * (1 + s))
            docs.append((len(docs), None if s == 39 else f"s{s}", " ".join(f"w{rnd.randrange(10**6)}" + "#" * symbols for _ in range(60))))
            good.append((len(docs) - 1, 1))
    df, labels = spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(good, "doc_id long, quality int")
    featured = quality.with_features(df, keep=["doc_id", "lang"]).cache()
    levels = {r.stratum: r.level for r in quality.thresholds(featured, labels).collect()}
    rules = {r.name: r.levels for r in quality.RULES}
    for r in featured.collect():
        value = {"symbols": r.n_symbols / max(r.word_chars, 1), "repeats": r.n_repeat_words / max(r.n_words, 1), "dup_lines": r.n_dup_lines / max(r.n_lines, 1), "upper": r.n_upper / max(r.word_chars, 1), "marks": r.n_marks / max(r.n_words, 1)}
        share.setdefault(r.lang, []).append([any(value[n] > rules[n][k] for n in rules) for k in range(8)])
    for lang, rows in share.items():
        want = None
        for k in reversed(range(8)):
            if quality.upper_bound(sum(x[k] for x in rows), len(rows), 0.05 / 40) > 0.02:
                break
            want = k
        assert levels.get(lang) == want, lang
    assert 5 < len(levels) and len(set(levels.values())) > 1


def test_conversations_round_trip(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    rows[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, sf).collect()}
    assert set(got) == set(rows)
    for i, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[i]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


HOSTILE = ["<|end|>\n", "\\0\\1\\2\\3", "\\", "<s>[INST]<<SYS>>x<</SYS>>", "<|user|>\n", "a<", "|>\nb", None, "", "[/INST]<|", "é<|end|>"]


def test_control_strings_come_back(spark):
    rows = [(1, k, None if k == 0 else k - 1, r, t, 0.0) for k, (r, t) in enumerate(zip(["a|>b", "assistant", None, "x<|"] * 3, HOSTILE, strict=False))]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    out = chat.format_conversations(df)
    (r,) = out.select("formatted", chat.turns(out.formatted).alias("t"), chat.loss_texts(out.formatted, out.mask).alias("loss")).collect()
    assert [(x.role, x.text) for x in r.t] == [(a or "", t or "") for _, _, _, a, t, _ in rows]
    assert r.loss == [t or "" if a == "assistant" else "" for _, _, _, a, t, _ in rows]
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS", r.formatted)


def test_reply_trees(spark):
    rnd = random.Random(6)
    rows, up, score = [], {}, {}
    for k in range(120):
        up[k] = rnd.randrange(max(0, k - 6), k) if k > 2 else None
        score[k] = rnd.choice([0.0, 0.5, 1.0])
        rows.append((k % 2 and 5 or 5, k, up[k], "user", f"m{k}", score[k]))
    rows += [(6, 900, 901, "user", "x", 1.0), (6, 901, 900, "user", "y", 1.0), (6, 902, 901, "user", "z", 1.0), (7, 1, 55, "user", "orphan", None), (None, 1, None, "u", "t", 0.0)]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")

    def path(k):
        return path(up[k]) + [k] if up[k] is not None else [k]

    leaves = [k for k in up if k not in up.values()]
    best = sorted(leaves, key=lambda k: (-sum(score[x] for x in path(k)) / len(path(k)), k))[:3]
    out = chat.format_conversations(df, top=3)
    got = {(r.tree_id, r.branch): [x.text for x in r.t] for r in out.select("tree_id", "branch", chat.turns(out.formatted).alias("t")).collect()}
    assert got == {(5, n + 1): [f"m{x}" for x in path(k)] for n, k in enumerate(best)} | {(7, 1): ["orphan"]}
    assert chat.format_conversations(df.where("false")).collect() == []


def test_main_text_of_pages(spark, sf):
    """The generator's pages: an article of paragraphs between furniture; the plain reading of it by expressions."""
    import html

    out = {r.page_id: r for r in queries.op1_html_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        assert out[r.page_id].text == "\n".join(w for w in want if w)
        assert out[r.page_id].n_chars == len(out[r.page_id].text) and out[r.page_id].url == r.url


def test_furniture_and_broken_markup():
    x = html_extract.extract
    page = "<body><header>H</header><div id=sidebar>S</div><main><h1>T &amp; U</h1><p>one<p>two <i>x</i>\n y<div class='comments'><p>c</p></div><form>f</form><ul><li>a<li>b</ul></main><footer>F</footer>"
    assert x(page, None) == "T & U\none\ntwo x y\na\nb"
    assert x("<article>a<!-- b", None) == "a" and x("<article>a<script>b", None) == "a" and x("<article>a<p title='x", None) == "a"
    assert x("", None) == x(None, None) == "" and x("plain 1 < 2", None) == "plain 1 < 2"
    assert x("<p>" * 20_000 + "deep", None) == "deep" and x("<div>" * 5_000 + "deep", None) == "deep"


def test_template_without_an_article_element(spark):
    rows = [(k, f"http://h.example/{k}", f"<html><body><div class=top>Our site</div><div class=c><p>Text {k} of the page, long enough.</p><p>More {k * 7}</p></div><div class=b>All rights kept</div></body></html>") for k in range(8)]
    rows += [(100, None, None), (101, "http://other.example", "<p>alone")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n_chars int, template_x string")
    out = {r.page_id: r.text for r in html_extract.texts(df).collect()}
    assert out[3] == "Text 3 of the page, long enough.\nMore 21" and out[100] == "" and out[101] == "alone"
    assert html_extract.texts(df.where("false")).collect() == []


def test_the_template_decides_where_pages_have_article_elements(spark):
    """The story sits in a div, cards elsewhere are article elements; a text repeated inside the story is template."""
    card = "<div class=list><article class=card><h3>Card {0}</h3></article><article class=card><h3>Another card {0}</h3></article></div>"
    page = "<html><body><div class=story><h1>Title {0}</h1><p>The long story of the page with number {0}, told at length.</p><p>Read with care.</p></div>" + card + "</body></html>"
    wide = "<html><body><main><h1>Title {0}</h1><div class=body><p>The long story of the page with number {0}, told at length.</p><p>Care <b>is</b> {0}</p></div>" + card + "</main></body></html>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(6)] + [(10 + k, f"http://b.example/{k}", wide.format(k)) for k in range(6)]
    out = {r.page_id: r.text for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2] == "Title 2\nThe long story of the page with number 2, told at length."
    assert out[13] == "Title 3\nThe long story of the page with number 3, told at length.\nCare is 3"


def test_class_words_beside_others_need_the_template(spark):
    """Words that only look like furniture stay in an article; a box that the host repeats goes."""
    own = "<p class='related work'>Related {0}.</p><p id='notice-of-motion'>Notice {0}.</p><section class='social history'><p>History {0}.</p></section>"
    page = "<html><body><article><h1>Title {0}</h1><p>Text {0} of the page.</p>" + "{1}<div class='share box'><p>Share {0}</p></div><div class='comments'><p>Nice {0}</p></div></article></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(k, own.format(k) if k == 4 else "")) for k in range(8)]
    out = {r.page_id: r.text for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[4] == "Title 4\nText 4 of the page.\nRelated 4.\nNotice 4.\nHistory 4." and out[3] == "Title 3\nText 3 of the page."


def test_classes_nest_by_whole_steps():
    step = [(["html", ">html>div.a", ">html>div.a>p"], 5, 5), ([">html>div.a>b", ">html>div.ab>i"], 4, 4)]
    assert [c["elements"] for c in html_extract.nested([([">html", ">html>div.a", ">html>div.a>p"], 5, 5), step[1]])] == [[">html", ">html>div.a", ">html>div.a>p"]]
    around = [([">html"], 6, 6), ([">html>x"], 5, 5), ([">html>y", ">html>x>y"], 4, 4)]  # one of the two lies inside another class
    assert len(html_extract.nested(around)) == 2
    texts = html_extract.nested([([">html", ">html>p", ">html>p|3"], 5, 5), ([">html>p|1", ">html>q|2"], 4, 4)])
    assert [c["texts"] for c in texts] == [[">html>p|3"]]


def test_a_text_of_no_valid_class_stays(spark):
    """On half of the pages a paragraph of the slot has the same words: a vector that no element has."""
    rows = [(k, f"http://h.example/{k}", f"<html><body><div class=c><p>Text {k} of the page, told at length.</p>" + f"<p>More {k}.</p>" * (k % 3) + ("<p>Same words.</p>" if k % 2 else "") + "</div></body></html>") for k in range(8)]
    out = {r.page_id: r.text for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("Same words." in out[k]) == (k % 2 == 1) for k in range(8))


def test_large_templates_stay_whole(spark, monkeypatch):
    """More than 200 tokens in a host's template, joined by shuffling as by broadcast."""
    menu = "".join(f"<div class=m{k}>Entry {k}</div>" for k in range(300))
    rows = [(k, f"http://h.example/{k}", f"<html><body>{menu}<div class=c><p>Text {k}.</p><p>More {k * 7}</p></div></body></html>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (html_extract.MOST_BROADCAST, 0):
        monkeypatch.setattr(html_extract, "MOST_BROADCAST", most)
        assert {r.page_id: r.text for r in html_extract.texts(df).collect()}[3] == "Text 3.\nMore 21"


@pytest.mark.parametrize("iban, after", [("AT61 1904 3002 3457 3201", " BIC BKAUATWW"), ("ES9121000418450200051332", " EUR 20"), ("BE68 5390 0754 7034", " BIC"), ("BE68 5390 0754 7034", " INFO MORE TEXT HERE"), ("GB82 WEST 1234 5698 7654 32", " A1")])
def test_account_numbers_before_capitals_or_numbers(iban, after):
    for before in ("IBAN ", "ACCOUNT AB13 3456 7890 "):
        text = before + iban + after
        assert pii.spans_of(text)[1] == [(len(before), "iban", len(before) + len(iban))]
        assert pii.masked(text) == before + "<IBAN>" + after


def test_keep_good_carries_columns_named_like_features(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "en", text, 7), (2, "en", "short", 8), (3, None, None, 9)], "doc_id long, lang string, text string, n_words int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.keep_good(docs, labels).collect()] == [(1, "en", text, 7)]
    assert quality.keep_good(docs.where("false"), labels).collect() == []


def test_pages_with_clashing_columns_and_repeats(spark):
    html = "<html><body><nav>menu</nav><article><h1>T</h1><figure><p>body text</p><figcaption>caption</figcaption></figure><p>x <math>y</math></p></article></body></html>"
    rows = [(1, None, html, "t"), (1, None, html, "t"), (2, "http://a/b", None, "u")]
    out = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, template string"))
    assert sorted((r.page_id, r.text, r.template) for r in out.collect()) == [(1, "T\nbody text\ncaption\nx y", "t")] * 2 + [(2, "", "u")]


def test_rows_without_a_conversation(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (3, 0, "user", None), (3, 0, "user", None)]
    out = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id if r.conv_id is not None else -9, r.n_turns, r.loss_chars) for r in out) == [(-9, 2, 2), (3, 2, 0)]
