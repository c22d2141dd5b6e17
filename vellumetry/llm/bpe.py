"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

A merge list has a *sufficient lookahead*: a number of symbols after which what follows can no longer move a token
boundary.  `sufficient_lookahead` computes it from the merges; `StreamingEncoder` keeps at most that many symbols
(plus a fixed window) and emits a token as soon as it is stable.  `StreamingDecoder` turns ids into text as they come,
keeping only the bytes of an unfinished character.

Defined cases: null text counts as empty and gives no ids; repeated rows are encoded each; columns of other names are
carried along, and clashing names (token_ids, decoded) are replaced; an empty table gives an empty table.  Characters
that Python's Unicode data doesn't know yet count as neither letters nor numbers.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import map_columns, small_batches

#: The pattern that a ByteLevel pre-tokenizer splits by.  A fixed value of the public tokenizer format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols that the encoder takes in beyond the lookahead before it merges.
WINDOW = 256
#: Characters of a slice of a long text, pieces merged together, entries of a task's memo, and characters of the pieces that it holds.
SLICE, GROUP, MEMO, MEMO_CHARS = 1 << 16, 400_000, 1_000_000, 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256."""
    seen, table = 0, []
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table.append(chr(b))
        else:
            table.append(chr(256 + seen))
            seen += 1
    return table


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int], parts: dict[int, tuple[int, int, int]]) -> int:
    """Symbols beyond a token's end after which its end can't move.

    merges: (left, right, new) by rank.  A boundary after token t moves only if an element x of t's right spine, before
    its own parent merges it, meets a right neighbour w by a rule of lower rank; whether w forms depends likewise on
    what follows w, by a rule of lower rank still.  Ranks fall along such a chain, so chains end, and the longest one
    is found by going through the rules in order of rank.
    """
    reach_ranks: dict[int, list[int]] = {}
    reach_most: dict[int, list[int]] = {}
    most = 1

    def within(t: int, rank: int) -> int:
        best, below = 0, rank
        while True:
            ranks = reach_ranks.get(t)
            if ranks and (k := bisect_left(ranks, below)):
                best = max(best, reach_most[t][k - 1])
            if t not in parts:
                return best
            made, _, right = parts[t]
            below, t = min(below, made), right

    for rank, (left, right, _) in enumerate(merges):
        reach = length[right] + within(right, rank)
        ranks, mosts = reach_ranks.setdefault(left, []), reach_most.setdefault(left, [])
        ranks.append(rank)
        mosts.append(max(reach, mosts[-1] if mosts else 0))
        most = max(most, reach)
    return most


@lru_cache(maxsize=8)
def _class(kind: str, end: int) -> str:
    """The characters below `end` of a general category, or of white space, as ranges for a character class."""
    if kind == "s":
        points = [c for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if c < end]
    else:
        points = [c for c in range(end) if unicodedata.category(chr(c))[0] == kind]
    ranges: list[list[int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def written_out(pattern: str, end: int) -> str:
    r"""The same pattern for texts of characters below `end`, with \p{L}, \p{N}, \s and \S written out as ranges."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "s")):
            if pattern.startswith(name, i):
                out.append(_class(kind, end) if inside else f"[{_class(kind, end)}]")
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{_class('s', end)}]")
                i += 2
                continue
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Vocabulary:
    """A tokenizer file of the public JSON format: BPE over bytes, with or without a word-end suffix."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path}: a BPE model is needed, not {model['type']}")
        self.suffix = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.inner = [ids.get(c) for c in alphabet]
        self.last = [ids.get(c + self.suffix) for c in alphabet]
        merges, self.parts, self.rank = [], {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, new = ids[left], ids[right], ids[left + right]
            merges.append((a, b, new))
            self.parts.setdefault(new, (rank, a, b))
            self.rank.setdefault((a, b), rank)
        self.made = [m[2] for m in merges]
        import numpy as np

        keys = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), dtype=np.int64)[order]
        self.made_array = np.array(self.made, dtype=np.int64)
        self.size = [0] * (max(self.tokens) + 1)
        for i, t in self.tokens.items():
            self.size[i] = len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        self.lookahead = sufficient_lookahead(merges, self.size, self.parts)
        self._text_rules(spec)
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: decoder {self.decoder} isn't supported")
        back = {c: b for b, c in enumerate(alphabet)}
        self.raw = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for i, t in self.tokens.items()} if self.decoder else {}

    def _text_rules(self, spec: dict) -> None:
        steps = spec.get("normalizer")
        steps = [] if not steps else steps["normalizers"] if steps["type"] == "Sequence" else [steps]
        kinds = [s["type"] for s in steps]
        if set(kinds) - {"NFC", "Lowercase", "Replace"}:
            raise ValueError(f"normalizers {kinds} aren't supported")
        pre = spec["pre_tokenizer"]
        pre = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        splits = [p for p in pre if p["type"] == "Split"]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        # collapsing white space changes nothing where the split drops it, the only case taken here
        if "Replace" in kinds and not (splits and splits[0]["behavior"] == "Removed" and splits[0]["invert"]):
            raise ValueError("replacing normalizers are supported only before a split that drops white space")
        pattern = splits[0]["pattern"]["Regex"] if splits else BYTE_LEVEL_PATTERN
        self.pattern, self.split_any = pattern, None  # the whole of Unicode is written out on first need
        self.split_latin1 = re.compile(written_out(pattern, 256))
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
            return self.split_latin1.findall(text.lower() if self.lower else text)
        except UnicodeEncodeError:
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.lower:
                text = text.replace("Σ", "σ").lower()  # character by character: no final sigma
            if self.split_any is None:
                self.split_any = re.compile(written_out(self.pattern, 0x110000))
            return self.split_any.findall(text)

    def merged(self, s: list[int]) -> list[int]:
        """Merge a bounded window in place: the lowest rank first, from the left."""
        get, made, none = self.rank.get, self.made, 1 << 60
        ranks = [get(p, none) for p in zip(s, s[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            s[i] = made[best]
            del s[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = get((s[i], s[i + 1]), none)
        return s


    def merged_many(self, words: list[list[int]]) -> list[list[int]]:
        """merged() for many windows of one length at a time, column by column."""
        import numpy as np

        s = np.array(words, dtype=np.int64)
        m, n = s.shape
        ranks, none, out = self._ranks(s[:, :-1], s[:, 1:]), len(self.made), [None] * m
        rows, size, columns = np.arange(m), np.full(m, n), np.arange(n)
        while True:
            i = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            at = np.arange(len(rows))
            best = ranks[at, i] if ranks.shape[1] else np.full(len(rows), none)
            over = best == none
            for r, x, k in zip(rows[over].tolist(), s[over].tolist(), size[over].tolist(), strict=True):
                out[r] = x[:k]
            if over.all():
                return out
            s, ranks, rows, size, i, best = (x[~over] for x in (s, ranks, rows, size, i, best))
            at = np.arange(len(rows))
            after = np.minimum(columns + (columns > i[:, None]), n - 1)
            s = np.take_along_axis(s, after, 1)
            s[at, i] = self.made_array[best]
            ranks = np.take_along_axis(ranks, np.minimum(after[:, :-1], n - 2), 1)
            size = size - 1
            ranks[at, size - 1] = none
            left = i > 0
            ranks[at[left], i[left] - 1] = self._ranks(s[at[left], i[left] - 1], s[at[left], i[left]])
            right = i < size - 1
            ranks[at[right], i[right]] = self._ranks(s[at[right], i[right]], s[at[right], i[right] + 1])

    def _ranks(self, left, right):
        import numpy as np

        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], len(self.made))


class StreamingEncoder:
    """One piece at a time: push() its bytes in parts of any size, then finish()."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held: list[int] = []
        self.waiting: int | None = None  # the last byte: its symbol depends on whether the piece ends

    def push(self, data: bytes) -> list[int]:
        out = []
        for k in range(0, len(data), WINDOW):
            part = data[k : k + WINDOW]
            if self.waiting is not None:
                part = bytes((self.waiting,)) + part
            self.held += [s for b in part[:-1] if (s := self.v.inner[b]) is not None]
            self.waiting = part[-1]
            if len(self.held) >= self.v.lookahead + WINDOW:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        if self.waiting is not None and (s := self.v.last[self.waiting]) is not None:
            self.held.append(s)
        out, self.held, self.waiting = self.v.merged(self.held), [], None
        return out

    def _stable(self) -> list[int]:
        """Tokens that end at least the lookahead before the end of what is held; the rest stays as symbols."""
        out, end, limit = [], 0, len(self.held) - self.v.lookahead
        for t in self.v.merged(self.held[:]):
            if end + self.v.size[t] > limit:
                break
            out.append(t)
            end += self.v.size[t]
        self.held = self.held[end:]
        return out


class _Memo(dict):
    """Little-endian ids of short pieces; a long piece goes through the transducer each time.  Emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.encoder = vocabulary, StreamingEncoder(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        return array("I", self.encoder.push(piece.encode()) + self.encoder.finish()).tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Short pieces fit into the transducer's first window, so they are merged at once, many of a length together."""
        if len(self) >= MEMO:
            self.clear()
        by_length: dict[int, list[tuple[str, list[int]]]] = {}
        v = self.v
        for piece in pieces:
            if len(piece) <= MEMO_CHARS:
                data = piece.encode()
                symbols = [*map(v.inner.__getitem__, data[:-1]), v.last[data[-1]]]
                if None in symbols:
                    symbols = [x for x in symbols if x is not None]
                by_length.setdefault(len(symbols), []).append((piece, symbols))
        for n, words in by_length.items():
            merged = v.merged_many([w for _, w in words]) if n > 1 else [w for _, w in words]
            for (piece, _), out in zip(words, merged, strict=True):
                self[piece] = array("I", out).tobytes()


_CUT = re.compile(r"(?<=\S) (?=\S)")


def slices(text: str) -> Iterator[str]:
    """Cut a long text where no piece can span: before a single space between other characters."""
    start, n = 0, len(text)
    while n - start > SLICE:
        cut = _CUT.search(text, start + SLICE)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Encoder:
    """Whole texts to little-endian 32-bit ids."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.memo = _Memo(self.v)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """One result a text, in order.  Texts are taken in groups of about GROUP characters, long ones in slices."""
        group: list[list[bytes | list[str]]] = []
        size = 0
        for text in texts:
            group.append(parts := [])
            for x in self._split(text or ""):
                parts.append(x)
                size += len(x)
                if size > GROUP:
                    done, size = self._finish(group), 0
                    yield from done[:-1]
                    group = [parts := [done[-1]]]
        yield from self._finish(group)

    def _split(self, text: str) -> Iterator[bytes | list[str]]:
        v = self.v
        parts = v.specials.split(text) if v.specials and any(t in text for t in v.added) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield array("I", [v.added[part]]).tobytes()
            elif part:
                yield from map(v.pieces, slices(part))

    def _finish(self, group: list[list[bytes | list[str]]]) -> list[bytes]:
        memo, get = self.memo, self.memo.__getitem__
        memo.learn({p for parts in group for x in parts if isinstance(x, list) for p in x}.difference(memo))
        return [b"".join(x if isinstance(x, bytes) else b"".join(map(get, x)) for x in parts) for parts in group]


class StreamingDecoder:
    """Ids to text as they come.

    With a byte-level decoder the state is the bytes of an unfinished character; ill-formed bytes become U+FFFD.
    Without a decoder tokens are joined by spaces, and the state is whether one has been seen.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace") if vocabulary.decoder else None
        self.started = False

    def push(self, ids: Iterable[int]) -> str:
        if self.bytes:
            return self.bytes.decode(b"".join(map(self.v.raw.__getitem__, ids)))
        text = " ".join(map(self.v.tokens.__getitem__, ids))
        if self.started and text:
            text = " " + text
        self.started = self.started or bool(text)
        return text

    def finish(self) -> str:
        text = self.bytes.decode(b"", True) if self.bytes else ""
        self.started = False
        return text


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add token_ids (binary, little-endian 32-bit), one narrow pass and no shuffle.  path: a tokenizer file on every node."""

    def make():
        encoder = Encoder(path)
        return lambda rows: ((x,) for x in encoder.encode_all(t for (t,) in rows))

    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != "token_ids"]
    return map_columns(df, [text], keep, make, "token_ids binary")


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add decoded (string) from ids made by encode_texts."""

    def make():
        import numpy as np

        v = vocabulary(path)

        def one(packed: bytes | None) -> str:
            decoder, out = StreamingDecoder(v), []
            numbers = np.frombuffer(packed or b"", "<u4")
            for k in range(0, len(numbers), SLICE):
                out.append(decoder.push(numbers[k : k + SLICE].tolist()))
            return "".join(out) + decoder.finish()

        return lambda rows: ((one(x),) for (x,) in rows)

    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c != "decoded"]
    return map_columns(df, [ids], keep, make, "decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, from its encoded and decoded forms."""
    encoded = encode_texts(documents.select("doc_id", "text"), path).drop("text")
    summed = encoded.select("doc_id", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"))
    decoded = decode_ids(summed, path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
