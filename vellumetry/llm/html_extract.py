"""Main text of web pages by equivalence-class template deduction.

Pass 1 turns each page into structural tokens, an element by its path of names and classes or a text node by its path and
digest, with its number of occurrences.  Over the pages of a host, a token's *occurrence vector* (pages and counts)
is summed into a commutative hash, so vectors of any length are compared by one aggregate with map-side combining, and a
host with a third of all pages is no hot task.  Tokens of one vector and enough support form an equivalence class;
a class is valid if its elements nest: all lie below one element, and the next classes around them are one and the same; texts
alone are no class.  The valid classes, nested by path, are the host's template.

Pass 2 matches pages against their host's template, on every page.  Template elements bound the slots; the innermost one
with more than half of the text outside links is the region.  An `article` or `main` element only adjusts it: the region
becomes the deepest one with more than half of its text (its heading often stands beside the slot), less articles beside
the slot.  Furniture never counts: elements that HTML names so (navigation, header, footer, aside, form, script, style), and those
that have a whole class, id or role of FURNITURE_WORDS (sidebar, notice, advert, comments by readers); beside other words, as
in "related work", that holds inside an article or main element only for elements of the template.  Nor does text that the template holds: single nodes outside article elements, whole
blocks inside.  Hosts with fewer than LEAST_PAGES pages have no template and rest on the page's article elements alone.

Defined cases: null or empty html, and pages without text, give an empty text; a null url is a host of its own; repeated
rows are extracted each; broken markup is read to its end, an unclosed comment, script or tag swallowing the rest;
extra columns are carried, and a column named text or n_chars is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import fresh, map_columns, small_batches, written

LEAST_PAGES, TEXT_SUPPORT = 3, 0.5
#: Hosts' templates are broadcast up to so many bytes together; more are joined by shuffling.  Bytes of templates in a batch.
MOST_BROADCAST, BATCH_BYTES = 32_000_000, 64_000_000

# Element names by their role, from the public HTML standard.  Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed xmp textarea title svg object".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select head".split()) | RAW
MAIN = frozenset("article main".split())
#: Elements that can bound a slot.
HOLDERS = frozenset("article body center dd details div dl html main ol section table tbody td tr ul".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "html", "body"))
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class, id or role that mark furniture.  Fixed values.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal "
    "nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, attributes) and ("close", name, "") in page order.  Linear in the page."""
    at, n = 0, len(page)
    raw_ends: dict[str, bool] = {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            following = page[lt + 1 : lt + 3]
            if not (following[:1].isalpha() or following[:1] == "/" and following[1:].isalpha()):
                yield "text", "<", ""
                at = lt + 1
                continue
            end = page.find(">", lt)  # a quote that isn't closed
            if end < 0:
                return
            name = re.match(r"</?([A-Za-z][^\s/>]*)", page[lt:end])[1].lower()
            yield ("close" if following[0] == "/" else "open"), name, ""
            at = end + 1
            continue
        name, at = m[2].lower(), m.end()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"):
            end = None
            if raw_ends.get(name, True):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                raw_ends[name] = end is not None
            yield "text", page[at : end.start() if end else n], ""
            at = end.start() if end else n


def furniture(name: str, attributes: str) -> bool:
    """By the element's own name, or hidden."""
    if name in FURNITURE:
        return True
    return "hidden" in attributes and name not in MAIN and name not in ("html", "body") and re.search(r"(?<![\w-])hidden(?![\w-])", attributes) is not None


def named_furniture(name: str, attributes: str) -> int:
    """By a whole class, id or role: 2 if an attribute has no other words, 1 if it has, 0 if none is of FURNITURE_WORDS."""
    if not attributes or name in MAIN or name in ("html", "body"):
        return 0
    marks = [set((m[1] or m[2] or m[3] or "").lower().split()) for m in _MARK.finditer(attributes)]
    return 2 if any(m and m <= FURNITURE_WORDS for m in marks) else int(any(m & FURNITURE_WORDS for m in marks))


def _class(attributes: str) -> str:
    m = _MARK.search(attributes) if attributes else None
    return "." + ".".join((m[1] or m[2] or m[3] or "").split()[:2]) if m else ""


class Walk:
    """One pass over a page: its text nodes with their path, and whether they are inside furniture or an article."""

    def __init__(self, page: str, template: frozenset[str] = frozenset()):
        self.elements: Counter[str] = Counter()
        #: (text, path, in furniture, numbers of the article and main elements around it, in a link, number of the block)
        self.nodes: list[tuple[str, str, bool, tuple[int, ...], bool, int]] = []
        #: the name of each article or main element
        self.areas: list[str] = []
        stack: list[tuple[str, str, bool]] = []  # name, path, furniture
        opened: Counter[str] = Counter()
        self.has_article = False
        skip = link = block = 0
        around: tuple[int, ...] = ()

        def pop() -> None:
            nonlocal skip, around, link, block
            name, _, out = stack.pop()
            opened[name] -= 1
            skip -= out
            around = around[:-1] if name in MAIN else around
            link -= name == "a"
            block += name in BLOCK

        for kind, data, attributes in tokens(page):
            if kind == "text":
                if data and (stack or not data.isspace()):
                    self.nodes.append((data, stack[-1][1] if stack else "", skip > 0, around, link > 0, block))
            elif kind == "open":
                if data in CLOSES_P and opened["p"]:
                    while stack and opened["p"] and stack[-1][0] not in ("td", "th", "button"):
                        pop()
                elif data in CLOSES_SAME:
                    while stack and stack[-1][0] in CLOSES_SAME[data] + ("p", "b", "i", "em", "strong", "span", "a"):
                        last = stack[-1][0]
                        pop()
                        if last in CLOSES_SAME[data] and last != "td" and last != "th":
                            break
                block += data in BLOCK
                if data == "br":
                    self.nodes.append((" ", stack[-1][1] if stack else "", skip > 0, around, link > 0, block))
                path = (stack[-1][1] if stack else "") + ">" + data + _class(attributes)
                if len(path) > 4096:  # a long path goes on from its digest, which stands for all of it
                    path = f">{_digest(path):x}"
                self.elements[path] += 1
                out = furniture(data, attributes) and not (data == "header" and around) or (named := named_furniture(data, attributes)) and (named == 2 or not around or path in template)
                if data in VOID or attributes.rstrip().endswith("/") and data not in BLOCK and data != "a":
                    continue
                stack.append((data, path, out))
                opened[data] += 1
                skip += out
                if data in MAIN:
                    around = (*around, len(self.areas))
                    self.areas.append(data)
                link += data == "a"
                self.has_article = self.has_article or data in MAIN and skip == 0
            elif opened[data] > 0:
                while stack[-1][0] != data:
                    pop()
                pop()
            elif data == "p":
                block += 1


def host_of(url: str | None) -> str:
    return re.sub(r"^[^/]*//|[/?#].*$", "", url or "").lower()


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, token, page, n: the structural tokens of each page, text nodes by digest."""
    for batch in batches:
        rows = []
        for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            walk = Walk(page or "")
            host, page_key = host_of(url), _digest(str(page_id))
            found: Counter[str] = Counter(walk.elements)
            for text, path, out, _, _, _ in walk.nodes:
                if not out and (t := " ".join(text.split())):
                    found[f"{path}|{_digest(t):x}"] += 1
            rows += [(host, token, _digest(f"{page_key}:{n}"), n) for token, n in found.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "vector", "n"])


def nested(classes: list[tuple[list[str], int, int]]) -> list[dict]:
    """Keep the valid classes, parents first: their elements lie below one element, the parent of the shortest, and what other
    valid class is next around each of them is the same for all.  A class of texts alone isn't valid."""
    out: list[dict] = []
    class_of: dict[str, int] = {}

    def around(path: str, own: set[str]) -> int:
        """The valid class next around an element, -1 for none."""
        while path := path.rpartition(">")[0]:
            if path in class_of and path not in own:
                return class_of[path]
        return -1

    for members, pages, total in sorted(classes, key=lambda c: (-c[1], min(map(len, c[0])))):
        elements = sorted((m for m in members if "|" not in m), key=len)
        below = elements[0].rpartition(">")[0] if elements else ""
        if not elements or not all(e.startswith(below + ">") for e in elements) or len({around(e, set(elements)) for e in elements}) > 1:
            continue
        class_of.update(dict.fromkeys(elements, len(out)))
        out.append({"elements": elements, "texts": [m for m in members if "|" in m], "once": total == pages})
    return out


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON): the nested equivalence classes of each host with LEAST_PAGES pages or more."""
    small_batches(pages.sparkSession)
    found = pages.select("page_id", "url", "html").mapInArrow(page_tokens, "host string, token string, vector long, n long")
    # the sum of mixed hashes of (page, count) is equal exactly for equal vectors, but for chance
    by_token = found.groupBy("host", "token").agg(F.sum(F.shiftright("vector", 12)).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("total"))
    by_token = written(by_token, "page-tokens")
    size = by_token.groupBy("host").agg(F.max("pages").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    often = by_token.join(size, "host").where(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.lit(TEXT_SUPPORT) * F.col("host_pages")))
    classes = often.groupBy("host", "vector", "pages", "total").agg(F.sort_array(F.collect_list("token")).alias("members"))
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("members", "pages", "total")).alias("classes"))

    def build(value: list) -> str:
        found = sorted(((list(c["members"]), c["pages"], c["total"]) for c in value), key=lambda c: (-c[1], -len(c[0]), c[0]))
        return json.dumps(nested(found))

    return map_columns(by_host, ["classes"], ["host"], lambda: lambda rows: ((build(c),) for (c,) in rows), "template string")


def elements_of(template: list[dict] | None) -> frozenset[str]:
    return frozenset(e for c in template or () for e in c["elements"])


def extract(page: str | None, template: list[dict] | None, elements: frozenset[str] | None = None) -> str:
    """The main text of one page.  elements: of the template, where they are at hand."""
    if not page:
        return ""
    walk = Walk(page, elements_of(template) if elements is None else elements)
    nodes = [x for x in walk.nodes if not x[2]]
    if template:
        nodes = _region(_unheld(nodes, {t for c in template for t in c["texts"]}), {e for c in template if c["once"] for e in c["elements"]}, walk.areas)
    elif walk.has_article:
        nodes = [x for x in nodes if x[3]]
    out: list[str] = []
    block, parts = None, []
    for text, _, _, _, _, k in [*nodes, ("", "", False, False, False, -1)]:
        if k != block:
            joined = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if joined:
                out.append(joined)
            block, parts = k, []
        parts.append(text)
    return "\n".join(out)


def _unheld(nodes: list, held: set[str]) -> list:
    """The nodes without text that the template holds: single nodes outside article elements, whole blocks inside."""
    if not held:
        return nodes
    own = [bool(t := " ".join(x[0].split())) and f"{x[1]}|{_digest(t):x}" not in held for x in nodes]
    blocks = {x[5] for x, o in zip(nodes, own, strict=True) if o}
    return [x for x, o in zip(nodes, own, strict=True) if o or (x[5] in blocks if x[3] else x[0].isspace())]


def _size(node: tuple) -> int:
    return 0 if node[4] else len(node[0].strip())


def _region(nodes: list, slots: set[str], areas: list[str]) -> list:
    """The text below the innermost template element that holds more than half of the text outside links, adjusted to the
    article or main element that holds more than half of that."""
    weight: Counter[str] = Counter()
    total = 0
    for x in nodes:
        path, size = x[1], _size(x)
        total += size
        while path:
            if path in slots and path.rpartition(">")[2].partition(".")[0] in HOLDERS:
                weight[path] += size
            path = path.rpartition(">")[0]
    good = [p for p, w in weight.items() if 2 * w > total]
    best = max(good, key=lambda p: (p.count(">"), p)) if good else ""
    inside = [not best or x[1] == best or x[1].startswith(best + ">") for x in nodes]
    of_area: Counter[int] = Counter()
    total = 0
    for x, i in zip(nodes, inside, strict=True):
        if i:
            total += _size(x)
            of_area.update(dict.fromkeys(x[3], _size(x)))
    big = [k for k, w in of_area.items() if 2 * w > total]
    if not big:
        return [x for x, i in zip(nodes, inside, strict=True) if i]
    area = max(big, key=lambda k: (areas[k] == "article", k))
    return [x for x, i in zip(nodes, inside, strict=True) if area in x[3] and (i or all(areas[k] == "main" for k in x[3][x[3].index(area) + 1 :]))]


def main_texts(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add text, the main text of html."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[^/]*//", ""), r"(?s)[/?#].*$", ""))
    of_host = written(templates(pages), "templates")
    bytes_of = of_host.agg(F.sum(F.octet_length("template")), F.max(F.octet_length("template"))).first()
    if (bytes_of[0] or 0) <= MOST_BROADCAST:
        of_host = F.broadcast(of_host)
    small_batches(pages.sparkSession, max(1, min(1000, BATCH_BYTES // (bytes_of[1] or 1))))
    at, held = fresh(pages.columns, "page_host"), fresh(pages.columns, "template")
    joined = pages.withColumn(at, host).join(of_host.toDF(at, held), at, "left")

    def make():
        parsed: dict[str, tuple[list[dict], frozenset[str]]] = {}

        def one(page: str | None, template: str | None) -> str:
            if template is not None and template not in parsed:
                if sum(map(len, parsed)) > BATCH_BYTES:
                    parsed.clear()
                parsed[template] = (found := json.loads(template)), elements_of(found)
            return extract(page, *parsed.get(template, (None, frozenset())))

        return lambda rows: ((one(p, t),) for p, t in rows)

    keep = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]
    return map_columns(joined, ["html", held], keep, make, "text string")


def texts(pages: DataFrame) -> DataFrame:
    out = main_texts(pages, ["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
