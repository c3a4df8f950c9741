"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: its block tags and its whole texts, each with the path of elements that it stands in. Over the distinct
pages of a host a token has an occurrence vector: how often it stands on each page. Tokens of equal vectors are an equivalence class. A
class of two or more tokens that half of the host's pages have is part of the template if it is valid: on every page its tokens
come in the same order, period after period, and in the same gaps between the tokens of the root class (the one with the most tokens of those that
every such page has once). So the classes make a tree: the root class, and in its gaps the classes nested there. What the template
does not hold are slots; the main text is the text of the slots.

Which slots are menus, forms, adverts and so on the template can't tell where they differ from page to page: elements that HTML names so, and unmistakable class,
id and role words, are left out. If the page marks its article (article, main or role=main), the slots within it are taken. If a
template holds more than half of a marked article, the host's pages are copies of one text, and nothing in the article is taken for template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.url_filter import url_host

#: Fixed values of HTML: elements without content, whose content is not markup, that break text into blocks, that are no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("aside audio button datalist dialog embed footer form head header iframe input map menu nav noscript option script select style svg template textarea title video".split())
#: Words that a class, id or role must be, or begin with before a - or _, for its element to be left out: everywhere, and only outside of the article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr"
    " masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted sidebar sponsored subscribe taboola".split()
)
OUTER_WORDS = frozenset("alert copyright header login modal notification overlay pager promotion recommended related respond share sharing signup skip social sponsor toolbar widget".split())
#: Pages that a host needs for a template, and the share of them that a class must have.
LEAST_PAGES, SHARE = 3, 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+)", re.I | re.S)
_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: Elements that a start tag ends (the optional end tags of HTML).
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}


def page_events(page: str) -> Iterator[tuple[str, str, str]]:
    """("start", name, attributes), ("end", name, ""), ("text", text, "") in page order; a start tag never closed ends with its parent.

    Entities are as they stand. Comments, declarations and the content of scripts and the like are left out. Each "start" has
    its "end", but for void elements.
    """
    at, size, stack = 0, len(page), []
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            break
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = max(m.end(), at + 1)
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), ""
            continue
        name = m[2].lower()
        if m[1]:
            if name in stack:
                while True:
                    last = stack.pop()
                    yield "end", last, ""
                    if last == name:
                        break
            continue
        if name in VOID:
            yield "start", name, m[3]
            continue
        ends = _CLOSES.get(name) or ({"p"} if name in _ENDS_P else set())
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth] in ends:
                for last in reversed(stack[depth:]):
                    yield "end", last, ""
                del stack[depth:]
                break
            if stack[depth] in BLOCK and stack[depth] != "p":
                break
        yield "start", name, m[3]
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else size
            yield "end", name, ""
        else:
            stack.append(name)
    for last in reversed(stack):
        yield "end", last, ""


def squeeze(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def token(text: str, is_text: bool) -> int:
    """64-bit hash; odd for texts, even for tags."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h | 1 if is_text else h & ~1) - (1 << 63)


def page_tokens(page: str) -> list[int]:
    """The page's tokens in order: block tags by path, and whole texts by path."""
    out, path, text = [], [], []

    def close() -> None:
        if text and (t := squeeze(text)):
            out.append(token("/".join(path) + " " + t, True))
        text.clear()

    for kind, name, _ in page_events(page):
        if kind == "text":
            text.append(name)
        else:
            if name in BLOCK:
                close()
            if kind == "start":
                if name not in VOID:
                    path.append(name)
                if name in BLOCK:
                    out.append(token("<" + "/".join(path), False))
            elif path:
                if name in BLOCK:
                    out.append(token(">" + "/".join(path), False))
                path.pop()
    close()
    return out


def signatures(tokens: list[int], class_of: dict[int, int], root: int) -> dict[int, int]:
    """Of each class on the page a hash of its order and of its gaps in the root class; one that only this page has if it is out of order."""
    seen: dict[int, list[int]] = {}
    gaps: dict[int, set[int]] = {}
    gap = 0
    for t in tokens:
        if (c := class_of.get(t)) is not None:
            seen.setdefault(c, []).append(t)
            gaps.setdefault(c, set()).add(gap)
            if c == root:
                gap = t
    out = {}
    for c, own in seen.items():
        period = list(dict.fromkeys(own))
        ordered = own == period * (len(own) // len(period))
        out[c] = token(repr((period, None if c == root else sorted(gaps[c])) if ordered else (tokens, "out of order")), False)
    return out


def outside(name: str, attributes: str, depth_in_main: int) -> bool:
    """Whether an element is no main text: by its name, or by a class, id or role. A header within the article is its own."""
    if name in OUTSIDE and not (name == "header" and depth_in_main):
        return True
    if attributes and name not in ("html", "body", "article", "main"):
        if not depth_in_main and _HIDDEN.search(attributes):
            return True
        words = OUTSIDE_WORDS if depth_in_main else OUTSIDE_WORDS | OUTER_WORDS
        for m in _NAMES.finditer(attributes):
            for one in m[1].strip("\"'").lower().split():
                if one in words or re.split("[-_]", one)[0] in words:
                    return True
    return False


def page_text(page: str, template: frozenset[int]) -> list[str]:
    """The blocks of the slots that are main text. template: the texts (tokens) of the host's valid classes."""
    blocks: list[tuple[bool, bool, str]] = []
    path, text, skip, main = [], [], 0, 0
    seen_main = False

    def close() -> None:
        if text and (t := squeeze(text)):
            blocks.append((main > 0, bool(template) and token("/".join(path) + " " + t, True) in template, t))
        text.clear()

    for kind, name, attributes in page_events(page):
        if kind == "text":
            if not skip:
                text.append(name)
            continue
        if name in BLOCK or name in RAW:
            close()
        elif name == "br":
            text.append(" ")
        if kind == "start":
            if name in VOID:
                continue
            path.append(name)
            if skip or outside(name, attributes, main):
                skip += 1
            elif main or name in ("article", "main") or _MAIN.search(attributes):
                main += 1
                seen_main = True
        elif path:
            if skip:
                skip -= 1
            elif main:
                main -= 1
            path.pop()
    close()
    inner = [(held, t) for inside, held, t in blocks if inside or not seen_main]
    slots = [t for held, t in inner if not held]
    return slots if not seen_main or 2 * sum(map(len, slots)) >= sum(len(t) for _, t in inner) else [t for _, t in inner]


def _batches(batches: Iterator[pa.RecordBatch], rows_of: Callable[..., Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            rows = [r for one in zip(*(c.to_pylist() for c in whole.slice(at, 128).columns)) for r in rows_of(*one)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def deduce(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, template array<long>): the texts of each host's valid classes; hosts with fewer distinct pages, or no valid class, have no row.

    pages has host and html. Shuffled are hashes only, a row for each distinct page and token, reduced before. A host's classes
    have at most 1 / share times as many tokens as its mean page, however many pages it has.
    """
    page = F.xxhash64("html").alias("page")
    sizes = pages.select("host", page).distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    counted = lambda host, key, html: ((host, key, t, n) for t, n in Counter(page_tokens(html)).items())
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])
    rows = pages.select("host", page, "html").mapInArrow(lambda b: _batches(b, counted, schema), "host string, page long, token long, n long").distinct()
    part = F.xxhash64("page", "n")
    vector = [F.sum(x).alias(c) for c, x in (("v0", F.shiftrightunsigned(part, 32)), ("v1", part.bitwiseAND(F.lit((1 << 32) - 1))))]
    tokens = rows.groupBy("host", "token").agg(F.count("*").alias("support"), F.max("n").alias("most"), *vector).join(C.small_side(C.cut(sizes)), "host").where(F.col("support") >= share * F.col("pages"))
    tokens = C.cut(tokens.select("host", "token", "support", "pages", "most", F.xxhash64("support", "v0", "v1").alias("class")))
    classes = tokens.groupBy("host", "class").agg(F.count("*").alias("size"), F.max("most").alias("most"), F.max(F.col("support") == F.col("pages")).alias("all")).where("size > 1")
    roots = classes.where("most = 1").groupBy("host").agg(F.max_by("class", F.struct("all", "size", "class")).alias("root"))
    of_host = tokens.join(classes.select("host", "class"), ["host", "class"]).groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes")).join(roots, "host", "left")
    of_host = C.cut(of_host)

    def signed(host: str, key: int, html: str, tokens: list[int], classes: list[int], root: int | None) -> Iterator[tuple]:
        return ((host, c, s) for c, s in signatures(page_tokens(html), dict(zip(tokens, classes)), root).items())

    schema2 = pa.schema([("host", pa.string()), ("class", pa.int64()), ("signature", pa.int64())])
    both = pages.select("host", page, "html").join(C.small_side(of_host, MOST_HOSTS), "host").select("host", "page", "html", "tokens", "classes", "root")
    found = both.mapInArrow(lambda b: _batches(b, signed, schema2), "host string, class long, signature long")
    valid = found.groupBy("host", "class").agg(F.min("signature").alias("lo"), F.max("signature").alias("hi")).where("lo = hi").select("host", "class")
    texts = tokens.where(F.col("token").bitwiseAND(F.lit(1)) == 1).join(valid, ["host", "class"])
    return texts.groupBy("host").agg(F.collect_set("token").alias("template"))


#: Hosts up to which their templates (some hundred hashes each) are broadcast.
MOST_HOSTS = 10_000


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, text, n_chars); other columns are not read.

    Null html is an empty page; a page without main text has the empty text; n_chars counts code points. A null url, or one
    without ://, belongs to the empty host. Hosts of one or two distinct pages have no template: all their text is in slots. Rows that
    repeat give a row each, and count once in the template. An empty table gives no rows. Pages of any length are read whole.
    """
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("host"))
    templates = C.cut(deduce(source))
    both = source.join(C.small_side(templates, MOST_HOSTS), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = ["\n\n".join(page_text(page, frozenset(t.as_py() or ()))) for page, t in zip(batch.column(2).to_pylist(), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
