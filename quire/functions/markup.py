"""HTML as a tree, sanitised, annotated for speech; languages by function words. Functions on one document, and Columns over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>")
_GONE = re.compile(r"<(script|iframe|object|embed)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>", re.I)
_EVENT = re.compile(r"([\s/\"'])on[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)", re.I)
_NUMERIC = re.compile(r"&#(x[0-9a-f]+|[0-9]+);?", re.I)
_URI = re.compile(r"(?:j\s*a\s*v\s*a|v\s*b)\s*s\s*c\s*r\s*i\s*p\s*t\s*:|data\s*:\s*text/html", re.I)


def sanitize(html: str) -> str:
    """html without script, iframe, object and embed elements (of unclosed ones the tag goes), event attributes within tags, and script addresses."""
    out, at, low = [], 0, html.lower()
    while m := _GONE.search(html, at):
        out.append(html[at : m.start()])
        end = low.find(f"</{m[1].lower()}>", m.end())
        at = m.end() if m[0].endswith("/>") or end < 0 else end + len(m[1]) + 3
    out.append(html[at:])

    def clean(m: re.Match) -> str:
        tag = m[0]
        while (less := _EVENT.sub(r"\1", tag)) != tag:
            tag = less
        plain = _NUMERIC.sub(lambda n: chr(min(int(n[1][1:], 16) if n[1][0] in "xX" else int(n[1]), 0x10FFFF)), tag)
        return _URI.sub("#disabled_uri:", plain) if _URI.search(plain) else tag

    return _TAG.sub(clean, "".join(out))


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def _add(self, **node) -> None:  # noqa: ANN003
        self.nodes.append({"node_id": len(self.nodes), "parent_id": self.open[-1] if self.open else None, "tag": None, "attrs": {}, "text": None, **node})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._add(kind="element", tag=tag, attrs={k: v or "" for k, v in attrs})
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(kind="element", tag=tag, attrs={k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[k]]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self._add(kind="text", text=data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")

    def handle_comment(self, data: str) -> None:
        self._add(kind="comment", text=data)


def dom(html: str) -> list[dict]:
    """Nodes in page order: node_id, parent_id, kind, tag, attrs, text; entities stay as they stand."""
    p = _Nodes()
    p.feed(html)
    p.close()
    return p.nodes


def by_tag(nodes: list[dict], tag: str) -> list[dict]:
    """Elements of a name, whatever its case, depth first."""
    return [n for n in nodes if n["tag"] == tag.lower()]


def without(nodes: list[dict], tags: set[str]) -> list[dict]:
    """The nodes but for elements of these names and all below them."""
    gone: set[int] = set()
    for n in nodes:
        if n["tag"] in tags or n["parent_id"] in gone:
            gone.add(n["node_id"])
    return [n for n in nodes if n["node_id"] not in gone]


def to_html(nodes: list[dict]) -> str:
    """Nodes as HTML again."""
    out: list[str] = []
    open_: list[dict] = []

    def close(parent: int | None) -> None:
        while open_ and open_[-1]["node_id"] != parent:
            out.append(f"</{open_.pop()['tag']}>")

    for n in nodes:
        close(n["parent_id"])
        if n["kind"] == "element":
            out.append(f"<{n['tag']}" + "".join(f' {k}="{escape(v)}"' for k, v in n["attrs"].items()) + ">")
            if n["tag"] not in _VOID:
                open_.append(n)
        else:
            out.append(n["text"] if n["kind"] == "text" else f"<!--{n['text']}-->")
    close(None)
    return "".join(out)


def tts_html(html: str) -> str:
    """html with each word of its texts in a span that has the word's number; scripts, styles and entities stay."""
    count, out, skip = 0, [], None
    for part in re.split(r"(<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>)", html):
        if part.startswith("<"):
            name = re.match(r"</?\s*([a-zA-Z0-9]*)", part)[1].lower()
            skip = (None if part.startswith("</") else name) if name in ("script", "style") else skip
            out.append(part)
        elif skip:
            out.append(part)
        else:
            for word in re.split(r"(\s+)", part):
                if word.strip():
                    out.append(f'<span class="tts-word" data-tts-index="{count}">{word}</span>')
                    count += 1
                else:
                    out.append(word)
    return "".join(out)


#: Frequent words by ISO 639-3 code.
PROFILES = {
    "eng": "the of and to in that is was for it with as his on be at by had not are but from or have".split(),
    "deu": "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fra": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il".split(),
    "spa": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "ita": "di che e la il un a per è in una mi sono ho non ma lo ha le si ti con cosa".split(),
    "por": "de a o que e do da em um para é com não uma os no se na por mais as dos como".split(),
    "nld": "de en van het een in is dat op te zijn met voor niet aan er om ook als dan maar bij".split(),
}


def language(text: str) -> str | None:
    """The language whose frequent words the text has most; None below 30 bytes or without any. (Function words, not a trained model.)"""
    if len(text.encode()) < 30:
        return None
    words = re.findall(r"[^\W\d_]+", text.lower())
    score = {k: sum(w in v for w in words) for k, v in ((k, frozenset(v)) for k, v in PROFILES.items())}
    best = max(sorted(score), key=score.__getitem__)
    return best if score[best] else None


def column(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A function on one text as a Column function over Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def over(x):  # noqa: ANN001, ANN202
        return x.map(lambda t: None if t is None else f(t))

    return over


def sanitized(html: Column) -> Column:
    """sanitize(); rows in which nothing can be found do not leave the JVM's hands changed."""
    suspect = html.rlike(r"(?i)<(script|iframe|object|embed)|[\s/\"']on[a-z]+\s*=|script\s*:|data\s*:\s*text|&#")
    return F.when(suspect, column(sanitize)(html)).otherwise(html)


def nearest_anchor(html: Column, offset: Column) -> Column:
    """The last id="..." before an offset, else the first of the document, else null."""
    ids = lambda x: F.filter(F.regexp_extract_all(x, F.lit(r'\sid="([^"]*)"'), F.lit(1)), lambda v: F.trim(v) != "")
    before = ids(F.substring(html, F.lit(1), offset.cast("int")))
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.get(ids(html), F.lit(0)))


def highlighted(html: Column) -> Column:
    plain = F.replace(html, F.lit("<pre><code>"), F.lit('<pre><code class="treesitter-highlighted">'))
    return F.replace(plain, F.lit('<pre><code class="'), F.lit('<pre><code class="treesitter-code '))


def right_to_left(html: Column) -> Column:
    """html with dir="rtl" on its html tag, or else its body, unless it has one."""
    has = lambda x: x.contains('dir="rtl"') | x.contains("dir='rtl'")
    first = F.replace(html, F.lit("<html"), F.lit('<html dir="rtl"'))
    return F.when(has(html), html).when(first.contains('dir="rtl"'), first).otherwise(F.replace(html, F.lit("<body"), F.lit('<body dir="rtl"')))
