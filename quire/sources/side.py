"""Side documents of books, as plain functions on one document and as DataFrames: tables of contents, landmarks, overlays, catalogues, licences,
encryption lists, containers, legacy charsets. A document that can't be read gives an error or no rows, never a failed job."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

DEEPEST = 32
_OPS = "{http://www.idpf.org/2007/ops}"
_BARE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);|#[^;]{0,9};)")


def tree(text: str) -> ElementTree.Element:
    """The document, bare ampersands being escaped if it does not parse otherwise."""
    text = text.lstrip("﻿ \r\n\t")
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return ElementTree.fromstring(_BARE.sub("&amp;", text))


def local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _of(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [c for c in e if local(c) in names]


def _words(e: ElementTree.Element) -> str:
    return (e.text or "").strip() or " ".join(t.strip() for t in e.itertext() if t.strip())


def resolve(folder: str, href: str) -> str:
    bare = unquote(href.split("#")[0].split("?")[0]).replace("\\", "/")
    path = posixpath.normpath("/" + posixpath.join(folder, bare)).lstrip("/")
    return "" if path == "." else path


Toc = list[tuple[int, int | None, int, str, str, str, str, int, str]]


def _rows(points: list[tuple], folder: str) -> Toc:
    """(node_id, parent_id, ord, id, label, href, full_path, depth, breadcrumb) in page order of nested (id, label, href, children)."""
    out: Toc = []

    def add(nodes: list[tuple], parent: int | None, depth: int, trail: str) -> None:
        for k, (own, label, href, children) in enumerate(nodes):
            at, here = len(out), f"{trail} > {label}" if trail else label
            out.append((at, parent, k, own, label, href, resolve(folder, href) if href else "", depth, here))
            add(children, at, depth + 1, here)

    add(points, None, 0, "")
    return out


def ncx(text: str, path: str = "") -> Toc:
    """Nodes of an NCX. Nodes deeper than 32 and leaves without a link are left out; labels default to Untitled, of containers to Untitled Container."""

    def points(e: ElementTree.Element, depth: int) -> list[tuple]:
        out = []
        for p in _of(e, "navPoint") if depth <= DEEPEST else ():
            label = next((_words(t) for x in _of(p, "navLabel") for t in reversed(_of(x, "text"))), "")
            href = next((c.get("src", "") for c in reversed(_of(p, "content"))), "")
            below = points(p, depth + 1)
            if href or below:
                out.append((p.get("id", ""), label or ("Untitled" if href else "Untitled Container"), href, below))
        return out

    return _rows([x for m in tree(text).iter() if local(m) == "navMap" for x in points(m, 0)], posixpath.dirname(path))


def _navs(text: str, kind: str, by_id: bool = False) -> Iterator[ElementTree.Element]:
    for e in tree(text).iter():
        if local(e) == "nav" and (kind in (e.get(_OPS + "type") or e.get("type") or "") or by_id and e.get("id") == kind):
            yield e


def nav(text: str, path: str = "") -> Toc:
    """Nodes of the toc of a navigation document: list items with a link, 32 levels at most."""

    def items(e: ElementTree.Element, depth: int) -> list[tuple]:
        out = []
        for li in _of(e, "li") if depth <= DEEPEST else ():
            a, span = _of(li, "a")[-1:], _of(li, "span")[:1]
            href = a[0].get("href", "") if a else ""
            if href:
                label = _words(a[0]) or (_words(span[0]) if span else "")
                out.append((a[0].get("id", ""), label or "Untitled", href, [x for sub in _of(li, "ol", "ul")[-1:] for x in items(sub, depth + 1)]))
        return out

    found: list[tuple] = []
    for e in _navs(text, "toc", True):
        found = next((x for sub in _of(e, "ol", "ul") if (x := items(sub, 0))), found)
    return _rows(found, posixpath.dirname(path))


def landmarks(text: str) -> list[tuple[str, str, str]]:
    """(epub_type, label, href) of the landmarks."""
    return [(a.get(_OPS + "type") or a.get("type") or "", _words(a), a.get("href", "")) for e in _navs(text, "landmarks") for a in e.iter() if local(a) == "a" and a.get("href")]


def page_list(text: str) -> list[tuple[str, str]]:
    """(label, href) of the print pages."""
    return [(_words(a), a.get("href", "")) for e in _navs(text, "page-list") for a in e.iter() if local(a) == "a" and a.get("href")]


def accessibility(pairs: list[tuple[str, str]]) -> dict:
    """Accessibility metadata of (property, text) pairs; lists hold each value once."""
    out: dict = {"access_modes": [], "access_modes_sufficient": [], "features": [], "hazards": [], "summary": None, "certified_by": None, "certifier_credential": None, "certifier_report": None}
    lists = {"accessMode": "access_modes", "accessibilityFeature": "features", "accessibilityHazard": "hazards"}
    single = {"accessibilitySummary": "summary", "certifiedBy": "certified_by", "certifierCredential": "certifier_credential", "certifierReport": "certifier_report"}
    for name, text in pairs:
        name, text = name.split(":")[-1], text.strip()
        if name in lists and text and text not in out[lists[name]]:
            out[lists[name]].append(text)
        elif name == "accessModeSufficient" and (modes := [m.strip() for m in text.split(",") if m.strip()]):
            out["access_modes_sufficient"].append(modes)
        elif name in single:
            out[single[name]] = text
    out["is_accessible"] = bool(out["access_modes"] or out["features"])
    return out


def clock(x: str) -> float:
    """Seconds of h:m:s, m:s, or a number with h, m, s or ms."""

    def number(s: str) -> float:
        try:
            return float(s)
        except ValueError:
            return 0.0

    p = x.strip().split(":")
    if len(p) in (2, 3):
        return sum(number(v) * 60**i for i, v in enumerate(reversed(p)))
    for unit, times in (("ms", 1), ("h", 3600), ("m", 60), ("s", 1)):
        if p[0].endswith(unit):
            return number(p[0][: -len(unit)]) * times
    return number(p[0])


def smil(text: str, path: str = "") -> list[tuple]:
    """(seq, seq_id, textref, ord, par_id, text_src, text_path, element_id, audio_src, audio_path, clip_begin, clip_end) of a media overlay."""
    folder, out = posixpath.dirname(path), []
    for s, seq in enumerate(e for e in tree(text).iter() if local(e) == "seq"):
        for k, par in enumerate(_of(seq, "par")):
            t = next((x for x in reversed(_of(par, "text")) if x.get("src")), None)
            a = next((x for x in reversed(_of(par, "audio")) if x.get("src")), None)
            if t is None and a is None:
                continue
            of_text = (t.get("src"), resolve(folder, t.get("src")), t.get("src").split("#")[1] if "#" in t.get("src") else None) if t is not None else (None,) * 3
            of_audio = (a.get("src"), resolve(folder, a.get("src")), clock(a.get("clipBegin", "0")), clock(a.get("clipEnd", "0"))) if a is not None else (None,) * 4
            out.append((s, seq.get("id"), seq.get(_OPS + "textref") or seq.get("textref"), k, par.get("id"), *of_text, *of_audio))
    return out


def opds(text: str) -> list[dict]:
    """Entries of a catalogue, Atom or JSON: id, title, authors, summary, content, published, updated, links (rel, href, type, title)."""
    if text.lstrip().startswith("{"):
        feed = json.loads(text)
        out = []
        for p in feed.get("publications") or []:
            who = _dig(p, ("metadata", "author"))
            who = who if isinstance(who, list) else [who]
            links = [{"rel": x.get("rel") or "acquisition", "href": x["href"], "type": x["type"], "title": x.get("title")} for x in p.get("links") or [] if x.get("href") is not None and x.get("type") is not None]
            m = lambda k, d=None: _dig(p, ("metadata", k)) or d  # noqa: E731, B023
            out.append({"id": m("identifier", ""), "title": m("title", "Untitled"), "authors": [a["name"] for a in who if isinstance(a, dict) and a.get("name")], "summary": m("description"), "content": None, "published": m("published"), "updated": m("modified"), "links": links})
        return out
    out = []
    for e in _of(tree(text), "entry"):
        one = lambda k, d=None: next((x.text or "" for x in _of(e, k)), d)  # noqa: E731, B023
        links = [{"rel": x.get("rel", ""), "href": x.get("href"), "type": x.get("type", ""), "title": x.get("title")} for x in _of(e, "link") if x.get("href")]
        out.append({"id": one("id", ""), "title": one("title", "Untitled"), "authors": [n.text for a in _of(e, "author") for n in _of(a, "name")[:1] if n.text], "summary": one("summary"), "content": one("content"), "published": one("published"), "updated": one("updated"), "links": links})
    return out


def _dig(x, keys):  # noqa: ANN001, ANN202
    for k in keys:
        x = x.get(k) if isinstance(x, dict) else None
    return x


def encryption(text: str) -> dict[str, str]:
    """Path to algorithm of an encryption list."""
    out = {}
    for e in tree(text).iter():
        if local(e) == "EncryptedData":
            method = next((x.get("Algorithm", "") for x in e.iter() if local(x) == "EncryptionMethod"), "")
            out |= {x.get("URI"): method for x in e.iter() if local(x) == "CipherReference" and x.get("URI")}
    return out


def deobfuscated(font: bytes, algorithm: str, identifier: str) -> bytes:
    """A font without its obfuscation: IDPF (SHA-1 of the identifier, 1040 bytes) or Adobe (the GUID's 16 bytes, 1024 bytes)."""
    bare = "".join(identifier.split())
    if "adobe" in algorithm:
        digits = re.sub("[^0-9a-fA-F]", "", bare.rsplit(":", 1)[-1])[:32]
        key, first = bytes.fromhex(digits) if len(digits) == 32 else b"", 1024
    else:
        key, first = hashlib.sha1(bare.encode()).digest(), 1040
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(font[:first])) + font[first:] if key else font


def decoded(data: bytes, label: str | None) -> str:
    """Text of a legacy charset; labels that are not known count as UTF-8, bytes that do not fit become U+FFFD."""
    try:
        return data.decode(label or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def byte_range(header: str) -> tuple[int, int | None] | None:
    """(first, last) of a Range header "bytes=a-b" or "bytes=a-"; None if it is not one."""
    m = re.fullmatch(r"\s*bytes=(\d+)-(\d*)\s*", header)
    return (int(m[1]), int(m[2]) if m[2] else None) if m else None


def range_header(first: int, last: int | None) -> str:
    return f"bytes={first}-{'' if last is None else last}"


def zip_tail(tail: bytes, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, offset, compressed, uncompressed, method) of the entries in a ZIP directory, read from the last bytes of a file of that size."""
    end = tail.rfind(b"PK\5\6")
    if end < 0 or len(tail) < end + 22:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    at, out = start - (size - len(tail)), []
    if at < 0:
        raise ValueError(f"the directory needs the last {size - start} bytes")
    for _ in range(count):
        if tail[at : at + 4] != b"PK\1\2":
            break
        method, small, large, n, extra, comment, offset = *struct.unpack_from("<H", tail, at + 10), *struct.unpack_from("<IIHHH", tail, at + 20), *struct.unpack_from("<I", tail, at + 42)
        out.append((tail[at + 46 : at + 46 + n].decode("utf-8", "replace"), offset, small, large, method))
        at += 46 + n + extra + comment
    return out


def carved_images(data: bytes) -> list[tuple[str, bytes]]:
    """(media type, bytes) of PNG and JPEG files within any bytes."""
    found = re.finditer(rb"\x89PNG\r\n\x1a\n.*?IEND....|\xff\xd8\xff.*?\xff\xd9", data, re.S)
    return [("image/png" if m[0][:1] == b"\x89" else "image/jpeg", m[0]) for m in found]


def kfx_entities(data: bytes) -> list[tuple[int, int, bytes]]:
    """(id, type, bytes) of the entities of a container: an 18-byte header, then index entries of 24 bytes, little-endian."""
    if data[:4] != b"CONT":
        raise ValueError("not a container")
    length, index_at, index_size = struct.unpack_from("<III", data, 6)
    out = []
    for at in range(index_at, min(index_at + index_size, len(data) - 23), 24):
        own, kind, offset, size = struct.unpack_from("<IIQQ", data, at)
        if length + offset + size <= len(data):
            out.append((own, kind, data[length + offset : length + offset + size]))
    return out


def kfx_container(entities: list[tuple[int, int, bytes]]) -> bytes:
    """Container of (id, type, bytes), version 2, with the SHA-1 of all that stands before at its end."""
    index, body = b"", b""
    for own, kind, content in entities:
        index += struct.pack("<IIQQ", own, kind, len(body), len(content))
        body += content
    whole = b"CONT" + struct.pack("<HIII", 2, 18 + len(index), 18, len(index)) + index + body
    return whole + hashlib.sha1(whole).digest()


def write_kfx(title: str, creators: list[str], sections: list[str]) -> bytes:
    """Metadata is entity 101 of type 490, sections are 200 and on of type 259."""
    meta = json.dumps({"title": title, "creators": creators}, ensure_ascii=False).encode()
    return kfx_container([(101, 490, meta), *((200 + i, 259, s.encode()) for i, s in enumerate(sections))])


TOC = "node_id int, parent_id int, ord int, id string, label string, href string, full_path string, depth int, breadcrumb string"
SMIL = "seq int, seq_id string, textref string, ord int, par_id string, text_src string, text_path string, element_id string, audio_src string, audio_path string, clip_begin double, clip_end double"
OPDS = "id string, title string, authors array<string>, summary string, content string, published string, updated string, links array<struct<rel:string,href:string,type:string,title:string>>"


def each(files: DataFrame, read: Callable[[str, str], list], schema: str) -> DataFrame:
    """files(path, text): rows of read(text, path) with path before and error behind; a document that can't be read is one row with its error."""
    whole = f"path string, {schema}, error string"
    kinds = files.sparkSession.createDataFrame([], whole)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds.schema)
    names = arrow.names[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found = read(text.as_py() or "", path or "")
                    rows = [{"path": path, "error": None, **(r if isinstance(r, dict) else dict(zip(names, r)))} for r in found]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one document
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"[:300]}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "text").mapInArrow(run, whole)


def toc(files: DataFrame) -> DataFrame:
    """TOC rows of files(path, text): NCX by its name or root, else navigation documents."""
    return each(files, lambda text, path: ncx(text, path) if path.lower().endswith(".ncx") or "<ncx" in text[:2000] else nav(text, path), TOC)


def overlays(files: DataFrame) -> DataFrame:
    return each(files, smil, SMIL)


def catalogues(files: DataFrame) -> DataFrame:
    return each(files, lambda text, path: opds(text), OPDS)
