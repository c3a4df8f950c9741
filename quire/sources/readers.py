"""Readers of e-book containers: files (path, content) to one row a section, a file that can't be read to one row with an error.

Binary parsing is per file, in Arrow batches; a broken or protected file never fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, format string, title string, creators array<string>, language string, identifier string, section_index int, href string, raw_html string, publisher string, pub_date string, direction string, error string"
#: Bytes of one archive member, and of all.
ENTRY_LIMIT, TOTAL_LIMIT = 200_000_000, 500_000_000


class Unreadable(Exception):
    """Why a file has no sections."""


def sniff(data: bytes, path: str = "") -> str:
    """The format by first bytes, in the order rar, pdf, zip kinds, kfx, mobi, lit, fb2, md, txt."""
    if data[:4] == b"Rar!":
        raise Unreadable("RAR archives are not supported; convert CBR to CBZ")
    if data[:5] == b"%PDF-":
        raise Unreadable("PDF is not supported")
    if data[:4] == b"PK\x03\x04":
        names = set(unzip(data, names_only=True))
        return "epub" if "META-INF/container.xml" in names else "odt" if {"content.xml", "meta.xml"} & names else "cbz"
    if data[:4] == b"CONT":
        return "kfx"
    if data[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
        return "mobi"
    if data[:8] == b"ITOLITLS":
        return "lit"
    if b"<FictionBook" in data:
        return "fb2"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        raise Unreadable("unknown format") from None
    return "md" if path.lower().endswith(".md") or "# " in text else "txt"


def unzip(data: bytes, names_only: bool = False) -> dict[str, bytes]:
    """Members of an archive within the limits."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = [x for x in z.infolist() if not x.is_dir()]
            if names_only:
                return dict.fromkeys((x.filename for x in members), b"")
            if any(x.file_size > ENTRY_LIMIT for x in members) or sum(x.file_size for x in members) > TOTAL_LIMIT:
                raise Unreadable("archive is too large when unpacked")
            return {x.filename.replace("\\", "/"): z.read(x) for x in members}
    except zipfile.BadZipFile as e:
        raise Unreadable(f"bad zip: {e}") from None


def _xml(data: bytes) -> ElementTree.Element:
    """Lenient: a DOCTYPE goes, bare & and named HTML entities are escaped."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", data.decode("utf-8-sig", "replace"), count=1, flags=re.S)
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos);|#\w{1,8};)", "&amp;", text)
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise Unreadable(f"bad XML: {e}") from None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e) == name]


def _text(e: ElementTree.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def epub(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    """Metadata and (href, html) of the spine's items that the archive has."""
    files = unzip(data)
    if "META-INF/rights.xml" in files or "license.lcpl" in files:
        raise Unreadable("protected (DRM)")
    roots = _all(_xml(files["META-INF/container.xml"]), "rootfile")
    opf = unquote(roots[0].get("full-path", "")) if roots else ""
    if opf not in files:
        raise Unreadable("no package document")
    package, folder = _xml(files[opf]), posixpath.dirname(opf)
    of = lambda name: [t for e in _all(package, name) if (t := _text(e))]
    manifest = {e.get("id"): posixpath.normpath(posixpath.join(folder, unquote(e.get("href", "")))) for e in _all(package, "item")}
    spine = [manifest[i] for e in _all(package, "itemref") if (i := e.get("idref")) in manifest]
    folded = {k.lower(): v for k, v in files.items()}
    sections = [(h, folded[h.lower()].decode("utf-8", "replace")) for h in spine if h.lower() in folded]
    way = [e.get("page-progression-direction") for e in _all(package, "spine")][-1:]
    first = lambda name: (of(name) or [None])[0]
    meta = {"title": ": ".join(of("title")) or title, "creators": of("creator"), "language": first("language"), "identifier": first("identifier"), "publisher": first("publisher"), "pub_date": (of("date") or [None])[-1]}
    return meta | {"direction": way[0] if way and way[0] in ("rtl", "ltr") else "default"}, sections


def fb2(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    root = _xml(data)
    info = next(iter(_all(root, "title-info")), root)
    people = [" ".join(t for c in a if _local(c) in ("first-name", "middle-name", "last-name") and (t := _text(c))) for a in _all(info, "author")]

    def html(e: ElementTree.Element) -> str:
        inner = escape(e.text or "") + "".join(html(c) + escape(c.tail or "") for c in e)
        tag = {"p": "p", "v": "p", "title": "h2", "subtitle": "h3", "emphasis": "em", "strong": "strong", "section": "section", "poem": "div", "stanza": "div", "cite": "blockquote", "epigraph": "blockquote"}.get(_local(e), "span")
        return f"<{tag}>{inner}</{tag}>"

    sections = [s for b in _all(root, "body") for s in b if _local(s) == "section"] or _all(root, "body")
    meta = {"title": _text(next(iter(_all(info, "book-title")), None)) or title, "creators": [p for p in people if p], "language": _text(next(iter(_all(info, "lang")), None)) or None}
    return meta, [(f"section_{i}.html", html(s)) for i, s in enumerate(sections)]


def natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name.lower())]


def cbz(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    """One section for each image, in natural order; hidden and system members are left out."""
    pages = [n for n in unzip(data, names_only=True) if re.search(r"\.(jpe?g|png|gif|webp)$", n, re.I) and not n.startswith("__MACOSX") and not posixpath.basename(n).startswith(".")]
    if not pages:
        raise Unreadable("no images in the archive")
    return {"title": title, "creators": []}, [(n, f'<div class="page"><img src="{escape(n)}" alt="Page {i + 1}"/></div>') for i, n in enumerate(sorted(pages, key=natural))]


def odt(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    files = unzip(data)
    meta = _xml(files["meta.xml"]) if "meta.xml" in files else None
    of = lambda name: _text(next(iter(_all(meta, name)), None)) if meta is not None else ""
    blocks = [(f"h{min(6, int(next((v for k, v in e.attrib.items() if k.endswith('outline-level')), '1')))}" if _local(e) == "h" else "p", _text(e)) for e in _xml(files.get("content.xml", b"<x/>")).iter() if _local(e) in ("h", "p")]
    html = "".join(f"<{t}>{escape(x)}</{t}>" for t, x in blocks if x)
    return {"title": of("title") or title, "creators": [c] if (c := of("creator") or of("initial-creator")) else []}, [("content.html", html)]


def palmdoc(data: bytes) -> bytes:
    """LZ77 of PalmDOC records: literals, runs, back references of 3 to 10 bytes, and blank-letter pairs."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c < 0xC0:
            if i >= len(data):
                break
            pair = c << 8 | data[i]
            i += 1
            back, n = pair >> 3 & 0x7FF, (pair & 7) + 3
            for _ in range(n if 0 < back <= len(out) else 0):
                out.append(out[-back])
        else:
            out += bytes((0x20, c ^ 0x80))
    return bytes(out)


def mobi(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    count = struct.unpack_from(">H", data, 76)[0]
    starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(count)] + [len(data)]
    records = [data[a:b] for a, b in zip(starts, starts[1:])]
    head = records[0]
    compression, texts, protected = struct.unpack_from(">H", head, 0)[0], struct.unpack_from(">H", head, 8)[0], struct.unpack_from(">H", head, 12)[0]
    if protected:
        raise Unreadable("protected (DRM)")
    if compression not in (1, 2):
        raise Unreadable(f"compression {compression} is not supported")
    raw = b"".join(palmdoc(r) if compression == 2 else r for r in records[1 : texts + 1])
    named: dict[int, list[str]] = {}
    at = head.find(b"EXTH")
    if at >= 0:
        place = at + 12
        for _ in range(struct.unpack_from(">I", head, at + 8)[0]):
            kind, size = struct.unpack_from(">II", head, place)
            named.setdefault(kind, []).append(head[place + 8 : place + size].decode("utf-8", "replace"))
            place += max(size, 8)
    text = raw.decode("utf-8", "replace").replace("\x00", "")
    text = _linked(text, {k: name for k, name, _ in mobi_images(data)})
    parts = [p for p in re.split(r"(?i)<mbp:pagebreak[^>]*>", text) if p.strip()]
    if len(parts) < 2:  # no page breaks: a section begins at each heading beyond the first 200 bytes
        starts = [m.start() for m in re.finditer(r"(?i)<h[123]", text) if m.start() > 200 or len(text[: m.start()].encode()) > 200]
        parts = [p for i, j in zip([0, *starts], [*starts, len(text)]) if (p := text[i:j]).strip()] or [text]
    at, size = struct.unpack_from(">II", head, 84) if head[16:20] == b"MOBI" and len(head) >= 92 else (0, 0)
    full = head[at : at + size].decode("utf-8", "replace").strip("\0 ") if size else ""
    first = lambda kind: (named.get(kind) or [None])[0]
    language = first(524)
    meta = {"title": first(503) or full or data[:32].split(b"\0")[0].decode("latin-1") or title, "creators": named.get(100, []), "language": language, "publisher": first(101), "pub_date": first(106)}
    meta["direction"] = "rtl" if (language or "").lower().startswith(("ar", "he", "fa", "ur")) else "ltr"
    return meta, [(f"section_{i}.html", p) for i, p in enumerate(parts)]


#: How image records begin, and their file extensions.
IMAGES = ((b"\xff\xd8\xff", "jpg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"RIFF....WEBP", "webp"), (b"BM", "bmp"))


def mobi_images(data: bytes) -> list[tuple[int, str, bytes]]:
    """(number, path, bytes) of the image records: number 1 is the record that the header names as the first image."""
    count = struct.unpack_from(">H", data, 76)[0]
    starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(count)] + [len(data)]
    head = data[starts[0] : starts[1]] if count else b""
    if head[16:20] != b"MOBI" or len(head) < 112:
        return []
    first, out = max(struct.unpack_from(">I", head, 108)[0], 1), []
    for r in range(first, count):
        content = data[starts[r] : starts[r + 1]]
        ext = next((e for magic, e in IMAGES if re.match(b".".join(re.escape(x) for x in magic.split(b".")), content, re.S)), None)
        if ext:
            k = r - first + 1
            out.append((k, f"images/img_{k:04}.{ext}", content))
    return out


def _linked(html: str, images: dict[int, str]) -> str:
    """HTML whose references to image records (recindex, kindle:embed, numbered files) are paths; others stay."""

    def path(m: re.Match, widths: tuple[int, ...]) -> str | None:
        k = int(m["k"])
        return images.get(k) if m["k"] in {f"{k:0{w}}" for w in widths} else None

    if not images:
        return html
    html = re.sub(r'recindex="(?P<k>\d{1,9})"', lambda m: f'src="{p}"' if (p := path(m, (1, 5))) else m[0], html)
    html = re.sub(r"kindle:embed:(?P<k>\d{1,9})", lambda m: path(m, (1, 4, 5)) or m[0], html)
    return re.sub(r'src="(?P<k>\d{1,9})\.jpg"', lambda m: f'src="{p}"' if (p := path(m, (1, 4, 5))) else m[0], html)


def plain(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    """Paragraphs between blank lines; Title, Author and Language lines among the first 15."""
    text = data.decode("utf-8", "replace").replace("\r\n", "\n")
    head = {m[1].lower(): m[2].strip() for x in text.split("\n")[:15] if (m := re.match(r"(?i)\s*(title|author|creator|language|lang)\s*:\s*(.+)", x))}
    html = "".join(f"<p>{escape(p.strip())}</p>" for p in re.split(r"\n\s*\n", text) if p.strip())
    who = head.get("author") or head.get("creator")
    return {"title": head.get("title") or title, "creators": [who] if who else [], "language": head.get("language") or head.get("lang")}, [("text.html", html)]


def markdown(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    """A heading begins a section if text is pending; fences become code blocks; each other line a paragraph."""
    sections, now, fence, first = [], [], None, None
    for line in data.decode("utf-8", "replace").splitlines():
        if line.startswith("```"):
            if fence is None:
                fence = (line[3:].strip() or "text", [])
            else:
                now.append(f'<pre><code class="language-{escape(fence[0])}">{escape(chr(10).join(fence[1]))}</code></pre>')
                fence = None
        elif fence is not None:
            fence[1].append(line)
        elif line.startswith("#"):
            level = min(6, len(line) - len(line.lstrip("#")))
            if now:
                sections.append("".join(now))
                now = []
            label = line.lstrip("#").strip()
            first = first or (label if level == 1 else None)
            now.append(f"<h{level}>{escape(label)}</h{level}>")
        elif line.strip():
            now.append(f"<p>{escape(line.strip())}</p>")
    sections += ["".join(now)] if now else []
    return {"title": first or title, "creators": []}, [(f"section_{i}.html", s) for i, s in enumerate(sections)]


def carved(data: bytes, title: str) -> tuple[dict, list[tuple[str, str]]]:
    """Readable runs of a container whose text is not otherwise addressed (KFX, LIT), in sections of about 18 KB."""
    if any(x in data for x in (b"$DRM", b"DRM_V1", b"DRM_V2", b"kfx_drm")):
        raise Unreadable("protected (DRM)")
    runs = [r.decode("utf-8", "replace").strip() for r in re.findall(rb"[\x09\x0a\x0d\x20-\x7e\x80-\xf4]{25,}", data)]
    sections, now = [], ""
    for r in runs:
        if len(now) > 18_000:
            sections.append(now)
            now = ""
        now += f"<p>{escape(r)}</p>" if "<" not in r else r
    return {"title": title, "creators": []}, [(f"section_{i}.html", s) for i, s in enumerate([*sections, now] if now else sections)]


READERS: dict[str, Callable[[bytes, str], tuple[dict, list[tuple[str, str]]]]] = {"epub": epub, "fb2": fb2, "cbz": cbz, "odt": odt, "mobi": mobi, "txt": plain, "md": markdown, "kfx": carved, "lit": carved}


def read_book(path: str, data: bytes) -> list[tuple]:
    """Rows of SCHEMA for one file."""
    title = posixpath.splitext(posixpath.basename(path))[0]
    kind = None
    try:
        kind = sniff(data, path)
        meta, sections = READERS[kind](data, title)
    except Exception as e:  # noqa: BLE001  whatever is wrong with one file, the others are read
        return [(path, kind, title, [], None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
    base = (path, kind, meta["title"], meta["creators"], meta.get("language"), meta.get("identifier"))
    also = (meta.get("publisher"), meta.get("pub_date"), meta.get("direction", "default"))
    return [(*base, i, href, html, *also, None) for i, (href, html) in enumerate(sections)] or [(*base, None, None, None, *also, "no sections")]


def parse(files: DataFrame) -> DataFrame:
    """files(path, content) as rows of SCHEMA."""
    kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int32()] + [pa.string()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.rsplit(" ", 1)[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = read_book(path.as_py(), content.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder. (readStream with the same options gives the stream that parse() takes as well.)"""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def book_uuid(title: str) -> str:
    """As functions.text.book_uuid()."""
    return str(uuid.UUID(bytes=hashlib.md5(title.encode()).digest(), version=4))


def write_epub(title: str, creators: list[str], language: str | None, sections: list[tuple[str, str]]) -> bytes:
    """An EPUB 3 file of (label, html) sections, with a navigation document."""
    out, parts = io.BytesIO(), list(enumerate(sections))
    items = "".join(f'<item id="s{i}" href="sec_{i}.xhtml" media-type="application/xhtml+xml"/>' for i, _ in parts)
    spine = "".join(f'<itemref idref="s{i}"/>' for i, _ in parts)
    links = "".join(f'<li><a href="sec_{i}.xhtml">{escape(label)}</a></li>' for i, (label, _) in parts)
    dc = f'<dc:identifier id="id">urn:uuid:{book_uuid(title)}</dc:identifier>' + f"<dc:title>{escape(title)}</dc:title>" + "".join(f"<dc:creator>{escape(c)}</dc:creator>" for c in creators) + f"<dc:language>{escape(language or 'en')}</dc:language>"
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, text, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, how)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        put("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{dc}</metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{spine}</spine></package>')
        put("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        for i, (_, html) in parts:
            put(f"OEBPS/sec_{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{html}</body></html>')
    return out.getvalue()


def font_key_xor(font: bytes, key: bytes, first: int) -> bytes:
    """Font obfuscation: the first bytes XOR the repeated key (IDPF: 1040 bytes, SHA-1 of the identifier; Adobe: 1024, the 16-byte GUID)."""
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(font[:first])) + font[first:]


def data_uri(mime: str, content: bytes) -> str:
    return f"data:{mime};base64,{base64.b64encode(content).decode()}"
