"""Package documents (OPF) and the members of archives, as plain functions on one document and as DataFrames."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources import readers, side

PACKAGE = (
    "version string, title string, creators array<string>, publishers array<string>, languages array<string>, subjects array<string>, rights string, description string, "
    "identifier string, pub_date string, modified_date string, direction string, cover_id string, cover_href string, toc_id string, nav_id string, "
    "manifest array<struct<id:string,href:string,full_path:string,media_type:string,properties:array<string>,fallback:string,media_overlay:string>>, "
    "spine array<struct<idref:string,linear:boolean,properties:array<string>,index:int,href:string,media_type:string>>, guide array<struct<type:string,title:string,href:string,full_path:string>>, accessible boolean"
)
RESOURCES = "book string, path string, content binary, error string"


def package(text: str, path: str = "") -> dict:
    """One row of PACKAGE. Spine entries that the manifest has not are left out.

    The cover is the last manifest item with the property cover-image, else the guide's first cover, else the item that a meta "cover" names.
    """
    root = side.tree(text)
    if side.local(root) != "package":
        raise ValueError("not a package document")
    folder = posixpath.dirname(path)
    within = lambda group, name: [e for g in root if side.local(g) == group for e in g if side.local(e) == name]
    dc = lambda name: [t for e in within("metadata", name) if (t := (e.text or "").strip())]
    last = lambda found: found[-1] if found else None

    items, covers, navs = {}, [], []
    for e in within("manifest", "item"):
        own, href, kind = e.get("id"), e.get("href"), e.get("media-type")
        if own is None or href is None or kind is None:
            continue
        properties = e.get("properties", "").split()
        items[own] = {"id": own, "href": href, "full_path": side.resolve(folder, href), "media_type": kind, "properties": properties, "fallback": e.get("fallback"), "media_overlay": e.get("media-overlay")}
        covers += [own] * ("cover-image" in properties)
        navs += [own] * ("nav" in properties)

    refs = [e for e in within("spine", "itemref") if e.get("idref") in items]
    spine = [{"idref": e.get("idref"), "linear": e.get("linear") != "no", "properties": e.get("properties", "").split(), "index": i, "href": items[e.get("idref")]["full_path"], "media_type": items[e.get("idref")]["media_type"]} for i, e in enumerate(refs)]
    guide = [{"type": e.get("type"), "title": e.get("title", ""), "href": e.get("href"), "full_path": side.resolve(folder, e.get("href"))} for e in within("guide", "reference") if e.get("type") is not None and e.get("href") is not None]

    metas = within("metadata", "meta")
    pairs = [(e.get("property"), (e.text or "").strip()) for e in metas if e.get("property") is not None]
    named = last([e.get("content") for e in metas if e.get("name") == "cover" and e.get("content") is not None])
    cover_id = last(covers) or named
    in_guide = next((g["full_path"] for g in guide if g["type"] == "cover"), None)
    cover_href = items[covers[-1]]["full_path"] if covers else in_guide or (items[named]["full_path"] if named in items else None)

    spines = [e for e in root if side.local(e) == "spine"]
    way = last([e.get("page-progression-direction") for e in spines if e.get("page-progression-direction") is not None])
    return {
        "version": root.get("version", "2.0"), "title": ": ".join(dc("title")), "creators": dc("creator"), "publishers": dc("publisher"), "languages": dc("language"), "subjects": dc("subject"),
        "rights": last(dc("rights")), "description": last(dc("description")), "identifier": last(dc("identifier")), "pub_date": last(dc("date")),
        "modified_date": last([t for k, t in pairs if k == "dcterms:modified"]), "direction": way if way in ("rtl", "ltr") else "default", "cover_id": cover_id, "cover_href": cover_href,
        "toc_id": last([e.get("toc") for e in spines if e.get("toc") is not None]), "nav_id": last(navs), "manifest": list(items.values()), "spine": spine, "guide": guide,
        "accessible": side.accessibility(pairs)["is_accessible"],
    }


def packages(files: DataFrame) -> DataFrame:
    """files(path, text) of package documents: path, the columns of PACKAGE, error."""
    return side.each(files, lambda text, path: [package(text, path)], PACKAGE)


def resources(files: DataFrame) -> DataFrame:
    """Members of the archives in files(path, content), one row each; an archive that can't be read is a row with its error.

    A member goes out in a batch of its own, so a task holds one archive within the readers' limits and no more.
    """
    names = ["book", "path", "content", "error"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(book, path, data, None) for path, data in readers.unzip(content.as_py() or b"").items()]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one archive
                    rows = [(book, None, None, f"{type(e).__name__}: {e}"[:300])]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return files.select("path", "content").mapInArrow(run, RESOURCES)
