"""Command line: parse, search, locations, rag, convert and sample. Paths may name a file, a folder or a pattern that Spark reads."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books as B
from quire.sources import readers, side


def _sections(read: DataFrame) -> DataFrame:
    """The rows of the readers as the operators' sections; a book is named by its path."""
    return read.where("error is null").select(F.col("path").alias("book_id"), "section_index", "href", "raw_html", T.plain_text(F.col("raw_html")).alias("plain_text"), "title", "creators", "language")


def _lines(rows: DataFrame) -> Iterator[str]:
    """One JSON object a row; rows come a partition at a time."""
    return (r[0] for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).toLocalIterator())


def _convert(sections: DataFrame, out: str, most_tokens: int) -> None:
    if out.endswith(".json"):
        chunks = [json.loads(x) for x in _lines(B.rag_chunks(sections, B.Chunking(most_tokens)).orderBy("book_id", "chunk_index"))]
        made = json.dumps(chunks, ensure_ascii=False, indent=2).encode()
    elif out.endswith((".epub", ".kfx")):
        rows = sections.orderBy("section_index").collect()  # one book
        if len({r.book_id for r in rows}) != 1:
            raise SystemExit("convert takes one book that can be read")
        html = [r.raw_html or "" for r in rows]
        head = rows[0]
        made = readers.write_epub(head.title, head.creators, head.language, [(f"Section {i + 1}", x) for i, x in enumerate(html)]) if out.endswith(".epub") else side.write_kfx(head.title, head.creators, html)
    else:
        raise SystemExit("the output must end in .epub, .kfx or .json")
    with open(out, "wb") as f:
        f.write(made)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quire")
    modes = parser.add_subparsers(dest="mode", required=True)
    for name, *places in (("parse", "path"), ("search", "path", "query"), ("locations", "path"), ("rag", "path"), ("convert", "path", "out"), ("sample", "out")):
        mode = modes.add_parser(name)
        for place in places:
            mode.add_argument(place)
        if name in ("rag", "convert"):
            mode.add_argument("most_tokens", type=int, nargs="?", default=512)
    a = parser.parse_args(arguments)
    if a.mode == "sample":
        with open(a.out, "wb") as f:
            f.write(readers.write_epub("Sample", ["Quire"], "en", [(f"Chapter {i}", f"<h1>Chapter {i}</h1><p>Text of chapter {i}.</p>") for i in (1, 2, 3)]))
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))  # workers find the package, wherever the driver was started
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))
    spark = SparkSession.builder.appName("quire").getOrCreate()
    read = readers.read_books(spark, a.path)
    sections = _sections(read)
    if a.mode == "convert":
        return _convert(sections, a.out, a.most_tokens)
    rows = {
        "parse": lambda: read.drop("raw_html").orderBy("path", "section_index"),
        "search": lambda: B.search(sections, a.query).orderBy("book_id", "spine_index", "char_offset"),
        "locations": lambda: B.locations(sections).orderBy("book_id", "location"),
        "rag": lambda: B.rag_chunks(sections, B.Chunking(a.most_tokens)).orderBy("book_id", "chunk_index"),
    }[a.mode]()
    for line in _lines(rows):
        print(line)


if __name__ == "__main__":
    main()
