"""Package documents, covers, resources put into sections, MOBI images, identifiers and the command line."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

import quire.__main__ as cli
from quire.functions import text as T
from quire.operators import assets as A
from quire.sources import package as P
from quire.sources import readers as R

ITEMS = '<item id="p" href="cover%20page.xhtml" media-type="application/xhtml+xml"/><item id="i" href="a.png" media-type="image/png"{}/>'


def opf(meta="", mark="", guide=""):
    return f'<package version="3.0"><metadata>{meta}</metadata><manifest>{ITEMS.format(mark)}</manifest><spine><itemref idref="p"/></spine><guide>{guide}</guide></package>'


def test_cover_chain_prefers_the_property_then_the_guide_then_the_meta():
    meta, mark, guide = '<meta name="cover" content="i"/>', ' properties="cover-image"', '<reference type="cover" href="cover%20page.xhtml#x"/>'
    of = lambda *a: P.package(opf(*a), "O/x.opf")["cover_href"]
    assert (of(meta, mark, guide), of(meta, "", guide), of(meta), of()) == ("O/a.png", "O/cover page.xhtml", "O/a.png", None)


def test_a_bad_package_is_a_row_with_its_error(spark):
    rows = P.packages(spark.createDataFrame([("a", "<html/>"), ("b", None), ("c", opf("<title>T</title>"))], "path string, text string")).orderBy("path").collect()
    assert "not a package" in rows[0].error and rows[1].error and (rows[2].title, rows[2].direction, rows[2].error) == ("T", "default", None)


def test_resources_and_covers(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("O/cover.html", "<body><image/><img alt='x' SRC='./a.png'></body>")
        z.writestr("O/a.png", b"\x89PNG")
    held = P.resources(spark.createDataFrame([("1", box.getvalue()), ("2", b"PK\x03\x04no"), ("3", None)], "path string, content binary"))
    assert sorted((r.book, r.path) for r in held.collect() if not r.error) == [("1", "O/a.png"), ("1", "O/cover.html")] and held.where("error is not null").count() == 2
    held = held.withColumnRenamed("book", "book_id")
    books = spark.createDataFrame([("1", "O/cover.html"), ("2", "O/a.png"), ("3", None)], "book_id string, cover_href string")
    rows = {r.book_id: r for r in A.covers(books, held).collect()}
    assert (rows["1"].cover_path, rows["1"].mime, bytes(rows["1"].content)) == ("O/a.png", "image/png", b"\x89PNG") and rows["2"].content is None and rows["3"].mime is None


def test_inlining_leaves_what_is_not_held(spark):
    held = spark.createDataFrame([(1, "a.png", b"x" * 100), (1, "s.css", b"u{src:url(a.png)} v{src:url(b.png)}\xff"), (2, "b.png", b"y")], "book_id long, path string, content binary")
    html = '<link href="s.css"><link rel="next" href="n.html"><img src="a.png"><img src="b.png"><img data-src="c.png">'
    rows = A.inlined(spark.createDataFrame([(1, 0, "t.xhtml", html), (2, 0, "t.xhtml", None), (2, 1, None, "<p>")], "book_id long, section_index int, href string, raw_html string"), held).orderBy("book_id", "section_index").collect()
    assert 'src="data:image/png;base64,eHh4' in rows[0].html and "\r" not in rows[0].html and '<img src="b.png"><img data-src="c.png">' in rows[0].html and 'href="n.html"' in rows[0].html
    assert rows[1].html is None and rows[2].html == "<p>"


def mobi(text, *images):
    exth = b"EXTH" + struct.pack(">II", 0, 2) + struct.pack(">II", 101, 11) + b"Pub" + struct.pack(">II", 524, 10) + b"he"
    full = "Full ñame".encode()
    head = bytearray(struct.pack(">HHIHHHH", 1, 0, len(text), 1, 4096, 0, 0) + b"MOBI" + bytes(92) + exth + full)
    struct.pack_into(">II", head, 84, len(head) - len(full), len(full))
    struct.pack_into(">I", head, 108, 2)
    records = [bytes(head), text, *images]
    at, table = 78 + 8 * len(records), b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return b"short".ljust(60, b"\0") + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records)) + table + b"".join(records)


def test_mobi_images_are_linked():
    data = mobi(b'<img recindex="00001"><img recindex="1"><img src="kindle:embed:0003?mime=x"><img src="00003.jpg"><img recindex="2"><img recindex="001">', b"\x89PNG\r\n\x1a\nx", b"none", b"RIFF1234WEBP")
    assert [(k, p) for k, p, _ in R.mobi_images(data)] == [(1, "images/img_0001.png"), (3, "images/img_0003.webp")]
    row = dict(zip([x.rsplit(" ", 1)[0] for x in R.SCHEMA.split(", ")], R.read_book("b.mobi", data)[0]))
    one, three = 'src="images/img_0001.png"', 'src="images/img_0003.webp'
    assert row["raw_html"] == f'<img {one}><img {one}><img {three}?mime=x"><img {three}"><img recindex="2"><img recindex="001">'
    assert (row["title"], row["publisher"], row["language"], row["direction"]) == ("Full ñame", "Pub", "he", "rtl")


def test_book_uuid(spark):
    titles = ["", "A", "ñandú", "Title 7"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.book_uuid(F.col("t")).alias("u")).collect()
    assert all(r.u == R.book_uuid(r.t) and r.u[14] == "4" and r.u[19] in "89ab" for r in rows)


def test_command_line(spark, tmp_path, capsys):
    book, out = str(tmp_path / "b.epub"), str(tmp_path / "c.json")
    cli.main(["sample", book])
    cli.main(["search", book, "chapter 2"])
    hits = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [h["spine_index"] for h in hits] == [1, 1]
    cli.main(["parse", book])
    assert [json.loads(x)["title"] for x in capsys.readouterr().out.splitlines()] == ["Sample"] * 3
    cli.main(["convert", book, str(tmp_path / "d.epub")])
    assert len(R.read_book("d.epub", (tmp_path / "d.epub").read_bytes())) == 3
    cli.main(["convert", book, out])
    assert isinstance(json.load(open(out)), list)
