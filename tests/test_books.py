"""Book operators on small fixtures, and the readers on files built here."""

import io
import zipfile

import pytest

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books as B
from quire.sources import readers as R

SECTION = "book_id long, section_index long, href string, plain_text string"


def sections(spark, *texts):
    return spark.createDataFrame([(1, i, f"s{i}", t) for i, t in enumerate(texts)], SECTION)


def test_search(spark):
    rows = B.search(sections(spark, "Dark aaaa <b>", "x DARK"), "dark").orderBy("spine_index").collect()
    assert [(r.spine_index, r.char_offset) for r in rows] == [(0, 0), (1, 2)]
    assert rows[0].snippet == "<mark>Dark</mark> aaaa &lt;b&gt;" and rows[1].cfi == "epubcfi(/6/4[s1]!/4/2/1:2)"
    assert B.search(sections(spark, "aaaa"), "aa").count() == 2
    assert B.search(sections(spark, "a.b axb"), "a.b").count() == 1
    assert B.search(sections(spark, "x"), "  ").count() == 0
    assert [r.char_offset for r in B.search_regex(sections(spark, "a1 b22"), "[0-9]+").orderBy("char_offset").collect()] == [1, 4]


def test_chunks_cite_their_place(spark):
    text = "\n".join(f"line {i} " + "word " * 20 for i in range(60))
    rows = B.rag_chunks(sections(spark, text), B.Chunking(100, 10, 10)).orderBy("chunk_index").collect()
    body = "\n".join(x.strip() for x in text.split("\n"))
    assert len(rows) > 5 and all(body[r.start_char : r.start_char + len(r.body)] == r.body for r in rows)


def test_locations_pages_and_cfi(spark):
    rows = [tuple(r)[1:] for r in B.locations(sections(spark, "x" * 120, "", "y" * 50), 50).orderBy("location").collect()]
    assert rows == [(1, 0, 0, 50), (2, 0, 50, 100), (3, 0, 100, 120), (4, 1, 0, 0), (5, 2, 0, 50)]
    assert B.Page().characters == 1660 and B.paginate(sections(spark, "x" * 1661)).count() == 2
    r = spark.range(1).select(T.cfi_spine_index(F.lit("epubcfi(/6/4[c]!/4/2/1:42)")).alias("s"), T.cfi_char_offset(F.lit("epubcfi(/6/4[c]!/4/2/1:42)")).alias("o")).first()
    assert (r.s, r.o) == (1, 42)


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.clock_seconds(F.lit(x))) for x in ("10s", "2.5s", "100ms", "01:30", "01:02:03")] == [10, 2.5, 100, 90, 3723]
    assert one(T.clock_format(F.lit(3723.5))) == "01:02:03.500"
    assert one(T.resolve_path(F.lit("OEBPS/text"), F.lit("../img/a%20b+c.png?v=2#x"))) == "OEBPS/img/a b+c.png"
    assert one(T.mime_type(F.lit("A/B.JPG"))) == "image/jpeg"
    assert one(T.plain_text(F.lit("<p>a<script>var t='</p>';</script><!-- it's --> b</p>"))) == "a b"
    names = spark.createDataFrame([("page10",), ("page2",), ("Page02x",)], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in names] == ["page2", "Page02x", "page10"]


def test_readers(spark):
    fb2 = b"<?xml version='1.0'?><FictionBook><description><title-info><book-title>T</book-title><lang>en</lang><author><first-name>A</first-name><last-name>B</last-name></author></title-info></description><body><section><p>x</p></section></body></FictionBook>"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for n in ("page10.jpg", "page2.png", "__MACOSX/x.jpg"):
            z.writestr(n, b"x")
    files = [
        ("a.epub", R.write_epub("My & Book", ["A B"], "en", [("One", "<p>first</p>"), ("Two", "<p>second</p>")])),
        ("b.fb2", fb2), ("c.cbz", box.getvalue()), ("d.md", b"# H\ntext\n## A\nmore\n```rust\nfn x\n```\n## B\nz"), ("e.cbr", b"Rar!\x1a\x07\x00"), ("f.pdf", b"%PDF-1.4"), ("g.txt", b"Title: X\n\nhello"), ("h.bin", b"\xff\xfe\xfa\x00"),
    ]
    rows = R.parse(spark.createDataFrame(files, "path string, content binary")).collect()
    of = lambda p: sorted((r for r in rows if r.path == p), key=lambda r: r.section_index or 0)
    assert [r.title for r in of("a.epub")] == ["My & Book"] * 2 and "second" in of("a.epub")[1].raw_html
    assert (of("b.fb2")[0].title, of("b.fb2")[0].creators, of("b.fb2")[0].language) == ("T", ["A B"], "en")
    assert [r.href for r in of("c.cbz")] == ["page2.png", "page10.jpg"] and len(of("d.md")) == 3
    assert "CBZ" in of("e.cbr")[0].error and of("f.pdf")[0].error and of("h.bin")[0].error and of("g.txt")[0].title == "X"
    with pytest.raises(R.Unreadable):
        R.unzip(b"PK\x03\x04nope")


def test_toc_of_more_nodes_than_the_row_limit_of_recursion(spark):
    nodes = [(b, i, i - 1 if i else None, 0, f"n{i}") for b in range(20) for i in range(5)] + [(99, i, i - 1 if i else None, 0, "x") for i in range(40)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "30")
    try:
        rows = B.toc_flatten(spark.createDataFrame(nodes, "book_id long, node_id long, parent_id long, ord int, label string")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted((r.book_id, r.node_id, r.depth) for r in rows) == [(b, i, i) for b in range(20) for i in range(5)] + [(99, i, i) for i in range(33)]
    assert {r.breadcrumb for r in rows if (r.book_id, r.node_id) == (3, 2)} == {"n0 > n1 > n2"}


def test_tts_tokens_all_has_every_turn(spark, tmp_path):
    import __spark_entry__ as entry

    turns = [(1, 0, "user", "one two"), (1, 1, "bot", "three"), (2, 0, "user", None), (2, 1, "bot", "a  b")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = entry.queries()["tts_tokens_all"](spark, str(tmp_path)).collect()
    assert sorted((r.book_id, r.section_index, r.word, r.start_char) for r in rows) == [(1, 0, "one", 0), (1, 0, "two", 4), (1, 1, "three", 0), (2, 1, "a", 0), (2, 1, "b", 2)]


def test_queries_have_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
