"""Side documents, markup and lookups on small cases."""

import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import text as T
from quire.operators import reading as R
from quire.sources import readers, side

NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="a"><navLabel><text> One & all </text></navLabel><content src="t/1.xhtml#x"/>
<navPoint><content src="../2.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>Empty</text></navLabel></navPoint><navPoint><navPoint><content src="3.xhtml"/></navPoint></navPoint></navMap></ncx>"""
NAV = """<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="1.xhtml"><b>First</b> part</a><ol><li><a href="1.xhtml#s">Sub</a></li></ol></li><li><span>No link</span></li></ol></nav>
<nav epub:type="landmarks"><ol><li><a epub:type="bodymatter" href="1.xhtml">Start</a></li></ol></nav><nav epub:type="page-list"><ol><li><a href="1.xhtml#p1">1</a></li></ol></nav></body></html>"""


def test_tables_of_contents(spark):
    got = side.ncx(NCX, "OEBPS/toc.ncx")
    assert [(r[0], r[1], r[4], r[6], r[7], r[8]) for r in got] == [(0, None, "One & all", "OEBPS/t/1.xhtml", 0, "One & all"), (1, 0, "Untitled", "2.xhtml", 1, "One & all > Untitled"), (2, None, "Untitled Container", "", 0, "Untitled Container"), (3, 2, "Untitled", "OEBPS/3.xhtml", 1, "Untitled Container > Untitled")]
    assert [(r[4], r[5], r[7]) for r in side.nav(NAV, "nav.xhtml")] == [("First part", "1.xhtml", 0), ("Sub", "1.xhtml#s", 1)] or side.nav(NAV)[0][4] == "First part"
    assert side.landmarks(NAV) == [("bodymatter", "Start", "1.xhtml")] and side.page_list(NAV) == [("1", "1.xhtml#p1")]
    rows = side.toc(spark.createDataFrame([("x/toc.ncx", NCX), ("nav.xhtml", NAV), ("bad.ncx", "<ncx"), ("null.ncx", None)], "path string, text string")).collect()
    assert sum(r.error is None for r in rows) == 6 and {r.path for r in rows if r.error} == {"bad.ncx", "null.ncx"}


def test_overlays_and_clocks():
    assert [side.clock(x) for x in ("10s", "2.5s", "01:30", "01:02:03", "2h", "1.5m", "x")] == [10, 2.5, 90, 3723, 7200, 90, 0]
    text = "<smil xmlns='http://www.w3.org/ns/SMIL'><body><seq id='s'><par id='p'><text src='c.xhtml#w1'/><audio src='../a.mp3' clipBegin='1s' clipEnd='0:02'/></par><par/></seq></body></smil>"
    assert side.smil(text, "o/s.smil") == [(0, "s", None, 0, "p", "c.xhtml#w1", "o/c.xhtml", "w1", "../a.mp3", "a.mp3", 1.0, 2.0)]


def test_catalogues():
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><id>1</id><title>T</title><author><name>A</name></author><link rel='http://opds-spec.org/acquisition' href='b.epub' type='application/epub+zip'/><link rel='x'/></entry></feed>"
    (e,) = side.opds(atom)
    assert (e["id"], e["title"], e["authors"], len(e["links"]), e["summary"]) == ("1", "T", ["A"], 1, None)
    (e,) = side.opds('{"publications":[{"metadata":{"title":"T","author":[{"name":"A"},{"x":1}]},"links":[{"href":"h","type":"t"},{"href":"only"}]}]}')
    assert e["authors"] == ["A"] and e["links"] == [{"rel": "acquisition", "href": "h", "type": "t", "title": None}] and e["id"] == ""


def test_encryption_fonts_charsets_ranges():
    xml = "<encryption><EncryptedData><EncryptionMethod Algorithm='http://www.idpf.org/2008/embedding'/><CipherData><CipherReference URI='f.otf'/></CipherData></EncryptedData></encryption>"
    assert side.encryption(xml) == {"f.otf": "http://www.idpf.org/2008/embedding"}
    font = bytes(range(256)) * 8
    for algorithm, identifier in (("idpf", "urn:uuid:1"), ("http://ns.adobe.com/pdf/enc#RC", "urn:uuid:12345678-1234-1234-1234-123456789abc")):
        hidden = side.deobfuscated(font, algorithm, identifier)
        assert hidden != font and side.deobfuscated(hidden, algorithm, identifier) == font and hidden[1040:] == font[1040:]
    assert side.decoded("\u201c\u20ac".encode("cp1252"), "windows-1252") == "\u201c\u20ac" and side.decoded(b"a\xff", "nonsense") == "a\ufffd"
    assert side.byte_range("bytes=5-") == (5, None) and side.byte_range("bytes=5-9") == (5, 9) and side.byte_range("x") is None and side.range_header(5, 9) == "bytes=5-9"


def test_zip_tail_images_containers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b/c.txt", "x" * 500, zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    assert [(n, size) for n, _, _, size, _ in side.zip_tail(data[-200:], len(data))] == [("a.txt", 5), ("b/c.txt", 500)]
    png = b"\x89PNG\r\n\x1a\n" + b"abc" + b"IEND" + zlib.crc32(b"IEND").to_bytes(4, "big")
    assert side.carved_images(b"xx" + png + b"yy\xff\xd8\xff123\xff\xd9z") == [("image/png", png), ("image/jpeg", b"\xff\xd8\xff123\xff\xd9")]
    book = side.write_kfx("T", ["A"], ["<p>one</p>", "two"])
    assert [(i, k) for i, k, _ in side.kfx_entities(book)] == [(101, 490), (200, 259), (201, 259)] and side.kfx_entities(book)[2][2] == b"two"


def test_accessibility_metadata():
    got = side.accessibility([("schema:accessMode", "textual"), ("schema:accessMode", "textual"), ("schema:accessModeSufficient", "textual, visual"), ("a11y:certifiedBy", "X")])
    assert got["access_modes"] == ["textual"] and got["access_modes_sufficient"] == [["textual", "visual"]] and got["certified_by"] == "X" and got["is_accessible"]


def test_sanitiser():
    assert M.sanitize("<p>a<script src='>'>x</script>b<SCRIPT/>c<iframe>d") == "<p>abcd"
    assert M.sanitize("<img/onload=x src=y>") == "<img/ src=y>" and M.sanitize("<p>donkey onload=5</p>") == "<p>donkey onload=5</p>"
    assert "disabled_uri" in M.sanitize('<a href="&#106;avascript:alert(1)">x</a>') and M.sanitize('<a href="a&#38;b">x</a>') == '<a href="a&#38;b">x</a>'


def test_tree_speech_language():
    nodes = M.dom("<div id=a><P>one<br>two &amp; x</P><!--c--></div><p>three")
    assert [n["node_id"] for n in M.by_tag(nodes, "p")] == [1, 8] or len(M.by_tag(nodes, "P")) == 2
    assert M.to_html(nodes) == '<div id="a"><p>one<br>two &amp; x</p><!--c--></div><p>three</p>' and M.to_html(M.without(nodes, {"p"})) == '<div id="a"><!--c--></div>'
    assert M.tts_html("<p>Hi <b>you</b><script>x y</script></p>") == '<p><span class="tts-word" data-tts-index="0">Hi</span> <b><span class="tts-word" data-tts-index="1">you</span></b><script>x y</script></p>'
    assert M.language("The cat and the dog were in the house with the mouse") == "eng" and M.language("Der Hund und die Katze sind nicht in dem Haus mit der Maus") == "deu" and M.language("short") is None


def test_columns(spark):
    df = spark.createDataFrame([('<html><body><p id="one">a</p> <p id="two">b</p></body></html>',)], "h string")
    got = df.select(M.nearest_anchor(F.col("h"), F.lit(45)).alias("a"), M.nearest_anchor(F.col("h"), F.lit(3)).alias("b"), M.right_to_left(F.col("h")).alias("r"), M.highlighted(F.lit("<pre><code>x")).alias("c"), R.scale(F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(200.0)).alias("s"), R.scale(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("n")).first()
    assert (got.a, got.b, got.s, got.n) == ("two", "one", 2.0, None) and got.r.startswith('<html dir="rtl"') and 'class="treesitter-code treesitter-highlighted"' in got.c
    assert "direction: rtl" in R.Rendition(writing_mode="horizontal-rtl", theme="dark").css() and "#0f172a" in R.Rendition(theme="dark").css() and "Mine" in R.Rendition(custom_font=("Mine", "u")).css()


def test_lookups(spark):
    sections = spark.createDataFrame([(1, 0, "t/a.xhtml", "x" * 100), (1, 1, "t/b.xhtml", ""), (1, 2, "t/c.xhtml", "y" * 60)], "book_id int, section_index int, href string, plain_text string")
    at = spark.createDataFrame([(1, 0, 0), (1, 0, 50), (1, 0, 51), (1, 0, 500), (1, 1, 0), (1, 2, 60)], "book_id int, section_index int, char_offset int")
    got = {(r.section_index, r.char_offset): r.location for r in R.location_lookup(sections, at, 50).collect()}
    assert got == {(0, 0): 1, (0, 50): 1, (0, 51): 2, (0, 500): 1, (1, 0): 3, (2, 60): 5}
    assert R.section_by_href(sections, "b.xhtml#x").first().section_index == 1
    assert R.section_by_cfi(sections, spark.createDataFrame([(1, "epubcfi(/6/6!/4:2)")], "book_id int, cfi string")).first().section_index == 2
    toc = spark.createDataFrame([(1, 0, 0, "B", "b.xhtml#k"), (1, 1, 0, "none", "z.xhtml")], "book_id int, ord int, depth int, label string, href string")
    assert [r.chapter for r in R.toc_labels(sections, toc).orderBy("section_index").collect()] == ["Section 1", "B", "Section 3"]
    assert [r.section_index for r in R.toc_targets(toc, sections).orderBy("ord").collect()] == [1, 0]
    html = sections.withColumn("raw_html", F.lit("<html><body onload='x()'>a</body></html>")).withColumn("direction", F.lit("rtl"))
    assert R.rendered(html, (lambda h: F.concat(h, F.lit("!")),)).first().html == '<html dir="rtl"><body >a</body></html>!'


def test_broken_files_do_not_fail_the_job():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", "<a>" + "x" * 5000 + "</a>")
    data = bytearray(out.getvalue())
    data[60:90] = b"\xff" * 30
    nested = ("<FictionBook><body>" + "<section>" * 3000 + "</section>" * 3000 + "</body></FictionBook>").encode()
    for name, content in (("a.odt", bytes(data)), ("b.fb2", b" " * 5000 + nested), ("c.kfx", b"CONT" + b"x" * 5000 + b"DRM_V1")):
        (row,) = readers.read_book(name, content)
        assert row[-1], name


def test_cfi_ranges_and_selectors(spark):
    cases = [
        ("epubcfi(/6/4[c]!/4/2,/1:10,/3:45)", "epubcfi(/6/4[c]!/4/2/1:10)", "epubcfi(/6/4[c]!/4/2/3:45)", "#c > *:nth-child(2) > *:nth-child(1)", "c"),
        (" /6/04!/4[a:7]/10:007 ", "epubcfi(/6/4!/4[a:7]/10:7)", "epubcfi(/6/4!/4[a:7]/10:7)", "#a:7 > *:nth-child(5)", "a:7"),
        ("epubcfi(/4/2,:1)", None, None, None, None),
        ("", "epubcfi()", "epubcfi()", "body", None),
        (None, None, None, None, None),
    ]
    x = F.col("cfi")
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, cfi string")
    got = df.select("i", T.cfi_point(x), T.cfi_point(x, 2), T.cfi_selector(x), T.cfi_element(x)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]


def test_mobi_sections_by_heading():
    def book(text):
        head = struct.pack(">HHIHHHH", 1, 0, len(text), 1, 4096, 0, 0)
        at = [78 + 2 * 8, 78 + 2 * 8 + len(head)]
        return b"A book".ljust(76, b"\0") + struct.pack(">H", 2) + b"".join(struct.pack(">II", a, 0) for a in at) + head + text

    intro = "<h1>Title</h1>" + "é" * 100
    of = lambda text: [p for _, p in readers.mobi(book(text.encode()), "t")[1]]
    assert of(intro + "<H2>One</H2>a<h4>x</h4> <h3>Two</h3>b") == [intro, "<H2>One</H2>a<h4>x</h4> ", "<h3>Two</h3>b"]
    assert of("<h1>T</h1>a<h2>b</h2>") == ["<h1>T</h1>a<h2>b</h2>"]
    assert of(intro + "<mbp:pagebreak/>" + intro + "<h2>c</h2>") == [intro, intro + "<h2>c</h2>"]
