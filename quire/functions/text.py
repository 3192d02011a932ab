"""Column functions over text, labels and list items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ascii_lower(c) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(_col(c), UPPER, LOWER)


def decode_pdf_string(raw) -> Column:
    """UTF-16BE after FE FF (an odd last byte dropped), else Latin-1. For strings
    with broken surrogates use the kernel's decoder."""
    raw = _col(raw)
    body = F.substring(raw, 3, 1 << 30)
    even = F.octet_length(body) - F.octet_length(body) % 2
    return F.when(raw.startswith(F.lit(b"\xfe\xff")), F.decode(F.substr(body, F.lit(1), even), "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))


def roman(n, upper: bool = False) -> Column:
    """Roman numerals of 1 to 3999; other numbers in figures."""
    n = _col(n)
    digits = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
    parts = [F.get(F.array(*map(F.lit, names)), (F.floor(n / unit) % 10).cast("int")) for names, unit in zip(digits, (1000, 100, 10, 1))]
    text = F.concat(*parts)
    return F.when((n >= 1) & (n <= 3999), F.upper(text) if upper else text).otherwise(n.cast("string"))


def alpha(n, upper: bool = False) -> Column:
    """a..z, aa, ab .. (bijective base 26) of 1 and up; 0 in figures."""
    n = _col(n).cast("long")
    letters = UPPER if upper else LOWER
    start = F.struct(n.alias("n"), F.lit("").alias("s"))

    def step(a, _):
        less = a["n"] - 1
        letter = F.substr(F.lit(letters), (less % 26 + 1).cast("int"), F.lit(1))
        return F.when(a["n"] > 0, F.struct(F.floor(less / 26).cast("long").alias("n"), F.concat(letter, a["s"]).alias("s"))).otherwise(a)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"])
    return F.when(n <= 0, n.cast("string")).otherwise(folded)


def page_label(page, start, style, prefix, first) -> Column:
    """The label of a page in the range that holds it."""
    page, start, style, prefix, first = map(_col, (page, start, style, prefix, first))
    n = first + page - start
    shown = F.when(style == "r", roman(n)).when(style == "R", roman(n, True)).when(style == "a", alpha(n)).when(style == "A", alpha(n, True)).when(style != "", n.cast("string"))
    return F.when(style.isNull() & prefix.isNull(), (page + 1).cast("string")).otherwise(F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(shown, F.lit(""))))


#: What a bulleted item starts with.
BULLETS = "•●○■□▪▫-*–—"
_BULLET = f"^[{BULLETS.replace('-', '')}-]"
_NUMBERED = r"^(\([0-9A-Za-z]{0,4}|[0-9A-Za-z]{1,5})[.):]"


def is_bullet(c) -> Column:
    return _col(c).rlike(_BULLET)


def is_numbered(c) -> Column:
    return _col(c).rlike(_NUMBERED) & (F.octet_length(_col(c)) >= 2)


def strip_bullet(c) -> Column:
    return F.regexp_replace(_col(c), _BULLET + r"[ \t]*", "")


def strip_number(c) -> Column:
    return F.regexp_replace(_col(c), r"^(\([0-9A-Za-z]{0,4}|[0-9A-Za-z]{0,5})[.):]?\)?[ \t]*", "")


def indent_level(x) -> Column:
    """Steps of 36 points, 6 at most."""
    return F.least(F.lit(6.0), F.greatest(F.lit(0.0), _col(x) / 36)).cast("int")


#: What structure types become in Markdown; others are paragraphs.
STRUCTURE = {
    "H": "heading1", "H1": "heading1", "H2": "heading2", "H3": "heading3", "H4": "heading4", "H5": "heading5", "H6": "heading6",
    "L": "list_item_bullet", "LI": "list_item_bullet", "Lbl": "list_item_bullet", "Table": "table_row", "TR": "table_row",
    "TH": "table_row", "TD": "table_row", "Code": "code_block", "BlockQuote": "blockquote", "Quote": "blockquote",
}


def structure_kind(c) -> Column:
    pairs = reduce(lambda a, b: a + b, ([F.lit(k), F.lit(v)] for k, v in STRUCTURE.items()))
    return F.coalesce(F.create_map(*pairs)[_col(c)], F.lit("paragraph"))


def normalize_space(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def page_numbers(spec, total) -> Column:
    """A page range such as "1-3,7" as an array of 0-based pages: order and repeats
    stay, a bad start is 1, a bad end the last page, a bad single page is left out,
    and what lies beyond the document is cut."""
    spec, total = _col(spec), _col(total)
    items = F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: s != "")
    # longer runs of figures mean the largest number
    whole = lambda s: F.when(s.rlike(r"^\+?\d{1,9}$"), s.cast("int")).when(s.rlike(r"^\+?\d+$"), F.lit(2147483647))

    def pages(item):
        dash = F.instr(item, "-")
        a = F.coalesce(whole(F.trim(F.substr(item, F.lit(1), dash - 1))), F.lit(1))
        b = F.coalesce(whole(F.trim(F.substr(item, dash + 1))), total)
        first, last = F.greatest(a - 1, F.lit(0)), F.least(b, total) - 1
        one = F.greatest(whole(item) - 1, F.lit(0))
        none = F.array().cast("array<int>")
        return F.when(dash > 0, F.when(first <= last, F.sequence(first, last)).otherwise(none)).otherwise(F.when(whole(item).isNotNull() & (one < total), F.array(one)).otherwise(none))

    return F.flatten(F.transform(items, pages))
