"""Queries over PDFs made from the test tables, and the same results in SQL over
the tables themselves."""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.kernel import writer as W
from quire.operators import layout, likeness, markdown, search
from quire.operators import text as X
from quire.session import table
from quire.sources.pdf import extract, headers
from quire.sources.synth import spread, synthesize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINES = 40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _chunks(items, n):
    return [items[k : k + n] for k in range(0, len(items), n)] or [[]]


# Text of documents

_PAGES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n // {LINES} AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY n) AS text
FROM l GROUP BY ALL
"""


def _lines_pdf(r):
    return W.simple_pdf([W.show_lines(p) for p in _chunks((r["text"] or "").split("\n"), LINES)])


def _documents(spark, d, make=_lines_pdf):
    return synthesize(table(spark, d, "documents").select("doc_id", "text"), make, "doc_id")


@query(_PAGES_SQL)
def text_stream(spark, d):
    return extract(_documents(spark, d), "page_text").select("doc_id", "page", F.col("stream").alias("text"))


@query(_PAGES_SQL)
def text_by_windows(spark, d):
    return X.from_operators(extract(_documents(spark, d), "content_ops"))


@query(_PAGES_SQL)
def text_accuracy(spark, d):
    return X.structured(extract(_documents(spark, d), "page_all")).select("doc_id", "page", "text")


@query(f"""
WITH p AS ({_PAGES_SQL}) SELECT doc_id, string_agg(text, chr(12) ORDER BY page) AS text FROM p GROUP BY doc_id
""")
def text_fast_all(spark, d):
    return X.document_text(extract(_documents(spark, d), "document_pages"), "plain")


def _cid_pdf(r):
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>] >>"
    return W.simple_pdf([W.show_lines(p, hexa="utf-16-be") for p in _chunks((r["text"] or "").split("\n"), LINES)], fonts={"F1": font})


@query(_PAGES_SQL)
def text_utf16_cid(spark, d):
    return extract(_documents(spark, d, _cid_pdf), "page_text").select("doc_id", "page", F.col("stream").alias("text"))


def _codes(text):
    return {c: 33 + k for k, c in enumerate(sorted(set(text) - {"\n", " "}))} | {" ": 32}


def _coded(text, codes, font):
    pages = [[line.translate(codes) for line in p] for p in _chunks(text.split("\n"), LINES)]
    return W.simple_pdf([W.show_lines(p, hexa="latin-1") for p in pages], fonts={"F1": font})


def _differences_pdf(r):
    codes = _codes(r["text"] or "")
    names = b" ".join(b"/uni%04X" % ord(c) for c in sorted(codes, key=codes.get))
    return _coded(r["text"] or "", {ord(c): chr(n) for c, n in codes.items()}, b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /BaseEncoding /StandardEncoding /Differences [32 %s] >> >>" % names)


@query(_PAGES_SQL)
def text_differences(spark, d):
    return extract(_documents(spark, d, _differences_pdf), "page_text").select("doc_id", "page", F.col("stream").alias("text"))


def _tounicode_pdf(r):
    """The text's characters by bfchar entries of a composite font, with codes that
    mean nothing else; `the` is one code."""
    text = (r["text"] or "").replace("the", "\ue000")
    codes = {c: 0x4000 + k for k, c in enumerate(sorted(set(text) - {"\n"}))}
    entries = b"\n".join(b"<%04X> <%s>" % (n, ("the" if c == "\ue000" else c).encode("utf-16-be").hex().encode()) for c, n in codes.items())
    w = W.Writer()
    root, tree, page, body, font, cmap = (w.reserve() for _ in range(6))
    pages = _chunks(text.split("\n"), LINES)
    kids = [page] + [w.reserve() for _ in pages[1:]]
    for k, lines in zip(kids, pages):
        shown = W.show_lines([line.translate({ord(c): chr(n) for c, n in codes.items()}) for line in lines], hexa="utf-16-be")
        w.put(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Contents %d 0 R >>" % (tree, w.stream(shown, flate=True)), k)
    w.put(b"null", body)
    w.stream(b"/CIDInit begincmap %d beginbfchar\n%s\nendbfchar endcmap" % (len(codes), entries), num=cmap)
    w.put(b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [] /ToUnicode %d 0 R >>" % cmap, font)
    w.put(b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 %d 0 R >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids), font), tree)
    w.put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    return w.save(root)


@query(_PAGES_SQL)
def text_tounicode(spark, d):
    return extract(_documents(spark, d, _tounicode_pdf), "page_text").select("doc_id", "page", F.col("stream").alias("text"))


_FILTERS = (
    (b"", lambda x: x),
    (b"/Filter /FlateDecode", zlib.compress),
    (b"/Filter /AHx", lambda x: x.hex().encode() + b">"),
    (b"/Filter [/ASCII85Decode]", lambda x: base64.a85encode(x) + b"~>"),
    (b"/Filter /RunLengthDecode", W.run_length_encode),
    (b"/Filter /LZWDecode", W.lzw_encode),
    (b"/Filter [/A85 /Fl]", lambda x: base64.a85encode(zlib.compress(x)) + b"~>"),
    (b"/Filter /Fl /DecodeParms << /Predictor 12 /Columns 16 >>", lambda x: zlib.compress(W.png_up(x, 16))),
)


def _filters_pdf(r):
    entries, encode = _FILTERS[r["doc_id"] % len(_FILTERS)]
    return W.simple_pdf([W.show_lines(p) for p in _chunks((r["text"] or "").split("\n"), LINES)], filters=entries, encode=encode)


@query(_PAGES_SQL)
def filters_roundtrip(spark, d):
    return extract(_documents(spark, d, _filters_pdf), "page_text").select("doc_id", "page", F.col("stream").alias("text"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn, text) AS text
FROM conversations GROUP BY conv_id
""")
def text_all_formfeed(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("turns"))
    files = synthesize(turns, lambda r: W.simple_pdf([W.show_lines(t["t"].split("\n")) for t in r["turns"]]), "conv_id")
    return X.document_text(extract(files, "document_pages"))


def _predicted(data: bytes, columns: int, tag: int) -> bytes:
    """Rows less what a PNG predictor makes of their neighbours."""
    from quire.kernel.filters import paeth

    data += b" " * (-len(data) % columns)
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns):
        row = data[at : at + columns]
        left = bytes(1) + row[:-1]
        corner = bytes(1) + above[:-1]
        guess = (bytes(columns), left, above, bytes((a + b) // 2 for a, b in zip(left, above)), bytes(map(paeth, left, above, corner)))[tag]
        out += bytes([tag]) + bytes((x - g) & 255 for x, g in zip(row, guess))
        above = row
    return bytes(out)


def _tiff(data: bytes, columns: int) -> bytes:
    data += b" " * (-len(data) % columns)
    return b"".join(bytes((x - y) & 255 for x, y in zip(row, bytes(1) + row[:-1])) for row in (data[at : at + columns] for at in range(0, len(data), columns)))


def _predictors_pdf(r):
    """Every PNG predictor, TIFF's, and PNG's after LZW, by document."""
    k = r["n_nationkey"] % 7
    if k < 5:
        entries, encode = b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 9 >>", lambda x: zlib.compress(_predicted(x, 9, k))
    elif k == 5:
        entries, encode = b"/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns 11 >>", lambda x: zlib.compress(_tiff(x, 11))
    else:
        entries, encode = b"/Filter /LZWDecode /DecodeParms << /Predictor 12 /Columns 9 >>", lambda x: W.lzw_encode(_predicted(x, 9, 2))
    return W.simple_pdf([W.show_lines([r["n_name"], r["n_comment"]])], filters=entries, encode=encode)


def _nations(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", "n_name", F.coalesce(*([F.col("n_comment")] if "n_comment" in n.columns else []), F.concat(F.lit("of "), "n_name")).alias("n_comment"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name || chr(10) || 'of ' || n_name AS text FROM nation")
def filters_predictors(spark, d):
    files = synthesize(_nations(spark, d).withColumn("n_comment", F.concat(F.lit("of "), "n_name")), _predictors_pdf, "n_nationkey")
    return extract(files, "page_text").select("doc_id", F.col("stream").alias("text"))


def _bfrange_pdf(r):
    """Letters by a range with an offset, by a range with a list, and a ligature."""
    font = W.Writer()
    root, tree, page, body, face = (font.reserve() for _ in range(5))
    cmap = b"begincmap 3 beginbfrange <0041> <005A> <0041> <0100> <0102> [<00660069> <0031> <20AC>] <0200> <0201> <D83DDE00> endbfrange endcmap"
    codes = "".join(f"{ord(c):04X}" for c in r["n_name"] if "A" <= c <= "Z")
    font.stream(b"BT /F1 12 Tf 1 1 Td <%s010001010102020002FF> Tj ET" % codes.encode(), num=body)
    font.put(b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [] /ToUnicode %d 0 R >>" % font.stream(cmap), face)
    font.put(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (tree, body), page)
    font.put(b"<< /Type /Pages /Count 1 /Kids [%d 0 R] /Resources << /Font << /F1 %d 0 R >> >> >>" % (page, face), tree)
    font.put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    return font.save(root)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, regexp_replace(n_name, '[^A-Z]', '', 'g') || 'fi1€😀' || chr(767) AS text FROM nation")
def text_bfrange(spark, d):
    return extract(synthesize(_nations(spark, d), _bfrange_pdf, "n_nationkey"), "page_text").select("doc_id", F.col("stream").alias("text"))


def _encoded_pdf(r):
    """A named encoding, or glyph names, by document."""
    encodings = ((b"/MacRomanEncoding", b"\x8e\xa5"), (b"/StandardEncoding", b"\xe1\xb7"), (b"/PDFDocEncoding", b"\xa0\x80"), (b"<< /Differences [128 /Lslash /fi /florint /onehalf] >>", b"\x80\x81\x82\x83"))
    encoding, codes = encodings[r["n_nationkey"] % 4]
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding %s >>" % encoding
    return W.simple_pdf([b"BT /F1 12 Tf 1 1 Td (%s%s) Tj ET" % (r["n_name"].encode(), codes)], fonts={"F1": font})


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name || ['é•', 'Æ•', '€•', 'Łﬁƒ½'][n_nationkey % 4 + 1] AS text FROM nation")
def text_encodings(spark, d):
    return extract(synthesize(_nations(spark, d), _encoded_pdf, "n_nationkey"), "page_text").select("doc_id", F.col("stream").alias("text"))


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(v.a + CASE WHEN v.simple THEN n_nationkey ELSE 0 END AS INTEGER) AS first_code, CAST(v.b + CASE WHEN v.simple THEN n_nationkey ELSE 0 END AS INTEGER) AS last_code, CAST(v.w + n_nationkey AS DOUBLE) AS width,
       CAST(CASE WHEN v.simple THEN 77 ELSE 900 END AS DOUBLE) AS default_width, CASE WHEN NOT v.simple THEN 'Japan1' END AS ordering
FROM nation, (VALUES (true, 65, 65, 500), (true, 66, 66, 600), (false, 1, 1, 10), (false, 2, 2, 20), (false, 5, 7, 30)) v(simple, a, b, w)
""")
def font_widths(spark, d):
    def make(r):
        k = r["n_nationkey"]
        plain = b"<< /Type /Font /Subtype /Type1 /FirstChar %d /Widths [%d %d] /FontDescriptor << /MissingWidth 77 >> >>" % (65 + k, 500 + k, 600 + k)
        inner = b"<< /Subtype /CIDFontType2 /DW 900 /W [1 [%d %d] 5 7 %d] /CIDSystemInfo << /Ordering (Japan1) >> >>" % (10 + k, 20 + k, 30 + k)
        return W.simple_pdf([b""], fonts={"F1": plain, "F2": b"<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [%s] >>" % inner})

    files = synthesize(table(spark, d, "nation").select("n_nationkey"), make, "n_nationkey")
    return extract(files, "font_widths").select("doc_id", "first_code", "last_code", "width", "default_width", "ordering")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name AS text FROM nation")
def xref_rebuild(spark, d):
    def make(r):
        whole = W.simple_pdf([W.show_lines([r["n_name"]])])
        return whole if r["n_nationkey"] % 2 else whole[: whole.rindex(b"xref\n0")]

    return extract(synthesize(_nations(spark, d), make, "n_nationkey"), "page_text", rebuild=True).select("doc_id", F.col("stream").alias("text"))


def _hostile(r):
    """Five kids: a good page, no reference, a page of huge numbers, a node that is no
    page, and a page that paints forms without end beside its text."""
    w = W.Writer()
    root, tree, font, form = (w.reserve() for _ in range(4))
    name, huge = r["n_name"].encode(), b"9" * 400
    bodies = [b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % name, b"/P <</MCID %s>> BDC BT /F1 %s Tf 1 0 0 1 -%s %s.5 Tm (far %s) Tj ET EMC" % (huge, huge, huge, huge, name), b"BT /F1 12 Tf 72 700 Td (last %s) Tj ET /X1 Do" % name]
    pages = [w.put(b"<< /Type /Page /Parent %d 0 R /Rotate 99999999999 /Contents %d 0 R >>" % (tree, w.stream(x))) for x in bodies]
    odd = w.put(b"<< /Type /Template /Parent %d 0 R >>" % tree)
    w.put(W.HELVETICA, font)
    w.stream(b"/X1 Do", b"/Type /XObject /Subtype /Form", form)
    kids = b"%d 0 R null %d 0 R %d 0 R %d 0 R" % (pages[0], pages[1], odd, pages[2])
    w.put(b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 %d 0 R >> /XObject << /X1 %d 0 R >> >> >>" % (kids, font, form), tree)
    w.put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    return w.save(root)


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, v.what, CAST(v.page AS INTEGER) AS page, CASE v.what WHEN 'error' THEN v.t ELSE v.t || n_name || CASE v.what WHEN 'markdown' THEN chr(10) ELSE '' END END AS text
FROM nation, (VALUES ('text', 0, ''), ('text', 1, 'far '), ('text', 2, 'last '), ('geometric', 0, ''), ('geometric', 1, 'far '), ('geometric', 2, 'last '), ('markdown', 0, ''), ('markdown', 1, 'far '), ('markdown', 2, 'last '),
              ('error', NULL, 'invalid_page_tree'), ('error', NULL, 'invalid_page_tree'), ('error', 2, 'limit')) v(what, page, t)
""")
def page_failures(spark, d):
    files = synthesize(_nations(spark, d), _hostile, "n_nationkey")
    spans = extract(files, "page_spans")
    found = {"text": extract(files, "page_text").withColumnRenamed("stream", "text"), "geometric": layout.geometric(spans), "markdown": markdown.pages(spans), "error": extract(files, "parse_errors").withColumn("text", F.col("kind"))}
    parts = [df.select("doc_id", F.lit(what).alias("what"), "page", "text") for what, df in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# Pages

_ORDERS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)"


def _customers(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice"), 2).alias("price"))
    return orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "price"))).alias("orders"))


def _order_pages(r):
    keys = [o["o_orderkey"] for o in r["orders"]]
    return W.simple_pdf([b""] * len(keys), boxes=[(10, 20, 110 + k % 500, 220 + k % 300) for k in keys], rotations=[k % 4 * 90 for k in keys])


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(count(*) AS INTEGER) AS n_pages FROM orders GROUP BY o_custkey")
def page_count(spark, d):
    return extract(synthesize(_customers(spark, d), _order_pages, "o_custkey"), "document").select("doc_id", "n_pages")


@query(f"""
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS page, CAST(100 + o_orderkey % 500 AS DOUBLE) AS width,
       CAST(200 + o_orderkey % 300 AS DOUBLE) AS height, CAST(o_orderkey % 4 * 90 AS INTEGER) AS rotation FROM {_ORDERS}
""")
def page_info(spark, d):
    return extract(synthesize(_customers(spark, d), _order_pages, "o_custkey"), "pages").select("doc_id", "page", "width", "height", "rotation")


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS page, CAST(100 + o_orderkey % 500 AS DOUBLE) AS width FROM {_ORDERS} WHERE k IN (0, 2)")
def pages_pruned(spark, d):
    files = synthesize(_customers(spark, d), _order_pages, "o_custkey")
    return extract(files, "pages", pages=[0, 2]).select("doc_id", "page", "width")


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(unnest(list_concat(
         generate_series(n_nationkey % 5, least(n_nationkey % 5 + 3, 5)),
         CASE WHEN n_nationkey % 9 < 6 THEN [CAST(n_nationkey % 9 AS BIGINT)] ELSE [] END)) AS INTEGER) AS page FROM nation
""")
def page_range(spark, d):
    spec = F.format_string("%d-%d, %d,x", F.col("n_nationkey") % 5 + 1, F.col("n_nationkey") % 5 + 4, F.col("n_nationkey") % 9 + 1)
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.explode(T.page_numbers(spec, F.lit(6))).alias("page"))


# Content and structure

def _tj(r):
    words = r["p_name"].split(" ")
    parts = b" -200 ".join(b"(%s) 40 (%s)" % (W.escape(w[: len(w) // 2]), W.escape(w[len(w) // 2 :])) for w in words)
    return W.simple_pdf([b"BT /F1 12 Tf 72 700 Td [%s -90] TJ T* <%s> Tj ET" % (parts, r["p_brand"].encode().hex().encode())])


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name || chr(10) || p_brand AS text FROM part")
def text_tj_spacing(spark, d):
    files = synthesize(spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey"), _tj, "p_partkey")
    return extract(files, "page_text").select("doc_id", F.col("stream").alias("text"))


def _revised(r):
    w = W.Writer()
    root, tree, page, body, font = (w.reserve() for _ in range(5))
    w.put(b"<< /Type /Catalog /Pages 2 0 R >>", root)
    w.put(b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", tree)
    w.put(b"<< /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", page)
    w.put(W.HELVETICA, font)
    w.stream(W.show_lines(["before " + r["o_orderstatus"]]), num=body)
    first = w.save(root)
    if r["o_orderkey"] % 2:
        return first
    w.stream(W.show_lines(["after " + r["o_orderpriority"]]), num=body)
    return w.save(root, before=first, only=[body])


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
       CASE WHEN o_orderkey % 2 = 1 THEN 'before ' || o_orderstatus ELSE 'after ' || o_orderpriority END AS text FROM orders
""")
def xref_incremental(spark, d):
    files = synthesize(spread(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey"), _revised, "o_orderkey")
    return extract(files, "page_text").select("doc_id", F.col("stream").alias("text"))


def _packed(r):
    return W.simple_pdf([W.show_lines([r["n_name"]])], info={"Title": r["n_name"]}, packed=True)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name AS text, n_name AS title FROM nation")
def xref_stream_objstm(spark, d):
    files = synthesize(table(spark, d, "nation").select("n_nationkey", "n_name"), _packed, "n_nationkey")
    return extract(files, "page_text").join(extract(files, "metadata"), "doc_id").select("doc_id", F.col("stream").alias("text"), "title")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, t.entry_type, t.n FROM nation, (VALUES ('in_use', CAST(3 AS BIGINT)), ('compressed', CAST(6 AS BIGINT)), ('free', CAST(1 AS BIGINT))) t(entry_type, n)")
def xref_entries(spark, d):
    files = synthesize(table(spark, d, "nation").select("n_nationkey", "n_name"), _packed, "n_nationkey")
    return extract(files, "xref").groupBy("doc_id", "entry_type").agg(F.count("*").alias("n"))


def _nested(r):
    depth = r["n_nationkey"] % 13
    forms = {f"X{k}": b"/X%d Do" % (k + 1) for k in range(1, depth)}
    shown = W.show_lines([r["n_name"]])
    if depth:
        forms[f"X{depth}"] = shown
    return W.simple_pdf([b"/X1 Do" if depth else shown], forms=forms)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CASE WHEN n_nationkey % 13 <= 10 THEN n_name ELSE '' END AS with_forms, CASE WHEN n_nationkey % 13 = 0 THEN n_name ELSE '' END AS without FROM nation")
def form_xobject(spark, d):
    files = synthesize(table(spark, d, "nation").select("n_nationkey", "n_name"), _nested, "n_nationkey")
    return extract(files, "page_text").select("doc_id", F.col("stream").alias("with_forms"), F.col("plain").alias("without"))


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'F1' AS font_name, 'Type1' AS subtype, false AS is_cid, CAST(1 AS INTEGER) AS bytes_per_char,
       CAST(0 AS INTEGER) AS wmode, CAST(800 + n_nationkey AS DOUBLE) AS ascender, CAST(-200 AS DOUBLE) AS descender FROM nation
""")
def fonts(spark, d):
    def make(r):
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FontDescriptor << /Ascent %d >> >>" % (800 + r["n_nationkey"])
        return W.simple_pdf([b""], fonts={"F1": font})

    files = synthesize(table(spark, d, "nation").select("n_nationkey"), make, "n_nationkey")
    return extract(files, "fonts").select("doc_id", "font_name", "subtype", "is_cid", "bytes_per_char", "wmode", "ascender", "descender")


# Spans and layout

def _orders_of_lines(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("t"))
    return spread(li, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "t"))).alias("rows"))


#: Lines of an order, numbered from 0: line numbers repeat in the test tables.
_LI = """(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus || l_partkey) - 1 AS k,
                 l_returnflag || l_linestatus || l_partkey AS t FROM lineitem)"""


def _grid(place, size=lambda k: 12):
    def make(r):
        shown = [b"1 0 0 1 %g %g Tm /F1 %g Tf (%s) Tj" % (*place(k), size(k), W.escape(x["t"])) for k, x in enumerate(r["rows"])]
        return W.simple_pdf([b"BT " + b"\n".join(shown) + b" ET"])

    return make


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(0 AS INTEGER) AS page, CAST(k AS INTEGER) AS seq, CAST(72 + 36 * k AS DOUBLE) AS x0, CAST(700 - 20 * k AS DOUBLE) AS y0,
       CAST(72 + 36 * k + strlen(t) * (8 + k) * 0.5 AS DOUBLE) AS x1, round(700 - 20 * k + 1.2 * (8 + k), 6) :: DOUBLE AS y1, t AS text, CAST(8 + k AS DOUBLE) AS font_size FROM {_LI}
""")
def spans_bounds(spark, d):
    files = synthesize(_orders_of_lines(spark, d), _grid(lambda k: (72 + 36 * k, 700 - 20 * k), lambda k: 8 + k), "l_orderkey")
    return layout.span_rows(extract(files, "page_spans")).withColumn("y1", F.round("y1", 6))


@query(f"""
WITH r AS (SELECT l_orderkey, k % 3 AS line, string_agg(t, ' ' ORDER BY k) AS text FROM {_LI} GROUP BY ALL)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, string_agg(text, chr(10) ORDER BY line) AS text FROM r GROUP BY l_orderkey
""")
def geometric_sort(spark, d):
    files = synthesize(_orders_of_lines(spark, d), _grid(lambda k: (72 + 150 * (k // 3), 700 - 30 * (k % 3))), "l_orderkey")
    return layout.geometric(extract(files, "page_spans")).select("doc_id", "text")


@query("""
WITH s AS (SELECT s_nationkey, s_name, s_suppkey FROM supplier)
SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, true AS two_columns,
       string_agg(s_name, chr(10) ORDER BY s_suppkey) || CASE WHEN count(*) = 1 THEN ' ' ELSE chr(10) END || string_agg('key ' || s_suppkey, chr(10) ORDER BY s_suppkey) AS text
FROM s GROUP BY s_nationkey
""")
def visual_two_columns(spark, d):
    def make(r):
        shown = [b"1 0 0 1 %d %d Tm (%s) Tj" % (x, 40_000 - 20 * k, W.escape(t)) for k, s in enumerate(r["s"]) for x, t in ((350, f"key {s['s_suppkey']}"), (72, s["s_name"]))]
        return W.simple_pdf([b"BT /F1 12 Tf " + b"\n".join(shown) + b" ET"])

    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    return layout.visual(extract(synthesize(rows, make, "s_nationkey"), "page_spans")).select("doc_id", "two_columns", "text")


def _broken(r):
    """Three pieces a line: two that touch, one apart."""
    shown = []
    for k, x in enumerate(r["rows"]):
        y, t = 700 - 15 * k - 30 * (k // 4), x["t"]
        at = 72 + 40 * (k % 5 == 2)
        shown += [b"1 0 0 1 %g %d Tm (%s) Tj" % (at, y, W.escape(t)), b"1 0 0 1 %g %d Tm (-) Tj" % (at + 6 * len(t) + 2, y), b"1 0 0 1 250 %d Tm (w%d) Tj" % (y, k)]
    return W.simple_pdf([b"BT /F1 12 Tf " + b"\n".join(shown) + b" ET"])


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS line_no, CAST(w AS INTEGER) AS word_no, CASE WHEN w = 0 THEN t || '-' ELSE 'w' || k END AS text
FROM {_LI}, (VALUES (0), (1)) v(w)
""")
def layout_words(spark, d):
    return layout.words(extract(synthesize(_orders_of_lines(spark, d), _broken, "l_orderkey"), "page_spans")).select("doc_id", "line_no", "word_no", "text")


_LINES_SQL = f"(SELECT l_orderkey, k, t, CAST(72 + CASE WHEN k % 5 = 2 THEN 40 ELSE 0 END AS DOUBLE) AS x0, CAST(700 - 15 * k - 30 * (k // 4) AS DOUBLE) AS y0 FROM {_LI})"


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS line_no, x0, y0, y0 AS baseline_y, t || '- w' || k AS text FROM {_LINES_SQL}")
def layout_lines(spark, d):
    return layout.lines(extract(synthesize(_orders_of_lines(spark, d), _broken, "l_orderkey"), "page_spans")).select("doc_id", "line_no", "x0", "y0", "baseline_y", "text")


@query(f"""
WITH l AS (SELECT *, lag(y0) OVER (PARTITION BY l_orderkey ORDER BY k) - y0 AS gap, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN avg(x0) OVER (PARTITION BY l_orderkey) ELSE 0 END AS margin FROM {_LINES_SQL}),
m AS (SELECT *, coalesce(avg(gap) OVER (PARTITION BY l_orderkey), 0) AS spacing FROM l),
p AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1.5 * spacing OR x0 - margin > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS para FROM m)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(para AS INTEGER) AS para_no, min(x0) AS x0, min(y0) AS y0, round(arg_min(x0 - margin, k), 6) AS first_line_indent, CAST(count(*) AS INTEGER) AS n_lines FROM p GROUP BY l_orderkey, para
""")
def layout_paragraphs(spark, d):
    p = layout.paragraphs(extract(synthesize(_orders_of_lines(spark, d), _broken, "l_orderkey"), "page_spans"))
    return p.select("doc_id", "para_no", "x0", "y0", F.round("first_line_indent", 6).alias("first_line_indent"), "n_lines")


@query(f"""
WITH w AS (SELECT l_orderkey, 8 + k % 3 * 2 AS size, sum(strlen(t)) AS n FROM {_LI} GROUP BY ALL)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(arg_max(size, n * 1000 - size) AS DOUBLE) AS body_size, CAST(min(size) AS DOUBLE) AS min_size, CAST(max(size) AS DOUBLE) AS max_size FROM w GROUP BY l_orderkey
""")
def body_font_mode(spark, d):
    files = synthesize(_orders_of_lines(spark, d), _grid(lambda k: (72, 700 - 20 * k), lambda k: 8 + k % 3 * 2), "l_orderkey")
    return markdown.body_size(extract(files, "page_spans")).select("doc_id", "body_size", "min_size", "max_size")


# Marked content

def _tagged(r):
    order = r["orders"]
    shown = [b"/P <</MCID %d>> BDC 0 -14 Td (order %d) Tj EMC" % (k, o["o_orderkey"]) for k, o in enumerate(order)]
    tree = sorted(range(len(order)), key=lambda k: (-order[k]["price"], order[k]["o_orderkey"]))
    if r["o_custkey"] % 2 == 0:
        tree = tree[: len(tree) // 3]
    return W.simple_pdf([b"BT /F1 12 Tf 72 720 Td " + b"\n".join(shown) + b" ET"], structure=[(0, k, "P") for k in tree])


_TAGGED_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, 'order ' || o_orderkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) - 1 AS r,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT o_custkey, chr(10) || string_agg(t, chr(10) ORDER BY k) AS plain,
             coalesce(string_agg(t, ' ' ORDER BY r) FILTER (WHERE o_custkey % 2 = 1 OR r < n // 3), '') AS tagged FROM o GROUP BY o_custkey)
"""


@query(_TAGGED_SQL + """
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN tagged <> '' AND strlen(tagged) >= strlen(plain) * 6 // 10 THEN tagged ELSE plain END AS text,
       CASE WHEN tagged <> '' AND strlen(tagged) >= strlen(plain) * 6 // 10 THEN 'structure' ELSE 'stream' END AS source FROM s
""")
def structured_order(spark, d):
    return X.structured(extract(synthesize(_customers(spark, d), _tagged, "o_custkey"), "page_all")).select("doc_id", "text", "source")


@query(_TAGGED_SQL + "SELECT CAST(o_custkey AS VARCHAR) AS doc_id, tagged AS text FROM s WHERE tagged <> ''")
def mcid_join(spark, d):
    files = synthesize(_customers(spark, d), _tagged, "o_custkey")
    return X.structured_by_join(extract(files, "mcid_refs"), extract(files, "mcid_text")).select("doc_id", "text")


# Markdown

def _page_of_part(r):
    lines = [(24, 720, r["p_brand"]), (12, 690, r["p_name"]), (12, 676, r["p_type"] + " " + r["p_name"]), (12, 662, "\x95 " + r["p_type"]), (12, 648, "1. size " + str(r["p_size"]))]
    shown = [b"1 0 0 1 72 %d Tm /F1 %d Tf (%s) Tj" % (y, s, W.escape(t.encode("latin-1"))) for s, y, t in lines]
    return W.simple_pdf([b"BT " + b"\n".join(shown) + b" ET"])


def _part_spans(spark, d):
    files = synthesize(spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), "p_partkey"), _page_of_part, "p_partkey")
    return extract(files, "page_spans")


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '# ' || p_brand || chr(10) || chr(10) || p_name || chr(10) || p_type || ' ' || p_name || chr(10) || chr(10) || '    - ' || p_type || chr(10) || '    1. size ' || p_size || chr(10) AS text FROM part")
def markdown_page(spark, d):
    return markdown.pages(_part_spans(spark, d)).select("doc_id", "text")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(e.n AS INTEGER) AS elem_no, e.kind, CAST(e.indent AS INTEGER) AS indent_level,
       CASE e.n WHEN 0 THEN p_brand WHEN 1 THEN '' WHEN 2 THEN p_name WHEN 3 THEN p_type || ' ' || p_name WHEN 4 THEN '• ' || p_type ELSE '1. size ' || p_size END AS text
FROM part, (VALUES (0, 'heading1', 2), (1, 'line_break', 0), (2, 'paragraph', 2), (3, 'paragraph', 2), (4, 'list_item_bullet', 2), (5, 'list_item_number', 2)) e(n, kind, indent)
""")
def md_elements(spark, d):
    return markdown.elements(_part_spans(spark, d)).select("doc_id", "elem_no", "kind", "indent_level", "text")


# Document features

def _suppliers(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS title, n_name AS author, CAST(NULL AS VARCHAR) AS subject, 'D:20240101' AS creation_date FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def metadata(spark, d):
    files = synthesize(_suppliers(spark, d), lambda r: W.simple_pdf([b""], info={"Title": r["s_name"], "Author": r["n_name"], "CreationDate": "D:20240101"}), "s_suppkey")
    return extract(files, "metadata").select("doc_id", "title", "author", "subject", "creation_date")


def _regions(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("r_regionkey"), "n_nationkey", "n_name")
    return table(spark, d, "region").join(n, "r_regionkey").groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))


def _outlined(r):
    items = [(r["r_name"], 0, 0)] + [(n["n_name"] + ("中é" if n["n_nationkey"] % 2 else ""), k + 1 if k % 3 else None, 1) for k, n in enumerate(r["nations"])] + [("End", None, 0)]
    return W.simple_pdf([b""] * (len(r["nations"]) + 1), outline=items)


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, CAST(0 AS INTEGER) AS ord, r_name AS title, CAST(0 AS INTEGER) AS dest_page, CAST(0 AS INTEGER) AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), CAST(k AS INTEGER), n_name || CASE WHEN n_nationkey % 2 = 1 THEN '中é' ELSE '' END, CASE WHEN (k - 1) % 3 <> 0 THEN CAST(k AS INTEGER) END, 1 FROM n
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), CAST(n + 1 AS INTEGER), 'End', NULL, 0 FROM n WHERE k = 1
""")
def outline(spark, d):
    return extract(synthesize(_regions(spark, d), _outlined, "r_regionkey"), "outline")


def _labelled(r):
    k = r["n_nationkey"]
    return W.simple_pdf([b""] * 12, labels=[(1, b"/S /r"), (4, b"/S /D /P (App-) /St %d" % (k + 1)), (7, b"/S /A /St %d" % (k + 20)), (10, b"/P (x)")])


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(p AS INTEGER) AS page,
       CASE WHEN p < 4 THEN ['i', 'ii', 'iii'][p] WHEN p < 7 THEN 'App-' || (n_nationkey + 1 + p - 4)
            WHEN p < 10 THEN CASE WHEN n_nationkey + 20 + p - 7 > 26 THEN chr(CAST(64 + (n_nationkey + 20 + p - 8) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n_nationkey + 20 + p - 8) % 26 AS INTEGER))
            ELSE 'x' END AS label
FROM nation, (SELECT unnest(generate_series(1, 11)) AS p)
""")
def page_labels(spark, d):
    files = synthesize(table(spark, d, "nation").select("n_nationkey"), _labelled, "n_nationkey")
    return search.page_labels(extract(files, "pages"), extract(files, "label_ranges"))


def _linked(r):
    """A page without a url has a link that goes nowhere in its place."""
    uri = b"/A << /S /URI /URI (%s) >>" % W.escape(r["url"], "utf-8") if r["url"] is not None else b"/A << /S /URI >>"
    return W.simple_pdf([b"", b""], links=[[((10, 20, 30, 40), uri), ((11, 20, 30, 40), b"/A << /S /GoTo /D [{page:1} /Fit] >>")], [((12, 20, 30, 40), b"/Dest [{page:0} /Fit]")]])


@query("""
SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(v.page AS INTEGER) AS page, CAST(v.ord AS INTEGER) AS ord, CAST(v.x0 AS DOUBLE) AS x0, CASE WHEN v.x0 = 10 THEN url END AS uri, CAST(v.dest AS INTEGER) AS dest_page
FROM pages, (VALUES (0, 0, 10, NULL), (0, 1, 11, 1), (1, 0, 12, 0)) v(page, ord, x0, dest)
""")
def links(spark, d):
    files = synthesize(spread(table(spark, d, "pages").select("page_id", "url"), "page_id"), _linked, "page_id")
    return extract(files, "links").select("doc_id", "page", "ord", "x0", "uri", "dest_page")


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, v.dest IS NOT NULL AS resolved, count(*) AS n FROM pages, (VALUES (NULL), (1), (0)) v(dest) GROUP BY ALL")
def link_dest(spark, d):
    files = synthesize(spread(table(spark, d, "pages").select("page_id", "url"), "page_id"), _linked, "page_id")
    targets = search.link_targets(extract(files, "links"), extract(files, "pages"))
    return targets.groupBy("doc_id", F.col("dest_obj").isNotNull().alias("resolved")).agg(F.count("*").alias("n"))


def _pictured(r):
    k = r["p_size"]
    return W.simple_pdf([b"2 0 0 3 5 7 cm q %d 0 0 %d 10 20 cm /Im0 Do Q" % (k, k + 1)], images=[(k * 10, k + 5)])


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(25 AS DOUBLE) AS x0, CAST(67 AS DOUBLE) AS y0, CAST(25 + 2 * p_size AS DOUBLE) AS x1, CAST(67 + 3 * (p_size + 1) AS DOUBLE) AS y1,
       CAST(p_size * 10 AS INTEGER) AS width, CAST(p_size + 5 AS INTEGER) AS height FROM part
""")
def images(spark, d):
    files = synthesize(spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), _pictured, "p_partkey")
    return extract(files, "images").select("doc_id", "x0", "y0", "x1", "y1", "width", "height")


def _form(r):
    name, segment = W.escape(r["c_name"], "utf-8"), W.escape(r["c_mktsegment"], "utf-8")
    return W.simple_pdf([b""], fields=[b"<< /T (customer) /Kids [<< /T (name) /FT /Tx /V (%s) /Rect [1 2 3 4] >> << /T (segment) /FT /Ch /V (%s) >> << /FT /Btn >>] >>" % (name, segment), b"<< /T (sign) /FT /Sig >>"])


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(v.ord AS INTEGER) AS ord, v.name, CASE v.ord WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS value, v.kind AS field_type
FROM customer, (VALUES (0, 'customer.name', 'text'), (1, 'customer.segment', 'choice'), (2, 'customer', 'button'), (3, 'sign', 'signature')) v(ord, name, kind)
""")
def form_fields(spark, d):
    files = synthesize(spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey"), _form, "c_custkey")
    return extract(files, "form_fields").select("doc_id", "ord", "name", "value", "field_type")


# Search

_SEARCH = "The th"


@query(f"""
WITH p AS ({_PAGES_SQL}), s AS (SELECT doc_id, page, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEARCH.lower()}') AS x FROM p),
h AS (SELECT doc_id, page, x, unnest(generate_series(1, len(x) - 1)) AS k FROM s)
SELECT doc_id, page, CAST(list_sum(list_transform(x[1:k], lambda v: strlen(v))) + (k - 1) * {len(_SEARCH)} AS BIGINT) AS "offset" FROM h
""")
def search_hits(spark, d):
    text = extract(_documents(spark, d), "page_text").select("doc_id", "page", F.col("plain").alias("text"))
    return search.search(text, _SEARCH).select("doc_id", "page", "offset")


@query(_TAGGED_SQL + """, t AS (SELECT o_custkey, CASE WHEN tagged <> '' AND strlen(tagged) >= strlen(plain) * 6 // 10 THEN tagged ELSE plain END AS text FROM s),
x AS (SELECT o_custkey, string_split(text, 'order 1') AS x FROM t), h AS (SELECT o_custkey, x, unnest(generate_series(1, len(x) - 1)) AS k FROM x)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(list_sum(list_transform(x[1:k], lambda v: strlen(v))) + (k - 1) * 7 AS BIGINT) AS "offset" FROM h
""")
def search_structured(spark, d):
    from quire.api import PdfCorpus

    return PdfCorpus(synthesize(_customers(spark, d), _tagged, "o_custkey")).search("ORDER 1").select("doc_id", "offset")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(strpos(lower(p_type), 'on') - 1 AS BIGINT) AS "offset",
       substr(p_type, greatest(strpos(lower(p_type), 'on') - 3, 1), strpos(lower(p_type), 'on') + 3 - greatest(strpos(lower(p_type), 'on') - 3, 1) + 1) AS context
FROM part WHERE strpos(lower(p_type), 'on') > 0
""")
def search_context(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.col("p_type").alias("text"))
    return search.search(rows, "oN", context=2).select("doc_id", "offset", "context")


# Export, errors, functions

@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '{"metadata":{"title":"' || s_name || '"},"page_count":2,"outline":[{"title":"' || n_name || '","page":1,"level":0}],"pages":[{"page":1,"label":"' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || '","text":"' || s_name
       || '","links":[{"uri":"http://host/' || s_suppkey || '","rect":[1.0,2.0,30.3,4.0]},{"dest_page":1,"rect":[5.0,6.0,7.0,8.0]}],"images":[{"rect":[3.0,4.0,13.0,24.0],"width":' || (s_suppkey % 50 + 1) || ',"height":9}]},{"page":2,"label":"'
       || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || '-7","text":"a\\\\b\\"' || n_name || '","links":[],"images":[]}]}' AS json FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def json_export(spark, d):
    from quire.operators.export import json_documents

    def make(r):
        k, letter = r["s_suppkey"], b"%c" % (65 + r["s_suppkey"] % 26)
        links = [[((1, 2, 30.25, 4), b"/A << /S /URI /URI (http://host/%d) >>" % k), ((5, 6, 7, 8), b"/Dest [{page:1} /Fit]")]]
        pages = [W.show_lines([r["s_name"]]) + b" 10 0 0 20 3 4 cm /Im0 Do", W.show_lines(['a\\b"' + r["n_name"]])]
        return W.simple_pdf(pages, info={"Title": r["s_name"]}, outline=[(r["n_name"], 1, 0)], links=links, images=[(k % 50 + 1, 9)], labels=[(0, b"/P (%s)" % letter), (1, b"/P (%s-) /S /D /St 7" % letter)])

    return json_documents(synthesize(_suppliers(spark, d), make, "s_suppkey"))


def _damaged(r):
    kind = r["s_suppkey"] % 4
    if kind == 3:
        return b"%PDF-1.4 cut"
    return W.simple_pdf([b""], encrypt=kind == 2, header=kind != 1)


def _damaged_files(spark, d):
    return synthesize(table(spark, d, "supplier").select("s_suppkey"), _damaged, "s_suppkey")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, ['invalid_header', 'encrypted', 'invalid_xref'][s_suppkey % 4] AS kind FROM supplier WHERE s_suppkey % 4 > 0")
def parse_errors(spark, d):
    return extract(_damaged_files(spark, d), "parse_errors").select("doc_id", "kind")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_suppkey % 4 <> 1 AS is_pdf, s_suppkey % 4 = 2 AS is_encrypted, CAST(CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE 1 END AS INTEGER) AS n_pages FROM supplier")
def encrypted_flag(spark, d):
    files = _damaged_files(spark, d)
    return headers(files).join(extract(files, "document"), "doc_id").select("doc_id", "is_pdf", "is_encrypted", "n_pages")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || 'é' ELSE n_name || '中' END AS text FROM nation")
def decode_pdf_string(spark, d):
    utf16 = F.concat(F.lit(b"\xfe\xff"), F.encode(F.concat("n_name", F.lit("中")), "UTF-16BE"))
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.encode(F.concat("n_name", F.lit("é")), "ISO-8859-1")).otherwise(utf16)
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), raw.alias("raw")).select("doc_id", T.decode_pdf_string("raw").alias("text"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey > 3999 OR p_partkey < 1 THEN CAST(p_partkey AS VARCHAR) ELSE
         ['', 'm', 'mm', 'mmm'][p_partkey // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][p_partkey // 100 % 10 + 1]
         || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][p_partkey // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_partkey % 10 + 1] END AS roman,
       CASE WHEN p_size > 26 THEN chr(CAST(64 + (p_size - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (p_size - 1) % 26 AS INTEGER)) AS alpha FROM part
""")
def roman_alpha(spark, d):
    return table(spark, d, "part").select("p_partkey", T.roman("p_partkey").alias("roman"), T.alpha("p_size", True).alias("alpha"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '- ' WHEN 1 THEN '• ' WHEN 2 THEN '(iv) ' WHEN 3 THEN '12. ' WHEN 4 THEN 'Note: ' ELSE '' END || p_type AS item, p_type, p_size FROM part)
SELECT p_partkey, p_partkey % 6 < 2 AS bullet, p_partkey % 6 IN (2, 3, 4) AS numbered, CASE WHEN p_partkey % 6 < 2 THEN p_type WHEN p_partkey % 6 < 5 THEN p_type ELSE item END AS stripped,
       CAST(least(6, p_size * 10 // 36) AS INTEGER) AS indent, translate(item, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM t
""")
def list_items(spark, d):
    k = F.col("p_partkey") % 6
    item = F.concat(F.when(k == 0, "- ").when(k == 1, "• ").when(k == 2, "(iv) ").when(k == 3, "12. ").when(k == 4, "Note: ").otherwise(""), "p_type")
    rows = table(spark, d, "part").select("p_partkey", "p_size", item.alias("item"))
    stripped = F.when(T.is_bullet("item"), T.strip_bullet("item")).when(T.is_numbered("item"), T.strip_number("item")).otherwise(F.col("item"))
    return rows.select("p_partkey", T.is_bullet("item").alias("bullet"), T.is_numbered("item").alias("numbered"), stripped.alias("stripped"), T.indent_level(F.col("p_size") * 10).alias("indent"), T.ascii_lower("item").alias("lowered"))


@query("SELECT n_nationkey, ['heading1', 'heading2', 'table_row', 'paragraph', 'list_item_bullet'][n_nationkey % 5 + 1] AS kind FROM nation")
def structure_kinds(spark, d):
    names = F.array(*map(F.lit, ("H", "H2", "TD", "Anything", "LI")))
    return table(spark, d, "nation").select("n_nationkey", T.structure_kind(F.get(names, F.col("n_nationkey") % 5)).alias("kind"))


@query("SELECT doc_id, CAST(1 AS DOUBLE) AS char_accuracy, CAST(0 AS DOUBLE) AS word_error_rate FROM documents")
def accuracy_metric(spark, d):
    pages = extract(_documents(spark, d), "page_text").select("doc_id", "page", F.col("stream").alias("text"))
    got = X.join_pages(pages, "\n").select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("x"))
    both = got.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("y")), "id")
    return likeness.accuracy(both).withColumnRenamed("id", "doc_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(2 AS INTEGER) AS n_pages, false AS is_encrypted, s_name AS title, CAST(1 AS INTEGER) AS n_fields, CAST(100 + s_suppkey % 9 + 200 AS DOUBLE) AS widths, s_name || '|' || n_name AS outline FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def document_info(spark, d):
    def make(r):
        return W.simple_pdf([b"", b""], info={"Title": r["s_name"]}, boxes=[(0, 0, 100 + r["s_suppkey"] % 9, 50), (0, 0, 200, 50)], outline=[(r["s_name"], 0, 0), (r["n_name"], None, 1)], fields=[b"<< /T (a) /FT /Tx >>"])

    widths = F.aggregate("page_sizes", F.lit(0.0), lambda a, p: a + p["width"]).alias("widths")
    outline = F.array_join(F.transform("outline", lambda o: o["title"]), "|").alias("outline")
    return search.info(synthesize(_suppliers(spark, d), make, "s_suppkey")).select("doc_id", "n_pages", "is_encrypted", "title", "n_fields", widths, outline)
