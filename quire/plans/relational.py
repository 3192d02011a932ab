"""Queries whose results come from DataFrame operators over less finished rows, and
their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.kernel import writer as W
from quire.operators import codes, content, likeness, revisions, trees
from quire.plans.queries import _LI, _PAGES_SQL, _SEARCH, LINES, QUERIES, _chunks, _documents, _form, _lines_pdf, _linked, _orders_of_lines, _outlined, _regions, query
from quire.plans.queries import ORACLES as _SQL
from quire.operators.textindex import TextIndex
from quire.session import new_path, table
from quire.sources.pdf import extract
from quire.sources.synth import spread, synthesize

# Scans over operators


def _spaced(r):
    """A line in three pieces: a small gap, which moves the span that it is in, and a
    large one, which ends it."""
    shown = [b"1 0 0 1 72 %d Tm /F1 10 Tf [(%s) -50 (-%d) -200 (z%d)] TJ" % (700 - 20 * k, W.escape(x["t"]), k, k) for k, x in enumerate(r["rows"])]
    return W.simple_pdf([b"BT " + b"\n".join(shown) + b" 3 -5 Td (end) ' ET"])


@query(f"""
WITH l AS (SELECT l_orderkey, k, t, max(k) OVER (PARTITION BY l_orderkey) AS last FROM {_LI}),
s AS (SELECT l_orderkey, 2 * k AS seq, 72.5 AS x0, 700 - 20 * k AS y0, t || '-' || k AS text FROM l
UNION ALL SELECT l_orderkey, 2 * k + 1, 72.5 + 5 * strlen(t || '-' || k) + 2, 700 - 20 * k, 'z' || k FROM l
UNION ALL SELECT l_orderkey, 2 * k + 2, 75, 695 - 20 * k, 'end' FROM l WHERE k = last)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(seq AS INTEGER) AS seq, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + 5 * strlen(text) AS DOUBLE) AS x1, CAST(y0 + 12 AS DOUBLE) AS y1, text, CAST(10 AS DOUBLE) AS font_size FROM s
""")
def spans_by_windows(spark, d):
    files = synthesize(_orders_of_lines(spark, d), _spaced, "l_orderkey")
    return content.of_steps(extract(files, "page_steps")).drop("page")


def _bracketed(r):
    """Each line in a mark with an id, inside one that has none, inside the one that the
    line before left open; ends without a mark first."""
    shown = [b"EMC EMC"]
    for k, x in enumerate(r["rows"]):
        shown.append(b"/P <</MCID %d>> BDC (%s) Tj /Q BMC (+) Tj /Named /Props BDC (-) Tj EMC EMC (.) Tj" % (k % 3, W.escape(x["t"])))
        if k % 2:
            shown.append(b"EMC (/) Tj EMC (free) Tj")
    return W.simple_pdf([b"BT /F1 12 Tf " + b"\n".join(shown) + b" ET"])


@query(f"""
WITH l AS (SELECT l_orderkey, k, t || '+-.' AS own, (k // 2) * 4 + k % 2 * 2 AS n FROM {_LI}),
p AS (SELECT l_orderkey, k % 3 AS mcid, n, own AS t FROM l UNION ALL SELECT l_orderkey, (k - 1) % 3, n + 1, '/' FROM l WHERE k % 2 = 1)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(mcid AS INTEGER) AS mcid, string_agg(t, '' ORDER BY n) AS text FROM p GROUP BY l_orderkey, mcid
""")
def marks_by_depth(spark, d):
    files = synthesize(_orders_of_lines(spark, d), _bracketed, "l_orderkey")
    return content.inside_marks(extract(files, "page_marks")).drop("page")


def _moved(r):
    """A scale, then a shift and an image for each line; shifts add up, scaled."""
    shown = [b"1 0 0 1 %d %d cm /Im0 Do" % (k % 7, k % 5) for k in r["keys"]]
    return W.simple_pdf([b"2 0 0 3 5 7 cm /None Do " + b" ".join(shown)], images=[(8, 9)])


@query(f"""
WITH s AS (SELECT l_orderkey, k, 5 + 2 * sum(l_partkey % 7) OVER w AS x, 7 + 3 * sum(l_partkey % 5) OVER w AS y FROM {_LI} WINDOW w AS (PARTITION BY l_orderkey ORDER BY k))
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS ord, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(x + 2 AS DOUBLE) AS x1, CAST(y + 3 AS DOUBLE) AS y1, CAST(8 AS INTEGER) AS width, CAST(9 AS INTEGER) AS height FROM s
""")
def images_by_products(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    orders = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").groupBy("l_orderkey").agg(F.transform(lines, lambda x: x["l_partkey"]).alias("keys"))
    return content.images(extract(synthesize(orders, _moved, "l_orderkey"), "page_paints")).drop("page")


# Trees


@query(_SQL["outline"])
def outline_by_ranks(spark, d):
    entries = extract(synthesize(_regions(spark, d), _outlined, "r_regionkey"), "entries")
    return trees.outline(entries, trees.pages(entries)[0])[0]


@query(_SQL["form_fields"])
def fields_by_ranks(spark, d):
    files = synthesize(spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey"), _form, "c_custkey")
    return trees.form_fields(extract(files, "entries")).select("doc_id", "ord", "name", "value", "field_type")


def _grouped(r):
    """A branch of the page tree for each three lines: every second has a box for its
    pages, every third page a rotation of its own."""
    w = W.Writer()
    root, top = w.reserve(), w.reserve()
    branches = [w.reserve() for _ in range(0, len(r["rows"]), 3)]
    for b, num in enumerate(branches):
        kids = [w.put(b"<< /Type /Page /Parent %d 0 R %s >>" % (num, b"/Rotate 90" if (3 * b + k) % 3 == 2 else b"")) for k in range(min(3, len(r["rows"]) - 3 * b))]
        w.put(b"<< /Type /Pages /Parent %d 0 R /Kids [%s] %s >>" % (top, b" ".join(b"%d 0 R" % k for k in kids), b"/MediaBox [0 0 %d 9]" % (100 + b) if b % 2 else b""), num)
    w.put(b"<< /Type /Pages /Rotate 180 /MediaBox [0 0 50 60] /Kids [%s] >>" % b" ".join(b"%d 0 R" % b for b in branches), top)
    w.put(b"<< /Type /Catalog /Pages %d 0 R >>" % top, root)
    return w.save(root)


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS page, CAST(CASE WHEN k // 3 % 2 = 1 THEN 100 + k // 3 ELSE 50 END AS DOUBLE) AS width, CAST(CASE WHEN k % 3 = 2 THEN 90 ELSE 180 END AS INTEGER) AS rotation FROM {_LI}
""")
def pages_by_ranks(spark, d):
    entries = extract(synthesize(_orders_of_lines(spark, d), _grouped, "l_orderkey"), "document_entries")
    return trees.pages_of_documents(entries)[0].select("doc_id", "page", F.element_at("media_box", 3).alias("width"), "rotation")


# Codes and ranges


def _ranged(r):
    """Codes are characters and 256; each block of 64 has a range that says so, and all lie
    in an older range that says otherwise. Widths by ranges that overlap."""
    text = r["text"] or ""
    blocks = sorted({ord(c) // 64 for c in text if c != "\n"})
    entries = b" ".join(b"<%04X> <%04X> <%04X>" % (256 + 64 * b, 256 + 64 * b + 63, 64 * b) for b in blocks)
    cmap = b"begincmap 2 beginbfrange <00F0> <BFFF> <0021> %s endbfrange 1 beginbfchar <0120> <0020> endbfchar endcmap" % entries
    w = W.Writer()
    root, tree, font = w.reserve(), w.reserve(), w.reserve()
    shift = _Shift()
    pages = [[line.translate(shift) for line in p] for p in _chunks(text.split("\n"), LINES)]
    kids = [w.put(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (tree, w.stream(W.show_lines(p, hexa="utf-16-be"), flate=True))) for p in pages]
    inner = b"<< /Subtype /CIDFontType2 /DW 900 /W [288 382 500 200 [1 2 3] 257 511 700 511 600 800] >>"
    w.put(b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [%s] /ToUnicode %d 0 R >>" % (inner, w.stream(cmap)), font)
    w.put(b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 %d 0 R >> >> >>" % (b" ".join(b"%d 0 R" % k for k in kids), font), tree)
    w.put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    return w.save(root)


class _Shift(dict):
    def __missing__(self, c):
        self[c] = c + 256
        return c + 256


_CODES_SQL = f"""
WITH p AS ({_PAGES_SQL}), l AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM p)
"""


@query(_CODES_SQL + "SELECT doc_id, page, CAST(n - 1 AS INTEGER) AS line, line AS text FROM l WHERE line <> ''")
def codes_by_intervals(spark, d):
    files = _documents(spark, d, _ranged)
    lines = codes.texts_of_pages(extract(files, "page_codes"))
    # a line is BT, Tf, Td, Tj and then Td, Tj each
    return lines.select("doc_id", "page", ((F.col("seq") - 3) / 2).cast("int").alias("line"), "text")


@query(_CODES_SQL + """, c AS (SELECT doc_id, page, unicode(unnest(string_split(line, ''))) AS c FROM l WHERE line <> '')
SELECT doc_id, page, CAST(sum(CASE WHEN c BETWEEN 32 AND 126 THEN 500 WHEN c BETWEEN 1 AND 255 THEN 700 WHEN c BETWEEN 256 AND 344 THEN 800 ELSE 900 END) AS DOUBLE) AS width FROM c GROUP BY ALL
""")
def widths_by_intervals(spark, d):
    files = _documents(spark, d, _ranged)
    return codes.page_widths(extract(files, "shown_codes"), extract(files, "font_widths"))


# Revisions


def revised(key: int, texts: list[str]) -> bytes:
    """A file and a revision for each text but the first: each writes object 5 anew and adds
    one. Every second file's oldest section leads back to its newest."""
    w = W.Writer()
    root, tree, page, body, info = (w.reserve() for _ in range(5))
    w.stream(W.show_lines([texts[0]]), num=body)
    w.put(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (tree, body), page)
    w.put(b"<< /Type /Pages /Kids [%d 0 R] >>" % page, tree)
    w.put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    w.put(b"<< /Title (%s) >>" % W.escape(texts[0]), info)
    data = w.save(root, b" /Info 5 0 R /Prev 1111111111" if key % 2 else b" /Info 5 0 R")
    for text in texts[1:]:
        w.put(b"<< /Title (%s) >>" % W.escape(text), info)
        data = w.save(root, b" /Info 5 0 R", before=data, only=[info, w.put(b"<< /Note (%s) >>" % W.escape(text))])
    return data.replace(b"/Prev 1111111111", b"/Prev %010d" % int(data[data.rindex(b"startxref") + 9 :].split()[0]))


@query(f"""
WITH l AS (SELECT l_orderkey, k FROM {_LI}), o AS (SELECT l_orderkey, max(k) AS last FROM l GROUP BY l_orderkey)
SELECT CAST(l.l_orderkey AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS revision, CAST(n AS BIGINT) AS obj_num, CASE WHEN n = 0 THEN 'free' ELSE 'in_use' END AS entry_type,
       CAST(CASE WHEN n < 5 THEN 0 WHEN n = 5 THEN k ELSE n - 5 END AS INTEGER) AS since, CAST(CASE WHEN n = 5 THEN k ELSE last END AS INTEGER) AS until
FROM (SELECT l.*, unnest(generate_series(0, 5 + k)) AS n FROM l) l JOIN o ON l.l_orderkey = o.l_orderkey
""")
def objects_of_revisions(spark, d):
    files = synthesize(_orders_of_lines(spark, d), lambda r: revised(r["l_orderkey"], [x["t"] for x in r["rows"]]), "l_orderkey")
    held = revisions.in_force(extract(files, "document_sections"))
    return revisions.each_revision(held).select("doc_id", "revision", "obj_num", "entry_type", "since", "until")


# Search


@query(_SQL["search_hits"])
def search_by_index(spark, d):
    index = TextIndex(spark, new_path(spark, "index"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    for k in (0, 1, 1):  # the second batch is sent twice
        files = synthesize(table(spark, d, "documents").where(half == k).select("doc_id", "text"), _lines_pdf, "doc_id")
        index.add(extract(files, "page_text").select("doc_id", "page", F.col("plain").alias("text")), f"batch {k}")
    return index.search(_SEARCH).select("doc_id", "page", "offset")


# Likeness


@query("""
WITH RECURSIVE t AS (SELECT p_partkey, p_name || ' ' || p_type AS x, p_type || ' ' || p_name AS y FROM part),
dp AS (SELECT p_partkey, x, y, 0 AS k, (1::HUGEINT << length(y)) - 1 AS v FROM t
UNION ALL SELECT p_partkey, x, y, k + 1, (((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(y)) - 1)) FROM (
  SELECT *, coalesce(list_sum(list_transform(generate_series(1, length(y)), lambda j: CASE WHEN substr(y, j, 1) = substr(x, k + 1, 1) THEN 1::HUGEINT << (j - 1) ELSE 0::HUGEINT END)), 0)::HUGEINT AS m FROM dp WHERE k < length(x)))
SELECT p_partkey, length(x) AS n, length(y) AS m, length(y) - len(list_filter(generate_series(1, length(y)), lambda j: (v >> (j - 1)) & 1 = 1)) AS common FROM dp WHERE k = length(x)
""")
def common_parts(spark, d):
    x, y = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name")
    return likeness.common(table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"))).withColumnRenamed("id", "p_partkey")


__all__ = ["QUERIES"]
