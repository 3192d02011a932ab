import json

import pytest
from pyspark.sql import functions as F

from quire.api import PageNotFoundError, from_binary, read_pdf
from quire.functions import layout as LF
from quire.functions import text as T
from quire.kernel import writer as W
from quire.kernel.content import stream_text
from quire.operators import layout, markdown, search
from quire.operators.text import from_operators
from quire.plans.components import connected_components
from quire.sources.pdf import extract

PAGES = [W.show_lines(["River stones", "and sand"]), W.show_lines(["Lake water"]), W.show_lines(["River bank", "reed and Reed and reed"])]


@pytest.fixture(scope="module")
def corpus(spark):
    data = W.simple_pdf(PAGES, info={"Title": "T"}, labels=[(1, b"/S /r")], outline=[("One", 0, 0)])
    rows = [("a", bytearray(data)), ("bad", bytearray(b"junk")), ("none", None)]
    return from_binary(spark.createDataFrame(rows, "doc_id string, content binary"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns[:2]).collect()]


def test_tables(corpus):
    assert rows(corpus.page_count()) == [("a", 3), ("bad", 0), ("none", 0)]
    assert rows(corpus.text())[1] == ("a", 1, "Lake water")
    assert corpus.full_text().first()["text"] == "River stones\nand sand\fLake water\fRiver bank\nreed and Reed and reed"
    assert corpus.full_text("fast").first() == corpus.full_text().first()
    assert rows(corpus.page_labels()) == [("a", 1, "i"), ("a", 2, "ii")]
    assert {r.kind for r in corpus.parse_errors().collect()} == {"invalid_header", "invalid_xref"}
    assert rows(corpus.outline())[0] == ("a", 0, "One", 0, 0)


def test_json(spark):
    links = [[((1, 2, 3.25, 4), b"/A << /S /URI /URI (http://x) >>"), ((1, 2, 3, 4), b"/Dest [{page:1} /Fit]")]]
    data = W.simple_pdf([b"10 0 0 20 1 2 cm /Im0 Do (a\x01\"\n) Tj", b""], links=links, images=[(5, 6)], labels=[(1, b"/S /D")], outline=[("x", None, 0)])
    got = json.loads(from_binary(spark.createDataFrame([("d", bytearray(data))], "doc_id string, content binary")).json().first()["json"])
    first = {"page": 1, "text": 'a\x01"\n', "links": [{"uri": "http://x", "rect": [1, 2, 3.3, 4]}, {"dest_page": 1, "rect": [1, 2, 3, 4]}], "images": [{"rect": [1, 2, 11, 22], "width": 5, "height": 6}]}
    assert got == {"metadata": {}, "page_count": 2, "outline": [{"title": "x", "page": -1, "level": 0}], "pages": [first, {"page": 2, "label": "1", "text": "", "links": [], "images": []}]}


def test_search(corpus):
    assert [(r.page, r.offset) for r in corpus.search("river").orderBy("page").collect()] == [(0, 0), (2, 0)]
    assert corpus.search("REED").count() == 3 and corpus.search("").count() == 0 and corpus.search("absent").count() == 0


def test_search_counts_bytes(spark):
    df = spark.createDataFrame([("d", 0, "é.é.* aaaa é.*")], "doc_id string, page int, text string")
    assert [r.offset for r in search.search(df, ".*").orderBy("offset").collect()] == [5, 15]
    assert [r.offset for r in search.search(df, "aa").collect()] == [8, 10]
    assert search.search(df, "aaaa", context=2).first()["context"] == "* aaaa �"


def test_one_page_on_the_driver(corpus):
    assert corpus.extract_page("a", 1) == "Lake water"
    with pytest.raises(PageNotFoundError):
        corpus.extract_page("a", 7)


def test_strict_mode_fails(spark):
    df = spark.createDataFrame([("bad", bytearray(b"junk"))], "doc_id string, content binary")
    with pytest.raises(Exception, match="no %PDF|InvalidPdf"):
        extract(df, "pages", mode="FAILFAST").collect()


def test_windows_agree_with_the_kernel(corpus):
    assert rows(from_operators(corpus.table("content_ops"))) == rows(corpus.text())


def spans(spark, items, width=612.0):
    df = spark.createDataFrame([("d", 0, k, float(x), float(y), float(x + len(t.encode()) * size / 2), y + 1.2 * size, t, float(size)) for k, (x, y, t, size) in enumerate(items)], "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    return layout.as_pages(df, width)


def test_anchored_lines(spark):
    got = layout.geometric(spans(spark, [(10, 690, "d", 12), (10, 700, "a", 12), (16, 698, "b", 12), (10, 696, "c", 12)])).first()["text"]
    assert got == "a\ncb\nd"


def test_gaps(spark):
    items = [(10, 700, "ab", 10), (22.4, 700, "cd", 10), (33, 700, "ef", 10), (60, 700, "g", 10)]
    assert layout.geometric(spans(spark, items)).first()["text"] == "ab cdef g"
    assert [r.text for r in layout.words(spans(spark, items)).orderBy("word_no").collect()] == ["abcdef", "g"]


def test_columns(spark):
    items = [(x, 700 - 20 * k, f"{s}{k}", 12) for k in range(4) for x, s in ((350, "R"), (72, "L"))]
    r = layout.visual(spans(spark, items)).first()
    assert r.two_columns and r.text == "L0\nL1\nL2\nL3\nR0\nR1\nR2\nR3"
    r = layout.visual(spans(spark, items[1::2] + items[:1])).first()
    assert not r.two_columns and r.text.startswith("L0 R0")


def test_paragraphs(spark):
    items = [(72, y, "line", 12) for y in (700, 686, 672, 640, 626)] + [(110, 612, "indented", 12)]
    got = [(r.para_no, r.n_lines) for r in layout.paragraphs(spans(spark, items)).orderBy("para_no").collect()]
    assert got == [(0, 3), (1, 2), (2, 1)]
    assert layout.paragraphs(spans(spark, items[:1])).first()["first_line_indent"] == 72.0


def test_markdown(spark):
    page = spans(spark, [(72, 720, "Title", 24), (72, 690, "Body text that is long enough", 12), (72, 676, "• item", 12), (72, 662, "a) next", 12), (72, 600, "After", 12), (108, 600, "more", 12)])
    assert markdown.render(markdown.elements(page)).first()["text"] == markdown.pages(page).first()["text"] == "# Title\n\nBody text that is long enough\n\n    - item\n    1. next\n\nAfter more\n"
    plain = markdown.elements(page, markdown.MarkdownOptions(detect_headings=False, detect_lists=False))
    assert {r.kind for r in plain.collect()} == {"paragraph", "line_break"}


def test_render_kinds(spark):
    kinds = [("code_block", "x"), ("blockquote", "q"), ("table_row", "a | b"), ("heading4", "h"), ("horizontal_rule", "")]
    df = spark.createDataFrame([("d", 0, k, kind, 0, t) for k, (kind, t) in enumerate(kinds)], "doc_id string, page int, elem_no int, kind string, indent_level int, text string")
    assert markdown.render(df).first()["text"] == "```\nx\n```\n> q\n| a | b |\n\n#### h\n\n---\n\n"


def test_labels_and_items(spark):
    df = spark.range(1, 4001)
    assert {r.id: r.r for r in df.where("id in (4, 9, 14, 1994, 3999, 4000)").select("id", T.roman("id").alias("r")).collect()} == {4: "iv", 9: "ix", 14: "xiv", 1994: "mcmxciv", 3999: "mmmcmxcix", 4000: "4000"}
    assert {r.id: r.a for r in df.where("id in (1, 26, 27, 28, 702, 703)").select("id", T.alpha("id").alias("a")).collect()} == {1: "a", 26: "z", 27: "aa", 28: "ab", 702: "zz", 703: "aaa"}
    items = spark.createDataFrame([(x,) for x in ("1. First", "2) Second", "a. Letter", "(i) Roman", "Hello", "Note: x", ".", "abcdef. x", "- y")], "t string")
    got = {r.t: (r.n, r.b, r.s) for r in items.select("t", T.is_numbered("t").alias("n"), T.is_bullet("t").alias("b"), T.strip_number("t").alias("s")).collect()}
    assert [t for t, (n, _, _) in got.items() if n] == ["1. First", "2) Second", "a. Letter", "(i) Roman", "Note: x"] and got["- y"][1] and got["(i) Roman"][2] == "Roman"


@pytest.mark.parametrize("spec, want", [("1-3", [0, 1, 2]), ("2", [1]), ("9", []), ("3-1", []), ("2-99,1", [1, 2, 3, 4, 0]), ("x-2", [0, 1]), ("4-y", [3, 4]), ("x,5", [4]), ("1,1", [0, 0]), ("", []), ("99999999999-", [])])
def test_page_numbers(spark, spec, want):
    assert spark.range(1).select(T.page_numbers(F.lit(spec), F.lit(5)).alias("p")).first()["p"] == want


def test_a_page_that_fails_keeps_the_others(spark, monkeypatch):
    from quire.sources import pdf as P

    def fails(ops, forms=True):
        text = stream_text(ops, forms)
        if text == "bad":
            raise ZeroDivisionError("planted")
        return text

    data = W.simple_pdf([W.show_lines([t]) for t in ("one", "bad", "three")])
    monkeypatch.setattr(P, "stream_text", fails)
    for table, texts in (("page_text", [(0, "one"), (1, ""), (2, "three")]), ("page_all", [(0, "one"), (1, ""), (2, "three")])):
        assert [(r[0], r[1]) for r in P.KERNELS[table](P.Document(data), None)] == texts or table == "page_all"
        assert [r[0] for r in P.KERNELS[table](P.Document(data), None)] == [0, 1, 2]
    assert [(r[0], r[3]) for r in P.KERNELS["parse_errors"](P.Document(data), None)] == [("invalid_stream", 1)]
    assert [p["text"] for p in next(iter(P.KERNELS["whole"](P.Document(data), None)))[-1]] == ["one", "", "three"]
    with pytest.raises(P.FAILURES):
        list(P.KERNELS["page_text"](P.Document(data, strict=True), None))


def test_values_that_no_column_holds(spark):
    from quire.sources.pdf import _batch, schema_of, to_arrow_schema

    b = _batch([("d", 0, 1 << 40, 3, "R", None), ("d\ud800", 1, 5, 3, "R", None)], to_arrow_schema(schema_of("mcid_refs").add("x", "string")))
    assert b.to_pylist()[0]["ord"] is None and b.to_pylist()[1]["doc_id"] == "d?"


def test_hostile_coordinates(spark):
    items = [(x, y, "t", 12) for x, y in ((1e300, 5), (-1e300, 1e300), (float("inf"), float("-inf")), (float("nan"), float("nan")), (3, 4))]
    page = spans(spark, items)
    assert layout.geometric(page).first()["text"].count("t") == 5 and layout.visual(page).first()["text"].count("t") == 5
    assert markdown.pages(page).first()["text"].count("t") == 5 and layout.words(page).count() >= 1 and layout.paragraphs(page).count() >= 1


def test_a_page_of_very_many_spans(spark):
    import time

    n = 50_000
    rows = spark.range(n, numPartitions=1).selectExpr("int(id) seq", "double(10 * (id % 100)) x0", "double(9000 - 15 * int(id / 100)) y0", "double(10 * (id % 100) + 4) x1", "double(9012) y1", "concat('w', id) text", "double(12) font_size")
    page = rows.selectExpr("'d' doc_id", "0 page", "*").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1", "text", "font_size"))).alias("spans")).selectExpr("doc_id", "page", "double(612) width", "spans").cache()
    page.count()
    began = time.time()
    assert len(layout.geometric(page).first()["text"].split()) == n
    assert layout.words(page).count() == n and layout.lines(page).count() >= n // 200 and markdown.elements(page).count() >= n // 100
    assert search.search(layout.geometric(page), "w1").count() > 11_000
    assert time.time() - began < 60


def test_page_operators_have_no_exchange(corpus):
    s = corpus.table("page_spans")
    for df in (layout.geometric(s), layout.visual(s), layout.words(s), layout.lines(s), layout.paragraphs(s), markdown.pages(s), markdown.elements(s), corpus.json(), corpus.info()):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    # a filter above doesn't multiply the folds
    assert corpus.markdown().where("text like '%River%'").count() == 2 and layout.lines(s).where("text like 'River%'").count() == 2


def test_empty_pages(spark):
    df = spark.createDataFrame([("d", 0, 612.0, [])], f"doc_id string, page int, width double, spans array<{__import__('quire.schemas').schemas.SPAN}>")
    assert layout.geometric(df).first()["text"] == "" and layout.visual(df).first()["text"] == "" and layout.lines(df).count() == 0
    assert LF.anchored_lines(df, "spans", LF.LAYOUT, "lines").select(LF.two_columns("lines", "width").alias("t")).first()["t"] is False


def test_files_streams_and_sql(spark, tmp_path):
    from quire.sources.datasource import register
    from quire.streaming.ingest import distinct_files, file_stream, ingest

    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.pdf").write_bytes(W.simple_pdf([W.show_lines([f"file {k % 2}"])]))
    (src / "other.txt").write_text("x")
    corpus = read_pdf(spark, str(src))
    assert sorted(r.text for r in corpus.text().collect()) == ["file 0", "file 0", "file 1"]
    register(spark)
    assert spark.read.format("pdf").option("table", "pages").load(str(src)).count() == 3
    (src / "broken.pdf").write_bytes(b"%PDF-1.4 cut")
    pdfs = spark.read.format("pdf").option("bytesPerTask", 2000)
    assert [pdfs.option("pages", p).load(str(src)).count() for p in ("1-2", "2,9")] == [3, 0]
    assert spark.read.format("pdf").option("table", "parse_errors").load(str(src)).count() == 1
    (src / "broken.pdf").unlink()
    corpus.files.createOrReplaceTempView("files")
    assert sorted(r.text for r in spark.sql("select t.text from files, lateral pdf_pages(content) as t").collect()) == ["file 0", "file 0", "file 1"]
    assert spark.sql("select sum(pdf_page_count(content)) n from files").first()["n"] == 3
    assert spark.sql("select h.offset from files, lateral pdf_pages(content) as t, lateral pdf_search(t.text, 'FILE') as h").count() == 3
    assert spark.sql("select s.x0 from files, lateral pdf_spans(content) as s").count() == 3
    out = str(tmp_path / "out")
    ingest(distinct_files(file_stream(spark, str(src))), "page_text", out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    (src / "new.pdf").write_bytes(W.simple_pdf([W.show_lines(["new"])]))
    ingest(distinct_files(file_stream(spark, str(src))), "page_text", out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (500, 499), (500, 499)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_metrics_cover_whole_texts(spark):
    from quire.functions.metrics import char_accuracy, similarity, word_error_rate

    want = " ".join(f"w{k}x{k * k}" for k in range(3_000))
    lost = " ".join(want.split()[:2_500])
    assert len(lost) > 15_000
    df = spark.createDataFrame([(0, lost, want), (1, want, want), (2, None, want), (3, None, None)], "k int, got string, want string")
    rows = df.select("k", char_accuracy("got", "want").alias("a"), word_error_rate("got", "want").alias("e"), similarity("got", "want").alias("s"),
                     char_accuracy("got", "want", 15_000).alias("a1"), word_error_rate("got", "want", 2_000).alias("e1")).orderBy("k").collect()
    assert rows[0].a == rows[0].s == pytest.approx(2 * len(lost) / (len(lost) + len(want))) and rows[0].e == pytest.approx(1 - 2 * 2_500 / 5_500)
    assert rows[0].a1 == 1 and rows[0].e1 == 0
    few = spark.createDataFrame([("a b c d " * 300 + "x", "a b c d " * 300 + "y")], "got string, want string")
    r = few.select(char_accuracy("got", "want").alias("a"), word_error_rate("got", "want").alias("e")).first()
    assert r.a > 0.999 and 0 < r.e < 0.001
    assert [tuple(r)[1:4] for r in rows[1:]] == [(1, 0, 1), (0, 1, 0), (1, 0, 1)]


def test_rows_of_a_small_file_are_dealt(spark, tmp_path):
    """A file of narrow rows is one task's; the documents made of them are not."""
    from quire.sources.synth import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    parts = spread(rows, "id").groupBy(F.spark_partition_id()).count().collect()
    assert rows.rdd.getNumPartitions() == 1 and len(parts) == 4 and max(r["count"] for r in parts) < 400
