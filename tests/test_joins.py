import random

from pyspark.sql import functions as F

from quire.operators import codes, joins
from quire.session import materialize
from quire.sources.pdf import extract


RANGES = "doc_id string, font string, first long, last long, rank int, v string"


def by_search(points, ranges):
    out = []
    for k, d, f, c in points:
        held = [(r, v) for d2, f2, a, b, r, v in ranges if (d2, f2) == (d, f) and c is not None and a <= c <= b]
        out.append((k, c, min(held)[1] if held else None))
    return sorted(map(str, out))


def test_ranges_of_all_sizes(spark):
    rng = random.Random(3)
    ranges = []
    for k in range(300):
        a = rng.randrange(0, 1 << rng.choice([4, 10, 20, 40]))
        ranges.append((rng.choice("ab"), rng.choice("xy"), a, a + rng.choice([0, 0, 1, 2, 3, 7, 100, 5000, 1 << 30, -1]), k, f"v{k}"))
    points = [(k, rng.choice("abc"), rng.choice("xy"), rng.choice([None, rng.randrange(0, 1 << rng.choice([4, 10, 20, 40])), rng.choice(ranges)[2], rng.choice(ranges)[3]])) for k in range(2000)]
    p = spark.createDataFrame(points, "k int, doc_id string, font string, code long").repartition(3)
    r = spark.createDataFrame(ranges, RANGES)
    for heavy, limit in ((1 << 16, 1 << 20), (3, 0)):
        got = joins.in_ranges(p, r, ["doc_id", "font"], "code", "first", "last", "rank", heavy, limit)
        assert sorted(str((x.k, x.code, x.v)) for x in got.collect()) == by_search(points, ranges)
    assert joins.in_ranges(p, r.limit(0), ["doc_id", "font"], "code", "first", "last", "rank").where("v is null").count() == 2000


def test_a_million_codes_without_a_nested_loop(spark):
    p = spark.range(1_000_000).select(F.lit("d").alias("doc_id"), F.lit("f").alias("font"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 65_536).cast("long").alias("code"))
    r = spark.range(256).select(F.lit("d").alias("doc_id"), F.lit("f").alias("font"), (F.col("id") * 256).alias("first"), (F.col("id") * 256 + 255).alias("last"), F.col("id").cast("int").alias("rank"), F.col("id").cast("string").alias("v"))
    got = joins.in_ranges(p, r, ["doc_id", "font"], "code", "first", "last", "rank", heavy=20_000, limit=0)
    assert got.where("v = cast(shiftright(code, 8) as string)").count() == 1_000_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_heavy_keys_are_dealt(spark):
    rows = spark.range(3000).selectExpr("id as v", "case when id < 2000 then 7 when id % 50 = 0 then null else id end as k").repartition(5)
    of = materialize(spark.createDataFrame([(7, "x"), (2001, "y"), (9, "z")], "k long, name string"), "of")
    want = sorted(str((v, "x" if v < 2000 else "y" if v == 2001 else None)) for v in range(3000))
    for limit in (10, 0):
        assert sorted(str((r.v, r.name)) for r in joins.lookup(rows, of, ["k"], ["v"], heavy=100, limit=limit).collect()) == want


def test_characters_equal_the_decoder(spark):
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [<< /Subtype /CIDFontType2 /DW 7 >>] /ToUnicode %d 0 R >>"
    from quire.kernel import writer as W

    w = W.Writer()
    root, tree, page, body, face = (w.reserve() for _ in range(5))
    cmap = b"begincmap 2 beginbfchar <0001> <00660069> <0300> <0042> endbfchar 4 beginbfrange <0041> <005A> <0061> <0050> <0052> <4E2D> <0100> <0102> [<00660069> <0031> <20AC>] <0200> <0210> <0000> endbfrange endcmap"
    w.put(font % w.stream(cmap), face)
    w.stream(b"BT /F1 12 Tf 1 1 Td <00010041005000510052005A030001000101010202000201003F0000> Tj ET", num=body)
    w.put(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (tree, body), page)
    w.put(b"<< /Type /Pages /Count 1 /Kids [%d 0 R] /Resources << /Font << /F1 %d 0 R >> >> >>" % (page, face), tree)
    w.put(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    df = spark.createDataFrame([("d", bytearray(w.save(root)))], "doc_id string, content binary")
    shown = codes.code_rows(extract(df, "shown_codes"))
    got = codes.characters(shown, extract(df, "code_maps")).orderBy("place").collect()
    assert "".join(r.text for r in got) == extract(df, "page_text").first()["stream"]
    assert {r.width for r in codes.widths(shown, extract(df, "font_widths")).collect()} <= {7.0, 1000.0}


def test_codes_meet_ranges_once_for_each_font(spark):
    """Texts and widths of long strings: rows are different codes, not places."""
    shown = spark.createDataFrame([("d", k, 3, "F", [65 + (j * (k + 1)) % 700 for j in range(5000)]) for k in range(4)] + [("d", 9, 0, "F", [])], "doc_id string, page int, seq int, font_name string, codes array<long>")
    maps = spark.createDataFrame([("d", k, "F", 65, 400, "a", 1) for k in range(3)] + [("d", 0, "F", 70, 70, "fi", 0)], "doc_id string, page int, font_name string, first_code long, last_code long, to string, rank int")
    wide = spark.createDataFrame([("d", k, "F", 65, 100, 250.0, 900.0, 0) for k in range(3)], "doc_id string, page int, font_name string, first_code int, last_code int, width double, default_width double, rank int")
    rows = codes.code_rows(shown)
    want = codes.characters(rows, maps).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("t")).collect()
    got = {r.page: r.text for r in codes.texts(shown, maps).collect()}
    assert got == {r.page: "".join(x.text for x in r.t) for r in want} and sorted(got) == [0, 1, 2, 3]
    summed = {r.page: r.width for r in codes.widths(rows, wide).groupBy("page").agg(F.sum("width").alias("width")).collect()}
    assert {r.page: r.width for r in codes.page_widths(shown, wide).collect()} == summed
    assert "place" not in codes.texts(shown, maps)._jdf.queryExecution().executedPlan().toString()


def test_codes_are_looked_up_in_their_page(spark):
    """Pages in their row, and beside longer maps that are joined, against joins for all."""
    from quire.plans.relational import _ranged

    rng = random.Random(3)
    made = [(str(k), bytearray(_ranged({"text": "\n".join("".join(rng.choices("ab é中文ж\x00Ġ", k=rng.randrange(0, 30))) for _ in range(k * 5))}))) for k in range(12)]
    files = spark.createDataFrame(made, "doc_id string, content binary").cache()
    names = ("doc_id", "page", "seq", "font_name", "text")
    rows = lambda df: sorted(map(str, map(tuple, df.select(*names).collect())))
    want = rows(codes.texts(extract(files, "shown_codes"), extract(files, "code_maps")))
    assert len(want) > 200
    for limit in (codes.IN_ROW, 6):
        assert rows(codes.texts_of_pages(extract(files, "page_codes"), limit)) == want
    plan = codes.texts_of_pages(extract(files, "page_codes"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
