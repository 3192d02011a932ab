import base64
import random
import zlib

import pytest

from quire.kernel import cff, filters, fonts
from quire.kernel import writer as W
from quire.kernel.content import PageReader, marked_text, operations, spans, stream_text
from quire.kernel.document import Document, decode_text_string
from quire.kernel.objects import Name, Parser, PdfError, Ref, Stream


def text(data, page=0, forms=True):
    d = Document(data)
    return stream_text(PageReader(d).ops(d.pages[page]), forms)


def one_page(content, **kw):
    return W.simple_pdf([content], **kw)


# Objects

@pytest.mark.parametrize("raw, value", [
    (b"null", None), (b"true", True), (b"false", False), (b"42", 42), (b"-7", -7), (b"+3", 3), (b".5", 0.5), (b"5.", 5.0), (b"-.25", -0.25),
    (b"(a(b)c)", b"a(b)c"), (rb"(\n\r\t\b\f\(\)\\)", b"\n\r\t\b\f()\\"), (rb"(\101\7\0534)", b"A\x07+4"), (b"(a\\\nb)", b"ab"), (b"(a\\\r\nb)", b"ab"), (rb"(\q)", b"q"),
    (b"<48 65 6C>", b"Hel"), (b"<4F3>", b"O0"), (b"<>", b""), (b"/Name", "Name"), (b"/A#20B", "A B"), (b"/A#ZZ", "A#ZZ"), (b"/", ""),
    (b"[1 2 R 3 0 R]", None), (b"[1 [2 (x)] /N]", [1, [2, b"x"], "N"]), (b"<< /A 1 /B << /C 2 >> /A 3 >>", {"A": 1, "B": {"C": 2}}), (b"12 0 R", Ref(12, 0)), (b"% note\n 7", 7), (b"1 0 Rx", 1),
])
def test_objects(raw, value):
    if raw == b"[1 2 R 3 0 R]":
        assert Parser(raw).parse() == [Ref(1, 2), Ref(3, 0)]
    else:
        assert Parser(raw).parse() == value


@pytest.mark.parametrize("raw", [b"", b"(abc", b"<41", b"[1 2", b"<< /A", b"<< 1 2 >>", b"]", b"[" * 200, b"99999999999999999999"])
def test_bad_objects(raw):
    with pytest.raises(PdfError):
        Parser(raw).parse()


def test_indirect_objects():
    ref, value = Parser(b"4 0 obj << /Length 3 >> stream\r\nabcdef endstream endobj").indirect()
    assert ref == Ref(4, 0) and value.data == b"abc"
    assert Parser(b"4 0 obj << /Length 9 0 R >> stream\nabc \n endstream").indirect()[1].data == b"abc"
    assert Parser(b"4 1 obj 17").indirect() == (Ref(4, 1), 17)
    assert isinstance(Parser(b"1 0 obj <</Length 0>> stream\nendstream").indirect()[1], Stream)


# Filters

def test_filter_values():
    assert filters.ascii_hex(b"48656C6C6F>", {}) == filters.ascii_hex(b"48 65 6C\n6C 6F >", {}) == b"Hello"
    assert filters.ascii85(b"87cURD]j7BEbo7~>", {}) == b"Hello world" and filters.ascii85(b"<~z~>", {}) == bytes(4)
    assert filters.run_length(b"\x02ABC\xfeX\x80", {}) == b"ABCXXX"


@pytest.mark.parametrize("seed", range(6))
def test_round_trips(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abcab \n" if seed % 2 else range(256)) for _ in range(rng.randrange(1, 30_000)))
    assert filters.decode(W.lzw_encode(data), "LZWDecode", None) == data
    assert filters.decode(W.run_length_encode(data), "RL", None) == data
    assert filters.decode(base64.a85encode(data) + b"~>", ["A85"], None) == data
    assert filters.decode(base64.a85encode(zlib.compress(data)) + b"~>", ["A85", "Fl"], None) == data
    padded = data + b" " * (-len(data) % 16)
    assert filters.decode(zlib.compress(W.png_up(data, 16)), "Fl", {"Predictor": 12, "Columns": 16}) == padded


def test_predictors():
    rows = [bytes([10, 20, 30, 40]), bytes([11, 22, 33, 44])]
    for tag in range(5):
        out, above = b"", bytes(4)
        for row in rows:
            line = []
            for i, v in enumerate(row):
                a, b, c = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
                line.append((v - (0, a, b, (a + b) // 2, filters.paeth(a, b, c))[tag]) & 255)
            out += bytes([tag, *line])
            above = row
        assert filters.predict(out, {"Predictor": 15, "Columns": 4}) == b"".join(rows)
    assert filters.predict(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])
    with pytest.raises(PdfError):
        filters.predict(b"abc", {"Predictor": 7})


def test_damaged_and_large_streams(monkeypatch):
    whole = zlib.compress(b"hello " * 1000)
    assert filters.flate(whole[:-6], {}).startswith(b"hello hello")
    with pytest.raises(PdfError):
        filters.flate(b"junk", {})
    monkeypatch.setattr(filters, "LIMIT", 1000)
    with pytest.raises(PdfError):
        filters.flate(whole, {})
    with pytest.raises(PdfError):
        filters.decode(b"", "Nope", None)
    assert filters.decode(b"x", "DCTDecode", None) == b"x"


# Content

def ops(raw):
    return list(operations(raw))


def test_lexer():
    assert ops(b"[(a) -200 <42>] TJ") == [(b"TJ", [[b"a", -200.0, b"B"]])]
    assert ops(b"/F1 12 Tf % note\n(x)Tj(y)'") == [(b"Tf", [Name("F1"), 12.0]), (b"Tj", [b"x"]), (b"'", [b"y"])]
    assert ops(b"BI /W 2 ID \x00(EI\x01 EI (z) Tj") == [(b"Tj", [b"z"])]
    assert ops(b"/P <</MCID 3>> BDC") == [(b"BDC", [Name("P"), Name("MCID"), 3.0])]
    assert ops(b"1 -.5 +2. Td T* (a\\)b) Tj") == [(b"Td", [1.0, -0.5, 2.0]), (b"T*", []), (b"Tj", [b"a)b"])]
    assert len(ops(b"1 " * 500 + b"x")[0][1]) == 500 and len(ops(b"[" + b"(a)" * 900 + b"] TJ")[0][1][0]) == 900
    assert ops(b"9" * 400 + b" w") == [(b"w", [1e15])]
    assert ops(b"(open") == []


def test_stream_text_rules():
    assert text(one_page(b"BT /F1 12 Tf 100 700 Td [(two) -150 (part) -60 (s)] TJ ET")) == "two parts"
    assert text(one_page(b"BT /F1 12 Tf 100 700 Td (a) Tj 0 -14 Td (b) Tj 5 -2 Td (c) Tj T* (d) Tj (e) ' 1 2 (f) \" ET")) == "a\nbc\nd\ne\nf"
    # raised by 5: less than 0.7 of 10, the size shown last, so still the same line; by 8 it is not
    raised = b"BT /F1 10 Tf 1 0 0 1 40 300 Tm (E = mc) Tj /F1 6 Tf 1 0 0 1 75 %d Tm (n) Tj /F1 10 Tf 1 0 0 1 80 %d Tm (, so) Tj ET"
    assert text(one_page(raised % (305, 300))) == "E = mcn, so" and text(one_page(raised % (308, 308))) == "E = mc\nn, so"
    assert text(one_page(b"(no font \x93x\x94\x81\x00) Tj")) == "no font “x”"


def test_contents_arrays_inline_images_and_missing_type():
    w = W.Writer()
    w.put(b"<< /Type /Catalog /Pages 2 0 R >>")
    w.put(b"<< /Kids [3 0 R] >>")
    w.put(b"<< /Contents [4 0 R 5 0 R] /Resources << /Font << /F1 6 0 R >> >> >>")
    w.stream(b"BT /F1 12 Tf 1 700 Td (Before) Tj ET BI /W 2 /H 2 ID \x01\x02 EI")
    w.stream(b"BT 1 600 Td (After) Tj ET")
    w.put(W.HELVETICA)
    d = Document(w.save(1))
    assert len(d.pages) == 1 and d.pages[0].media_box == [0, 0, 612, 792] and text(w.save(1)) == "Before\nAfter"


def test_spans():
    d = Document(one_page(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm [(ab) -200 (cd)] TJ 10 -20 Td (\xe9) Tj ET"))
    got = spans(PageReader(d).ops(d.pages[0]))
    assert got == [(50, 700, 60, 712, "ab", 10), (62, 700, 72, 712, "cd", 10), (60, 680, 70, 692, "é", 10)]


def test_forms_nest_ten_deep():
    def doc(depth):
        forms = {f"X{k}": b"/X%d Do" % (k + 1) for k in range(1, depth)} | {f"X{depth}": W.show_lines(["deep"])}
        return one_page(b"/X1 Do", forms=forms)

    assert text(doc(10)) == "deep" and text(doc(11)) == "" and text(doc(1), forms=False) == ""


def test_marked_content():
    content = b"/P <</MCID 0>> BDC BT (a) Tj ET /Span BMC (b) Tj EMC EMC /Q /Named BDC (c) Tj EMC (d) Tj /P <</MCID 1>> BDC [(e) -200 (f)] TJ EMC"
    d = Document(one_page(content, structure=[(0, 1, "P"), (0, 0, "H1")]))
    assert marked_text(PageReader(d).ops(d.pages[0])) == {0: "ab", 1: "e f"}
    assert d.reading_order() == [(0, 1, "P"), (0, 0, "H1")] and d.has_structure


# Fonts

def test_encodings_and_glyphs():
    assert fonts.named_encoding("WinAnsiEncoding")[0x93] == 0x201C and fonts.named_encoding("MacRomanEncoding")[0xCA] == 0xA0
    assert fonts.named_encoding("StandardEncoding")[0xE1] == 0xC6 and fonts.named_encoding("StandardEncoding")[0x27] == 0x2019
    assert fonts.named_encoding("PDFDocEncoding")[0xA0] == 0x20AC
    got = {n: fonts.glyph(n) for n in ("A", "bullet", "fi", "uni0041", "u1F600", "eacute", "Scaron", "nothing", "uniD800")}
    assert got == {"A": 65, "bullet": 0x2022, "fi": 0xFB01, "uni0041": 65, "u1F600": 0x1F600, "eacute": 0xE9, "Scaron": 0x160, "nothing": None, "uniD800": None}


def cid(cmap=b""):
    f = fonts.Font(is_cid=True, bytes_per_char=2)
    fonts.read_cmap(cmap, f)
    return f


def test_cid_decoding():
    f = cid()
    assert f.decode(bytes.fromhex("00414E2DD83DDE000000")) == "A中😀 "
    assert f.decode(b"\x00A\x42") == "AB" and f.decode(b"\xd8\x00\x00A") == "�A"
    f = cid(b"2 beginbfchar <0001> <0058> <0002> <006600660069> endbfchar 2 beginbfrange <0100> <0102> <0058> <0200> <0201> [<0061> <00620063>] endbfrange /WMode 1 def")
    assert f.decode(bytes.fromhex("00010002010001020200020101FF")) == "XffiXZabcǿ" and f.wmode == 1


def test_simple_font_with_unicode_map():
    f = fonts.Font()
    fonts.read_cmap(b"beginbfchar <41> <0042> endbfchar", f)
    assert f.is_cid and f.bytes_per_char == 1 and f.decode(b"AC\x00") == "BC "


def test_differences_and_metrics():
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /nothing /uni4E2D] >> /FontDescriptor << /Ascent 750 /MissingWidth 99 >> /FirstChar 65 /Widths [500 600] >>"
    d = Document(one_page(W.show_lines(["ABCD"]), fonts={"F1": font}))
    f = PageReader(d).fonts(d.pages[0])["F1"]
    assert f.decode(b"ABCD") == "é 中D" and (f.ascender, f.width(66), f.width(1)) == (750, 600, 99)
    inner = b"<< /Subtype /CIDFontType2 /DW 300 /W [1 [10 20] 5 7 30] /CIDSystemInfo << /Ordering (Japan1) >> >>"
    d = Document(one_page(b"", fonts={"F1": b"<< /Subtype /Type0 /Encoding /UniJIS-V /DescendantFonts [%s] >>" % inner}))
    f = PageReader(d).fonts(d.pages[0])["F1"]
    assert [f.width(c) for c in (1, 2, 3, 6, 9)] == [10, 20, 300, 30, 300] and f.wmode == 1 and f.ordering == "Japan1" and f.gid(4) == 4


def small_cff(charset):
    def index(items):
        if not items:
            return b"\0\0"
        out, at = len(items).to_bytes(2, "big") + b"\x01", 1
        out += bytes([at] + [at := at + len(i) for i in items])
        return out + b"".join(items)

    def build(cs_at, glyphs_at):
        num = lambda v: b"\x1c" + v.to_bytes(2, "big")
        return b"\x01\x00\x04\x01" + index([b"F"]) + index([num(cs_at) + b"\x0f" + num(glyphs_at) + b"\x11"]) + index([b"own"]) + index([])

    head = len(build(0, 0))
    return build(head, head + len(charset)) + charset + index([b"x"] * 4)


def test_compact_font_names():
    assert cff.glyph_names(small_cff(b"\x00\x00\x22\x00\x42\x01\x87")) == [".notdef", "A", "a", "own"]
    assert cff.glyph_names(small_cff(b"\x01\x00\x22\x02")) == [".notdef", "A", "B", "C"]
    assert cff.glyph_names(b"junk") is None
    assert cff.operand(bytes([30, 0x3A, 0x14, 0xFF]), 0)[0] == 3 and cff.operand(bytes([30, 0xE1, 0xA5, 0xFF]), 0)[0] == -2
    assert cff.glyph_names(small_cff(b"\x00\x01\x4a\x01\x0a\x01\x40")) == [".notdef", "sevensuperior", "ff", "oneeighth"]
    assert len(cff.STRINGS) == 391 and cff.STRINGS[390] == "Semibold" and len(cff._ids(cff.EXPERT)) == 166 and len(cff._ids(cff.EXPERT_SUBSET)) == 87 and cff.STRINGS[1] == "space" and cff.STRINGS[149] == "germandbls" and cff.STRINGS[228] == "zcaron" and cff.STRINGS[34] == "A"


# Documents

def test_pages_inherit():
    d = Document(W.simple_pdf([b"", b""], boxes=[(0, 0, 300, 400), (10, 20, 110, 220)], rotations=[0, 90]))
    assert [(p.media_box, p.rotation) for p in d.pages] == [([0, 0, 300, 400], 0), ([10, 20, 110, 220], 90)] and d.pages[0].crop_box == d.pages[0].media_box


@pytest.mark.parametrize("packed", [False, True])
def test_features(packed):
    data = W.simple_pdf(
        [b"30 0 0 45 7 11 cm /Im0 Do", b"", b"", b"", b""], packed=packed, info={"Title": "Reef survey", "Author": "Kim"},
        outline=[("Methods", 2, 0), ("Sites", 3, 1), ("Depth", 3, 2), ("Résumé 鱼", None, 0)],
        labels=[(1, b"/S /r /St 4"), (3, b"/P (T.) /S /D"), (4, b"/S /A")],
        links=[[((5, 6, 50, 16), b"/A << /S /URI /URI (ftp://reef.test/a) >>"), ((9, 8, 7, 6), b"/A << /S /GoTo /D [{page:4} /Fit] >>")]],
        images=[(31, 17)], fields=[b"<< /T (site) /Kids [<< /T (no) /FT /Tx /V (12) >> << /FT /Btn >>] >>", b"<< /FT /Sig /Rect [2 4 6 8] >>"],
    )
    d = Document(data)
    assert d.errors == [] and d.metadata()[:3] == [b"Reef survey", b"Kim", None]
    assert [(t, d.page_of(r), n) for t, r, n in d.outline()] == [("Methods", 2, 0), ("Sites", 3, 1), ("Depth", 3, 2), ("Résumé 鱼", None, 0)]
    assert d.label_ranges() == [(1, "r", None, 4), (3, "D", "T.", 1), (4, "A", None, 1)]
    assert [(r[:2], u, d.page_of(t)) for r, u, t in d.links(d.pages[0])] == [([5, 6], "ftp://reef.test/a", None), ([9, 8], None, 4)]
    assert list(PageReader(d).images(d.pages[0])) == [([7, 11, 37, 56], 31, 17)]
    assert d.form_fields() == [("site.no", "12", "text", None), ("site", None, "button", None), ("", None, "signature", [2, 4, 6, 8])]


def test_incremental_update():
    w = W.Writer()
    w.put(b"<< /Pages 2 0 R >>")
    w.put(b"<< /Kids [3 0 R] >>")
    w.put(b"<< /Contents 4 0 R >>")
    w.stream(b"(draft) Tj", num=4)
    w.last = 4
    first = w.save(1)
    w.stream(b"(final) Tj", num=4)
    both = w.save(1, before=first, only=[4])
    assert text(first) == "draft" and text(both) == "final" and Document(both).xref[4].offset > len(first) - 1


def test_text_strings():
    for raw, want in ((b"plain", "plain"), (b"", ""), (b"\xfe\xff\0o\0k", "ok"), (b"na\xefve", "naïve"), (b"\xfe\xff\x6c\x34", "水"), (b"\xfe\xff\xd8\x3c\xdf\x0a!", "🌊"), (b"\xfe\xff\xd8\x01\0x\0y", "�y"), (b"\xfe\xff\xdd\x00\0z", "�z")):
        assert decode_text_string(raw) == want


def kinds(data):
    return [e[0] for e in Document(data).errors]


def test_errors_and_guards():
    assert kinds(b"") == ["invalid_header", "invalid_xref"] and kinds(one_page(b"", encrypt=True)) == ["encrypted"] and Document(one_page(b"", encrypt=True)).encrypted
    assert kinds(one_page(b"", header=False)) == ["invalid_header"]
    with pytest.raises(PdfError):
        Document(b"junk", strict=True)
    w = W.Writer()
    w.put(b"<< /Pages 2 0 R >>")
    w.put(b"<< /Kids [2 0 R] >>")
    assert kinds(w.save(1)) == ["invalid_page_tree"]
    looped = w.save(1, b" /Prev 99999")
    at = looped.rindex(b"xref\n0")
    assert kinds(looped.replace(b"/Prev 99999", b"/Prev %05d" % at)) == ["invalid_page_tree"]


def test_cycles_end():
    w = W.Writer()
    w.put(b"<< /Pages 2 0 R /Outlines << /First 4 0 R >> /AcroForm << /Fields [5 0 R] >> /StructTreeRoot << /K 6 0 R >> >>")
    w.put(b"<< /Kids [3 0 R] >>")
    w.put(b"<< /Type /Page >>")
    w.put(b"<< /Title (x) /Next 4 0 R /First 4 0 R >>")
    w.put(b"<< /T (f) /Kids [5 0 R] >>")
    w.put(b"<< /S /P /Pg 3 0 R /K [6 0 R 1 << /Type /MCR /MCID 2 >> << /S /Artifact /K 9 >>] >>")
    d = Document(w.save(1))
    assert d.outline() == [("x", None, 0)] and d.form_fields() == [] and d.reading_order() == [(0, 1, "P"), (0, 2, "P")]


def test_odd_nodes_of_the_page_tree_are_left_out():
    w = W.Writer()
    w.put(b"<< /Pages 2 0 R >>")
    w.put(b"<< /Kids [3 0 R null 4 0 R 5 0 R 6 0 R] >>")
    w.put(b"<< /Type /Page /Contents 7 0 R >>")
    w.put(b"<< /Type /Pages >>")
    w.put(b"<< /Type /Template >>")
    w.put(b"<< /Type /Page /Contents 7 0 R >>")
    w.stream(b"(kept) Tj")
    d = Document(w.save(1))
    assert [text(w.save(1), k) for k in range(len(d.pages))] == ["kept", "kept"] and [e[0] for e in d.errors] == ["invalid_page_tree"] * 3


def test_no_cut_without_an_error_row():
    deep = W.simple_pdf([b"(top) Tj /X1 Do"], forms={f"X{k}": b"/X%d Do" % (k + 1) for k in range(1, 13)} | {"X13": b"(deep) Tj"})
    d = Document(deep)
    PageReader(d).ops(d.pages[0])
    assert [(e[0], e[3]) for e in d.errors] == [("limit", 0)]
    d = Document(W.simple_pdf([b""], outline=[(f"item {k}", None, k % 2) for k in range(1500)]))
    assert len(d.outline()) == 1500 and d.errors == []


def test_searching_a_file_for_its_objects():
    whole = W.simple_pdf([W.show_lines(["found again"])])
    for cut in (whole[: whole.rindex(b"startxref")], whole[: whole.rindex(b"xref\n0")], whole.replace(b"startxref", b"startxxxx")):
        assert Document(cut).pages == []
        d = Document(cut, rebuild=True)
        assert stream_text(PageReader(d).ops(d.pages[0])) == "found again" and [e[0] for e in d.errors] == ["invalid_xref"]
    assert Document(b"%PDF-1.4 nothing", rebuild=True).pages == []


def test_overlapping_code_ranges():
    f = fonts.Font(is_cid=True, bytes_per_char=2)
    fonts.read_cmap(b"3 beginbfrange <0000> <00FF> <4E00> <0010> <0012> <0041> <0200> <0201> <0061> endbfrange", f)
    assert f.decode(bytes.fromhex("001100130201")) == "B" + chr(0x4E13) + "b" and f.decode(b"\x01\x50") == chr(0x150)


@pytest.mark.parametrize("seed", range(40))
def test_broken_files_never_raise(seed):
    rng = random.Random(seed)
    data = bytearray(W.simple_pdf([W.show_lines(["some text", "more"]), b"/X1 Do"], forms={"X1": b"(x) Tj"}, outline=[("a", 0, 0)], labels=[(0, b"/S /r")], fields=[b"<< /T (x) >>"], packed=seed % 2 == 0, structure=[(0, 0, "P")]))
    for _ in range(rng.randrange(1, 30)):
        k = rng.randrange(len(data))
        data[k : k + rng.randrange(3)] = bytes(rng.randrange(256) for _ in range(rng.randrange(3)))
    d = Document(bytes(data))
    r = PageReader(d)
    for p in d.pages:
        stream_text(r.ops(p)), spans(r.ops(p)), list(r.images(p)), list(d.links(p))
    d.metadata(), d.outline(), d.label_ranges(), d.form_fields(), d.reading_order()


def test_fonts_with_one_table_share_what_codes_show():
    from quire.kernel.fonts import Font

    a, b, c = Font(), Font(), Font(multi={65: "fi"})
    assert a.decode(b"A\xe9") == b.decode(b"A\xe9") == "Aé" and c.decode(b"AB") == "fiB" and a.decode(b"A") == "A"
    assert a._map is b._map and a._map is not c._map


def test_objects_that_come_again_are_parsed_once(monkeypatch):
    from quire.kernel import document

    document._short.cache_clear()
    one, two = (W.simple_pdf([b"BT (%s) Tj ET" % t]) for t in (b"first", b"other"))
    Document(one)
    parsed = []
    own = document.Parser.indirect
    monkeypatch.setattr(document.Parser, "indirect", lambda self: parsed.append(self) or own(self))
    pages = Document(two).pages
    assert len(pages) == 1 and parsed == []


@pytest.mark.parametrize(
    "body",
    [
        b"5 0 obj << /Length 40 >> stream\nabc endstream endobj 6 0 obj 1 more of it endstream endobj",
        b"5 0 obj (a endobj b) endobj",
        b"5 0 obj /Name-endobj-b 1 endobj",
        b"5 0 obj <</A 1 % endobj\n/B 2>> endobj",
        b"5 0 obj <</A 1>> % endobj\nstream\nabc\nendstream endobj",
        b"5 0 obj <</Length 6 0 R>> stream\na endobj b\nendstream endobj",
        b"5 0 obj <</Length true>> stream\na\nendstream endobj",
        b"5 0 obj 12 0 Rendobj 7",
        b"5 0 obj 12 0 R endobj",
        b"5 0 obj [1 2 (x)] endobj",
        b"5 0 obj <</A 1>>",
    ],
)
def test_kept_objects_equal_those_read_in_place(body):
    from quire.kernel.document import FAILURES, object_at
    from quire.kernel.objects import Parser, Stream

    def plain(read):
        try:
            value = read()
        except FAILURES as e:
            return type(e)
        return (value.dict, value.data) if isinstance(value, Stream) else value

    want = plain(lambda: Parser(body, 0).indirect()[1])
    for _ in range(2):
        assert plain(lambda: object_at(body, 0)) == want


@pytest.mark.parametrize("data", [b"1 -2. .5 +3 Td", b"[1 2 3 (a) 4 5] TJ", b"1 2 3Tj", b"1 2 3-4 Td", b"1 2e3 Td", b"1\x002 3\t4\r\n5 Td", b"99999999999999999999 1 -99999999999999999999 2 cm", b"1 2 % 3\n4 5 Td", b"1 2", b"1 2 ", b"/F1 12 Tf 1 1 Td <00> Tj"])
def test_runs_of_numbers_equal_numbers_one_at_a_time(data, monkeypatch):
    import re

    from quire.kernel import content

    got = list(content.operations(data))
    single = content._TOKEN.pattern.replace(b"{2,})", b"{99,})")
    assert single != content._TOKEN.pattern
    monkeypatch.setattr(content, "_TOKEN", re.compile(single, re.S))
    assert got == list(content.operations(data))
