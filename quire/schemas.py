"""Schemas of the tables that documents are read into. Pages count from 0."""

SPAN = "struct<seq: int, x0: double, y0: double, x1: double, y1: double, text: string, font_size: double>"

_METADATA = "title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string"
_OUTLINE = "struct<ord: int, title: string, dest_page: int, level: int>"

TABLES = {
    "document": "doc_id string, n_pages int, n_xref int, is_encrypted boolean, has_structure boolean, n_fields int",
    "xref": "doc_id string, obj_num long, entry_type string, offset long, gen_or_index long",
    "pages": "doc_id string, page int, obj_num long, media_box array<double>, crop_box array<double>, width double, height double, rotation int",
    "fonts": "doc_id string, page int, font_name string, subtype string, is_cid boolean, bytes_per_char int, wmode int, ascender double, descender double, cap_height double, x_height double, italic_angle double, missing_width double",
    "content_ops": "doc_id string, page int, seq int, frame int, depth int, op string, x double, y double, size double, parts array<struct<adjust: double, text: string>>, mcid int, wmode int",
    "entries": "doc_id string, obj long, key string, place int, ref long, num double, bytes binary, name string",
    "document_entries": "doc_id string, entries array<struct<obj: long, key: string, place: int, ref: long, num: double, bytes: binary, name: string>>",
    "code_maps": "doc_id string, page int, font_name string, first_code long, last_code long, to string, rank int",
    "shown_codes": "doc_id string, page int, seq int, font_name string, codes array<long>",
    "page_codes": "doc_id string, page int, shown array<struct<seq: int, font_name: string, codes: array<long>>>, maps array<struct<font_name: string, first_code: long, last_code: long, to: string, rank: int>>",
    "xref_sections": "doc_id string, start long, prev long, newest boolean, entries array<struct<obj_num: long, entry_type: string, offset: long, gen_or_index: long>>",
    "document_sections": "doc_id string, sections array<struct<start: long, prev: long, newest: boolean, entries: array<struct<obj_num: long, entry_type: string, offset: long, gen_or_index: long>>>>",
    "page_ops": "doc_id string, page int, ops array<struct<op: string, nums: array<double>, name: string, parts: array<struct<adjust: double, text: string>>, mcid: int>>, "
    "xobjects array<struct<name: string, subtype: string, width: int, height: int>>",
    "page_paints": "doc_id string, page int, ops array<struct<op: string, nums: array<double>, name: string>>, xobjects array<struct<name: string, subtype: string, width: int, height: int>>",
    "page_steps": "doc_id string, page int, steps array<struct<ends: boolean, kind: int, x: double, y: double, text: string>>",
    "page_marks": "doc_id string, page int, marks array<struct<way: int, mcid: int, piece: string>>",
    "page_text": "doc_id string, page int, stream string, plain string",
    "page_spans": f"doc_id string, page int, width double, spans array<{SPAN}>",
    "mcid_refs": "doc_id string, page int, ord int, mcid int, struct_type string",
    "mcid_text": "doc_id string, page int, mcid int, text string",
    "page_all": f"doc_id string, page int, width double, has_structure boolean, plain string, spans array<{SPAN}>, refs array<struct<mcid: int, struct_type: string>>, marked map<int, string>",
    "document_pages": "doc_id string, pages array<struct<page: int, plain: string, refs: array<struct<mcid: int, struct_type: string>>, marked: map<int, string>>>",
    "metadata": f"doc_id string, {_METADATA}",
    "outline": "doc_id string, ord int, title string, dest_page int, level int",
    "label_ranges": "doc_id string, start int, style string, prefix string, first int",
    "links": "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, uri string, dest_page int",
    "images": "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, width int, height int",
    "form_fields": "doc_id string, ord int, name string, value string, field_type string, rect array<double>",
    "parse_errors": "doc_id string, kind string, offset long, message string, page int",
    "font_widths": "doc_id string, page int, font_name string, first_code int, last_code int, width double, default_width double, ordering string, first_gid int, rank int",
    "info": f"doc_id string, size long, n_pages int, n_xref int, is_encrypted boolean, has_structure boolean, n_fields int, {_METADATA}, page_sizes array<struct<width: double, height: double, rotation: int>>, outline array<{_OUTLINE}>",
    "whole": f"doc_id string, n_pages int, {_METADATA}, outline array<{_OUTLINE}>, label_ranges array<struct<start: int, style: string, prefix: string, first: int>>, "
    "pages array<struct<page: int, text: string, links: array<struct<uri: string, dest_page: int, rect: array<double>>>, images: array<struct<rect: array<double>, width: int, height: int>>>>",
}
