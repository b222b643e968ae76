"""Schemas of the tables that operators exchange; every order is an explicit column."""

LISTS = "array<struct<type:string,topic:string,items:array<string>>>"
TABLES = "array<struct<caption:string,rows:array<array<string>>>>"

TEXT_LINES = "doc_id string, page_idx int, line_no int, text string"
WORDS = "doc_id string, page_idx int, word_idx int, text string, x0 double, top double, bottom double, fontname string, size double"
BODY_LINES = "doc_id string, page_idx int, line_no int, text string, bold boolean, size double"
RAW_TABLES = "doc_id string, page_idx int, table_idx int, bbox struct<x0:double,top:double,x1:double,bottom:double>, rows array<array<string>>"
HEADINGS = "doc_id string, pos int, level string, depth int, number string, text string"
SECTIONS = f"doc_id string, sec_pos int, level string, depth int, number string, heading string, content string, lists {LISTS}, tables {TABLES}"
#: On disk, without the ordinals: one object of the array for each heading or section.
HEADING_JSON = "level string, depth int, number string, text string"
SECTION_JSON = f"level string, depth int, number string, heading string, content string, lists {LISTS}, tables {TABLES}"
