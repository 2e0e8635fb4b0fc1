"""Tables that the operators pass to each other, as DDL. Keys come first; an ordinal column fixes every order."""

BOX = "x0 double, y0 double, x1 double, y1 double"
RUNS = f"doc_id {{id}}, page int, run_ix bigint, text string, {BOX}, font_size double, mcid bigint"
RULES = "doc_id {id}, page int, line_ix int, vertical boolean, pos double, lo double, hi double"
DRAWS = "doc_id {id}, page int, draw_ix int, obj_id string, a double, b double, c double, d double, e double, f double"
LINES = "doc_id {id}, page int, line_ix int, column int, text string, y double, x0 double, x1 double, size double, gap_xs array<double>, cells array<struct<text:string,x0:double,x1:double>>"
CELL = "struct<text:string,bbox:array<double>,col:int,colspan:int,rowspan:int>"
TABLE = f"struct<columns:int,header_rows:int,rows:array<array<{CELL}>>>"
BLOCKS = f"doc_id {{id}}, block_ix int, page int, kind string, text string, bbox array<double>, size double, column int, table {TABLE}"
CHUNKS = f"doc_id {{id}}, chunk_ix int, page int, kind string, text string, heading_path array<string>, bbox array<double>, token_estimate bigint, table {TABLE}, char_start bigint, char_len bigint"


def of(ddl: str, id_type: str = "bigint") -> str:
    return ddl.format(id=id_type)
