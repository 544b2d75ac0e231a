"""Columns of the canonical tables, as DDL."""

TOKEN = (
    "doc_id bigint, token_id int, ord int, text string, x0 double, y0 double, x1 double, y1 double, "
    "font_size double, bold boolean, italic boolean, color string, block_id int, role string, separated_pair boolean"
)
EDGE = "doc_id bigint, from_id int, to_id int, relation string, edge_ord int"
FIELD = "doc_type string, ord int, name string, description string"
OCCURRENCE = (
    "label_type string, field_name string, seq bigint, x double, y double, role string, data_type string, "
    "strategy string, connections int, found boolean"
)
TABLE_CELL = "doc_id bigint, table_id int, token_id int, row int, col int"
