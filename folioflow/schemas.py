"""Schemas (DDL) that readers apply; nothing is inferred."""

BBOX = "struct<x0:double,top:double,x1:double,bottom:double>"
BLOCKS = f"doc_id string, id string, page int, ord int, kind string, markdown string, bbox {BBOX}, source_ref string"
