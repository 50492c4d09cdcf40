"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

ALIAS = "struct<text:string,key:string,source:string>"
CATALOG = f"schema_version int, id string, name string, producer string, region string, style array<string>, color string, grapes array<string>, year int, alcohol_percent double, slug string, image_url string, aliases array<{ALIAS}>, search_text string, source string"
LINES = "obs_id string, line_idx int, text string, confidence double"
FORMS = "id string, field string, field_pos int, form_pos int, form string"
EVIDENCE = "struct<field:string,ocr_text:string,catalog_key:string,ocr_indices:array<int>,similarity:double,weighted_similarity:double,contribution:double,matched_words:int>"
POINT = "struct<x:double,y:double>"
BOXES = f"obs_id string, box_id int, points array<{POINT}>, image_w int, image_h int"
READINGS = "obs_id string, crop_index int, pass_index int, text string, char_conf array<double>"
TASK = "task_id string, object_key string"
