"""Schemas of the engine's tables."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
BBOX = "struct<x:double,y:double,w:double,h:double>"

#: One wide row per drawing entity; ``seq`` is the order in the file and decides ties.
ENTITIES = (
    "document_hash string, seq long, entity_id string, handle string, kind string, source string, layer string, page int, confidence double, x double, y double, text string, tag string, "
    f"points array<{POINT}>, closed boolean, cx double, cy double, radius double, start_angle double, end_angle double, block_name string, ins_x double, ins_y double, rotation double, scale_x double, scale_y double, ltype string, eed array<string>"
)
DOCUMENTS = "content_hash string, path string, document_type string, file_size long, classification string, confidence double, error string"
TOPOLOGY = "cable_id string, conductor_no int, strip_name string, terminal_no int, terminal_no_remote string, cabinet_name string, cabinet_name_remote string, circuit_desc string, loop_id string, document_hash string, source_type string"
MATCHES = "cable string, pdf string, path string, time string, hash string, match_type string"
