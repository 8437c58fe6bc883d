"""Explicit schemas of all inputs and tables; nothing is inferred."""

QA_DEV = "qid string, question string, answers array<struct<answer:string>>, supporting_context array<struct<doc_id:string,doc_part:string>>"
QA_TEXTS = "id string, text string, url string"
QA_IMAGES = "id string, url string, path string"
QA_TABLES = "id string, url string, table struct<table_rows:array<array<struct<text:string>>>>"
COMPONENT = "type string, heading_path array<string>, edge array<string>, paragraph string, src string, caption string, table array<array<string>>"
PAGE = f"title string, comp_data array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in COMPONENT.split(', ')))}>>"
DESCRIPTION = "image string, explanation string, ocr string"
DETECTION = "image string, bboxes array<array<int>>"
RETRIEVAL = "qid string, final_component_id_list array<bigint>, final_component_uuid_list array<string>"
ANSWER = "qid string, answer string"
