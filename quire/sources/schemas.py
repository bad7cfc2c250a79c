"""Schemas of the store's tables, as DDL."""

JOBS = """job_id STRING, filename STRING, file_sha256 STRING, page_count INT, status STRING, stage STRING, output_dir STRING, options STRING,
pdf_metadata MAP<STRING,STRING>, pipeline_version STRING, created_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP, error STRUCT<error:STRING,qa:ARRAY<STRING>>"""
PAGES = """job_id STRING, page_number INT, version BIGINT, status STRING, render_dpi INT, reference STRING, reference_kind STRING, markdown STRING, coverage_score INT,
retries INT, needs_review BOOLEAN, floor_score DOUBLE, figures ARRAY<STRUCT<index:INT,bbox:ARRAY<DOUBLE>,alt:STRING,caption:STRING>>, notes STRING,
token_usage STRUCT<prompt:BIGINT,completion:BIGINT>, source_page_hash STRING, render_hash STRING, ocr_hash STRING, markdown_hash STRING"""
IMAGES = """job_id STRING, page_number INT, image_id BIGINT, asset_path STRING, source STRING, bbox ARRAY<DOUBLE>, alt_text STRING, caption STRING, referenced BOOLEAN,
mermaid STRING, diagram_type STRING, conversion_status STRING, confidence INT"""
EVENTS = "job_id STRING, event_id BIGINT, ts TIMESTAMP, level STRING, stage STRING, message STRING"
ATTEMPTS = """job_id STRING, page_number INT, attempt INT, dpi INT, reference_kind STRING, reference STRING, raw STRING, markdown STRING, figures STRING, notes STRING,
coverage INT, verdict STRING, misses ARRAY<STRING>, floor_score DOUBLE, prompt_tokens BIGINT, completion_tokens BIGINT, ms DOUBLE, transcribe_ms DOUBLE, verify_ms DOUBLE, envelope_error STRING"""
