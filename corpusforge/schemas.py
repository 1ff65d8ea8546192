"""Schemas of the engine's tables, as DDL."""

DOCUMENT = "uuid string, vws_id string, create_date string, type string, link string, attachment_links array<string>, content string"
RAW_DOCUMENT = "uuid string, vws_id string, create_date timestamp_ntz, type string, link string, attachment_links array<string>, content string, source string"
CHUNK = "chunk_id bigint, doc_uuid string, pos int, type string, link string, content string, content_date timestamp_ntz"
METADATA = "ID string, Matter string, Family string, Document string, `File Type` string, Datum string, `Document Link` string, besluit_id string, available boolean"
CONTEXT_PIECE = "doc_uuid string, chunk_id bigint, content string, type string, source string"
HISTORY = "timestamp string, question string, response string, document_chunks array<string>, data_sources array<string>, chat_type string"
BENCHMARK = "type string, question string, answer string, relevant_uuids array<string>, context string"
TRAINING_PAIR = "query string, chunk string"
EVIDENCE_REPLY = "relevant_chunk_indices array<int>, summary_reasoning string"
PROGRESS_REPLY = "status string, reasoning string"
SUBQUERY_REPLY = "subquery string, explanation string"
SOURCE_REPLY = "source_name string, reasoning string"
SUGGESTION_REPLY = "suggestions array<string>, explanation string"
