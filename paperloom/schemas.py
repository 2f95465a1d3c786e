"""Schemas of the document-review tables. Reads give them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

AUDIT = (
    "created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, "
    "created_by string, updated_by string, deleted_by string"
)
RECTS = "array<struct<x1:double,y1:double,x2:double,y2:double>>"

#: table -> (own columns, has the audit columns and so soft delete)
TABLES: dict[str, tuple[str, bool]] = {
    "users": ("id string, username string, email string, password string, phone_number string, access_level string, icon_id string", True),
    "user_images": ("id string, user_id string, file_path string", False),
    "password_resets": ("id string, user_id string, token string, expires_at timestamp_ntz, used boolean", False),
    "system_settings": ("id string, key string, value string, description string", True),
    "sources": ("id string, name string, description string, file_path string", True),
    "typifications": ("id string, name string", True),
    "typification_sources": ("typification_id string, source_id string, created_at timestamp_ntz, created_by string", False),
    "taxonomies": ("id string, typification_id string, title string, description string", True),
    "taxonomy_sources": ("taxonomy_id string, source_id string, created_at timestamp_ntz, created_by string", False),
    "branches": ("id string, taxonomy_id string, title string, description string", True),
    "documents": (
        "id string, name string, identifier string, description string, processing_status string, is_archived boolean, "
        "source string, project_document_id string, advisorship_id string",
        True,
    ),
    "document_typifications": ("document_id string, typification_id string, created_at timestamp_ntz, created_by string", False),
    "document_editors": ("document_id string, user_id string, created_at timestamp_ntz, created_by string", False),
    "document_histories": ("id string, document_id string, status string", True),
    "document_releases": ("id string, history_id string, file_path string, version string, description string", True),
    "applied_sources": ("id string, original_id string, name string, description string", False),
    "applied_typifications": ("id string, original_id string, applied_release_id string, name string", False),
    "applied_typification_sources": ("applied_typification_id string, applied_source_id string", False),
    "applied_taxonomies": ("id string, original_id string, applied_typification_id string, title string, description string", False),
    "applied_taxonomy_sources": ("applied_taxonomy_id string, applied_source_id string", False),
    "applied_branches": (
        "id string, applied_taxonomy_id string, original_id string, title string, feedback string, fulfilled boolean, "
        f"score int, references array<struct<chunk_id:string,text_snippet:string,page:int,rects:{RECTS}>>",
        False,
    ),
    "document_messages": (
        "id string, document_id string, release_id string, author_id string, quoted_message_id string, content string",
        True,
    ),
    "document_message_mentions": ("message_id string, entity_id string, entity_type string, label string", False),
    "audit_logs": (
        "id string, table_name string, record_id string, action string, user_id string, old_data string, "
        "created_at timestamp_ntz, description string",
        False,
    ),
    "projects": ("id string, name string, description string, status string", True),
    "project_documents": ("id string, project_id string, name string, type string, status string", True),
    "document_groups": ("id string, name string", True),
    "document_group_items": ("id string, group_id string, name string", True),
    "chat_conversations": ("id string, user_id string, document_id string, title string, text_cache string", True),
    "chat_messages": ("id string, conversation_id string, role string, content string, created_at timestamp_ntz", False),
    "advisorships": (
        "id string, advisor_id string, advisee_id string, project_id string, role_type string, topic string, status string",
        True,
    ),
}

#: Columns of which active rows may hold a combination once.
ACTIVE_KEYS = {
    "users": [["phone_number"], ["email"]],
    "sources": [["name"]],
    "typifications": [["name"]],
    "taxonomies": [["title", "typification_id"]],
    "branches": [["taxonomy_id", "title"]],
    "documents": [["identifier"]],
    "system_settings": [["key"]],
    "document_groups": [["name"]],
    "advisorships": [["advisor_id", "advisee_id", "project_id", "role_type"]],
}

WORDS = (
    "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int"
)
CHUNKS = (
    "source string, chunk_id string, chunk_index int, page int, rects array<array<double>>, section_title string, "
    "text string, embedding array<float>, pii_map map<string,map<string,string>>"
)
SECTIONS = "doc_id string, ord int, section string, start_text string, end_text string"
SPANS = (
    "doc_id string, page int, block int, line int, span int, text string, size double, font string, flags int, color int, "
    "x0 double, y0 double, x1 double, y1 double, line_x0 double, line_y0 double, line_x1 double, line_y1 double, "
    "page_w double, page_h double"
)


def schema_of(table: str) -> T.StructType:
    own, audit = TABLES[table]
    return T.StructType.fromDDL(f"{own}, {AUDIT}" if audit else own)


def soft_deleted(table: str) -> bool:
    return TABLES[table][1]
