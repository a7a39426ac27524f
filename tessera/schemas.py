"""Table schemas and limits of the retrieval engine, in one place."""

from __future__ import annotations

SPAN = "struct<block_id:string,page_no:int,bbox:array<double>,start:int,end:int>"
CELL = f"struct<cell_id:string,row:int,column:int,row_span:int,col_span:int,raw_text:string,column_header:boolean,row_header:boolean,source_spans:array<{SPAN}>>"
BLOCK = f"struct<block_id:string,type:string,text:string,heading_path:array<string>,reading_order:int,source_spans:array<{SPAN}>,table_id:string,table_caption:string,row_index:int,cell_ranges:array<struct<a:int,z:int>>>"
TABLE = f"struct<table_id:string,caption:string,heading_path:array<string>,cells:array<{CELL}>,block_ids:array<string>,num_rows:int,num_cols:int,source_spans:array<{SPAN}>,quality_flags:array<string>,column_paths:array<array<string>>>"
CHUNK = (
    "struct<chunk_id:string,parent_id:string,kind:string,body_text:string,context_prefix:string,embedding_text:string,"
    f"heading_path:array<string>,source_spans:array<{SPAN}>,overlap_spans:array<{SPAN}>,token_count:int,block_ids:array<string>,"
    "table_id:string,row_range:array<int>,column_paths:array<array<string>>,prev_id:string,next_id:string>"
)
CITATION = f"struct<number:int,document_id:bigint,version:string,file_name:string,chunk_key:string,kind:string,heading_path:array<string>,source_spans:array<{SPAN}>,table_id:string,row_range:array<int>,column_paths:array<array<string>>>"

TABLES = {
    "users": "id bigint, username string, role string, org_tags string, primary_org string, created_at timestamp",
    "org_tags": "tag_id string, name string, description string, parent_tag string, created_by bigint, created_at timestamp",
    "file_upload": "id bigint, file_md5 string, file_name string, total_size bigint, status int, user_id bigint, org_tag string, is_public boolean, created_at timestamp, merged_at timestamp, merge_token string, merge_expires_at timestamp",
    "chunk_info": "document_id bigint, user_id bigint, file_md5 string, chunk_index int, chunk_md5 string, storage_path string",
    "processing_state": "document_id bigint, user_id bigint, file_md5 string, active_version string, pending_version string, status string, error string, created_at timestamp, updated_at timestamp",
    "document_chunk": f"document_id bigint, version string, chunk_id string, parent_id string, user_id bigint, is_parent boolean, data {CHUNK}, created_at timestamp",
    "index_doc": f"vector_id string, file_md5 string, chunk_id int, text_content string, context_prefix string, vector array<float>, model_version string, user_id bigint, org_tag string, is_public boolean, document_id bigint, version string, chunk_key string, parent_id string, file_name string, heading_path array<string>, source_spans array<{SPAN}>, token_count int, kind string, table_id string, row_range array<int>, column_paths array<array<string>>",
    "conversation_state": "id string, user_id bigint, version bigint, last_turn bigint, summary string, summary_until bigint, context_after bigint, created_at timestamp, updated_at timestamp",
    "turn": f"id bigint, user_id bigint, conversation_id string, turn_id string, turn_no bigint, question string, answer string, sources array<{CITATION}>, created_at timestamp",
    "user_memory": "id bigint, user_id bigint, scope string, kind string, key string, content string, keywords array<string>, version bigint, expires_at timestamp, created_at timestamp, updated_at timestamp",
    "outbox": "document_id bigint, user_id bigint, attempts int, available_at timestamp, lease_token string, lease_until timestamp, last_error string, created_at timestamp, updated_at timestamp",
}

# fixed values: upload states
UPLOADING, COMPLETE, FAILED, DELETING, MERGING = range(5)

# fixed values: limits
CANDIDATES_PER_RESULT, MAX_RESULTS = 30, 100
FUSED_RESULTS = 12
RRF_OFFSET = 60
PARENT_BYTES = 3000
UPLOAD_PART = 5 * 1024 * 1024
MAX_FILE_BYTES, MAX_TEXT_CHARS, MAX_PAGES = 32 * 1024 * 1024, 1_000_000, 200
MAX_CHUNKS, MAX_REFS = 20_000, 1000
BULK, EMBED_BATCH = 100, 32
MEMORIES_PER_USER, RECALLED = 50, 5
MAX_INPUT, WINDOW_TOKENS, OUTPUT_TOKENS, WINDOW_MARGIN = 20_000, 32_768, 8_192, 1024
IN_PROGRESS_STATUSES = ("queued", "parsing", "normalizing", "chunking", "embedding", "indexing")
IN_PROGRESS_SECONDS = 300
LEASE_SECONDS = 30
