"""Schemas of the tables, as DDL. Ids are strings; amounts of money are decimal(18,8)."""

USERS = "id string, email string, role string, status string, created_at timestamp, updated_at timestamp"
REFRESH_TOKENS = "id string, user_id string, token_hash string, expires_at timestamp, revoked_at timestamp"
RETRIEVAL_CONFIG = "chunk_size int, chunk_overlap int, dense_top_k int, sparse_top_k int, rerank_top_k int, final_top_k int, minimum_score double, rrf_k int, rerank_enabled boolean"
KNOWLEDGE_BASES = f"id string, owner_id string, name string, description string, embedding_model string, embedding_dimension int, retrieval_config struct<{RETRIEVAL_CONFIG.replace(' ', ':').replace(',:', ', ')}>, created_at timestamp, updated_at timestamp, deleted_at timestamp"
DOCUMENTS = "id string, knowledge_base_id string, filename string, mime_type string, size_bytes long, sha256 string, object_key string, status string, chunk_count int, index_version int, error_code string, error_message string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
CHUNKS = "id string, knowledge_base_id string, document_id string, index_version int, chunk_index int, content string, token_count int, page_start int, page_end int, heading_path string, content_hash string, metadata map<string,string>, embedding array<float>, created_at timestamp"
JOBS = "id string, document_id string, index_version int, status string, stage string, progress int, attempts int, idempotency_key string, error_code string, error_message string, started_at timestamp, finished_at timestamp, created_at timestamp"
USAGE = "id string, user_id string, knowledge_base_id string, request_id string, trace_id string, request_type string, model string, prompt_tokens int, completion_tokens int, text_count int, estimated_cost_usd decimal(18,8), latency_ms int, status string, error_code string, created_at timestamp"
QUEUE_MESSAGE = "type string, job_id string, document_id string, knowledge_base_id string, owner_id string, index_version int"
QUESTIONS = "id string, knowledge_base string, question string, expected_document_ids array<string>, expected_chunk_ids array<string>, reference_answer string, tags array<string>"
ANSWER_QUESTIONS = "id string, question string, reference_answer string, expected_sources array<string>, expected_evidence array<string>, tags array<string>, conversation_group string, turn int, unanswerable boolean"
BLOCK = "struct<content:string,page_start:int,page_end:int,para_from:int,para_to:int,heading_path:string,metadata:map<string,string>>"
