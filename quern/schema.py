"""Schemas of tables and results, as DDL."""

from __future__ import annotations

DOCUMENTS = "id string, name string, source string, source_type string, content_hash string, content string, char_count int, metadata map<string,string>, created_at timestamp, updated_at timestamp"
PARENT_CHUNKS = "id string, document_id string, ordinal int, section string, sections array<string>, page int, start_char int, end_char int, token_count int, text string, created_at timestamp"
CHUNKS = "id string, document_id string, parent_id string, ordinal int, section string, page int, start_char int, end_char int, token_count int, text string, embedding array<float>, embedding_model string, metadata map<string,string>, created_at timestamp"
RESULTS = "query_id string, document_id string, chunk_id string, text string, score double, rank int, retriever string, parent_id string, section string, page int, start_char int, end_char int, metadata map<string,string>, components map<string,map<string,double>>"
EVAL_ITEMS = (
    "id string, question string, ground_truth_answer string, question_type string, difficulty string, split string, "
    "evidence array<struct<document_id:string,start_char:int,end_char:int,quote:string>>, relevant_document_ids array<string>, relevant_chunk_ids array<string>, "
    "subtype string, notes map<string,string>, provenance struct<method:string,generator_model:string,prompt_version:string>"
)
EXPERIMENTS = "id string, name string, strategy string, dataset_version string, git_commit string, config string, retrieval_metrics string, generation_metrics string, cost_latency string, results_path string, status string, created_at timestamp"

QUESTION_TYPES = ("simple_factual", "semantic", "keyword_heavy", "numerical", "multi_hop", "comparison", "ambiguous", "unanswerable", "adversarial")
DIFFICULTIES = ("easy", "medium", "hard")
SPLITS = ("dev", "test")
SECTION = "struct<start:int,end:int,heading_path:array<string>,page:int>"
