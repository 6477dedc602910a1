"""Row types of the data model, as DDL strings for readers and createDataFrame."""

from __future__ import annotations

RAW_DOCUMENT = "id string, titre string, text string, date string, source string, type string, metadata map<string,string>"
INGESTION = "struct<processed_at_utc:string,pipeline:string,source_file:string,chunk_size:int,chunk_overlap:int,hard_max_chunk:int,metadata_schema_version:string>"
CHUNK = f"chunk_id string, doc_id string, chunk_index int, total_chunks int, titre string, text string, date string, source string, type string, metadata map<string,string>, ingestion {INGESTION}"
VECTOR = "chunk_id string, vector array<float>"
INDEX_META = "model string, prefix string, dim int, count long"
UNIFIED = "vector array<float>, text string, doc_id string, chunk_id string, source string, title string, metadata variant"
QUESTION = "id string, question string, reference_answer string, reference_keywords array<string>, topic string"
#: The superset of all generations of result files; absent columns read as null.
RESULT = (
    "question_id string, question string, topic string, answer string, keyword_recall double, word_f1 double, citation_faithfulness double, context_coverage double, "
    "hallucination_risk double, latency_s double, n_retrieved int, sources_titles array<string>, ragas_faithfulness double, ragas_context_precision double, ragas_error string, "
    "bertscore_f1 double, judge_score double, judge_label string, judge_reason string, judge_error string"
)
MESSAGE = "conv_id long, turn long, role string, text string"
#: The columns of the experiment log, in file order.
EXPERIMENT_LOG = (
    "exp_id int, timestamp string, retriever string, k int, faiss_weight double, bm25_weight double, use_reranker boolean, prompt_version int, model string, keyword_recall double, word_f1 double, "
    "citation_faithfulness double, context_coverage double, hallucination_risk double, latency_s double, score double, n_questions int, status string, reason string, duration_s double"
)
AUDIT = (
    "timestamp string, query struct<text:string,sha256:string>, answer struct<preview:string,sha256:string,chars:int>, retrieval struct<method:string,k:int,used:int,omitted:int>, "
    "chunks array<struct<chunk_id:string,rank:int,score:double,preview:string>>"
)
