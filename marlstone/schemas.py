"""Schemas of the relational tables and of the records that models reply with."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType()}


def _ddl(text: str) -> T.StructType:
    """A flat schema; unlike StructType.fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


SESSIONS = _ddl("id BIGINT, name STRING, user_id STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ")
MESSAGES = _ddl("id BIGINT, session_id BIGINT, role STRING, content STRING, timestamp TIMESTAMP_NTZ, tokens INT")
KNOWLEDGE_BASES = _ddl("id BIGINT, name STRING, description STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ")
DOCUMENTS = _ddl(
    """id BIGINT, kb_id BIGINT, name STRING, file_path STRING, file_type STRING, file_size BIGINT, status STRING,
    chunk_count INT, upload_time TIMESTAMP_NTZ, indexed_time TIMESTAMP_NTZ"""
)
MONITOR_LOGS = _ddl(
    """id BIGINT, module STRING, operation STRING, status STRING, tokens INT, latency DOUBLE, cost DOUBLE,
    timestamp TIMESTAMP_NTZ, error_msg STRING, extra_data STRING"""
)
REVIEW_TASKS = _ddl(
    """id BIGINT, task_id STRING, file_name STRING, file_path STRING, status STRING, progress INT, current_agent STRING,
    kb_id INT, created_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, result STRING, error_msg STRING"""
)
RAG_CONFIGS = _ddl(
    """id BIGINT, user_id STRING, retrieval_method STRING, retrieval_k INT, similarity_threshold DOUBLE, model_name STRING,
    temperature DOUBLE, max_tokens INT, is_active BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""
)
CHUNKS = T.StructType(
    [
        *_ddl("chunk_id BIGINT, kb_id BIGINT, doc_id BIGINT, chunk_no INT, content STRING"),
        T.StructField("metadata", _ddl("source STRING, page INT, filename STRING, upload_time STRING")),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

#: One change of a review; each detector fills its own fields.
CHANGE_DDL = """id INT, type STRING, category STRING, paragraph_index INT, original STRING, corrected STRING, improved STRING,
position STRING, reason STRING, issue STRING, suggestion STRING, reference STRING, severity STRING, paragraph_index_1 INT,
paragraph_index_2 INT, content_1 STRING, content_2 STRING, similarity DOUBLE"""
CHANGE = _ddl(CHANGE_DDL)
REVIEW_RESULT = T.StructType(
    [
        *_ddl("original_content STRING, revised_content STRING"),
        T.StructField("all_changes", T.ArrayType(CHANGE)),
        *_ddl("total_changes INT, typo_count INT, fluency_count INT, duplicate_count INT, compliance_count INT"),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)

BY_NAME = {
    "sessions": SESSIONS,
    "messages": MESSAGES,
    "knowledge_bases": KNOWLEDGE_BASES,
    "documents": DOCUMENTS,
    "monitor_logs": MONITOR_LOGS,
    "review_tasks": REVIEW_TASKS,
    "rag_configs": RAG_CONFIGS,
    "chunks": CHUNKS,
}

#: Values of a config when none is active.
RAG_DEFAULTS = {"retrieval_method": "similarity", "retrieval_k": 4, "similarity_threshold": 0.5, "temperature": 0.7, "max_tokens": 2000}
