"""The tables of the code-metadata model and how partial tables are completed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_IO = "array<struct<name:string,type:string,description:string>>"
_LINES = "array<struct<name:string,line:int>>"

TABLES: dict[str, str] = {
    "projects": "id long, name string, repo_url string, language string, last_analyzed_commit string, created_at timestamp_ntz, updated_at timestamp_ntz, overview_analysis string, overview_analysis_updated_at timestamp_ntz, analysis_mode string",
    "files": "id long, project_id long, file_path string, file_hash string, size_bytes long, language string, created_at timestamp_ntz, dependencies struct<imports:array<struct<source:string,line:int>>>",
    "functions": f"id long, file_id long, name string, language string, signature string, start_line int, end_line int, docstring string, created_at timestamp_ntz, code_snippet string, explanation_simple string, explanation_logic string, ai_purpose string, ai_inputs {_IO}, ai_outputs struct<type:string,description:string>, ai_side_effects array<string>, return_type string, expert_purpose string, expert_tech_details string, expert_error_handling string, expert_concurrency string, expert_tradeoffs string, code_hash string, llm_processed boolean, embedding array<float>",
    "classes": f"id long, file_id long, name string, start_line int, end_line int, docstring string, code_snippet string, explanation_simple string, explanation_architecture string, ai_purpose string, ai_interfaces {_IO}, ai_patterns array<struct<pattern:string,confidence:string,evidence:string>>, base_classes {_LINES}, interfaces {_LINES}, expert_purpose string, expert_architecture string, expert_responsibilities string, expert_extension_points string",
    "function_relationships": "id long, source_function_id long, target_function_name string, target_file_id long, relationship_type string, confidence int, context_line int, created_at timestamp_ntz",
    "class_relationships": "id long, source_class_id long, target_class_name string, target_file_id long, relationship_type string, confidence int, context_line int, created_at timestamp_ntz",
    "analysis_tasks": "id long, project_id long, status string, current_step string, started_at timestamp_ntz, finished_at timestamp_ntz, created_at timestamp_ntz, error_message string, retry_count int, progress_percent int, processed_files array<string>, last_processed_file string, total_files int",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``: missing ones as nulls, others cast."""
    have = {c.lower() for c in df.columns}
    want = T.StructType.fromDDL(TABLES[table]).fields
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
