"""Readers and writers."""

from .io import append_usage, chunk_table, drop_chunks, load_answer_questions, load_questions, read_chunks, read_files, read_messages, write_chunks
from .reports import answer_report_markdown, report_json, report_markdown
from .snapshots import SnapshotTable

__all__ = ["SnapshotTable", "answer_report_markdown", "append_usage", "chunk_table", "drop_chunks", "load_answer_questions", "load_questions", "read_chunks", "read_files", "read_messages", "report_json", "report_markdown", "write_chunks"]
