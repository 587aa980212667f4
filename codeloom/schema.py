"""Schemas of stored rows."""

from __future__ import annotations

SYMBOL = (
    "id string, repository_id string, project string, file_path string, name string, qualified_name string, kind string, start_line int, start_column int, "
    "end_line int, end_column int, signature string, language string, module_id string, structural_identity string"
)
RELATIONSHIP = (
    "id string, repository_id string, source_id string, target_id string, kind string, file_path string, line int, col int, confidence string, language string, "
    "module_id string, structural_identity string"
)
MAX_DIAGNOSTICS = 200
