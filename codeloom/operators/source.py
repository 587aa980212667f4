"""Line ranges of source files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LINES, MOST_LINES = 60, 400


def window(total: int, start: int = 1, end: int = 0, clamp: bool = True, most: int = MOST_LINES) -> tuple[int, int, bool]:
    """First and last line to show and whether that is less than was asked for. Without
    ``clamp`` a range that is reversed or begins beyond the file is an error."""
    if not clamp and (start > end > 0 or start > max(total, 1)):
        raise ValueError(f"lines {start} to {end} are not in a file of {total} lines")
    first = min(max(start, 1), max(total, 1))
    asked = first + DEFAULT_LINES if end <= 0 else end
    last = min(max(min(asked, first + most - 1), first), max(total, first))
    return first, last if total else 0, last < min(asked, total)


def get_source(lines: DataFrame, path: str, start: int = 1, end: int = 0, clamp: bool = True, most: int = MOST_LINES) -> DataFrame:
    """One row: ``file_path``, ``start_line``, ``end_line``, ``total_lines``, ``content``, ``truncated``. One
    pass over the file counts its lines and brings back the ``most`` that may be shown."""
    low = max(start, 1)
    shown = F.when(F.col("line_no").between(low, low + most - 1), F.struct("line_no", "line"))
    own = lines.where(F.col("file_path") == path).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(shown)).alias("shown"), F.max_by("line", "line_no").alias("last")).first()
    first, last, truncated = window(own["n"], start, end, clamp, most)
    found = [r["line"] or "" for r in own["shown"] if first <= r["line_no"] <= last]
    if first < low and own["n"]:
        found = [own["last"] or ""]
    row = (path, first, last, own["n"], "\n".join(found), truncated)
    return lines.sparkSession.createDataFrame([row], "file_path string, start_line int, end_line int, total_lines int, content string, truncated boolean")


def contained(root: str, path: str) -> Path:
    """The full path of a file below ``root``; anything outside is refused."""
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise PermissionError(f"{path} is outside {root}")
    return full
