"""Identities of declarations and relationships as hashes of a canonical byte form."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(parts: list[str | int | None], digits: int = 24) -> str:
    """Version byte 1, then strings as their UTF-8 length and bytes and whole numbers as four
    bytes, little-endian; the first ``digits`` (even, 16 to 64) of the SHA-256 in hex.
    A missing string counts as empty, and paths have forward slashes."""
    if digits % 2 or not 16 <= digits <= 64:
        raise ValueError("digits must be even and from 16 to 64")
    out = bytearray(b"\x01")
    for p in parts:
        if isinstance(p, int):
            out += struct.pack("<i", p)
        else:
            raw = (p or "").encode("utf-8")
            out += struct.pack("<i", len(raw)) + raw
    return hashlib.sha256(bytes(out)).hexdigest()[:digits]


def _int_bytes(c: Column) -> Column:
    """A whole number as four bytes, little-endian."""
    digits = F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 9, 8)
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def _text_bytes(c: Column) -> Column:
    raw = F.coalesce(c, F.lit("")).cast("binary")
    return F.concat(_int_bytes(F.length(raw)), raw)


def declaration_id(prefix: str = "", digits: int = 24) -> Column:
    """``canonical_hash`` of a declaration's columns; a missing line or column counts as 0."""
    texts = [F.col(prefix + n) for n in ("repository_id", "module_id", "kind", "qualified_name")]
    path = F.replace(F.col(prefix + "file_path"), F.lit("\\"), F.lit("/"))
    numbers = [F.coalesce(F.col(prefix + n), F.lit(0)) for n in ("start_line", "start_column")]
    form = F.concat(F.unhex(F.lit("01")), *[_text_bytes(c) for c in (*texts, path)], *[_int_bytes(c) for c in numbers])
    return F.substring(F.sha2(form, 256), 1, digits)


def logical_identity(namespace: list[str], types: list[tuple[str, int]], name: str, arity: int, parameters: list[tuple[str, str, str | None]]) -> str:
    """Of a symbol wherever it stands: parameter names don't count."""
    parts: list[str | int | None] = [len(namespace), *namespace, len(types)]
    for t, n in types:
        parts += [t, n]
    parts += [name, arity, len(parameters)]
    for kind, ref, _ in parameters:
        parts += [kind, ref]
    return canonical_hash(parts)


def physical_identity(logical: str, path: str, span: tuple[int, int, int, int]) -> str:
    return canonical_hash([logical, path.replace("\\", "/"), *span])
