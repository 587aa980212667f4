"""Token operators on empty tables, repeated rows, null ids and clashing columns."""

import zlib

import numpy as np
import pytest

pytest.importorskip("codeloom.llm")
from codeloom.llm import op01_token_files as op1  # noqa: E402
from codeloom.llm import op08_bpe as op8  # noqa: E402

SCHEMA = "doc_id long, text string, ids string, n_tokens string, `__text` string, shard string, offset string, part int"
ROWS = [(5, "same words", "a", "b", "c", "d", "e", 1), (5, "same words", "a", "b", "c", "d", "e", 1), (None, "no id", "", "", "", "", "", 2), (None, None, "", "", "", "", "", 2), (2, "", "", "", "", "", "", 3), (1, "long " * 60_000, "", "", "", "", "", 4)]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(op8.vocabulary_path())
    found.no_truncation()
    return found


def test_bpe(spark, library):
    got = op8.encode_documents(spark.createDataFrame(ROWS, SCHEMA), op8.vocabulary_path(), digest_only=False).collect()
    want = sorted((r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert op8.encode_documents(spark.createDataFrame([], SCHEMA), op8.vocabulary_path()).count() == 0


@pytest.mark.parametrize("docs_per_shard", [2, 1000])
def test_files(spark, library, tmp_path, docs_per_shard):
    folder = f"file://{tmp_path}/files"
    index = op1.write_token_files(spark.createDataFrame(ROWS, SCHEMA), folder, op8.vocabulary_path(), docs_per_shard=docs_per_shard).cache()
    index.count()
    start, want = 0, []
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, op1.END_ID], dtype="<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op1.read_token_files(index, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
