"""Token ids in Arrow files of equal-length sequences.

A shard holds the ids of a contiguous range of documents, in ascending document order, cut
into sequences of a fixed length. Each record batch of the Arrow file has two fixed-size-list
columns: ``ids`` (16-bit where the vocabulary allows, else 32-bit) and ``mask`` (one bit an id,
false only in the padding after a shard's last id). Sequence i is row i % R of batch i // R,
so a memory-mapped reader gets any sequence as a view without copying.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, read_table
from codeloom.llm.op08_bpe import lower, vocabulary_path

END_ID = 2
SEQUENCE_LENGTH = 2048
BATCH_SEQUENCES = 64
DOCS_PER_SHARD = 4096
MAX_SHARDS = 20_000
CACHE_CHUNKS = 600_000
CACHE_CHARS = 12_000_000
_ODD_SPACE = re.compile("[\x1c-\x1f]").search


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk between white space once.

    For tokenizer files whose pattern never crosses white space. Chunks not met before are
    encoded together, joined by spaces, and told apart by the byte lengths of their tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.removesuffix("</w>"))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.row = Rows()
        self.start = np.zeros(1024, dtype=np.int64)
        self.length = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(8192, dtype=np.uint32)
        self.used = self.chars = self.met = self.missed = 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def learn(self, first: int, chunks: list[str]) -> None:
        """Gives the rows from ``first`` on the ids of ``chunks``."""
        ids = self.whole(" ".join(chunks))
        want = np.cumsum([len(c) if c.isascii() else len(lower(unicodedata.normalize("NFC", c)).encode()) for c in chunks])
        have = np.cumsum(self.n_bytes[ids])
        ends = np.searchsorted(have, want, side="left") + 1
        if len(ids) == 0 or have[-1] != want[-1] or not np.array_equal(have[np.minimum(ends, len(ids)) - 1], want):
            parts = [self.whole(c) for c in chunks]
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        last = first + len(chunks)
        while last > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        begins = np.concatenate(([0], ends[:-1]))
        self.start[first:last], self.length[first:last] = begins + self.used, ends - begins
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none).

        A full cache keeps the chunks it has, and those of a batch only as long as the batch;
        it starts afresh once a fifth of the chunks are missing from it.
        """
        direct: dict[int, np.ndarray] = {}
        split: list[list[str]] = []
        for i, t in enumerate(texts):
            if not t:
                split.append([])
            elif _ODD_SPACE(t) or "<" in t and any(a in t for a in self.added):
                direct[i] = self.whole(t)
                split.append([])
            else:
                split.append(canonical(t).split())
        known, used = len(self.row), self.used
        rows = [np.fromiter(map(self.row.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]
        new = self.row.new
        if new:
            self.learn(known, new)
        out = []
        for i, own in enumerate(rows):
            if i in direct or not len(own):
                out.append(direct.get(i, np.zeros(0, dtype=np.uint32)))
                continue
            length = self.length[own]
            last = np.cumsum(length)
            out.append(self.flat[np.arange(last[-1]) + np.repeat(self.start[own] - last + length, length)])
        self.chars += sum(map(len, new))
        if len(self.row) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            for c in new:
                del self.row[c]
            self.chars -= sum(map(len, new))
            self.used = used
            self.met += sum(map(len, split))
            self.missed += len(new)
            if self.met > CACHE_CHUNKS and self.missed > self.met / 5:
                self.reset()
        self.row.new = []
        return out


class Rows(dict):
    """Row numbers of chunks; a chunk not met before gets the next and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


def canonical(text: str) -> str:
    """The text in the tokenizer's normal form, so that fewer chunks differ, or as it is where
    that form isn't stable (a letter and mark that compose in lower case only)."""
    if text.isascii():
        return text.lower()
    normal = lower(unicodedata.normalize("NFC", text))
    return normal if unicodedata.is_normalized("NFC", normal) else text


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def local_or_remote(uri: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return None, unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes one shard; the file appears under its name only when it is whole, and writing
    a shard again gives the same bytes, so that tasks may be repeated."""

    def __init__(self, folder: str, name: str, wide: bool, length: int, batch: int):
        self.fs, self.folder = local_or_remote(folder)
        self.final, self.temporary = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.kind = pa.uint32() if wide else pa.uint16()
        self.dtype = np.uint32 if wide else np.uint16
        self.length, self.per_batch = length, length * batch
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        if self.fs is None:
            os.makedirs(self.folder, exist_ok=True)
            self.sink = pa.OSFile(self.temporary, "wb")
        else:
            self.fs.create_dir(self.folder, recursive=True)
            self.sink = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.parts.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= self.per_batch:
            flat = np.concatenate(self.parts)
            whole = len(flat) // self.per_batch * self.per_batch
            for at in range(0, whole, self.per_batch):
                self.flush(flat[at : at + self.per_batch], self.per_batch)
            self.parts, self.waiting = [flat[whole:]], len(flat) - whole

    def flush(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, type=t), self.length) for x, t in ((flat, self.kind), (mask, pa.bool_()))]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.parts)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=self.dtype)
            padded[: len(flat)] = flat
            self.flush(padded, len(flat))
        self.writer.close()
        self.sink.close()
        if self.fs is None:
            os.replace(self.temporary, self.final)
        else:
            self.fs.move(self.temporary, self.final)


class SequenceReader:
    """Random access to a shard's sequences; in a local or mounted folder without copying."""

    def __init__(self, folder: str, name: str):
        fs, path = local_or_remote(folder)
        source = pa.memory_map(f"{path}/{name}") if fs is None else fs.open_input_file(f"{path}/{name}")
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if not n else (n - 1) * self.batch_rows + self.file.get_batch(n - 1).num_rows

    def flat(self, batch: int, column: str = "ids") -> pa.Array:
        c = self.file.get_batch(batch).column(column)
        return c.values.slice(c.offset * self.length, len(c) * self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence ``i``."""
        b, at = i // self.batch_rows, i % self.batch_rows * self.length
        return self.flat(b).to_numpy(zero_copy_only=True)[at : at + self.length], self.flat(b, "mask").slice(at, self.length)

    def tokens(self, offset: int, n: int) -> np.ndarray:
        """``n`` ids from the shard's id ``offset`` on."""
        size, parts = self.batch_rows * self.length, []
        while n > 0:
            got = self.flat(offset // size).to_numpy(zero_copy_only=True)[offset % size :][:n]
            parts.append(got)
            offset, n = offset + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def shard_name(shard: int) -> str:
    return f"tokens-{shard:05d}.arrow"


def shard_column(docs: DataFrame, docs_per_shard: int = DOCS_PER_SHARD):
    """A column with the number of a document's range, and how many ranges there are (at
    most ``MAX_SHARDS``). Null ids come first."""
    n = docs.count()
    shards = max(1, min(MAX_SHARDS, -(-n // docs_per_shard)))
    cuts: list[int] = []
    if shards > 1:
        steps = [i / shards for i in range(1, shards)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", steps, 10 * shards).alias("c")).first()["c"] or []))
    if not cuts:
        return F.lit(0), 1
    # A binary search over literal cuts, as a balanced tree of comparisons.
    edges = F.array(*[F.lit(c) for c in cuts]) if len(cuts) <= 64 else None
    if edges is not None:
        return F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))), len(cuts) + 1

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts)), len(cuts) + 1


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, length: int = SEQUENCE_LENGTH, batch: int = BATCH_SEQUENCES, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) into shard files under ``folder``.

    Returns, not yet run, one row per document: ``doc_id``, ``shard``, ``offset`` (the ids
    before it in its shard) and ``n_tokens``; running it writes the files. Documents are in
    ascending order of (doc_id, text), null ids first; a null or empty text has the end id
    alone; repeated rows are written each; an empty table writes no file. Other columns are
    not read.
    """
    rows = docs.select("doc_id", "text")
    shard, shards = shard_column(rows, docs_per_shard)
    rows = rows.withColumn("shard", shard.cast("int"))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(path)
        writer = at = None
        for rows in batches:
            for lo in range(0, len(rows), 512):
                part = rows.iloc[lo : lo + 512]
                ids = code.encode([t if isinstance(t, str) else None for t in part["text"]])
                offsets, counts = [], []
                for s, own in zip(part["shard"], ids, strict=True):
                    if s != at:
                        if writer:
                            writer.close()
                        writer, at = SequenceWriter(folder, shard_name(s), code.size > 65536, length, batch), s
                    offsets.append(writer.total)
                    counts.append(len(own) + 1)
                    writer.add(np.append(own, np.uint32(end_id)))
                yield pd.DataFrame({"doc_id": part["doc_id"], "shard": part["shard"], "offset": offsets, "n_tokens": counts})
        if writer:
            writer.close()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.mapInPandas(run, f"doc_id {kind}, shard int, offset long, n_tokens long")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """Per document of ``index``, from the files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit integers)."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    # One row a shard, at most MAX_SHARDS rows: small enough for one task and to broadcast.
    before = totals.sort("shard").select("shard", "ids").collect()
    starts, total = [], 0
    for r in before:
        starts.append((r["shard"], total))
        total += r["ids"]
    spark = index.sparkSession
    starts_df = spark.createDataFrame(starts, "shard int, shard_start long")
    shards = max([s for s, _ in starts], default=0) + 1
    rows = index.join(F.broadcast(starts_df), "shard").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = at = None
        for part in batches:
            crcs = []
            for s, offset, n in zip(part["shard"], part["offset"], part["n_tokens"], strict=True):
                if s != at:
                    reader, at = SequenceReader(folder, shard_name(s)), s
                crcs.append(zlib.crc32(reader.tokens(offset, n).astype("<u4").tobytes()))
            yield pd.DataFrame({"doc_id": part["doc_id"], "start": part["shard_start"] + part["offset"], "n_tokens": part["n_tokens"], "ids_crc32": np.asarray(crcs, dtype=np.int64)})

    kind = index.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files and their index to the shared folder and reads them back. Both stay
    there, as the result reads them when it runs."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("files")
    index = scratch.keep(write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary_path()), "index")
    return read_token_files(index, folder)
