"""BPE encoding and decoding with a priority queue over a linked symbol list.

The vocabulary file is that of a public tokenizer and is a parameter. Each distinct word
is merged once for each Python worker; texts then map words to the ids found.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import free_when_idle, in_use, read_table

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64
BATCH_ROWS = 256
#: str.split also takes four control characters as white space, which the pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]").search
SEPARATORS = regex.compile(r"\S+").findall


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_symbols(symbols: list[int], merges: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges to symbol ids, lowest rank first and leftmost first within a rank.

    ``merges`` has the rank of a pair by ``left << 32 | right``, ``merged`` the symbol that a
    rank makes. Symbols form a doubly linked list; the priority queue holds rank and
    position of mergeable pairs as one integer. As a rank stands for one pair only, an entry
    is stale, and skipped, if the pair now at its position has another rank or none.
    """
    n = len(symbols)
    text = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of = merges.get
    heap = []
    for i in range(n - 1):
        rank = rank_of(text[i] << 32 | text[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or text[i] < 0 or rank_of(text[i] << 32 | text[j]) != rank:
            continue
        text[i] = made = merged[rank]
        text[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := rank_of(made << 32 | text[k])) is not None:
                heapq.heappush(heap, rank << 32 | i)
        if (h := before[i]) >= 0 and (rank := rank_of(text[h] << 32 | made)) is not None:
            heapq.heappush(heap, rank << 32 | h)
    return [t for t in text if t >= 0]


class Bpe:
    """A byte-level BPE with word ends, read from a tokenizer file (normaliser NFC, white
    space to a space, lower case; words by the file's own pattern)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.words_of = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {self.ids[a] << 32 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.words_of |= {i: t for t, i in self.added.items()}
        self.table = [self.words_of.get(i, "") for i in range(max(self.words_of) + 1)]
        self.decimal = [str(i) for i in range(len(self.table))]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        symbols = byte_symbols()
        self.inner = [self.ids[c] for c in symbols]
        self.last = [self.ids[c + self.suffix] for c in symbols]
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return tuple(merge_symbols(symbols, self.merges, self.merged))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without white space and added tokens. No word of the pattern and
        no composition crosses white space, so chunks are encoded one by one."""
        text = chunk.lower() if chunk.isascii() else lower(unicodedata.normalize("NFC", chunk))
        out: list[int] = []
        for w in self.find(text):
            ids = self.words.get(w)
            if ids is None:
                ids = self.word(w)
                remember(self.words, w, ids)
            out += ids
        ids = tuple(out)
        remember(self.chunks, chunk, ids)
        return ids

    def pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        """Added tokens as (id, ""), and the texts between them as (None, text)."""
        at = 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            yield None, text[at : m.start()]
            yield self.added[m.group()], ""
            at = m.end()
        yield None, text[at:] if at else text

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cached = self.chunks.get
        for special, piece in self.pieces(text or ""):
            if special is not None:
                out.append(special)
            for c in SEPARATORS(piece) if ODD_SPACE(piece) else piece.split():
                ids = cached(c)
                out += self.chunk(c) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined; as the file names no decoder, by a space, and
        word ends stay as they are. Ids beyond the vocabulary are left out."""
        try:
            return " ".join([self.table[i] for i in ids])
        except IndexError:
            return " ".join([self.table[i] for i in ids if i in self.words_of])

    def digits(self, ids: list[int]) -> str:
        return " ".join([self.decimal[i] for i in ids])


def remember(cache: dict[str, tuple[int, ...]], key: str, ids: tuple[int, ...]) -> None:
    if len(key) <= CACHE_WORD_CHARS:
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        cache[key] = ids


def lower(text: str) -> str:
    """Lower case of each character by itself, as the tokenizer has it (no final sigma)."""
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def forget() -> None:
    _LOADED.clear()


def encode_documents(docs: DataFrame, path: str, digest_only: bool = True, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Encode and decode every text.

    Returns the columns ``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` and,
    unless ``digest_only``, ``ids`` and ``decoded``. A null or empty text has no ids and
    decodes to the empty string. Repeated rows each get their own result. Other columns
    of the input are not read, so their names can't clash.
    """
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    fields += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    if not digest_only:
        fields += ["ids array<int>", "decoded string"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_use(path)
        bpe = load(path)
        try:
            for batch in batches:
                for lo in range(0, len(batch), BATCH_ROWS):
                    part = batch.iloc[lo : lo + BATCH_ROWS]
                    n, own, back, ids_out, texts = [], [], [], [], []
                    for t in part["__text"]:
                        ids = bpe.encode(t)
                        decoded = bpe.decode(ids)
                        n.append(len(ids))
                        own.append(hashlib.sha256(bpe.digits(ids).encode()).hexdigest())
                        back.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                        if not digest_only:
                            ids_out.append(ids)
                            texts.append(decoded)
                    out = part.drop(columns="__text").assign(n_tokens=n, ids_sha256=own, decoded_sha256=back)
                    yield out if digest_only else out.assign(ids=ids_out, decoded=texts)
        finally:
            free_when_idle(path, forget)

    return source.mapInPandas(run, ", ".join(fields))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), vocabulary_path())
