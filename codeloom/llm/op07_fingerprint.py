"""Document fingerprints from improbable features in chained Bloom filters.

Features are windows of 64 bytes. Their rarity is how far their byte entropy lies from that of
common text. Of each 64 features in a row the rarest (the first of equals) gets a point, and
features with at least 8 points are selected. Selected features enter Bloom filters of 2,048
bits with five bits each, 160 features a filter. Two fingerprints are compared filter by
filter by their common bits, between what chance and what containment would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import read_table
from codeloom.llm.op01_token_files import shard_column

WINDOW = 64
POINTS = 8
FILTER_BITS = 2048
HASHES = 5
FILTER_FEATURES = 160
#: Entropy of common text, in thousandths of the most a window can have (six bits).
COMMON_ENTROPY = 620
CUTOFF = 0.1
SEGMENT = 1 << 20
_MARGIN = 4 * WINDOW
_SCALE = 1 << 16
_F = np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 2)])
_STEP = np.diff(np.round(_F * _SCALE).astype(np.int32), append=0).astype(np.int32)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, in thousandths, of the 64 bytes from each position on that has as many."""
    n = len(data)
    earlier, later = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        for lag in range(1, WINDOW):
            a = max(lo, lag)
            if a < hi:
                same = (data[a:hi] == data[a - lag : hi - lag]).view(np.uint8)
                earlier[a:hi] += same
                later[a - lag : hi - lag] += same
    change = _STEP[earlier]
    change[WINDOW:] -= _STEP[later[: n - WINDOW]]
    total = np.cumsum(change, dtype=np.int32)[WINDOW - 1 :]
    return (1000 - total.astype(np.int64) * 1000 // (6 * WINDOW * _SCALE)).astype(np.int32)


def selected(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions of selected features; ``valid`` has those that lie within one text."""
    n = len(valid)
    rarity = np.abs(entropies(data) - COMMON_ENTROPY) + 1
    at = np.arange(n, dtype=np.int64)
    span = 1 << 32
    key = np.where(valid, rarity.astype(np.int64) * span + (span - 1 - at), -1)
    # The largest key of each 64 in a row, from running maxima of blocks of 64 both ways.
    pad = np.full((WINDOW - 1) * 2 + (-(n + 2 * (WINDOW - 1)) % WINDOW), -1, dtype=np.int64)
    key = np.concatenate((pad[: WINDOW - 1], key, pad[WINDOW - 1 :])).reshape(-1, WINDOW)
    ahead = np.maximum.accumulate(key, axis=1).ravel()
    back = np.maximum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    most = np.maximum(back[: -(WINDOW - 1)], ahead[WINDOW - 1 :])
    won = span - 1 - (most[most >= 0] & (span - 1))
    return np.flatnonzero(np.bincount(won, minlength=n) >= POINTS)


def feature_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = data[at[:, None] + np.arange(WINDOW)].view("<u8").reshape(-1, WINDOW // 8)
    out = np.full(len(at), 0x243F6A8885A308D3, dtype=np.uint64)
    for i in range(WINDOW // 8):
        out = (out ^ words[:, i]) * _P1
        out = (out ^ (out >> np.uint64(29))) * _P2
    return out ^ (out >> np.uint64(32))


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the selected features of each text, in text order. A text under 64 bytes is
    one feature, padded with zero bytes; an empty one has none."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    pieces: list[tuple[int, int, int, bytes]] = []  # text, core's start and end in the piece, piece
    for i, t in enumerate(texts):
        if t:
            t = t.ljust(WINDOW, b"\0")
            for lo in range(0, len(t), SEGMENT):
                a, b = max(0, lo - _MARGIN), min(len(t), lo + SEGMENT + _MARGIN)
                pieces.append((i, lo - a, min(len(t), lo + SEGMENT) - a, t[a:b]))
    lo = 0
    while lo < len(pieces):
        hi, size = lo, 0
        while hi < len(pieces) and (hi == lo or size + len(pieces[hi][3]) <= 2 * SEGMENT):
            size += len(pieces[hi][3])
            hi += 1
        own = pieces[lo:hi]
        data = np.frombuffer(b"".join(p[3] for p in own), dtype=np.uint8)
        lengths = np.array([len(p[3]) for p in own])
        ends = np.cumsum(lengths)
        n = len(data) - WINDOW + 1
        valid = np.ones(n + WINDOW, dtype=bool)
        for e in ends:
            valid[max(0, e - WINDOW + 1) : e] = False
        at = selected(data, valid[:n])
        hashes = feature_hashes(data, at)
        which = np.searchsorted(ends, at, side="right")
        within = at - (ends - lengths)[which]
        begin, end = np.array([p[1] for p in own]), np.array([p[2] for p in own])
        keep = (within >= begin[which]) & (within < end[which])
        hashes, which = hashes[keep], which[keep]
        for k, part in enumerate(np.split(hashes, np.searchsorted(which, np.arange(1, len(own))))):
            i = own[k][0]
            out[i] = np.concatenate((out[i], part)) if len(out[i]) else part
        lo = hi
    return out


class Fingerprint:
    """Filters as rows of bits, and how many features each has. A feature that its filter
    has already is not counted again."""

    def __init__(self, hashes: np.ndarray):
        hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
        n = -(-len(hashes) // FILTER_FEATURES)
        self.bits = np.zeros((n, FILTER_BITS), dtype=bool)
        which = np.arange(len(hashes)) // FILTER_FEATURES
        for k in range(HASHES):
            self.bits[which, (hashes >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        self.counts = np.bincount(which, minlength=n)

    def text(self) -> str:
        return f"{len(self.counts)}:{int(self.counts.sum())}:{base64.b64encode(np.packbits(self.bits, axis=1).tobytes()).decode()}"


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1: the mean over the smaller fingerprint's features of their filter's best
    match in the other. Two empty fingerprints are alike, one empty one is unlike any other."""
    if len(a.counts) == 0 or len(b.counts) == 0:
        return float(len(a.counts) == len(b.counts))
    if (len(a.counts), a.counts.sum()) > (len(b.counts), b.counts.sum()):
        a, b = b, a
    on = b.bits.sum(axis=1).astype(np.float64)
    right = b.bits.astype(np.float32).T
    total = 0.0
    for lo in range(0, len(a.counts), 64):
        left = a.bits[lo : lo + 64]
        own = left.sum(axis=1).astype(np.float64)[:, None]
        common = (left.astype(np.float32) @ right).astype(np.float64)
        least, most = own * on / FILTER_BITS, np.minimum(own, on)
        low = least + CUTOFF * (most - least)
        score = np.clip((common - low) / np.maximum(most - low, 1e-9), 0, 1)
        total += float((score.max(axis=1) * a.counts[lo : lo + 64]).sum())
    return total / float(a.counts.sum())


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    return [Fingerprint(f) for f in features([t.encode("utf-8", "surrogatepass") for t in texts])]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``doc_id``, ``text``, ``part`` and ``tail``, dealt by ranges of doc_id and in
    descending order, each range followed by a copy (``tail``) of the row after its last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part, parts = shard_column(rows)
    rows = rows.withColumn("part", part.cast("int")).withColumn("h", F.xxhash64("text"))
    # One row a range, at most MAX_SHARDS.
    tops = sorted(rows.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect())
    spark = docs.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    after = [(t["part"], t["top"]["doc_id"], t["top"]["h"], tops[(i + 1) % len(tops)]["part"]) for i, t in enumerate(tops)]
    firsts = spark.createDataFrame(after, f"own int, id {kind}, hash long, to int")
    same = (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    tails = rows.join(F.broadcast(firsts), same).select("doc_id", "text", F.col("to").alias("part"), "h", F.lit(True).alias("tail")).dropDuplicates(["part"])
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return dealt.select("doc_id", "text", "part", "tail"), parts


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Documents are in descending order of doc_id, null ids last, rows of one doc_id in an order
    fixed by their texts; after the last comes the first, and one row alone comes after
    itself. A null text counts as empty. Other columns are not read.
    """
    dealt, _ = with_next(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts = [], []
        # ``texts`` has one more than ``ids`` has rows to return.
        size = 0

        def flush() -> pd.DataFrame:
            edits = [edited_text(t, u) for t, u in zip(texts, texts[1:], strict=False)]
            prints = fingerprints(texts + edits)
            own, other = prints[: len(texts)], prints[len(texts) :]
            return pd.DataFrame({
                "doc_id": pd.Series(ids[: len(edits)], dtype=object),
                "n_chars": [len(t) for t in texts[: len(edits)]],
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
                "fingerprint": [p.text() for p in own[: len(edits)]],
                "edited_fingerprint": [p.text() for p in other],
                "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=False)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
            })

        for batch in batches:
            for i, t, tail in zip(batch["doc_id"], batch["text"], batch["tail"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t)
                size += len(t)
                if tail or size > SEGMENT // 2:
                    if len(texts) > 1:
                        yield flush()
                    ids, texts, size = ([], [], 0) if tail else (ids[-1:], texts[-1:], len(t))
        if len(texts) > 1:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInPandas(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
