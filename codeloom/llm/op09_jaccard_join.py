"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Shingles are in one global order, rare first by their exact number of documents. If two
sets link, their l-prefixes (the first n - ceil(t n) + l shingles) share at least l shingles,
for every l. Each document takes the l that its estimated candidate cost makes cheapest,
and a pair is verified only if it shares as many prefix shingles as the smaller of its two l.

Texts are read once. Each task turns its documents into batches; the distinct shingles of a
batch go, packed by hash range, to the tasks that count them, and those that a second
document has come back to the batch. Shingles of one document only take part in a set's size
and in positions, but not in any intersection, so what came back is enough for the
prefixes and for exact verification.

Documents with equal sets are one node. The result needs the components of the link graph,
not its edges, so each prefix bucket first has one pivot, the node with the fewest rarer
shingles, verified against the rest, which joins groups of copies by stars. Buckets within one
component need no further comparison. What remains is joined pairwise across components,
and the nodes of a bucket's main component are never joined with each other. No link that
could join two components is lost.

Shingles are 56-bit hashes. Two different shingles of one pair of documents are taken as
equal with a probability of about n^2 / 2^56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, components, read_table, release, tidy

MOST_MATCHES = 4
PARITY = tuple(f"b{i}" for i in range(8))
#: After a round of pivots there is another as long as the pairs that are left are over so many times
#: the prefix entries, but no more rounds than that.
PAIRS_PER_ENTRY = 64
PIVOT_ROUNDS = 6
CACHE_WORDS = 400_000
#: A task that has sets of documents writes so many at least, where there are as many.
DOCS_IN_TASK = 5000
#: Bounds of a batch, whose documents have 16-bit numbers.
BATCH_TOKENS = 1_000_000
BATCH_DOCS = 60_000
ROWS_AT_ONCE = 512
#: A shingle that so many documents of a batch have is counted without naming them.
COMMON = 8
#: A hash range holds the shingles of about so many bytes of text; a task has one range, or more
#: in turn where there would be over ``MOST_TASKS`` tasks.
RANGE_BYTES = 8 << 20
LEAST_TASKS, MOST_TASKS = 32, 1 << 15
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles of ``width`` words. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased, which is how bytes are split and lower-cased; a text with fewer words is one
    shingle of all of them; without words the set is empty."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > CACHE_WORDS:
            known.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                out.append(h)
            return out

    def set(self, text: str | None) -> np.ndarray:
        """Distinct hashes in ascending order."""
        hashes = self.words(text) if text else []
        if not hashes:
            return np.zeros(0, dtype=np.uint64)
        words = np.array(hashes, dtype=np.uint64)
        n = min(self.width, len(words))
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = mix((out + words[i : i + len(out)]) * _P1)
        return np.unique(out >> np.uint64(8))


def ceil_share(n, num: int, den: int):
    return -(-num * n // den)


def key_of(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(tokens.sum(dtype=np.uint64).view(np.int64)), int((mix(tokens) * _P1).sum(dtype=np.uint64).view(np.int64))


def planes(tokens: np.ndarray) -> bytes:
    """Hashes byte plane by byte plane: those of a sorted range have leading planes that compress."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes()


def tokens_of(planes: bytes) -> np.ndarray:
    out = np.zeros((len(planes) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(planes, dtype=np.uint8).reshape(7, -1).T
    return out.view(np.uint64).ravel()


def range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def slots(counts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Which elements of lists of ``counts`` elements, one behind another, are in lists to keep."""
    return np.repeat(keep, counts)


def level_of(documents: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of documents: exact up to 64, then its logarithm."""
    logs = 64 + 6 * np.log2(np.maximum(documents, 64) / 64)
    return np.minimum(255, np.where(documents <= 64, documents, logs)).astype(np.uint8)


def documents_of(levels: np.ndarray) -> np.ndarray:
    """About how many documents a level stands for."""
    levels = levels.astype(np.float64)
    return np.where(levels <= 64, levels, 64 * 2 ** ((levels - 64) / 6))


def parity(tokens: np.ndarray) -> np.ndarray:
    """512 bits: whether each of as many buckets holds an odd number of a set's hashes."""
    counts = np.bincount((tokens >> np.uint64(40) & np.uint64(511)).astype(np.int64), minlength=512)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


class Batches:
    """Cuts documents into batches and packs each as rows (``range``, ``batch``, ``tokens``, ``counts``,
    ``owners``): one a hash range, and with range -1 what the batch itself needs of its documents."""

    def __init__(self, width: int, ranges: int, partition: int):
        self.shingler, self.ranges, self.next = Shingler(width), ranges, partition << 32
        self.ids: list[int | None] = []
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = self.shingler.set(text)
        self.ids.append(doc_id)
        self.sets.append(own)
        self.size += len(own)

    def full(self) -> bool:
        return self.size >= BATCH_TOKENS or len(self.ids) >= BATCH_DOCS

    def rows(self) -> pa.RecordBatch:
        ids, sets = self.ids, self.sets
        n = np.array([len(x) for x in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(first, len(tokens)))
        distinct, common = tokens[first], counts >= COMMON
        about = {"id": np.array([x or 0 for x in ids], dtype=np.int64), "null": np.array([x is None for x in ids]), "n": n}
        keys = np.array([key_of(x) for x in sets], dtype=np.int64).reshape(-1, 2)
        bits = np.array([parity(x) for x in sets], dtype=np.int64).reshape(-1, len(PARITY))
        payload = b"".join(np.ascontiguousarray(x).tobytes() for x in (about["id"], about["null"], n, keys, bits))
        out = [(-1, self.next, planes(distinct[common]), counts[common].astype("<u4").tobytes(), owners[slots(counts, common)].tobytes(), payload)]
        named = np.where(common, 0, counts)
        ends = np.cumsum(named)
        few = owners[slots(counts, ~common)]
        at = range_of(distinct, self.ranges)
        cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = few[ends[lo] - named[lo] : ends[hi - 1]]
            out.append((int(at[lo]), self.next, planes(distinct[lo:hi]), counts[lo:hi].astype("<u4").tobytes(), part.tobytes(), None))
        self.next, self.ids, self.sets, self.size = self.next + 1, [], [], 0
        return records(out, PACKED_FIELDS)


PACKED_FIELDS = pa.schema([("range", pa.int64()), ("batch", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary()), ("about", pa.binary())])
COUNTED_FIELDS = pa.schema([("batch", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary()), ("levels", pa.binary()), ("about", pa.binary())])
PACKED = "range long, batch long, tokens binary, counts binary, owners binary, about binary"
COUNTED = "batch long, tokens binary, counts binary, owners binary, levels binary, about binary"


def records(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def counted(rows: list[tuple]) -> pa.RecordBatch:
    """The rows of one hash range, with only those shingles that two documents have, and their levels."""
    tokens = [tokens_of(r[2]) for r in rows]
    counts = [np.frombuffer(r[3], dtype="<u4").astype(np.int64) for r in rows]
    _, of = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate(counts))[of]
    out, at = [], 0
    for row, t, c in zip(rows, tokens, counts, strict=True):
        documents = total[at : at + len(t)]
        at += len(t)
        keep = documents > 1
        named = np.where(c >= COMMON, 0, c)
        owners = np.frombuffer(row[4], dtype=np.uint16)[slots(named, keep)]
        if keep.any():
            out.append((row[1], planes(t[keep]), named[keep].astype(np.uint8).tobytes(), owners.tobytes(), level_of(documents[keep]).tobytes(), None))
    return records(out, COUNTED_FIELDS)


def count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts each hash range of a partition that is sorted by range; what is for the batch itself passes."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(c)[i].as_py() for c in range(batch.num_columns))
            if row[0] < 0:
                yield records([(*row[1:5], None, row[5])], COUNTED_FIELDS)
                continue
            if held and held[0][0] != row[0]:
                yield counted(held)
                held = []
            held.append(row)
    if held:
        yield counted(held)


def plan_prefix(n: int, documents: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """How many of a set's shared shingles are in its prefix, and the prefix's number of matches l.

    ``documents`` has how many documents share each of those shingles of the set of size ``n``
    that any other document has, in the global order; the rest come before them. A prefix
    of l matches reads as many bucket entries as its shingles have sharers; at most an l-th
    part of them are candidates, each of which costs a comparison of whole sets.
    """
    base = n - ceil_share(n, num, den)
    matches = np.arange(1, min(MOST_MATCHES, n - base) + 1)
    ends = np.clip(base + matches - (n - len(documents)), 0, None)
    read = np.concatenate([[0], np.cumsum(documents - 1)])[ends]
    best = int(np.argmin(read + (8 + n / 8) * read / matches))
    return int(ends[best]), best + 1


SETS = "doc_id long, n int, k1 long, k2 long, matches byte, shared array<long>, prefix array<long>, pos array<int>, " + ", ".join(f"{c} long" for c in PARITY)


def assembled(rows: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """One row per document of a batch. ``shared`` has, in ascending order, the shingles that any
    other document has; ``prefix`` those of them in the prefix, and ``pos`` their places
    in the global order. The three are null if the prefix has none."""
    own = rows[rows["about"].notna()].iloc[0]
    each = 8 * (1 + 1 + 2 + len(PARITY)) + 1
    size = len(own["about"]) // each
    cuts = np.cumsum([0, 8 * size, size, 8 * size, 16 * size, 8 * len(PARITY) * size])
    ids, null, n, keys, bits = (np.frombuffer(own["about"][a:b], dtype=t) for a, b, t in zip(cuts[:-1], cuts[1:], (np.int64, bool, np.int64, np.int64, np.int64), strict=True))
    tokens, levels, owners = [], [], []
    common = tokens_of(own["tokens"])
    common_counts = np.frombuffer(own["counts"], dtype="<u4").astype(np.int64)
    common_levels = np.zeros(len(common), dtype=np.uint8)
    for r in rows[rows["about"].isna()].itertuples(index=False):
        t, c, v = tokens_of(r.tokens), np.frombuffer(r.counts, dtype=np.uint8), np.frombuffer(r.levels, dtype=np.uint8)
        common_levels[np.searchsorted(common, t[c == 0])] = v[c == 0]
        tokens.append(np.repeat(t, c))
        levels.append(np.repeat(v, c))
        owners.append(np.frombuffer(r.owners, dtype=np.uint16))
    token = np.concatenate([*tokens, np.repeat(common, common_counts)])
    level = np.concatenate([*levels, np.repeat(common_levels, common_counts)])
    owner = np.concatenate([*owners, np.frombuffer(own["owners"], dtype=np.uint16)])
    order = np.lexsort((token, level, owner))
    token, documents = token[order], documents_of(level[order])
    ends = np.cumsum(np.bincount(owner, minlength=size))
    out = {c: [None] * size for c in ("shared", "prefix", "pos")}
    matches, live = np.zeros(size, dtype=np.int8), np.zeros(size, dtype=bool)
    base = n - ceil_share(n, num, den)
    held = np.diff(ends, prepend=0)
    for i in np.flatnonzero((n > 0) & (base + 1 > n - held)).tolist():
        mine = slice(ends[i] - held[i], ends[i])
        k, matches[i] = plan_prefix(int(n[i]), documents[mine], num, den)
        own_tokens = token[mine].view(np.int64)
        out["shared"][i] = np.sort(own_tokens)
        out["prefix"][i] = own_tokens[:k]
        out["pos"][i] = np.arange(k, dtype=np.int32) + np.int32(n[i] - held[i])
        live[i] = True
    keys, bits = keys.reshape(-1, 2), np.where(live[:, None], bits.reshape(-1, len(PARITY)), 0)
    found = {"doc_id": pd.array(np.where(null, 0, ids), dtype="Int64"), "n": n.astype(np.int32), "k1": keys[:, 0], "k2": keys[:, 1], "matches": matches} | out
    found["doc_id"][null] = pd.NA
    return pd.DataFrame(found | {c: bits[:, i] for i, c in enumerate(PARITY)})


def shingle_sets(docs: DataFrame, text_bytes: int, width: int, num: int, den: int) -> DataFrame:
    """A row of ``SETS`` per row of ``docs`` (``doc_id``, ``text``) with so many bytes of text."""
    ranges = max(LEAST_TASKS, text_bytes // RANGE_BYTES)
    tasks = min(MOST_TASKS, ranges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                for doc_id, text, partition in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    held = held or Batches(width, ranges, partition)
                    held.add(doc_id, text)
                    if held.full():
                        yield held.rows()
        if held and held.ids:
            yield held.rows()

    read = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("at"))
    packed = read.mapInArrow(tidy(pack), PACKED)
    to = F.when(F.col("range") < 0, F.pmod("batch", F.lit(tasks))).otherwise(F.pmod("range", F.lit(tasks))).cast("int")
    dealt = packed.repartitionById(tasks, to).sortWithinPartitions("range")
    return dealt.mapInArrow(tidy(count_ranges), COUNTED).groupBy("batch").applyInPandas(lambda rows: assembled(rows, num, den), SETS)


def fits(a: str, b: str, num: int, den: int):
    """Whether sizes, the positions of one shared prefix shingle and the parity bits, which
    differ in no more places than the sets in elements, allow a link."""
    na, nb, pa, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    size = F.least(na, nb) * den >= F.greatest(na, nb) * num
    most = F.least(pa, pb) + 1 + F.least(na - pa - 1, nb - pb - 1)
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in PARITY), F.lit(0))
    return size & (most * (num + den) >= (na + nb) * num) & (apart * (num + den) <= (na + nb) * (den - num))


def verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets link: den * intersection >= num * union."""
    x, y = (nodes.select(F.col("node").alias(v), F.struct("n", "shared").alias(s)) for v, s in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").withColumn("same", F.size(F.array_intersect("x.shared", "y.shared")))
    return both.where(den * F.col("same") >= num * (F.col("x.n") + F.col("y.n") - F.col("same"))).select("a", "b")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, pairs_per_entry: int = PAIRS_PER_ENTRY) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest doc_id reachable over links, itself included.

    Two documents link when their sets' intersection is at least num/den of their union.
    Null, empty and blank texts have an empty set and link with nothing. Rows that share a doc_id
    are documents of their own, each with its own text's size and class. Rows without doc_id
    link with nothing and have a null component. Repeated rows are returned as often as they come,
    an empty table gives an empty one, and texts of any length are one set each. Only the two
    columns are read, so others may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    base = scratch.keep(shingle_sets(docs, size["bytes"], width, num, den), "base", size["rows"], DOCS_IN_TASK)
    release(spark)
    side = ("node", "component", "n", "pos", *PARITY)

    # Equal sets have equal columns, so any row's do.
    wanted = ("n", "matches", "shared", "prefix", "pos", *PARITY)
    live = base.where("shared is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in wanted])
    nodes = scratch.keep(live.withColumn("node", F.monotonically_increasing_id()), "nodes", size["rows"], DOCS_IN_TASK)
    n = nodes.count()

    def entries(joined: DataFrame | None) -> DataFrame:
        about = nodes.select("node", "n", "matches", "prefix", F.col("pos").alias("places"), *PARITY)
        if joined is None:
            about = about.withColumn("component", F.col("node"))
        else:
            about = about.join(joined.select(F.col("id").alias("node"), "component_id"), "node", "left").withColumn("component", F.coalesce("component_id", "node"))
        zipped = about.withColumn("at", F.explode(F.arrays_zip("prefix", "places")))
        return zipped.select(F.col("at.prefix").alias("token"), "node", "component", "n", F.col("at.places").alias("pos"), "matches", *PARITY)

    found = entries(None)
    links = joined = tried = None
    for turn in range(PIVOT_ROUNDS):
        # A bucket's pivot has the fewest rarer shingles, and isn't of the component that is most of the bucket.
        about = F.struct(F.col("pos").alias("first"), F.xxhash64("node").alias("h"), *side)
        if turn:
            about = F.when(~F.col("inner"), about)
        pivots = found.groupBy("token").agg(F.count("*").alias("size"), F.min(about).alias("p")).where("size > 1 and p is not null").select("token", F.col("p").alias("y"))
        pairs = found.select("token", F.struct(*side).alias("x")).join(pivots, "token").where("x.component <> y.component").where(fits("x", "y", num, den))
        pairs = scratch.keep(pairs.select(*ordered("x.node", "y.node")).distinct(), f"pairs{turn}", n)
        new = scratch.keep(verified(pairs, nodes, num, den), f"links{turn}", n)
        links = new if links is None else links.unionByName(new)
        tried = pairs if tried is None else tried.unionByName(pairs)
        joined = components(links)
        found = entries(joined)
        mixed = main_components(found).where("size > most")
        found = scratch.keep(found.join(mixed, "token").withColumn("inner", F.col("component") == F.col("main")), f"mixed{turn}", n, DOCS_IN_TASK)
        left = found.agg(F.count("*").alias("n"), F.sum(F.when(~F.col("inner"), F.col("size"))).alias("cost")).first()
        if (left["cost"] or 0) <= pairs_per_entry * left["n"] or new.isEmpty():
            break

    x = found.where("not inner").select("token", F.struct(*side, "matches").alias("x"))
    y = found.select("token", F.struct(*side, "matches").alias("y"), F.col("inner").alias("y_inner"))
    pairs = x.join(y, "token").where("(y_inner or x.node < y.node) and x.component <> y.component").where(fits("x", "y", num, den))
    ends = pairs.select(*ordered("x.node", "y.node"), F.least("x.matches", "y.matches").alias("m"))
    counted = ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("m").alias("least")).where("n >= least").select("a", "b")
    pairs = scratch.keep(counted.join(tried, ["a", "b"], "left_anti"), "pairs", n)
    links = links.unionByName(scratch.keep(verified(pairs, nodes, num, den), "links", n))

    ids = nodes.select("node", "rep", "k1", "k2").join(components(links).withColumnRenamed("id", "node"), "node", "left")
    ids = ids.withColumn("component", F.coalesce("component_id", "node")).drop("component_id")
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = scratch.keep(ids.join(least, "component").select("k1", "k2", "component_id"), "labelled", n)
    scratch.drop("nodes", "pairs", "links", *[f"{t}{k}" for k in range(turn + 1) for t in ("pairs", "links", "mixed")])
    # Only these rows can have a link, so only they meet others of the same set.
    alike = base.where("shared is not null").select("doc_id", "n", "k1", "k2").join(labelled, ["k1", "k2"], "left").select("doc_id", "n", "component_id")
    alone = base.where("shared is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return alike.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), out.alias("component_id"))


def main_components(entries: DataFrame) -> DataFrame:
    """For each bucket its ``size``, its most frequent component ``main`` and how often (``most``)."""
    counts = entries.groupBy("token", "component").agg(F.count("*").alias("c"))
    out = counts.groupBy("token").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("m"))
    return out.select("token", "size", F.col("m.component").alias("main"), F.col("m.c").alias("most"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


ORACLES = {
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
g AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(reach.c) AS component_id FROM n JOIN reach ON reach.id = n.doc_id GROUP BY 1
"""
}
