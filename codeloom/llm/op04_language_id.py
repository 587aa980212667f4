"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of one to three letters, words padded by one
separator. A text gets the language whose profile has the least out-of-place distance: the
sum, over the text's own most frequent n-grams, of how far each is from its rank in the
profile, or a fixed most for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import give_back, read_table

PROFILE_GRAMS = 400
#: About how many labelled texts of each language the profiles are learned from, at most.
TRAIN_TEXTS = 1500
UNKNOWN = "und"
_OTHER = 1023
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Codes of all n-grams of a text whose separators are 0, ``bits`` bits a symbol; the
    number of symbols is in the two bits above."""
    kind = np.uint32 if bits <= 10 else np.uint64
    shift = kind(bits)
    keep = symbols != 0
    before = np.concatenate(([False], keep[:-1]))
    c = np.concatenate((np.zeros(1, dtype=kind), symbols[keep | before].astype(kind), np.zeros(1, dtype=kind)))
    if len(c) > 3 and c[-2] == 0:
        c = c[:-1]
    pair = c[:-1] << shift | c[1:]
    triple = (pair[:-1] << shift | c[2:])[c[1:-1] != 0]
    top = kind(3 * bits if bits <= 10 else 62)
    one = c[c != 0]
    if bits <= 10:
        return np.concatenate((one, pair | kind(1) << top, triple | kind(2) << top)) if len(one) else one
    return np.concatenate((one, pair | kind(1) << kind(2 * bits), triple | kind(1) << kind(3 * bits))) if len(one) else one


#: 20 bits hold all letters of the planes 0 to 15; planes above have none.
_RAW_BITS = 20


def raw_grams(text: str) -> np.ndarray:
    points = code_points(text)
    return grams(np.where(letters()[points], points & np.uint32(0xFFFFF), 0), _RAW_BITS)


def raw_parts(code: int) -> list[int]:
    n = 3 if code >> 60 else 2 if code >> 40 else 1
    return [code >> _RAW_BITS * (n - 1 - i) & 0xFFFFF for i in range(n)]


class Profiles:
    """Languages and, for each n-gram of any profile, its rank in each of them."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.languages, self.size = sorted(ranked), size
        seen = {c for codes in ranked.values() for code in codes for c in raw_parts(code) if c}
        self.alphabet = {c: i for i, c in enumerate(sorted(seen)[: _OTHER - 1], 1)}
        self.table: np.ndarray | None = None
        ranks: dict[int, np.ndarray] = {}
        for k, lang in enumerate(self.languages):
            for r, code in enumerate(ranked[lang]):
                parts = [self.alphabet.get(c, _OTHER) if c else 0 for c in raw_parts(code)]
                small = sum(p << 10 * (len(parts) - 1 - i) for i, p in enumerate(parts)) | (len(parts) - 1) << 30
                ranks.setdefault(small, np.full(len(self.languages), -1, dtype=np.int64))
                if ranks[small][k] < 0:
                    ranks[small][k] = r
        self.codes = np.array(sorted(ranks), dtype=np.uint32)
        self.ranks = np.array([ranks[c] for c in sorted(ranks)]).reshape(len(ranks), len(self.languages))

    def symbols(self, text: str) -> np.ndarray:
        if self.table is None:
            self.table = np.where(letters(), _OTHER, 0).astype(np.uint16)
            self.table[list(self.alphabet)] = list(self.alphabet.values())
        return self.table[code_points(text)]

    def predict(self, text: str | None) -> tuple[str, float]:
        symbols = self.symbols(text or "")
        if not self.languages or not symbols.any():
            return UNKNOWN, 0.0
        codes, counts = np.unique(grams(symbols, 10), return_counts=True)
        own = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1)
        off = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        distance = off.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(own)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE_GRAMS, texts: int = TRAIN_TEXTS) -> Profiles:
    """Profiles from ``text`` and ``lang`` of ``docs``; rows without either teach nothing.

    Of a language with more than ``texts`` rows, a pseudo-random share by doc_id of about
    that many rows is read.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    shares = {r["lang"]: min(1.0, texts / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Profiles({}, size)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in shares.items()])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                codes, n = np.unique(np.concatenate([raw_grams(t) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    counts = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    found = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["r"])):
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, size)


def language(profiles: Profiles, text: str = "text") -> Column:
    """A struct of ``lang`` and ``score`` for each text; ``und`` and 0 where it is null or
    has no letter, or where no language was learned."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang", "score"])
        give_back()

    # Else a filter on the result would have the texts sent to Python twice.
    return predict.asNondeterministic()(F.col(text))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from the rows that are not held out; a row without doc_id is neither held
    out nor learned from. Repeated rows are predicted each; other columns are not read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    out = docs.select("doc_id", held_out().alias("held_out"), language(profiles).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
