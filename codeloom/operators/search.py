"""Symbol search: exact names first, else all tokens of the query, ranked by where it
matches and by BM25 over weighted fields."""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import FIELD_WEIGHTS, WORD_EDGE, WORD_GAP, contains, normalize, tokens
from codeloom.operators.edges import adjacent
from codeloom.operators.overview import TEXTUAL

FIELDS = tuple(FIELD_WEIGHTS)
K1, B = 1.2, 0.75


@dataclass
class Index:
    """Postings (``id``, ``lexeme``, ``frequency``), ``lexeme`` with ``df``, and the row of ``corpus_totals``."""

    terms: DataFrame
    lexicon: DataFrame
    corpus: DataFrame


def query_tokens(query: str) -> list[str]:
    """As ``functions.text.tokens``, by the same patterns; without any letter or digit the normal form itself."""
    found = set()
    for run in regex.split(WORD_GAP, query, flags=regex.V1):
        if run:
            found.add(run.lower())
            found.update(p.lower() for p in regex.split(WORD_EDGE, run, flags=regex.V1) if p)
    return sorted(found) or [normal_query(query)]


def normal_query(query: str) -> str:
    return query.strip().replace("\\", "/").lower()


def filtered(symbols: DataFrame, kind: str | None = None, path_contains: str | None = None, include_textual: bool = True) -> DataFrame:
    out = symbols
    if kind and kind.strip():
        out = out.where(F.lower("kind") == kind.lower())
    if path_contains and path_contains.strip():
        out = out.where(contains(F.col("file_path"), path_contains))
    if not include_textual:
        out = out.where(F.col("kind") != TEXTUAL)
    return out


def is_exact(query: str) -> Column:
    q = normal_query(query)
    return (normalize(F.col("name")) == q) | (normalize(F.col("qualified_name")) == q)


def has_token(token: str) -> Column:
    """A token of three characters or more anywhere in a field; one of two at the start of a
    token of a field, or of a whole name; one of one as such a token or name."""
    if len(token) >= 3:
        return F.greatest(*[contains(F.col(f), token) for f in FIELDS])
    fits = (lambda t: t == token) if len(token) == 1 else (lambda t: t.startswith(token))
    names = [fits(normalize(F.col(f))) for f in ("name", "qualified_name")]
    return F.greatest(*names, *[F.exists(tokens(F.col(f)), fits) for f in FIELDS])


def matches(query: str) -> Column:
    out = F.lit(True)
    for t in query_tokens(query):
        out = out & has_token(t)
    return out


def lexical_score(query: str) -> Column:
    q = normal_query(query)
    name, qualified = F.lower("name"), F.lower("qualified_name")
    return (
        F.when((name == q) | (qualified == q), 100.0)
        .when(name.startswith(q), 70.0)
        .when(F.instr(name, q) > 0, 60.0)
        .when(F.instr(qualified, q) > 0, 50.0)
        .when(contains(F.col("signature"), q), 45.0)
        .when(contains(F.col("file_path"), q), 30.0)
        .otherwise(10.0)
    )


def document_length() -> Column:
    """Weighted number of tokens of all fields, null ones left out; one at least."""
    total = sum((F.coalesce(F.size(tokens(F.col(f))), F.lit(0)) * w for f, w in FIELD_WEIGHTS.items()), F.lit(0))
    return F.greatest(F.lit(1), total).cast("long")


def term_frequencies(symbols: DataFrame) -> DataFrame:
    """``id``, ``lexeme`` and its weighted frequency: each field counts a token once."""
    weighted = lambda w: lambda t: F.struct(t.alias("lexeme"), F.lit(w).alias("w"))
    each = [F.transform(tokens(F.col(f)), weighted(w)) for f, w in FIELD_WEIGHTS.items()]
    each = [F.coalesce(a, F.array().cast("array<struct<lexeme:string,w:int>>")) for a in each]
    rows = symbols.select("id", F.explode(F.concat(*each)).alias("t")).select("id", "t.*")
    return rows.groupBy("id", "lexeme").agg(F.sum("w").alias("frequency"))


def lexeme_df(symbols: DataFrame) -> DataFrame:
    return term_frequencies(symbols).groupBy("lexeme").agg(F.count("*").alias("df"))


def corpus_totals(symbols: DataFrame) -> DataFrame:
    """One row: number of symbols and their total length."""
    length = F.col("length") if "length" in symbols.columns else document_length()
    return symbols.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total_length"))


def corpus_stats(totals: DataFrame) -> DataFrame:
    """``corpus_totals`` and the mean length (at least 1)."""
    mean = F.greatest(F.lit(1.0), F.col("total_length") / F.nullif("n", F.lit(0)))
    return totals.select("n", "total_length", F.round(F.coalesce(mean, F.lit(1.0)), 6).alias("average_length"))


def index_of(symbols: DataFrame) -> Index:
    terms = term_frequencies(symbols)
    return Index(terms, lexeme_df(symbols), corpus_totals(symbols))


#: The postings of a token are read first if they are at most so many, or one in ``SHARE`` of all symbols.
FEW, SHARE = 10_000, 20


def held_by(token: str) -> Column:
    """Whether a lexeme has a token as ``has_token`` asks for it. Tokens are letters and digits, so each is
    within one run of a field, and the lower-cased run is a lexeme."""
    lexeme = F.col("lexeme")
    return F.instr(lexeme, token) > 0 if len(token) >= 3 else lexeme.startswith(token) if len(token) == 2 else lexeme == token


def lexicon_counts(index: Index, terms: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """By token of a query: the symbols that have it as a lexeme, and the postings of all lexemes that hold it."""
    own = [F.coalesce(F.sum(F.when(F.col("lexeme") == t, F.col("df"))), F.lit(0)).alias(f"d{i}") for i, t in enumerate(terms)]
    all_of = [F.coalesce(F.sum(F.when(held_by(t), F.col("df"))), F.lit(0)).alias(f"h{i}") for i, t in enumerate(terms)]
    row = index.lexicon.agg(*own, *all_of).first()
    return {t: row[f"d{i}"] for i, t in enumerate(terms)}, {t: row[f"h{i}"] for i, t in enumerate(terms) if regex.fullmatch(r"[\p{L}\p{Nd}]+", t)}


def candidates(rows: DataFrame, index: Index, held: dict[str, int], n: int) -> DataFrame:
    """The rows that can have all tokens, by the postings of the rarest one, or all rows where it isn't rare."""
    if not held:
        return rows
    rarest = min(held, key=held.get)
    if not held[rarest]:
        return rows.limit(0)
    if held[rarest] > max(FEW, n // SHARE):
        return rows
    found = index.terms.join(index.lexicon.where(held_by(rarest)).select("lexeme"), "lexeme", "left_semi")
    return rows.join(found.select("id"), "id", "left_semi")


def scored(symbols: DataFrame, query: str, index: Index | None = None, **filters) -> DataFrame:
    """All hits with ``score``. The corpus of BM25 is all of ``symbols``, whatever the filters. Only the
    postings of the query's tokens are read, and joined to the hits alone. With an ``index``
    symbols have their ``length``; without, both come from the symbols themselves."""
    if not query.strip():
        return symbols.limit(0).withColumn("score", F.lit(0.0))
    rows = filtered(symbols, **filters)
    exact = rows.where(is_exact(query))
    if not exact.isEmpty():
        return exact.withColumn("score", F.lit(100.0))
    terms = query_tokens(query)
    index = index or index_of(symbols)
    totals = index.corpus.first()
    mean = max(1.0, totals["total_length"] / totals["n"]) if totals["n"] else 1.0
    counts, held = lexicon_counts(index, terms)
    hits = candidates(rows, index, held, totals["n"]).where(matches(query))
    if "length" not in hits.columns:
        hits = hits.withColumn("length", document_length())
    each = [F.max(F.when(F.col("lexeme") == t, F.col("frequency"))).alias(f"f{i}") for i, t in enumerate(terms)]
    hits = hits.join(index.terms.where(F.col("lexeme").isin(terms)).groupBy("id").agg(*each), "id", "left")
    bm25 = F.lit(0.0)
    for i, t in enumerate(terms):
        df = counts.get(t, 0)
        f = F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("double")
        idf = F.log(F.lit(1.0 + (totals["n"] - df + 0.5) / (df + 0.5)))
        bm25 = bm25 + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(mean)))).otherwise(0.0)
    return hits.withColumn("score", F.round(lexical_score(query) + 5 * bm25, 6)).select(*symbols.columns, "score")


def search(symbols: DataFrame, query: str, limit: int = 20, index: Index | None = None, **filters) -> DataFrame:
    """The best ``limit`` (1 to 200) hits with ``score`` and ``rank``, in order, and whether there are more."""
    limit = min(max(limit, 1), 200)
    order = [F.desc("score"), F.length("name"), F.col("file_path"), F.col("id")]
    found = scored(symbols, query, index, **filters).orderBy(*order).limit(limit + 1)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = ranked.withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return ranked.where(F.col("rank") <= limit)


def with_edges(hits: DataFrame, relationships: DataFrame, most: int = 24) -> DataFrame:
    """For each hit up to ``most`` edges, outgoing before incoming, each by id."""
    rows = adjacent(relationships, hits.select("id"))
    rank = Window.partitionBy("node").orderBy("dir", "id")
    return rows.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= most)


def trigram_candidates(symbols: DataFrame, part: str) -> DataFrame:
    """Symbols whose fields have all trigrams of a text of three characters or more between
    them: a superset of those that contain it, as an index lookup would give."""
    n = normal_query(part)
    wanted = sorted({n[i : i + 3] for i in range(len(n) - 2)})
    found = F.lit(bool(wanted))
    for t in wanted:
        found = found & F.greatest(*[F.instr(normalize(F.col(f)), t) > 0 for f in FIELDS])
    return symbols.where(found)
