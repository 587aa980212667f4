"""Search and graph queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import edges as e
from codeloom.operators import graph as g
from codeloom.operators import search as s
from codeloom.operators.search import FIELDS, query_tokens
from codeloom.plans.catalog_scan import _RES, EDGE
from codeloom.plans.sqltext import tokens_sql, with_views
from codeloom.sources import views
from codeloom.streaming import debounce

ROOT, HOT = "nat:000", "prt:000000042"
_NODE = ("id", "name", "qualified_name", "kind", "file_path", "start_line")


def _search(spark, d, query: str, limit: int = 50, **filters) -> DataFrame:
    pack = views.pack(spark, d)
    return s.search(pack.table("symbols"), query, limit, pack.index(), **filters)


def _hits(query: str, limit: int = 50, **filters):
    return lambda spark, d: _search(spark, d, query, limit, **filters).select("id", "name", "kind", "file_path", "score", "rank", "truncated")


def _walked(find, spark, d, root: str, *args, **how) -> g.Graph:
    pack = views.pack(spark, d)
    return find(pack.table("symbols"), pack.table("relationships"), root, *args, adjacency=pack.adjacency(), **how)


def _graph(part: str, root: str, **how):
    def run(spark, d) -> DataFrame:
        graph = _walked(g.traverse, spark, d, root, **how)
        if part == "nodes":
            return graph.nodes.select(*_NODE)
        return graph.edges.select(*EDGE.split(", ")).withColumn("truncated", F.lit(graph.truncated))

    return run


def _found(find, part: str, root: str, **how):
    def run(spark, d) -> DataFrame:
        graph = _walked(find, spark, d, root, **how)
        return graph.nodes.select("id") if part == "nodes" else graph.edges.select(*EDGE.split(", "))

    return run


def _detail(part: str, projected: bool = False):
    def run(spark, d) -> DataFrame:
        found = _walked(g.symbol_detail, spark, d, ROOT, 10, projected)[part]
        if "lines" in found.columns:
            return _lines(found)
        return found.select("id", "name", "kind")

    return run


def _lines(df: DataFrame) -> DataFrame:
    return df.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


def _with_edges(query: str, limit: int = 5):
    def run(spark, d) -> DataFrame:
        return s.with_edges(_search(spark, d, query, limit).select("id"), views.pack(spark, d).table("outgoing")).select("node", "id", "dir", "rn")

    return run


QUERIES = {
    "search_exact": _hits("Orders.Order000000042"),
    "search_prefix": _hits("Customer#00000000"),
    "search_substring": _hits("ring"),
    "search_multi_token": _hits("blue bolt"),
    "search_short_token": _hits("f"),
    "search_negative": _hits("zzzz_none"),
    "search_textual": _hits("src", include_textual=False),
    "search_with_textual": _hits("click"),
    "search_kind_filter": _hits("order", kind="method"),
    "search_path_filter": _hits("order", path_contains="URGENT"),
    "search_ranked": _hits("large_bolt", 20),
    "search_lexical_score": lambda spark, d: views.symbols(spark, d).where(s.matches("bolt")).select("id", s.lexical_score("bolt").alias("score")),
    "search_bm25": lambda spark, d: s.scored(views.pack(spark, d).table("symbols"), "red bolt", views.pack(spark, d).index()).select("id", "score"),
    "search_with_relationships": _with_edges("NATION_"),
    "term_frequencies": lambda spark, d: views.pack(spark, d).table("terms").select("id", "lexeme", F.col("frequency").cast("long").alias("frequency")),
    "lexeme_df": lambda spark, d: views.pack(spark, d).table("lexicon"),
    "bm25_corpus_stats": lambda spark, d: s.corpus_stats(views.pack(spark, d).table("corpus")),
    "trigram_candidates": lambda spark, d: s.trigram_candidates(views.symbols(spark, d), "small").select("id"),
    "graph_depth1": _graph("edges", ROOT, depth=1, limit=40),
    "graph_nodes_depth1": _graph("nodes", ROOT, depth=1, limit=40),
    "graph_depth2": _graph("edges", ROOT, depth=2, limit=200),
    "graph_nodes_depth2": _graph("nodes", ROOT, depth=2, limit=200),
    "graph_calls_only": _graph("edges", "ord:000000001", depth=2, limit=100, kinds=["calls"]),
    "graph_limit": _graph("nodes", HOT, depth=2, limit=7),
    "graph_fanout_cap": _graph("edges", "sup:000000001", depth=1, limit=2000, cap=20),
    "graph_isolated": _graph("nodes", "evt:000000001", depth=2),
    "graph_projected": lambda spark, d: _lines(e.groups(_walked(g.traverse, spark, d, ROOT, 2, 100).edges)),
    "find_callers": _found(g.find_callers, "edges", HOT, depth=1, limit=60),
    "find_callers_nodes": _found(g.find_callers, "nodes", HOT, depth=1, limit=60),
    "find_callers_wide": _found(g.find_callers, "edges", "cus:000000001", depth=1, wide=True),
    "find_callers_direct": lambda spark, d: g.direct_callers(views.symbols(spark, d), views.relationships(spark, d), HOT).select(*EDGE.split(", ")),
    "find_callees": _found(g.find_callees, "edges", "ord:000000001", depth=1),
    "find_references": _found(g.find_references, "edges", "cus:000000001", depth=1),
    "symbol_detail": _detail("symbol"),
    "symbol_neighbors": _detail("neighbors"),
    "symbol_detail_projected": _detail("outgoing", True),
    "debounce_sessions": lambda spark, d: debounce.sessions(views.changes(spark, d), "5 minutes").select("first", "last", "events", "paths"),
}


def _match_sql(query: str) -> str:
    out = []
    for t in query_tokens(query):
        if len(t) >= 3:
            out.append("(" + " OR ".join(f"contains(lower({f}), '{t}')" for f in FIELDS) + ")")
        else:
            test = f"x = '{t}'" if len(t) == 1 else f"starts_with(x, '{t}')"
            lists = ", ".join(["[lower(name), lower(qualified_name)]", *[tokens_sql(f) for f in FIELDS]])
            out.append("len(list_filter(flatten([" + lists + f"]), lambda x: {test})) > 0")
    return " AND ".join(out)


def _lexical_sql(q: str) -> str:
    q = q.lower()
    return (
        f"CASE WHEN lower(name) = '{q}' OR lower(qualified_name) = '{q}' THEN 100.0 WHEN starts_with(lower(name), '{q}') THEN 70.0 WHEN contains(lower(name), '{q}') THEN 60.0 "
        f"WHEN contains(lower(qualified_name), '{q}') THEN 50.0 WHEN contains(lower(signature), '{q}') THEN 45.0 WHEN contains(lower(file_path), '{q}') THEN 30.0 ELSE 10.0 END"
    )


_LEX = "lex AS (SELECT id, lexeme, sum(w) AS frequency FROM (" + " UNION ALL ".join(f"SELECT id, unnest({tokens_sql(f)}) AS lexeme, {w} AS w FROM sym" for f, w in zip(FIELDS, (10, 4, 2, 1), strict=True)) + ") t GROUP BY 1, 2)"
_STATS = "dl AS (SELECT s.id, greatest(1, coalesce(sum(l.frequency), 0)) AS dl FROM sym s LEFT JOIN lex l ON l.id = s.id GROUP BY s.id), st AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total, greatest(1.0, sum(dl) / count(*)) AS mean FROM dl)"


def _scored_sql(query: str, where: str = "true") -> tuple[str, ...]:
    q = query.strip().lower()
    terms = ", ".join(f"('{t}')" for t in query_tokens(query))
    return (
        _LEX, _STATS,
        f"qt(lexeme) AS (VALUES {terms})",
        "df AS (SELECT qt.lexeme, count(l.id) AS df FROM qt LEFT JOIN lex l ON l.lexeme = qt.lexeme GROUP BY 1)",
        """bm AS (SELECT l.id, sum(ln(1.0 + (st.n - df.df + 0.5) / (df.df + 0.5)) * l.frequency * 2.2 / (l.frequency + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.mean))) AS bm25
           FROM lex l JOIN df ON df.lexeme = l.lexeme JOIN dl ON dl.id = l.id, st GROUP BY l.id)""",
        f"f AS (SELECT * FROM sym WHERE {where})",
        f"ex AS (SELECT * FROM f WHERE lower(name) = '{q}' OR lower(qualified_name) = '{q}')",
        f"""sc AS (SELECT ex.*, 100.0 AS score FROM ex UNION ALL
           SELECT f.*, round({_lexical_sql(q)} + 5 * coalesce(bm.bm25, 0), 6) AS score FROM f LEFT JOIN bm ON bm.id = f.id WHERE NOT EXISTS (SELECT 1 FROM ex) AND {_match_sql(query)})""",
    )


def _search_sql(query: str, limit: int = 50, where: str = "true") -> str:
    return with_views(
        f"""SELECT id, name, kind, file_path, CAST(score AS DOUBLE) AS score, rank, total > {limit} AS truncated FROM
        (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, length(name), file_path, id) AS INT) AS rank, count(*) OVER () AS total FROM sc) q WHERE rank <= {limit}""",
        *_scored_sql(query, where),
    )


def _graph_ctes(root: str, depth: int, limit: int, kinds: list[str] | None = None, cap: int = 500) -> tuple[list[str], str]:
    """CTEs of a traversal unrolled by level, and the name of the last level. Edges are carried whole, so
    that the last level has the answer's columns, and each level is computed once."""
    k = "true" if not kinds else "r.kind IN (" + ", ".join(f"'{x}'" for x in kinds) + ")"
    ends = "r.id, r.source_id, r.target_id, r.kind, r.file_path, r.line, r.col"
    out = [
        _RES.replace(" AS (", " AS MATERIALIZED (", 1), f"n0 AS MATERIALIZED (SELECT id FROM sym WHERE id = '{root}')", f"k0 AS MATERIALIZED (SELECT {EDGE} FROM rel WHERE false)",
        "t0 AS MATERIALIZED (SELECT false AS t)", "f0 AS MATERIALIZED (SELECT id FROM n0)",
    ]
    for i in range(1, depth + 1):
        p = i - 1
        out += [
            f"j{i} AS MATERIALIZED (SELECT f.id AS f, 0 AS dir, r.target_id AS other, {ends} FROM f{p} f JOIN res r ON r.source_id = f.id WHERE {k} UNION ALL SELECT f.id, 1, r.source_id, {ends} FROM f{p} f JOIN res r ON r.target_id = f.id WHERE r.source_id <> r.target_id AND {k})",
            f"r{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY f ORDER BY dir, id) AS rn FROM j{i})",
            f"q{i} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, dir) AS q FROM r{i} WHERE rn <= {cap})",
            f"c{i} AS MATERIALIZED (SELECT q{i}.*, n.id AS old FROM q{i} LEFT JOIN k{p} ON k{p}.id = q{i}.id LEFT JOIN n{p} n ON n.id = q{i}.other WHERE q = 1 AND k{p}.id IS NULL)",
            f"z{i} AS (SELECT other, f, dir, id, row_number() OVER (PARTITION BY other ORDER BY f, dir, id) AS z FROM c{i} WHERE old IS NULL)",
            f"u{i} AS (SELECT other, row_number() OVER (ORDER BY f, dir, id) AS pos FROM z{i} WHERE z = 1)",
            f"f{i} AS MATERIALIZED (SELECT other AS id FROM u{i} WHERE pos <= {limit} - (SELECT count(*) FROM n{p}))",
            f"n{i} AS MATERIALIZED (SELECT id FROM n{p} UNION ALL SELECT id FROM f{i})",
            f"k{i} AS MATERIALIZED (SELECT * FROM k{p} UNION ALL SELECT {', '.join('c.' + x for x in EDGE.split(', '))} FROM c{i} c JOIN n{i} n ON n.id = c.other)",
            f"t{i} AS MATERIALIZED (SELECT t OR (SELECT count(*) FROM r{i} WHERE rn > {cap}) > 0 OR (SELECT count(*) FROM c{i}) + (SELECT count(*) FROM k{p}) > (SELECT count(*) FROM k{i}) AS t FROM t{p})",
        ]
    return out, str(depth)


def _graph_sql(part: str, root: str, depth: int = 2, limit: int = 80, kinds: list[str] | None = None, cap: int = 500, where: str = "true") -> str:
    ctes, last = _graph_ctes(root, depth, limit, kinds, cap)
    if part == "nodes":
        return with_views(f"SELECT {', '.join('s.' + c for c in _NODE)} FROM sym s JOIN n{last} n ON n.id = s.id", *ctes)
    if part == "edges":
        return with_views(f"SELECT {EDGE}, t AS truncated FROM k{last}, t{last}", *ctes)
    if part == "kept":
        return with_views(f"SELECT {EDGE} FROM k{last} WHERE {where}", *ctes)
    if part == "ends":
        return with_views(f"SELECT id FROM sym WHERE id = '{root}' OR id IN (SELECT source_id FROM w UNION SELECT target_id FROM w)", *ctes, f"w AS (SELECT * FROM k{last} WHERE {where})")
    return with_views(f"SELECT source_id, target_id, kind, file_path, count(*) AS occurrences, array_to_string(list_slice(list_sort(list(DISTINCT line)), 1, 8), ',') AS lines FROM k{last} GROUP BY 1, 2, 3, 4", *ctes)


_PAGES = f"o AS (SELECT * FROM res WHERE source_id = '{ROOT}' ORDER BY id LIMIT 10), i AS (SELECT * FROM res WHERE target_id = '{ROOT}' ORDER BY id LIMIT 10)"

ORACLES = {
    "search_exact": _search_sql("Orders.Order000000042"),
    "search_prefix": _search_sql("Customer#00000000"),
    "search_substring": _search_sql("ring"),
    "search_multi_token": _search_sql("blue bolt"),
    "search_short_token": _search_sql("f"),
    "search_negative": _search_sql("zzzz_none"),
    "search_textual": _search_sql("src", where="kind <> 'textual-evidence'"),
    "search_with_textual": _search_sql("click"),
    "search_kind_filter": _search_sql("order", where="lower(kind) = 'method'"),
    "search_path_filter": _search_sql("order", where="contains(lower(file_path), 'urgent')"),
    "search_ranked": _search_sql("large_bolt", 20),
    "search_lexical_score": with_views(f"SELECT id, CAST({_lexical_sql('bolt')} AS DOUBLE) AS score FROM sym WHERE {_match_sql('bolt')}"),
    "search_bm25": with_views("SELECT id, CAST(score AS DOUBLE) AS score FROM sc", *_scored_sql("red bolt")),
    "search_with_relationships": with_views(
        """SELECT node, id, dir, rn FROM (SELECT node, id, dir, CAST(row_number() OVER (PARTITION BY node ORDER BY dir, id) AS INT) AS rn FROM
        (SELECT h.id AS node, r.id, 0 AS dir FROM h JOIN res r ON r.source_id = h.id UNION ALL SELECT h.id, r.id, 1 FROM h JOIN res r ON r.target_id = h.id AND r.source_id <> r.target_id) q) w WHERE rn <= 24""",
        _RES, *_scored_sql("NATION_"), "h AS (SELECT id FROM sc ORDER BY score DESC, length(name), file_path, id LIMIT 5)"),
    "term_frequencies": with_views("SELECT id, lexeme, CAST(frequency AS BIGINT) AS frequency FROM lex", _LEX),
    "lexeme_df": with_views("SELECT lexeme, count(*) AS df FROM lex GROUP BY 1", _LEX),
    "bm25_corpus_stats": with_views("SELECT n, total AS total_length, round(CAST(mean AS DOUBLE), 6) AS average_length FROM st", _LEX, _STATS),
    "trigram_candidates": with_views("SELECT id FROM sym WHERE " + " AND ".join("(" + " OR ".join(f"contains(lower({f}), '{t}')" for f in FIELDS) + ")" for t in ("sma", "mal", "all"))),
    "graph_depth1": _graph_sql("edges", ROOT, 1, 40),
    "graph_nodes_depth1": _graph_sql("nodes", ROOT, 1, 40),
    "graph_depth2": _graph_sql("edges", ROOT, 2, 200),
    "graph_nodes_depth2": _graph_sql("nodes", ROOT, 2, 200),
    "graph_calls_only": _graph_sql("edges", "ord:000000001", 2, 100, ["calls"]),
    "graph_limit": _graph_sql("nodes", HOT, 2, 7),
    "graph_fanout_cap": _graph_sql("edges", "sup:000000001", 1, 2000, cap=20),
    "graph_isolated": _graph_sql("nodes", "evt:000000001", 2),
    "graph_projected": _graph_sql("groups", ROOT, 2, 100),
    "find_callers": _graph_sql("kept", HOT, 1, 60, ["calls"], where=f"target_id = '{HOT}'"),
    "find_callers_nodes": _graph_sql("ends", HOT, 1, 60, ["calls"], where=f"target_id = '{HOT}'"),
    "find_callers_wide": _graph_sql("kept", "cus:000000001", 1, 80, ["calls", "references"], where="target_id = 'cus:000000001'"),
    "find_callers_direct": with_views(f"SELECT {EDGE} FROM res WHERE target_id = '{HOT}' AND kind = 'calls'", _RES),
    "find_callees": _graph_sql("kept", "ord:000000001", 1, 80, ["calls", "constructs"], where="source_id = 'ord:000000001'"),
    "find_references": _graph_sql("kept", "cus:000000001", 1, 80, ["references"], where="(source_id = 'cus:000000001' OR target_id = 'cus:000000001')"),
    "symbol_detail": with_views(f"SELECT id, name, kind FROM sym WHERE id = '{ROOT}'"),
    "symbol_neighbors": with_views(f"SELECT id, name, kind FROM sym WHERE id <> '{ROOT}' AND id IN (SELECT target_id FROM o UNION SELECT source_id FROM i) ORDER BY id LIMIT 200", _RES, _PAGES),
    "symbol_detail_projected": with_views("SELECT source_id, target_id, kind, file_path, count(*) AS occurrences, array_to_string(list_slice(list_sort(list(DISTINCT line)), 1, 8), ',') AS lines FROM o GROUP BY 1, 2, 3, 4", _RES, _PAGES),
    "debounce_sessions": """WITH c AS (SELECT ts, 'src/events/u' || CAST(user_id % 50 AS VARCHAR) || '.cs' AS path FROM events),
        m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM c),
        s AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT min(ts) AS first, max(ts) AS last, count(*) AS events, count(DISTINCT lower(path)) AS paths FROM s GROUP BY k""",
}
