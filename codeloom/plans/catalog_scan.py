"""Queries over symbols and relationships without search or traversal, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import ids, text
from codeloom.operators import edges as e
from codeloom.operators import overview as o
from codeloom.operators import project as p
from codeloom.operators import source as src
from codeloom.operators import store_checks as sc
from codeloom.plans.sqltext import GENERATED_SQL, SYM_COLUMNS, tokens_sql, with_views
from codeloom.sources import views

HUB = "prt:000000042"
SYM = ", ".join(SYM_COLUMNS)
EDGE = "id, source_id, target_id, kind, file_path, line, col"
_TEXT = "kind <> 'textual-evidence'"
_RES = "res AS (SELECT r.* FROM rel r WHERE r.source_id IN (SELECT id FROM sym) AND r.target_id IN (SELECT id FROM sym))"


def _sym(f):
    return lambda spark, d: f(views.symbols(spark, d))


def _rel(f):
    return lambda spark, d: f(views.relationships(spark, d))


def _both(f):
    return lambda spark, d: f(views.symbols(spark, d), views.relationships(spark, d))


def _pack(f):
    return lambda spark, d: f(views.pack(spark, d))


def _edges(df: DataFrame) -> DataFrame:
    return df.select(*EDGE.split(", "))


def _syms(df: DataFrame) -> DataFrame:
    return df.select(*SYM_COLUMNS)


def _lines_text(df: DataFrame) -> DataFrame:
    return df.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


def _top_sql(table: str, key: str, n: int, where: str = "true") -> str:
    return with_views(f"SELECT {key} AS key, count(*) AS n FROM {table} WHERE {where} GROUP BY 1 ORDER BY n DESC, key LIMIT {n}")


def _hubs_sql(where: str) -> str:
    return with_views(
        f"""SELECT s.id, s.name, s.qualified_name, s.kind, s.file_path, CAST(d.degree AS BIGINT) AS degree FROM sym s JOIN
        (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM res UNION ALL SELECT target_id FROM res) x GROUP BY id) d ON d.id = s.id
        WHERE {where} ORDER BY degree DESC, id LIMIT 20""", _RES)


def _page_sql(side: str, limit: int) -> str:
    return with_views(f"SELECT {EDGE}, rn, n > {limit} AS has_more FROM (SELECT {EDGE}, CAST(row_number() OVER (ORDER BY id) AS INT) AS rn, count(*) OVER () AS n FROM res WHERE {side} = '{HUB}') x WHERE rn <= {limit}", _RES)


def _delta(s: DataFrame) -> DataFrame:
    """One file's symbols under new names, with ids of their own: a synthetic file delta."""
    own = s.where("module_id = 'csharp-roslyn' and file_path = 'src/customers/building.cs'")
    return own.withColumn("name", F.concat(F.lit("New"), F.col("name")))


_DELTA_SQL = f"d AS (SELECT * REPLACE ('New' || name AS name) FROM sym WHERE module_id = 'csharp-roslyn' AND file_path = 'src/customers/building.cs')"

QUERIES = {
    "scan_symbols": _sym(lambda s: _syms(s).orderBy("id")),
    "scan_relationships": _rel(lambda r: _edges(r).orderBy("id")),
    "symbol_lookup": _sym(lambda s: _syms(s.where(F.col("id") == "nat:000"))),
    "path_exclusion": _sym(lambda s: s.select("id", text.is_excluded(F.col("file_path"), ["/parts/"]).alias("excluded"))),
    "files_not_excluded": _sym(lambda s: s.select("file_path").distinct().where(~text.is_excluded(F.col("file_path"), ["generated"]))),
    "generated_files": _sym(lambda s: s.select("file_path").distinct().select("file_path", text.is_generated(F.col("file_path")).alias("generated"))),
    "project_orientation": _sym(lambda s: p.project(s, p.ORIENTATION)),
    "project_compact": _sym(lambda s: p.project(s, p.COMPACT)),
    "project_full": _sym(lambda s: p.project(s, p.FULL)),
    "project_graph_only": _sym(lambda s: p.project(s, p.GRAPH_ONLY)),
    "outline_compact": _sym(lambda s: p.outline_compact(o.outline(s, "geo/regions.ts"))),
    "outline_without_file": _sym(lambda s: p.outline_without_file(o.outline(s, "geo/regions.ts"))),
    "file_outline": _sym(lambda s: _syms(o.outline(s, "src/customers/building.cs", 100))),
    "list_files": _pack(lambda k: o.list_rollup(k.table("files"), "src/", 50)),
    "path_universe": _both(lambda s, r: s.select("file_path").union(r.select("file_path")).distinct()),
    "external_filter": _rel(lambda r: _edges(r.where(~F.col("target_id").startswith("ext:")))),
    "resolved_edges": _both(lambda s, r: _edges(e.resolved(r, s))),
    "resolved_count": _pack(lambda k: k.table("outgoing").agg(F.count("*").alias("resolved"))),
    "unresolved_edges": _both(lambda s, r: _edges(e.unresolved(r, s))),
    "prune_dangling": _both(lambda s, r: _edges(e.resolved(r, s.where("module_id = 'csharp-roslyn'")))),
    "adjacent_edges": _both(lambda s, r: e.adjacent(e.resolved(r, s), s.where("kind = 'class'").select("id")).select("node", "dir", "other", "id", "kind")),
    "overview_kinds": _sym(o.kinds),
    "overview_languages": _sym(o.languages),
    "overview_projects": _sym(o.projects),
    "overview_edge_kinds": _rel(o.edge_kinds),
    "overview_top_files": _sym(o.top_files),
    "overview_top_files_generated": _sym(lambda s: o.top_files(s, True)),
    "overview_hubs": _pack(lambda k: o.hubs(k.table("symbols"))),
    "overview_hubs_generated": _pack(lambda k: o.hubs(k.table("symbols"), include_generated=True)),
    "overview_totals": _both(o.totals),
    "file_rollup": _pack(lambda k: k.table("files")),
    "degree_in": _pack(lambda k: k.table("symbols").select("id", "degree_in").where("degree_in > 0")),
    "degree_out": _pack(lambda k: k.table("symbols").select("id", "degree_out").where("degree_out > 0")),
    "edge_groups": _rel(lambda r: _lines_text(e.groups(r))),
    "edge_groups_wire": _rel(lambda r: _lines_text(e.groups_wire(r))),
    "repository_status": _pack(lambda k: sc.status(k.table("segments"))),
    "purge_count": _sym(lambda s: o.purge_count(s, "/parts/")),
    "purge_path": _sym(lambda s: _syms(s.where(~text.contains(F.col("file_path"), "/parts/")))),
    "symbol_outgoing": _pack(lambda k: e.page(k.table("outgoing"), "ord:000000001", True, 40).select(*EDGE.split(", "), "rn", "has_more")),
    "symbol_incoming": _pack(lambda k: e.page(k.table("incoming"), HUB, False, 40).select(*EDGE.split(", "), "rn", "has_more")),
    "token_budget_projection": _sym(lambda s: p.within_budget(s, [F.col("id")], p.ORIENTATION, 100, 2000).select("id", "tokens", "rn", "total")),
    "estimated_tokens": _sym(lambda s: p.project(s).select("id", p.tokens_of(p.ORIENTATION).alias("tokens"))),
    "dedupe_first": _sym(lambda s: sc.dedupe_first(s, "name", ["module_id", "id"]).select("name", "id")),
    "resolve_by_name": _both(lambda s, r: sc.resolve_by_name(s, r)),
    "enclosing_declaration": _both(lambda s, r: sc.enclosing(s.where("kind not in ('textual-evidence', 'module')"), r)),
    "enclosing_symbol": _both(lambda s, r: sc.enclosing(s.where("kind not in ('textual-evidence', 'module')"), r, s.where("kind = 'module'"))),
    "resolve_imports": _sym(lambda s: sc.resolve_imports(s)),
    "verify_parity": _sym(lambda s: sc.parity(s, s.where("id <> 'nat:000'").unionByName(s.where("id = 'nat:001'").withColumn("id", F.lit("nat:999"))))),
    "incremental_merge": _sym(lambda s: _syms(sc.merge(s, _delta(s), ["module_id", "file_path"]))),
    "module_replace": _sym(lambda s: _syms(sc.merge(s, _delta(s), ["module_id"]))),
    "identity_violations": _sym(lambda s: sc.identity_violations(s.unionByName(_delta(s).withColumn("file_path", F.lit("src/customers/Other.cs"))))),
    "delta_violations": _sym(lambda s: _syms(sc.delta_violations(s, "csharp-roslyn", ["src/customers/building.cs"]))),
    "get_source": lambda spark, d: src.get_source(views.source_lines(spark, d), _path(spark, d), 1, 0),
    "get_source_window_cap": lambda spark, d: src.get_source(views.source_lines(spark, d), _path(spark, d), 2, 50, most=5),
    "fn_normalize": _sym(lambda s: s.select("id", text.normalize(F.concat(F.lit("A\\"), F.col("qualified_name"))).alias("value"))),
    "fn_normalize_path": _sym(lambda s: s.select("id", text.normalize_path(F.concat(F.lit("c:\\x\\"), F.col("file_path"))).alias("value"))),
    "fn_tokenize": _sym(lambda s: s.select("id", F.array_join(text.tokens(F.col("qualified_name")), ",").alias("value"))),
    "fn_trigrams": _sym(lambda s: s.select("id", F.array_join(text.trigrams(F.col("name")), ",").alias("value"))),
    "distinct_tokens": _sym(lambda s: s.select(F.explode(text.tokens(F.col("name"))).alias("token")).agg(F.countDistinct("token").alias("n"))),
    "fn_signature": lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.signature_line(F.col("text"), 240).alias("value")),
    "fn_language": _sym(lambda s: s.select("id", text.language(F.col("file_path")).alias("value"))),
    "fn_is_source": lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.is_source(F.split(F.col("url"), "[?#]")[0]).alias("value")),
    "fn_normalize_relative": _sym(lambda s: s.select("id", text.resolve_relative(F.concat(F.lit("./a/../"), F.col("file_path"))).alias("value"))),
    "fn_storage_slug": _sym(lambda s: s.select("id", text.storage_slug(F.concat(F.lit("C:\\r "), F.col("id"))).alias("value"))),
    "fn_edge_id": _rel(lambda r: r.select("id", text.edge_id(F.col("source_id"), F.col("target_id"), F.col("kind"), F.col("file_path"), F.col("line").cast("string")).alias("value"))),
    "fn_generation": lambda spark, d: views.changes(spark, d).select("ts", F.date_format("ts", "yyyyMMddHHmmssSSS").alias("value")),
    "fn_declaration_id": _sym(lambda s: s.select("id", ids.declaration_id().alias("value"))),
    "wire_json": _sym(p.wire_json),
    "textual_evidence": lambda spark, d: sc.textual_evidence(spark.read.parquet(f"{d}/documents.parquet")),
    "project_score": _sym(lambda s: sc.project_score(s)),
    "project_scores": _sym(sc.project_scores),
    "stream_interest": lambda spark, d: views.changes(spark, d).where(text.is_source(F.col("path")) & ~text.is_excluded(F.col("path"))).groupBy("path").agg(F.count("*").alias("n")),
}


def _path(spark, d: str) -> str:
    """The document with the most lines, the first by path of equals."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), "doc_id", F.lit(".txt"))
    most = docs.select(path.alias("file_path"), F.regexp_count("text", F.lit("\r\n|\n|\r")).alias("n")).where("file_path is not null")
    return most.orderBy(F.desc("n"), "file_path").first()["file_path"]


_LINES = """lines AS (SELECT file_path, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line_no, unnest(l) AS line FROM
  (SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS file_path, string_split(text, chr(10)) AS l FROM documents) q),
longest AS (SELECT file_path, max(line_no) AS n FROM lines GROUP BY 1 ORDER BY n DESC, file_path LIMIT 1)"""


def _source_sql(start: int, end: int, most: int) -> str:
    asked = f"{end}" if end else f"{start} + 60"
    last = f"least({asked}, {start} + {most} - 1, n)"
    return f"""WITH {_LINES} SELECT l.file_path, {start} AS start_line, CAST(any_value({last}) AS INT) AS end_line, CAST(any_value(n) AS INT) AS total_lines,
      string_agg(line, chr(10) ORDER BY line_no) AS content, any_value({last} < least({asked}, n)) AS truncated
      FROM lines l JOIN longest g ON l.file_path = g.file_path WHERE line_no BETWEEN {start} AND {last} GROUP BY l.file_path"""


_ORIENT = "id, name, kind, nullif(qualified_name, name) AS qualified_name, file_path, start_line"
_COMPACT = _ORIENT + ", project, nullif(signature, name) AS signature, nullif(end_line, start_line) AS end_line"
_OUTLINE = f"SELECT * FROM sym WHERE file_path = 'geo/regions.ts' AND {_TEXT}"
_TOKENS = "greatest(1, (length(id) + length(name) + length(kind) + coalesce(length(nullif(qualified_name, name)), 0) + length(file_path) + 75) // 4)"
_GROUPS = "SELECT source_id, target_id, kind, file_path, count(*) AS occurrences, array_to_string(list_slice(list_sort(list(DISTINCT line)), 1, 8), ',') AS lines FROM rel GROUP BY 1, 2, 3, 4"
#: The smallest declaration around each line of a use.
_AROUND_SQL = """(SELECT file_path, line, id AS owner_id FROM (SELECT l.file_path, l.line, s.id, row_number() OVER (PARTITION BY l.file_path, l.line ORDER BY s.end_line - s.start_line, s.start_line DESC, s.id) AS k
          FROM (SELECT DISTINCT file_path, line FROM rel) l JOIN sym s ON s.file_path = l.file_path AND l.line BETWEEN s.start_line AND s.end_line WHERE s.kind NOT IN ('textual-evidence', 'module')) q WHERE k = 1)"""



def _le_sql(n: str) -> str:
    return "(" + " || ".join(f"substr(printf('%08x', {n}), {at}, 2)" for at in (7, 5, 3, 1)) + ")"


def _bytes_sql(c: str) -> str:
    return f"({_le_sql(f'octet_length(encode({c}))')} || hex(encode({c})))"


_FORM_SQL = " || ".join(["'01'", *[_bytes_sql(c) for c in ("repository_id", "module_id", "kind", "qualified_name", "file_path")], _le_sql("start_line"), _le_sql("start_column")])
_WIRE_SQL = ", ".join([
    "'id', id, 'name', name, 'kind', kind, 'qualifiedName', nullif(qualified_name, name), 'filePath', file_path, 'startLine', start_line",
    "'project', project, 'signature', nullif(signature, name), 'endLine', nullif(end_line, start_line)",
])

ORACLES = {
    "fn_declaration_id": with_views(f"SELECT id, substr(sha256(unhex({_FORM_SQL})), 1, 24) AS value FROM sym"),
    "wire_json": with_views(f"SELECT id, CAST(json_merge_patch('{{}}', json_object({_WIRE_SQL})) AS VARCHAR) AS json FROM sym"),
    "scan_symbols": with_views(f"SELECT {SYM} FROM sym"),
    "scan_relationships": with_views(f"SELECT {EDGE} FROM rel"),
    "symbol_lookup": with_views(f"SELECT {SYM} FROM sym WHERE id = 'nat:000'"),
    "path_exclusion": with_views("SELECT id, len(list_intersect(string_split(lower(file_path), '/'), ['.git', '.tmp', 'node_modules', 'dist', 'build', 'coverage', 'bin', 'obj'])) > 0 OR contains(file_path, '/parts/') AS excluded FROM sym"),
    "files_not_excluded": with_views("SELECT DISTINCT file_path FROM sym WHERE NOT contains(file_path, 'generated')"),
    "generated_files": with_views(f"SELECT DISTINCT file_path, {GENERATED_SQL} AS generated FROM sym"),
    "project_orientation": with_views(f"SELECT {_ORIENT} FROM sym"),
    "project_compact": with_views(f"SELECT {_COMPACT} FROM sym"),
    "project_full": with_views(f"SELECT {_COMPACT}, language, module_id, start_column, end_column FROM sym"),
    "project_graph_only": with_views("SELECT id, name, kind FROM sym"),
    "outline_compact": with_views(f"SELECT name, kind, start_line FROM ({_OUTLINE}) q"),
    "outline_without_file": with_views(f"SELECT id, name, kind, nullif(qualified_name, name) AS qualified_name, start_line, project, nullif(signature, name) AS signature, nullif(end_line, start_line) AS end_line FROM ({_OUTLINE}) q"),
    "file_outline": with_views(f"SELECT {SYM} FROM sym WHERE file_path = 'src/customers/building.cs' AND {_TEXT} ORDER BY start_line, start_column, id LIMIT 100"),
    "list_files": with_views(f"SELECT file_path, count(*) AS symbol_count, max(language) AS language FROM sym WHERE {_TEXT} AND contains(lower(file_path), 'src/') GROUP BY 1 ORDER BY 1 LIMIT 51"),
    "path_universe": with_views("SELECT file_path FROM sym UNION SELECT file_path FROM rel"),
    "external_filter": with_views(f"SELECT {EDGE} FROM rel WHERE NOT starts_with(target_id, 'ext:')"),
    "resolved_edges": with_views(f"SELECT {EDGE} FROM res", _RES),
    "resolved_count": with_views("SELECT count(*) AS resolved FROM res", _RES),
    "unresolved_edges": with_views(f"SELECT {EDGE} FROM rel WHERE source_id NOT IN (SELECT id FROM sym) OR target_id NOT IN (SELECT id FROM sym)"),
    "prune_dangling": with_views(f"SELECT {EDGE} FROM rel WHERE source_id IN (SELECT id FROM c) AND target_id IN (SELECT id FROM c)", "c AS (SELECT id FROM sym WHERE module_id = 'csharp-roslyn')"),
    "adjacent_edges": with_views("SELECT s.id AS node, 0 AS dir, r.target_id AS other, r.id, r.kind FROM sym s JOIN res r ON r.source_id = s.id WHERE s.kind = 'class' UNION ALL SELECT s.id, 1, r.source_id, r.id, r.kind FROM sym s JOIN res r ON r.target_id = s.id WHERE s.kind = 'class' AND r.source_id <> r.target_id", _RES),
    "overview_kinds": _top_sql("sym", "kind", 30),
    "overview_languages": _top_sql("sym", "language", 12),
    "overview_projects": _top_sql("sym", "coalesce(project, '(none)')", 30),
    "overview_edge_kinds": _top_sql("rel", "kind", 12),
    "overview_top_files": _top_sql("sym", "file_path", 20, f"{_TEXT} AND NOT ({GENERATED_SQL})"),
    "overview_top_files_generated": _top_sql("sym", "file_path", 20, _TEXT),
    "overview_hubs": _hubs_sql(f"{_TEXT} AND NOT ({GENERATED_SQL})"),
    "overview_hubs_generated": _hubs_sql(_TEXT),
    "overview_totals": with_views("SELECT (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM rel) AS relationships"),
    "file_rollup": with_views(f"SELECT file_path, count(*) FILTER ({_TEXT}) AS symbol_count, max(language) AS language, count(*) FILTER ({_TEXT}) > 0 AS visible FROM sym GROUP BY 1"),
    "degree_in": with_views("SELECT target_id AS id, count(*) AS degree_in FROM res GROUP BY 1", _RES),
    "degree_out": with_views("SELECT source_id AS id, count(*) AS degree_out FROM res GROUP BY 1", _RES),
    "edge_groups": with_views(_GROUPS),
    "edge_groups_wire": with_views(f"SELECT source_id, target_id, kind, file_path, CASE WHEN occurrences > 8 THEN occurrences END AS count, lines FROM ({_GROUPS}) g"),
    "repository_status": with_views("SELECT count(*) AS segments, CAST(sum(s) AS BIGINT) AS symbols, CAST(sum(r) AS BIGINT) AS relationships FROM (SELECT module_id, file_path, sum(s) AS s, sum(r) AS r FROM (SELECT module_id, file_path, 1 AS s, 0 AS r FROM sym UNION ALL SELECT module_id, file_path, 0, 1 FROM rel) u GROUP BY 1, 2) g"),
    "purge_count": with_views("SELECT count(*) AS removed FROM sym WHERE contains(lower(file_path), '/parts/')"),
    "purge_path": with_views(f"SELECT {SYM} FROM sym WHERE NOT contains(lower(file_path), '/parts/')"),
    "symbol_outgoing": _page_sql("source_id", 40).replace(HUB, "ord:000000001"),
    "symbol_incoming": _page_sql("target_id", 40),
    "token_budget_projection": with_views(f"SELECT id, tokens, rn, total FROM (SELECT id, tokens, CAST(row_number() OVER (ORDER BY id) AS INT) AS rn, CAST(sum(tokens) OVER (ORDER BY id) AS BIGINT) AS total FROM (SELECT id, CAST({_TOKENS} AS BIGINT) AS tokens FROM sym ORDER BY id LIMIT 100) q) w WHERE rn = 1 OR total <= 2000"),
    "estimated_tokens": with_views(f"SELECT id, CAST({_TOKENS} AS BIGINT) AS tokens FROM sym"),
    "dedupe_first": with_views("SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY module_id, id) AS rn FROM sym) q WHERE rn = 1"),
    "resolve_by_name": with_views("SELECT r.id AS edge_id, n.name, f.id AS resolved_id FROM rel r JOIN sym n ON n.id = r.target_id JOIN (SELECT name, min(id) AS id FROM sym WHERE kind <> 'module' GROUP BY 1) f ON f.name = n.name"),
    "enclosing_declaration": with_views(f"SELECT r.id AS edge_id, o.owner_id FROM rel r JOIN {_AROUND_SQL} o ON o.file_path = r.file_path AND o.line = r.line"),
    "enclosing_symbol": with_views(
        f"""SELECT r.id AS edge_id, coalesce(o.owner_id, m.id) AS owner_id FROM rel r LEFT JOIN {_AROUND_SQL} o ON o.file_path = r.file_path AND o.line = r.line
        LEFT JOIN (SELECT file_path, min(id) AS id FROM sym WHERE kind = 'module' GROUP BY 1) m ON m.file_path = r.file_path"""),
    "resolve_imports": with_views("SELECT file_path AS importer, upper(regexp_replace(file_path, '[.]ts$', '')) AS spec, file_path AS resolved FROM (SELECT DISTINCT file_path FROM sym) q"),
    "verify_parity": with_views("SELECT 'missing' AS problem, 'nat:000' AS id UNION ALL SELECT 'extra', 'nat:999'"),
    "incremental_merge": with_views(f"SELECT {SYM} FROM sym WHERE NOT (module_id = 'csharp-roslyn' AND file_path = 'src/customers/building.cs') UNION ALL SELECT {SYM} FROM d", _DELTA_SQL),
    "module_replace": with_views(f"SELECT {SYM} FROM sym WHERE module_id <> 'csharp-roslyn' UNION ALL SELECT {SYM} FROM d", _DELTA_SQL),
    "identity_violations": with_views("SELECT id, 'duplicate' AS problem FROM sym WHERE module_id = 'csharp-roslyn' AND file_path = 'src/customers/building.cs'"),
    "delta_violations": with_views(f"SELECT {SYM} FROM sym WHERE NOT (module_id = 'csharp-roslyn' AND file_path = 'src/customers/building.cs')"),
    "get_source": _source_sql(1, 0, 400),
    "get_source_window_cap": _source_sql(2, 50, 5),
    "fn_normalize": with_views("SELECT id, lower(replace('A\\' || qualified_name, '\\', '/')) AS value FROM sym"),
    "fn_normalize_path": with_views("SELECT id, replace('c:\\x\\' || file_path, '\\', '/') AS value FROM sym"),
    "fn_tokenize": with_views(f"SELECT id, array_to_string({tokens_sql('qualified_name')}, ',') AS value FROM sym"),
    "fn_trigrams": with_views("SELECT id, array_to_string(list_sort(list_distinct(list_transform(range(1, length(name) - 1), lambda i: substring(lower(name), CAST(i AS INT), 3)))), ',') AS value FROM sym"),
    "distinct_tokens": with_views(f"SELECT count(DISTINCT t) AS n FROM (SELECT unnest({tokens_sql('name')}) AS t FROM sym) q"),
    "fn_signature": "SELECT doc_id, substring(trim(string_split(text, chr(10))[1]), 1, 240) AS value FROM documents",
    "fn_language": with_views("SELECT id, CASE WHEN file_path LIKE '%.cs' THEN 'csharp' WHEN file_path LIKE '%.ts' THEN 'typescript' ELSE 'javascript' END AS value FROM sym"),
    "fn_is_source": "SELECT page_id, regexp_matches(regexp_extract(url, '^[^?#]*'), '(?i)\\.(cs|tsx?|jsx?|mjs|cjs|c|h|cc|cpp|cxx|hpp|hh|hxx|inl)$') AS value FROM pages",
    "fn_normalize_relative": with_views("SELECT id, file_path AS value FROM sym"),
    "fn_storage_slug": with_views("SELECT id, substring(regexp_replace('C:\\r ' || id, '[^a-zA-Z0-9_.-]', '-', 'g'), 1, 48) || '__' || substring(sha256('C:\\r ' || id), 1, 10) AS value FROM sym"),
    "fn_edge_id": with_views("SELECT id, substring(sha256(source_id || '|' || target_id || '|' || kind || '|' || file_path || '|' || CAST(line AS STRING)), 1, 24) AS value FROM rel"),
    "fn_generation": "SELECT ts, strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(CAST(date_part('millisecond', ts) AS INT) % 1000 AS VARCHAR), 3, '0') AS value FROM events",
    "textual_evidence": "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '\\b[A-Za-z_][A-Za-z0-9_]{3,}\\b')) AS token FROM documents) q WHERE regexp_matches(token, '[A-Z_]') GROUP BY 1, 2",
    "project_score": with_views("SELECT file_path, CASE WHEN file_path LIKE '%.sln' THEN 20 ELSE 0 END - greatest(0, len(string_split(file_path, '/')) - 2) AS score FROM (SELECT DISTINCT file_path FROM sym) q ORDER BY score DESC, length(file_path), file_path LIMIT 1"),
    "project_scores": with_views("SELECT file_path, CASE WHEN lower(file_path) LIKE '%.sln' THEN 20 ELSE 0 END - greatest(0, len(string_split(file_path, '/')) - 2) AS score FROM (SELECT DISTINCT file_path FROM sym) q"),
    "stream_interest": "SELECT 'src/events/u' || CAST(user_id % 50 AS VARCHAR) || '.cs' AS path, count(*) AS n FROM events GROUP BY 1",
}
