import json
import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.functions.ids import canonical_hash, declaration_id, logical_identity, physical_identity
from codeloom.operators.project import diagnostics_split
from codeloom.operators.search import document_length, query_tokens, term_frequencies
from codeloom.operators.source import contained, window
from codeloom.plans.tools import Tools
from codeloom.sources import ingest, modules, scan_ts
from codeloom.sources.store import Store
from codeloom.streaming import debounce, file_events
from tests.rows import edges, symbols

SHAPES = """import { log } from './log';
// a comment with new Fake()
export class Shape { area(): number { return 0; } }
export class Square extends Shape {
  side = 2;
  constructor(s: number) { super(); this.side = s; }
  area() { log('x'); return this.side; }
}
export function build() { const s = new Square(2); return s.area(); }
"""


def test_scanner(spark):
    files = spark.createDataFrame([("src/shapes.ts", SHAPES), ("src/log.ts", "export function log(m) { return m; }"), ("src/empty.ts", ""), ("src/bad.ts", None)], "path string, text string")
    s, r = scan_ts.analyze(files, "repo")
    names = {(x["name"], x["kind"]) for x in s.collect()}
    assert {("Shape", "class"), ("Square", "class"), ("area", "method"), ("constructor", "constructor"), ("build", "function"), ("log", "function"), ("shapes.ts", "module"), ("side", "property")} <= names
    by_id = {x["id"]: x["name"] for x in s.collect()}
    found = {(by_id[x["source_id"]], x["kind"], by_id[x["target_id"]]) for x in r.collect()}
    assert ("Square", "inherits", "Shape") in found
    assert ("build", "constructs", "Square") in found and ("area", "calls", "log") in found
    assert ("shapes.ts", "imports", "log.ts") in found
    assert not any("Fake" in x for x in by_id.values())
    scan_ts.register_functions(spark)
    rows = spark.sql("select f.* from {files}, lateral syntax_facts(path, text) f", files=files)
    assert sorted(map(str, rows.collect())) == sorted(map(str, scan_ts.scan_files(files).collect()))
    assert s.select("id").distinct().count() == s.count()


def test_ingest(spark, tmp_path):
    lines = [{"type": "symbol", "id": "a", "name": "A"}, {"type": "relationship", "id": "e", "source_id": "a"}]
    (tmp_path / "x.ndjson").write_text("\n".join(map(json.dumps, lines)))
    s, r = ingest.analyzer_rows(spark, str(tmp_path / "x.ndjson"))
    assert [x["name"] for x in s.collect()] == ["A"] and [x["source_id"] for x in r.collect()] == ["a"]
    (tmp_path / "y.ndjson").write_text("{broken\n\n" + json.dumps({"type": "other", "id": "x"}) + "\n" + json.dumps({"type": "symbol"}) + "\n" + json.dumps(lines[0]))
    assert ingest.malformed_lines(spark, str(tmp_path / "y.ndjson")).count() == 3 and ingest.malformed_lines(spark, str(tmp_path / "x.ndjson")).count() == 0
    assert ingest.analyzer_rows(spark, str(tmp_path / "y.ndjson"))[0].count() == 1
    (tmp_path / "cc.json").write_text(json.dumps([{"file": "a.c", "directory": "/", "command": "one"}, {"file": "a.c", "directory": "/", "arguments": ["cc", "a.c"]}]))
    assert [tuple(x) for x in ingest.compile_commands(spark, str(tmp_path / "cc.json")).collect()] == [("a.c", "/", "cc a.c")]
    (tmp_path / "p" / "node_modules").mkdir(parents=True)
    for name in ("p/a.ts", "p/b.txt", "p/node_modules/c.ts"):
        (tmp_path / name).write_text("let x = 1")
    assert [x["path"] for x in ingest.source_files(spark, str(tmp_path / "p")).collect()] == ["a.ts"]


def test_catalog(spark, tmp_path):
    c = ingest.Catalog(f"file://{tmp_path}/c.json", spark)
    c.merge({"id": "b", "root_path": "/b"})
    c.merge({"id": "A", "root_path": "/a"})
    assert [r["id"] for r in json.loads((tmp_path / "c.json").read_text())] == ["A", "b"]
    assert c.merge({"id": "b", "root_path": None, "solution": "x"}) == {"id": "b", "root_path": "/b", "solution": "x"}
    c.exclude("b", "Gen")
    assert c.exclude("b", "gen")["excluded_paths"] == ["Gen"]
    (tmp_path / "c.json").write_text("{broken")
    assert c.load() == {} and ingest.Catalog(str(tmp_path / "sub" / "none.json")).load() == {}


def test_textual_hint_and_orders(spark, tmp_path):
    s = symbols(spark, ("a", "Alpha", "a.cs"), ("t", "betaOnlyInText", "b.cs", "textual-evidence"))
    t = Tools(spark, ingest.Catalog(str(tmp_path / "c.json")), f"file://{tmp_path}/data", None, lambda entry: (s.withColumn("repository_id", F.lit(entry["id"])), edges(spark)))
    for name in ("beta", "Alpha", "gamma"):
        t.open_repository(str(tmp_path), name)
    assert [r["repository_id"] for r in t.list_repositories()] == ["Alpha", "beta", "gamma"]
    assert t.list_modules() == sorted(t.list_modules())
    assert t.search_symbols("beta", "betaonly") == {"items": [], "truncated": False, "hint": "only textual evidence matches; set include_textual"}
    assert "hint" not in t.search_symbols("beta", "nothing") and t.search_symbols("beta", "betaonly", include_textual=True)["items"][0]["id"] == "t"
    t.remove_repository("gamma", delete_data=True)
    assert "gamma" not in t.catalog.load() and t.call("repository_status", {"repository_id": "gamma"})["isError"]


def test_diagnostics_split():
    lines = ["ts-semantic (full): 3 files", "warning", "tsconfig: a.json", "ts-semantic (incremental): 1", "ts-semantic: x"]
    assert diagnostics_split(lines) == ([lines[0], lines[2], lines[3]], [lines[1], lines[4]])


def test_windows_and_paths(tmp_path):
    assert window(100) == (1, 61, False) and window(10, 3, 5) == (3, 5, False)
    assert window(1000, 1, 900) == (1, 400, True) and window(0) == (1, 0, False)
    with pytest.raises(ValueError):
        window(10, 8, 4, clamp=False)
    (tmp_path / "a").mkdir()
    assert contained(str(tmp_path / "a"), "x.cs").name == "x.cs"
    with pytest.raises(PermissionError):
        contained(str(tmp_path / "a"), "../a2/x.cs")


def test_tokens_and_identities():
    assert query_tokens("HTTPServerV2fooBar x") == sorted({"httpserverv2foobar", "http", "server", "v", "2", "foo", "bar", "x"})
    one = logical_identity(["N"], [("T", 0)], "M", 0, [("int", "none", "a")])
    assert one == logical_identity(["N"], [("T", 0)], "M", 0, [("int", "none", "b")]) != logical_identity(["N"], [("T", 0)], "K", 0, [("int", "none", "a")])
    assert physical_identity(one, "a\\b.cs", (1, 1, 2, 2)) == physical_identity(one, "a/b.cs", (1, 1, 2, 2))
    assert len(canonical_hash(["x"], 16)) == 16
    with pytest.raises(ValueError):
        canonical_hash(["x"], 15)


def test_tools(spark, tmp_path):
    s = symbols(spark, *[(f"s{i:02d}", f"RepositoryThing{i}", "src/A.cs") for i in range(12)])
    lines = spark.createDataFrame([("src/A.cs", i, f"line {i}") for i in range(1, 6)], "file_path string, line_no int, line string")
    t = Tools(spark, ingest.Catalog(str(tmp_path / "c.json")), f"file://{tmp_path}/data", lambda _: lines, lambda _: (s, edges(spark, ("e", "s00", "s01"))))
    assert t.open_repository(str(tmp_path), "repo")["symbols"] == 12
    assert len(t.search_symbols("repo", "repositorything", 3)["items"]) == 3 and t.search_symbols("repo", "repositorything", 3)["truncated"]
    assert t.find_callers("repo", "s01")["edges"][0]["source_id"] == "s00"
    assert t.get_source("repo", "src/A.cs", 2, 3)["content"] == "line 2\nline 3"
    for outside in ("../etc/passwd", "/etc/passwd", "src/../../x.cs"):
        with pytest.raises(PermissionError):
            t.get_source("repo", outside)
    assert t.find_callees("repo", "s00")["nodes"] and t.find_references("repo", "s00")["edges"] == [] and t.get_graph("repo", "s00", 1)["edges"][0]["target_id"] == "s01"
    assert t.file_outline("repo", "src/A.cs", 5)["truncated"] and not t.file_outline("repo", "src/A.cs")["truncated"]
    assert t.close_repository("repo") == {"closed": "repo"} and t.get_symbol("repo", "s00")["outgoing"][0]["target_id"] == "s01"
    done = t.batch([{"tool": "list_files", "arguments": {"repository_id": "repo"}}, {"tool": "batch"}, {"tool": "get_symbol", "arguments": {"repository_id": "repo", "symbol_id": "?"}}])
    assert [("result" in r) for r in done["results"]] == [True, False, False] and not done["truncated"]
    with pytest.raises(ValueError):
        t.batch([{}] * 11)
    assert t.repo_overview("repo")["symbols"] == 12
    assert t.exclude_path("repo", "A.cs") == {"symbolsRemoved": 12}
    t.remove_repository("repo", delete_data=True)
    assert t.list_repositories() == []


def test_module_registry(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.ts").write_text(SHAPES)
    t = Tools(spark, ingest.Catalog(str(tmp_path / "c.json")), f"file://{tmp_path}/data")
    found = t.open_repository(str(tmp_path / "code"), "repo", enabled_modules=["typescript-syntax", "csharp-roslyn"])
    assert found["symbols"] > 5 and any("csharp-roslyn failed" in d for d in t.repository_status("repo", True)["diagnostics"])
    modules.register(modules.Module("notes", lambda spark, entry: (symbols(spark, ("n", "Note", "n.txt", "note", "notes")), edges(spark))))
    assert "notes" in t.list_modules()
    t.open_repository(str(tmp_path / "code"), "repo", reindex=True, enabled_modules=["notes"])
    assert t.search_symbols("repo", "note")["items"][0]["id"] == "n"
    with pytest.raises(ValueError):
        t.open_repository("/r", "other", enabled_modules=["no such"])


def test_literals_and_positions():
    text = "export const api = {\n  get(a) { return a; },\n  limit: 5,\n  run: async (x) => x,\n  'odd key': 1,\n};\ntype Options = {\n  depth: number;\n  visit(n: string): void\n  name?: string\n};\n"
    found = {(d["name"], d["kind"], d["owner"]) for d in scan_ts.scan(text)[0]}
    assert {("get", "method", "api"), ("limit", "property", "api"), ("run", "method", "api"), ("odd key", "property", "api")} <= found
    assert {("depth", "property", "Options"), ("visit", "method", "Options"), ("name", "property", "Options")} <= found
    lines = scan_ts.Lines(text)
    for at in range(len(text) + 1):
        assert lines.position(at) == (text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1)


def test_declaration_ids(spark):
    rows = [("r", "m", "Méthode", "N.A", "a\\b.cs", 7, 2), ("r", None, "k", "", "x", None, None), ("r", "m", "k", "q", "p", -1, 2**31 - 1)]
    frame = spark.createDataFrame(rows, "repository_id string, module_id string, kind string, qualified_name string, file_path string, start_line int, start_column int")
    want = [canonical_hash([a, b, c, d, e.replace("\\", "/"), f or 0, g or 0]) for a, b, c, d, e, f, g in rows]
    assert [r[0] for r in frame.select(declaration_id()).collect()] == want


def test_query_tokens_are_index_tokens(spark):
    texts = ["ПриветМир v2Test", "HTTPServer_x9 ÄÖü ßStraße", "naïveCafé42b", "日本語テスト abc١٢", "Ǆx ǅy a1B2c3", "x²y ½", "__", "ΑΒγΔ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_sort(text.tokens(F.col("t")))).collect()
    for t, r in zip(texts, got, strict=True):
        assert query_tokens(t) == (r[0] or [t.strip().lower()]), t


def test_length_leaves_null_fields_out(spark):
    s = symbols(spark, ("a", "OneTwo", "x/y.cs")).withColumn("signature", F.lit(None).cast("string"))
    full = 10 * 3 + 4 * 4 + 1 * 3
    assert [r[0] for r in s.select(document_length()).collect()] == [full]
    assert {r["lexeme"] for r in term_frequencies(s).collect()} == {"onetwo", "one", "two", "n", "x", "y", "cs"}


def test_sessions_by_time(spark):
    rng = random.Random(8)
    at, rows = 0, []
    for i in range(700):
        at += rng.choice([0, 1, 749_999, 750_000, 750_001, 3_000_000, 900_000_000_000 if i % 97 == 0 else 5])
        rows.append((at, rng.choice(["a.cs", "A.cs", "b.cs", "c.cs"])))
    want, run = [], []
    for t, p in rows:
        if run and t - run[-1][0] > 750_000:
            want.append(run)
            run = []
        run.append((t, p))
    want.append(run)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "t long, path string").selectExpr("timestamp_micros(t) as ts", "path")
    got = debounce.sessions(frame).selectExpr("unix_micros(first) as a", "unix_micros(last) as b", "events", "paths").collect()
    assert sorted(map(tuple, got)) == [(r[0][0], r[-1][0], len(r), len({p.lower() for _, p in r})) for r in want]
    assert debounce.sessions(frame.limit(0)).count() == 0


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streamed_changes_reach_a_store_as_they_are_written(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/store", "repo")
    kept.replace(symbols(spark, ("a", "Old", "src/Program.cs"), ("b", "Stays", "src/Other.cs")), edges(spark))
    rows = [("2026-01-01 00:00:00", "src/Program.cs"), ("2026-01-01 00:00:00.5", "src/Program.cs"), ("2026-01-01 00:00:00.6", "SRC/bin/x.cs"), ("2026-01-01 01:00:00", "late.cs")]
    spark.createDataFrame(rows, "ts string, path string").selectExpr("cast(ts as timestamp) as ts", "path").write.parquet(str(tmp_path / "in"))
    asked = []

    def analyze(batch, paths):
        asked.append(paths)
        return symbols(spark, ("a", "New", "src/Program.cs")), edges(spark)

    stream = spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in"))
    drain(debounce.start_incremental(stream, kept, analyze, "csharp-roslyn", str(tmp_path / "cp"), delay="1 second"))
    assert asked == [["src/Program.cs"]] and sorted(r["name"] for r in kept.symbols().collect()) == ["New", "Stays"]


def test_overflow_asks_for_a_full_run(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/store", "repo")
    rows = [(f"2026-01-01 00:00:00.{i:03d}", f"f{i}.cs") for i in range(20)] + [("2026-01-01 01:00:00", "late.cs")]
    spark.createDataFrame(rows, "ts string, path string").selectExpr("cast(ts as timestamp) as ts", "path").write.parquet(str(tmp_path / "in"))
    asked = []

    def analyze(batch, paths):
        asked.append(paths)
        return symbols(spark, ("w", "Whole", "w.cs")), edges(spark)

    stream = spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in"))
    drain(debounce.start_incremental(stream, kept, analyze, "csharp-roslyn", str(tmp_path / "cp"), delay="1 second", most=10))
    assert asked == [None] and [r["name"] for r in kept.symbols().collect()] == ["Whole"]


def test_file_events(spark, tmp_path):
    root = tmp_path / "code"
    (root / "sub").mkdir(parents=True)
    (root / "Keep.cs").write_text("1")
    (root / "Old.cs").write_text("2")
    spark.dataSource.register(file_events.FileEvents)
    reader = file_events.FileEventReader({"path": str(root), "state": str(tmp_path / "state"), "most": "3"})
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == [] and reader.read(start)[1] == start
    (root / "Old.cs").rename(root / "sub" / "New.cs")
    (root / "Keep.cs").write_text("changed")
    rows, end = reader.read(start)
    assert [r[1:] for r in rows] == [("Keep.cs", "changed"), ("Old.cs", "deleted"), ("sub/New.cs", "created")]
    assert [r[1:] for r in reader.readBetweenOffsets(start, end)] == [("Keep.cs", "changed"), ("Old.cs", "deleted"), ("sub/New.cs", "created")]
    for i in range(5):
        (root / f"n{i}.cs").write_text("x")
    assert [r[1:] for r in reader.read(end)[0]] == [("", "overflow")]
    stream = spark.readStream.format(file_events.FORMAT).option("path", str(root)).option("state", str(tmp_path / "state2")).load()
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        (root / "n9.cs").write_text("x")
        for _ in range(40):
            query.processAllAvailable()
            if spark.table("seen").count():
                break
            time.sleep(0.25)
        assert [(r["path"], r["kind"]) for r in spark.table("seen").collect()] == [("n9.cs", "created")]
    finally:
        query.stop()
