"""Store checks on small rows."""

import random

from codeloom import catalog
from codeloom.operators import store_checks as sc

SF = "/root/testdata/sf0.001"


def test_delta_violations_are_all_rows_outside_the_delta(spark):
    rows = catalog.queries()["scan_symbols"](spark, SF).collect()
    outside = {r["id"] for r in rows if not (r["module_id"] == "csharp-roslyn" and r["file_path"] == "src/customers/building.cs")}
    assert {r["id"] for r in catalog.queries()["delta_violations"](spark, SF).collect()} == outside


def test_enclosing_falls_back_on_the_module(spark):
    rng = random.Random(3)
    spans = [("d%03d" % i, f"f{i % 3}", a, a + rng.choice([-1, 0, 1, 5, 64, 700])) for i in range(120) for a in [rng.randrange(1, 900)]] + [("whole", "f0", 0, 2**31 - 1)]
    uses = [("u%03d" % i, f"f{i % 5}", rng.randrange(0, 1800)) for i in range(300)] + [("none", "f1", None)]
    modules = [("m1", "f1"), ("m2", "f2"), ("m3", "f3")]
    want = {}
    for u, f, line in uses:
        around = [(e - s, -s, d) for d, g, s, e in spans if g == f and line is not None and s <= line <= e]
        want[u] = min(around)[2] if around else dict((g, m) for m, g in modules).get(f)
    frames = spark.createDataFrame(spans, "id string, file_path string, start_line int, end_line int"), spark.createDataFrame(uses, "id string, file_path string, line int")
    got = sc.enclosing(*frames, spark.createDataFrame(modules, "id string, file_path string")).collect()
    assert len(got) == len(uses) and {r["edge_id"]: r["owner_id"] for r in got} == want
    inner = {u for u, d in want.items() if d is not None and not d.startswith("m")}
    assert {r["edge_id"] for r in sc.enclosing(*frames).collect()} == inner


def test_every_relationship_is_asked_for_its_declaration(spark):
    every = catalog.queries()["scan_relationships"](spark, SF).count()
    assert catalog.queries()["enclosing_symbol"](spark, SF).count() == every


def test_every_file_has_a_project_score(spark):
    rows = [(f"a/b/f{i}.cs",) for i in range(30)] * 2 + [("x/y/z.SLN",), ("r.csproj",)]
    got = {r["file_path"]: r["score"] for r in sc.project_scores(spark.createDataFrame(rows, "file_path string")).collect()}
    assert len(got) == 32 and got["x/y/z.SLN"] == 19 and got["r.csproj"] == 0 and got["a/b/f7.cs"] == -1
