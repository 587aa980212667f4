"""The store's commits: what readers see after each, after crashes, and between two writers."""

import os
import time

import pytest

from codeloom.operators import graph, overview, search
from codeloom.sources import store as module
from codeloom.sources.store import ConcurrentWriteError, FileDelta, Store, StoreError, ViolationError
from tests.rows import edges, symbols

SHARP = "csharp-roslyn"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/shelf"


@pytest.fixture
def store(spark, root):
    return Store(spark, root, "repo")


def names(store):
    return sorted(r["name"] for r in store.symbols().collect())


def kitchen(spark):
    s = symbols(spark, ("oven", "PreheatOven", "kitchen/Oven.cs"), ("dough", "KneadDough", "kitchen/Dough.cs"), ("till", "RingTill", "shop/Till.cs"), ("memo", "flourMemo", "shop/Till.cs", "textual-evidence"))
    return s, edges(spark, ("bake", "dough", "oven", "calls", "kitchen/Dough.cs"), ("sell", "till", "dough", "references", "shop/Till.cs"), ("lost", "till", "gone", "calls", "shop/Till.cs"))


def test_readers_and_the_pack_agree(spark, store):
    s, r = kitchen(spark)
    store.replace(s, r, generation="monday")
    pack = store.pack()
    s, r = store.symbols(), store.relationships()
    for index, frame in ((None, s), (pack.index(), pack.table("symbols"))):
        assert [(h["id"], h["score"]) for h in search.search(frame, "kneaddough", index=index).collect()] == [("dough", 100.0)]
        assert [h["id"] for h in search.search(frame, "heat", index=index).collect()] == ["oven"]
        scores = {h["id"]: h["score"] for h in search.search(frame, "flour", index=index, include_textual=True).collect()}
        assert set(scores) == {"memo"} and scores["memo"] > 10
    for adjacency in (None, pack.adjacency()):
        found = graph.traverse(s, r, "oven", 2, 20, adjacency=adjacency)
        assert {n["id"] for n in found.nodes.collect()} == {"oven", "dough", "till"} and {x["id"] for x in found.edges.collect()} == {"bake", "sell"}
        detail = graph.symbol_detail(s, r, "dough", adjacency=adjacency)
        assert [x["id"] for x in detail["outgoing"].collect()] == ["bake"] and [x["id"] for x in detail["incoming"].collect()] == ["sell"]
    assert [(f["file_path"], f["symbol_count"]) for f in overview.list_rollup(pack.table("files"), "shop").collect()] == [("shop/Till.cs", 1)]
    assert {h["id"]: h["degree"] for h in overview.hubs(pack.table("symbols")).collect()} == {"dough": 2, "oven": 1, "till": 1}
    assert store.verify() == {"valid": True, "problems": [], "resolved": 2}


def test_a_file_commit_writes_that_file_only(spark, store, tmp_path):
    store.replace(*kitchen(spark), generation="monday")
    store.replace_files(SHARP, ["shop\\Till.cs"], symbols(spark, ("till", "OpenTill", "shop/Till.cs")), edges(spark), "tuesday")
    assert names(store) == ["KneadDough", "OpenTill", "PreheatOven"] and store.relationships().count() == 1
    assert store.status()["symbols"] == 3 and store.status()["relationships"] == 1 and store.status()["generation"] == "tuesday"
    newest = max((tmp_path / "shelf" / "data").iterdir(), key=lambda p: p.name)
    assert newest.name.startswith("2-") and spark.read.parquet(f"file://{newest}/0/symbols").count() == 1
    assert [x["name"] for x in store.segment(SHARP, "shop/Till.cs")[0].collect()] == ["OpenTill"]
    store.replace_files(SHARP, ["kitchen/Oven.cs", "shop/Till.cs"], symbols(spark, ("grill", "HeatGrill", "kitchen/Oven.cs")), edges(spark), "wednesday")
    assert names(store) == ["HeatGrill", "KneadDough"] and store.verify()["valid"]


def test_many_file_commits_are_written_anew(spark, store, monkeypatch):
    monkeypatch.setattr(module, "MOST_PARTS", 2)
    store.replace(symbols(spark, *[(f"i{k}", f"N{k}", f"f{k}.cs") for k in range(3)]), edges(spark))
    for k in range(4):
        store.replace_files(SHARP, [f"f{k % 3}.cs"], symbols(spark, (f"i{k % 3}", f"M{k}", f"f{k % 3}.cs")), edges(spark))
        assert len(store.current().segments[SHARP].parts) <= 2 and store.status()["symbols"] == 3
    assert names(store) == ["M1", "M2", "M3"]


def test_deltas_outside_their_files_are_rejected(spark, store):
    store.replace(*kitchen(spark), generation="monday")
    stray = symbols(spark, ("x", "X", "kitchen/Dough.cs"))
    other = symbols(spark, ("x", "X", "shop/Till.cs", "class", "typescript-syntax"))
    for bad in (stray, other):
        with pytest.raises(ViolationError):
            store.replace_files(SHARP, ["shop/Till.cs"], bad, edges(spark))
    with pytest.raises(ViolationError):
        store.replace_files(SHARP, ["shop/Till.cs"], symbols(spark), edges(spark, ("e", "till", "oven", "calls", "kitchen/Oven.cs")))
    with pytest.raises(ViolationError):
        store.apply_mutation({}, [FileDelta(SHARP, ["shop/Till.cs"], symbols(spark), edges(spark)), FileDelta(SHARP, ["shop\\Till.cs"], symbols(spark), edges(spark))])
    with pytest.raises(ViolationError):
        store.apply_mutation({SHARP: (symbols(spark), edges(spark))}, [FileDelta(SHARP, ["a.cs"], symbols(spark), edges(spark))])
    assert store.status()["generation"] == "monday" and store.status()["sequence"] == 1


def test_ids_are_of_one_file(spark, store):
    store.replace(*kitchen(spark))
    with pytest.raises(ViolationError):
        store.replace_files(SHARP, ["new.cs"], symbols(spark, ("oven", "PreheatOven", "new.cs")), edges(spark))
    for bad in (symbols(spark, ("k", "A", "p.cs"), ("k", "A", "q.cs")), symbols(spark, ("k", "A", "p.cs"), ("k", "B", "p.cs")), symbols(spark, (" ", "A", "p.cs"))):
        with pytest.raises(ViolationError):
            store.replace(bad, edges(spark))
    assert store.status()["sequence"] == 1
    # A file may take over an id when the file that had it goes in the same commit.
    store.replace_files(SHARP, ["new.cs", "kitchen/Oven.cs"], symbols(spark, ("oven", "PreheatOven", "new.cs"), ("oven", "PreheatOven", "new.cs")), edges(spark))
    assert store.status()["symbols"] == 4


def test_purge_and_modules(spark, store):
    s, r = kitchen(spark)
    s = s.unionByName(symbols(spark, ("page", "Page", "web/page.ts", "class", "typescript-syntax")))
    store.replace(s, r)
    assert store.purge_path("KITCHEN/") == 2 and names(store) == ["Page", "RingTill", "flourMemo"]
    assert graph.symbol_detail(store.symbols(), store.relationships(), "till")["outgoing"].count() == 0
    store.replace(symbols(spark, ("van", "DriveVan", "van.cs"), ("page", "Ignored", "web/page.ts", "class", "typescript-syntax")), edges(spark), modules=[SHARP])
    assert names(store) == ["DriveVan", "Page"]
    store.replace(symbols(spark, ("van", "DriveVan", "van.cs")), edges(spark))
    assert names(store) == ["DriveVan"] and store.status()["modules"] == [SHARP]


def test_a_module_that_fails_keeps_its_rows(spark, store):
    store.replace(symbols(spark, ("a", "A", "a.cs"), ("t", "T", "t.ts", "class", "typescript-syntax")), edges(spark))
    broken = symbols(spark).selectExpr("*", "raise_error('no compiler') as x").drop("x")
    fails = symbols(spark, ("t", "U", "t.ts", "class", "typescript-syntax")).selectExpr("* except (name)", "cast(raise_error('no compiler') as string) as name").select(broken.columns)
    store.run_modules({SHARP: lambda: (symbols(spark, ("b", "B", "b.cs")), edges(spark)), "typescript-syntax": lambda: (fails, edges(spark))})
    assert names(store) == ["B", "T"]
    assert [d.startswith("typescript-syntax failed") for d in store.status()["diagnostics"]] == [True]


POINTS = "before-lease after-lease before-segments before-part after-part after-segments after-compaction before-checks before-manifest after-manifest before-pointer after-pointer before-vacuum after-vacuum after-release".split()


@pytest.mark.parametrize("point", POINTS)
def test_a_crash_leaves_one_of_both_states(spark, root, point):
    Store(spark, root, "repo").replace(symbols(spark, ("p", "Before", "p.cs")), edges(spark), generation="old")

    def fault(at):
        if at == point:
            raise RuntimeError(at)

    with pytest.raises(RuntimeError):
        Store(spark, root, "repo", fault).replace(symbols(spark, ("q", "During", "p.cs")), edges(spark), generation="new")
    after = Store(spark, root, "repo")
    assert names(after) == (["During"] if POINTS.index(point) >= POINTS.index("after-pointer") else ["Before"])
    after.replace(symbols(spark, ("r", "After", "p.cs")), edges(spark))
    assert names(after) == ["After"] and after.verify()["valid"]


def test_of_two_writers_one_is_told(spark, root):
    first = Store(spark, root, "repo")
    first.replace(symbols(spark, ("p", "Start", "p.cs")), edges(spark))
    told = []

    def meanwhile(at):
        if at in ("after-lease", "before-manifest", "after-manifest"):
            with pytest.raises(ConcurrentWriteError):
                Store(spark, root, "repo").replace(symbols(spark, ("s", "Second", "s.cs")), edges(spark))
            told.append(at)

    Store(spark, root, "repo", meanwhile).replace(symbols(spark, ("f", "First", "f.cs")), edges(spark))
    assert names(first) == ["First"] and len(told) == 3
    # One that planned on the state before is told as well, and the lease is free again.
    with pytest.raises(ConcurrentWriteError):
        first.apply_mutation({SHARP: (symbols(spark), edges(spark))}, expected=1)
    first.replace(symbols(spark, ("s", "Second", "s.cs")), edges(spark))
    assert names(first) == ["Second"]


def test_a_dead_writers_lease_ends(spark, store, tmp_path):
    store.replace(symbols(spark, ("p", "P", "p.cs")), edges(spark))
    lease = tmp_path / "shelf" / "lease-2"
    lease.write_text("a writer that was killed")
    with pytest.raises(ConcurrentWriteError):
        store.replace(symbols(spark, ("q", "Q", "q.cs")), edges(spark))
    os.utime(lease, (time.time() - 2 * module.LEASE_SECONDS,) * 2)
    store.replace(symbols(spark, ("q", "Q", "q.cs")), edges(spark))
    assert names(store) == ["Q"] and not lease.exists()


def test_a_damaged_pointer_or_manifest_is_passed_over(spark, store, tmp_path):
    store.replace(symbols(spark, ("p", "Older", "p.cs")), edges(spark))
    store.replace(symbols(spark, ("p", "Newer", "p.cs")), edges(spark))
    shelf = tmp_path / "shelf"
    kept = shelf / store.current().manifest
    for crc in shelf.glob(".*.crc"):
        crc.unlink()
    whole = kept.read_text()
    kept.write_text(whole[: len(whole) // 2])
    assert names(store) == ["Older"]
    kept.write_text(whole)
    assert names(store) == ["Newer"]


def test_snapshots_diagnostics_and_leftovers(spark, store, tmp_path):
    made = store.replace(symbols(spark, ("p", "P", "p.cs")), edges(spark), diagnostics=["slow", "  ", "slow", "odd"])
    assert made.diagnostics == ["slow", "odd"]
    assert store.apply_mutation({}, preserve_diagnostics=True).sequence == made.sequence == 1
    old = store.symbols()
    store.pack().table("terms")
    for k in range(3):
        store.replace(symbols(spark, ("q", f"Q{k}", "q.cs")), edges(spark))
        if not k:
            assert [r["id"] for r in old.collect()] == ["p"]
    shelf = tmp_path / "shelf"
    assert len(list((shelf / "data").iterdir())) == 2 and len(list(shelf.glob("manifest-*"))) == 2
    assert not list((shelf / "packs").iterdir()) and not list(shelf.glob("lease-*"))
    store.delete()
    assert not shelf.exists() and store.status()["sequence"] == 0 and issubclass(ConcurrentWriteError, StoreError)
