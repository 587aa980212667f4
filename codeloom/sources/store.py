"""A store of immutable generations with atomic, optimistic commits.

A generation's manifest names, for each module, its parts: Parquet tables of symbols and relationships.
The first part has all files of the module; each later one has the rows of some files and the
list of those files, whose rows in earlier parts no longer count. So a commit writes the rows of
the files it changes only; a module of many parts is written anew. Then come the manifest and
one of two pointer files in turn; readers open the newest pointer whose manifest is whole. A
reader's frames are over fixed paths, so commits don't change them. A writer holds the lease of the
sequence it is to publish, a file that only one writer can create.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import contains, normalize_path
from codeloom.operators.edges import resolved
from codeloom.operators.store_checks import identity_violations, parity, row_violations
from codeloom.schema import MAX_DIAGNOSTICS, RELATIONSHIP, SYMBOL
from codeloom.sources.files import SmallFiles
from codeloom.sources.pack import Pack
from codeloom.sources.shared import cut

#: A module of more parts is written anew.
MOST_PARTS = 8
#: A lease that old is a dead writer's.
LEASE_SECONDS = 900
TABLES = (("symbols", SYMBOL), ("relationships", RELATIONSHIP))


class StoreError(Exception):
    pass


class ConcurrentWriteError(StoreError):
    pass


class ViolationError(StoreError):
    pass


@dataclass
class Part:
    """Tables of rows, and the table of the files (``file_path``) they replace; None for a whole module."""

    symbols: str
    relationships: str
    files: str | None = None


@dataclass
class Segment:
    parts: list[Part]
    symbol_count: int
    relationship_count: int


@dataclass
class Generation:
    sequence: int = 0
    generation: str | None = None
    indexed_at: int = 0
    diagnostics: list[str] = field(default_factory=list)
    segments: dict[str, Segment] = field(default_factory=dict)
    manifest: str = ""


@dataclass
class FileDelta:
    """The rows of some files of a module. ``files`` are paths, or a frame of distinct ``file_path``."""

    module_id: str
    files: list[str] | DataFrame
    symbols: DataFrame
    relationships: DataFrame


def merged_diagnostics(old: list[str], new: list[str], preserve: bool) -> list[str]:
    """Distinct non-blank lines, 200 at most, after the old ones where those are kept."""
    return list(dict.fromkeys(d for d in [*(old if preserve else []), *new] if d.strip()))[:MAX_DIAGNOSTICS]


class Store:
    def __init__(self, spark: SparkSession, root: str, repository_id: str, fault: Callable[[str], None] | None = None):
        self.spark, self.root, self.repository_id = spark, root.rstrip("/"), repository_id
        self.fault = fault or (lambda point: None)
        self._files_at = SmallFiles(spark, self.root)
        self._fs, self._path = self._files_at.fs, self._files_at.path
        self._read, self._write, self._create = self._files_at.read, self._files_at.write, self._files_at.create

    @contextmanager
    def _lease(self, sequence: int, expected: int) -> Iterator[Callable[[], None]]:
        """Holds the right to publish ``sequence`` on top of ``expected``; gives a check that it still does."""
        name, own = f"lease-{sequence}", uuid.uuid4().hex
        self.fault("before-lease")
        if not self._create(name, own):
            p = self._path(f"{self.root}/{name}")
            if self._fs.exists(p) and time.time() - self._fs.getFileStatus(p).getModificationTime() / 1000 > LEASE_SECONDS:
                self._fs.delete(p, False)
            if not self._create(name, own):
                raise ConcurrentWriteError(f"another writer is about to publish {sequence}")

        def check() -> None:
            if self._read(name) != own or self.current().sequence != expected:
                raise ConcurrentWriteError(f"the store is not at sequence {expected} any more")

        try:
            check()
            self.fault("after-lease")
            yield check
        finally:
            if self._read(name) == own:
                self._fs.delete(self._path(f"{self.root}/{name}"), False)

    @staticmethod
    def _sealed(body: str) -> str:
        return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})

    @staticmethod
    def _opened(text: str | None) -> dict | None:
        try:
            outer = json.loads(text or "")
            return json.loads(outer["body"]) if outer["crc"] == zlib.crc32(outer["body"].encode()) else None
        except (ValueError, KeyError, TypeError):
            return None

    def generations(self) -> list[Generation]:
        """Valid generations that a pointer names, newest first."""
        out = []
        for slot in ("pointer-a.json", "pointer-b.json"):
            pointer = self._opened(self._read(slot))
            manifest = pointer and self._opened(self._read(pointer["manifest"]))
            if manifest and manifest["sequence"] == pointer["sequence"]:
                segments = {k: Segment([Part(**p) for p in v.pop("parts")], **v) for k, v in manifest.pop("segments").items()}
                if all(self._fs.exists(self._path(f"{path}/_SUCCESS")) for s in segments.values() for p in s.parts for path in asdict(p).values() if path):
                    out.append(Generation(segments=segments, manifest=pointer["manifest"], **manifest))
        return sorted(out, key=lambda g: -g.sequence)

    def current(self) -> Generation:
        return next(iter(self.generations()), Generation())

    def _table(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _rows(self, segments: list[Segment], name: str, schema: str) -> DataFrame:
        """The rows of modules: those of each part whose files no later part has."""
        out = None
        for s in segments:
            later: DataFrame | None = None
            for p in reversed(s.parts):
                rows = self._table(getattr(p, name), schema)
                if later is not None:
                    rows = rows.join(later, "file_path", "left_anti").select(rows.columns)
                out = rows if out is None else out.unionByName(rows)
                if p.files:
                    files = self._table(p.files, "file_path string")
                    later = files if later is None else later.unionByName(files)
        return self.spark.createDataFrame([], schema) if out is None else out

    def symbols(self, at: Generation | None = None) -> DataFrame:
        return self._rows(list((at or self.current()).segments.values()), *TABLES[0])

    def relationships(self, at: Generation | None = None) -> DataFrame:
        return self._rows(list((at or self.current()).segments.values()), *TABLES[1])

    def segment(self, module_id: str, file_path: str) -> tuple[DataFrame, DataFrame]:
        """The symbols and relationships of one file of a module. Parts are sorted by file."""
        found = [s for m, s in self.current().segments.items() if m == module_id]
        path = file_path.replace("\\", "/")
        return tuple(self._rows(found, *t).where(F.col("file_path") == path) for t in TABLES)

    def pack(self, at: Generation | None = None) -> Pack | None:
        """The tables derived from a generation; None before the first commit."""
        at = at or self.current()
        if not at.sequence:
            return None
        return Pack(self.spark, f"{self.root}/packs/{at.manifest.removesuffix('.json')}", lambda: self.symbols(at), lambda: self.relationships(at))

    def replace(self, symbols: DataFrame, relationships: DataFrame, modules: list[str] | None = None, generation: str | None = None, diagnostics: list[str] | None = None) -> Generation:
        """All rows, or those of the named modules only; rows of other modules are then ignored."""
        if modules is None:
            found = [r["module_id"] for r in symbols.select("module_id").union(relationships.select("module_id")).distinct().collect()]
            return self.apply_mutation({m: (symbols, relationships) for m in found}, replace_all=True, generation=generation, diagnostics=diagnostics)
        return self.apply_mutation({m: (symbols, relationships) for m in modules}, generation=generation, diagnostics=diagnostics)

    def replace_files(self, module_id: str, files: list[str] | DataFrame, symbols: DataFrame, relationships: DataFrame, generation: str | None = None) -> Generation:
        return self.apply_mutation({}, [FileDelta(module_id, files, symbols, relationships)], generation=generation, preserve_diagnostics=True)

    def run_modules(self, analyzers: dict[str, Callable[[], tuple[DataFrame, DataFrame]]], generation: str | None = None) -> Generation:
        """Replaces the rows of each module that its analyzer can give. One that fails keeps its rows,
        and a diagnostic says so; if all fail only the diagnostics change."""
        done, said = {}, []
        for m, analyze in analyzers.items():
            try:
                done[m] = tuple(cut(rows.where(F.col("module_id") == m)) for rows in analyze())
            except Exception as error:
                said.append(f"{m} failed: {str(error).splitlines()[0][:200] if str(error) else type(error).__name__}")
        return self.apply_mutation(done, generation=generation, diagnostics=said)

    def apply_mutation(
        self, modules: dict[str, tuple[DataFrame, DataFrame]], deltas: list[FileDelta] | None = None, replace_all: bool = False, generation: str | None = None,
        diagnostics: list[str] | None = None, preserve_diagnostics: bool = False, expected: int | None = None,
    ) -> Generation:
        """One atomic commit. Rejected rows leave the store as it was; without any change the
        current generation is returned."""
        base = self.current()
        expected = base.sequence if expected is None else expected
        deltas = deltas or []
        if {d.module_id for d in deltas} & set(modules):
            raise ViolationError("a module is both replaced and patched")
        patched: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}
        for m in dict.fromkeys(d.module_id for d in deltas):
            own = [d for d in deltas if d.module_id == m]
            frames = []
            for d in own:
                files = self._files(d.files)
                for rows in (d.symbols, d.relationships):
                    rows = rows.select("module_id", normalize_path(F.col("file_path")).alias("file_path"))
                    if not rows.where(F.col("module_id") != m).isEmpty() or not rows.join(files, "file_path", "left_anti").isEmpty():
                        raise ViolationError("a delta has rows outside its module and files")
                frames.append(files)
            files, symbols, relationships = frames[0], own[0].symbols, own[0].relationships
            for d, more in zip(own[1:], frames[1:], strict=True):
                files, symbols, relationships = files.unionByName(more), symbols.unionByName(d.symbols), relationships.unionByName(d.relationships)
            twice = files.groupBy("file_path").count().where("count > 1").limit(1).collect()
            if twice:
                raise ViolationError(f"file {twice[0]['file_path']} is listed twice")
            patched[m] = files, symbols, relationships
        lines = merged_diagnostics(base.diagnostics, diagnostics or [], preserve_diagnostics)
        whole = {m: tuple(rows.where(F.col("module_id") == m) for rows in pair) for m, pair in modules.items()}
        gone = [m for m in base.segments if replace_all and m not in whole and m not in patched]
        if not whole and not patched and not gone and lines == base.diagnostics:
            return base
        return self._commit(base, whole, patched, gone, lines, generation, expected)

    def _files(self, files: list[str] | DataFrame) -> DataFrame:
        if isinstance(files, list):
            files = self.spark.createDataFrame([(f,) for f in files], "file_path string")
        return files.select(normalize_path(F.col("file_path")).alias("file_path"))

    def _written(self, folder: str, frames: tuple[DataFrame, DataFrame], files: DataFrame | None) -> Part:
        """A part of clean rows, sorted by file."""
        self.fault("before-part")
        for (name, schema), rows in zip(TABLES, frames, strict=True):
            columns = [c.split()[0] for c in schema.split(", ")]
            rows = rows.withColumn("file_path", normalize_path(F.col("file_path"))).select(columns).dropDuplicates()
            rows.repartitionByRange("file_path", "id").sortWithinPartitions("file_path", "id").write.parquet(f"{folder}/{name}")
            if not row_violations(self._table(f"{folder}/{name}", schema), self.repository_id).isEmpty():
                raise ViolationError(f"{name} have blank keys or belong to another repository")
        if files is not None:
            files.coalesce(1).write.parquet(f"{folder}/files")
        self.fault("after-part")
        return Part(f"{folder}/symbols", f"{folder}/relationships", f"{folder}/files" if files is not None else None)

    def _commit(self, base: Generation, whole: dict, patched: dict, gone: list[str], lines: list[str], generation: str | None, expected: int) -> Generation:
        sequence = base.sequence + 1
        with self._lease(sequence, expected) as check:
            folder = f"{self.root}/data/{sequence}-{uuid.uuid4().hex[:8]}"
            segments = {m: s for m, s in base.segments.items() if m not in whole and m not in gone}
            new: list[Part] = []
            self.fault("before-segments")
            for i, m in enumerate(sorted([*whole, *patched])):
                old = base.segments.get(m)
                files = patched[m][0] if m in patched else None
                part = self._written(f"{folder}/{i}", patched[m][1:] if m in patched else whole[m], files)
                parts = [*old.parts, part] if files is not None and old else [part]
                counts = [self._table(getattr(part, name), schema).count() for name, schema in TABLES]
                if len(parts) > 1:
                    listed = self._table(part.files, "file_path string")
                    before = [self._rows([old], *t).join(listed, "file_path", "left_semi").count() for t in TABLES]
                    counts = [had - out + own for had, out, own in zip((old.symbol_count, old.relationship_count), before, counts, strict=True)]
                new.append(part)
                segments[m] = Segment(parts, *counts)
            self.fault("after-segments")
            for i, (m, s) in enumerate(sorted(segments.items())):
                if len(s.parts) > MOST_PARTS:
                    frames = tuple(self._rows([s], *t) for t in TABLES)
                    segments[m] = Segment([self._written(f"{folder}/whole-{i}", frames, None)], s.symbol_count, s.relationship_count)
            self.fault("after-compaction")
            made = Generation(sequence, generation or time.strftime("%Y%m%d%H%M%S", time.gmtime()) + f"{int(time.time() * 1000) % 1000:03d}", int(time.time() * 1000), lines, segments)
            self.fault("before-checks")
            # Only ids that come in can collide with others.
            for name, schema in TABLES if new else ():
                ids = [self._table(getattr(p, name), schema).select("id") for p in new]
                incoming = ids[0]
                for more in ids[1:]:
                    incoming = incoming.unionByName(more)
                met = self._rows(list(segments.values()), name, schema).join(incoming.distinct(), "id", "left_semi")
                bad = identity_violations(met).limit(1).collect()
                if bad:
                    raise ViolationError(f"{bad[0]['problem']} id {bad[0]['id']} in {name}")
            self.fault("before-manifest")
            body = json.dumps({k: v for k, v in asdict(made).items() if k != "manifest"})
            made.manifest = f"manifest-{sequence}-{uuid.uuid4().hex[:8]}.json"
            self._write(made.manifest, self._sealed(body))
            self.fault("after-manifest")
            self.fault("before-pointer")
            check()
            self._write("pointer-a.json" if sequence % 2 == 0 else "pointer-b.json", self._sealed(json.dumps({"sequence": sequence, "manifest": made.manifest})))
            self.fault("after-pointer")
            self.fault("before-vacuum")
            self._vacuum()
            self.fault("after-vacuum")
        self.fault("after-release")
        return made

    def _vacuum(self) -> None:
        """Deletes what no pointer needs, if both pointers are whole: data and packs of other generations up
        to the newest, crashed writers' among them, manifests, and files that never got their names.
        The lease keeps other writers' away."""
        kept = self.generations()
        if len(kept) < 2:
            return
        paths = [path for g in kept for s in g.segments.values() for p in s.parts for path in asdict(p).values() if path]
        used = {path.removeprefix(f"{self.root}/data/").split("/", 1)[0] for path in paths}
        names = {g.manifest for g in kept}
        for folder, keep in (("data", used), ("packs", {n.removesuffix(".json") for n in names}), ("", names)):
            at = self._path(f"{self.root}/{folder}".rstrip("/"))
            for status in self._fs.listStatus(at) if self._fs.exists(at) else []:
                name = status.getPath().getName()
                if folder and name not in keep or not folder and (name.startswith("manifest-") and name not in keep or name.startswith(".") and not name.endswith(".crc") and status.isFile()):
                    self._fs.delete(status.getPath(), True)

    def purge_path(self, pattern: str) -> int:
        """Drops all rows of files whose path contains ``pattern``; returns how many symbols."""
        base = self.current()
        patched, removed = {}, 0
        none = tuple(self.spark.createDataFrame([], schema) for _, schema in TABLES)
        for m, s in base.segments.items():
            frames = [self._rows([s], *t).where(contains(F.col("file_path"), pattern.replace("\\", "/"))) for t in TABLES]
            files = cut(frames[0].select("file_path").unionByName(frames[1].select("file_path")).distinct())
            if not files.isEmpty():
                removed += frames[0].count()
                patched[m] = (files, *none)
        if patched:
            self._commit(base, {}, patched, [], base.diagnostics, base.generation, base.sequence)
        return removed

    def status(self) -> dict:
        """From the manifest alone."""
        g = self.current()
        return {
            "repository_id": self.repository_id, "generation": g.generation, "sequence": g.sequence, "indexed_at": g.indexed_at, "modules": sorted(g.segments),
            "symbols": sum(s.symbol_count for s in g.segments.values()), "relationships": sum(s.relationship_count for s in g.segments.values()), "diagnostics": g.diagnostics,
        }

    def verify(self) -> dict:
        """Counts of the modules against the manifest, ids, resolved edges, and the pack's rows against the parts'."""
        g = self.current()
        problems = []
        for m, s in g.segments.items():
            for (name, schema), n in zip(TABLES, (s.symbol_count, s.relationship_count), strict=True):
                found = self._rows([s], name, schema).count()
                if found != n:
                    problems.append(f"{m}: {found} {name}, the manifest says {n}")
        symbols, relationships = self.symbols(g), self.relationships(g)
        problems += [f"{r['problem']} id {r['id']}" for rows in (symbols, relationships) for r in identity_violations(rows).limit(20).collect()]
        pack = self.pack(g)
        for rows, name in ((symbols, "base"), (relationships, "relationships")) if pack else ():
            problems += [f"{r['problem']} id {r['id']} in the pack" for r in parity(rows, pack.table(name)).limit(20).collect()]
        return {"valid": not problems, "problems": problems, "resolved": resolved(relationships, cut(symbols.select("id"))).count()}

    def delete(self) -> None:
        """Deletes everything, as the one writer of the next generation."""
        at = self.current().sequence
        with self._lease(at + 1, at):
            self._fs.delete(self._path(self.root), True)
