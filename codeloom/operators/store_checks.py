"""Checks and merges that a commit makes, and the joins of the syntax analyzers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status(segments: DataFrame) -> DataFrame:
    """Segments, symbols and relationships, from counts by module and file."""
    return segments.agg(F.count("*").alias("segments"), F.sum("symbols").alias("symbols"), F.sum("relationships").alias("relationships"))


def merge(current: DataFrame, upserts: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """Rows of ``current`` whose key is neither upserted nor removed, and the upserts."""
    gone = upserts.select(*keys).distinct()
    if removed is not None:
        gone = gone.unionByName(removed.select(*keys)).distinct()
    return current.join(gone, keys, "left_anti").select(current.columns).unionByName(upserts.select(current.columns))


def identity_violations(rows: DataFrame) -> DataFrame:
    """``id`` and ``problem``: ``duplicate`` where an id is in two files or modules, ``conflicting``
    where rows of one file differ. Equal rows of one file are no violation."""
    key = F.struct("module_id", "file_path")
    every = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)])
    found = rows.groupBy("id").agg(F.min(key).alias("k0"), F.max(key).alias("k1"), F.min(every).alias("h0"), F.max(every).alias("h1"))
    problem = F.when(F.col("k0") != F.col("k1"), "duplicate").when(F.col("h0") != F.col("h1"), "conflicting")
    return found.select("id", problem.alias("problem")).where("problem is not null")


def delta_violations(rows: DataFrame, module: str, files: list[str]) -> DataFrame:
    """Rows outside the module and files that a delta declares."""
    files = [f.replace("\\", "/") for f in files]
    return rows.where((F.col("module_id") != module) | ~F.col("file_path").isin(files))


def row_violations(rows: DataFrame, repository: str) -> DataFrame:
    """Rows of another repository or with a blank key column."""
    blank = F.lit(False)
    for c in ("id", "module_id", "file_path", *(["source_id", "target_id"] if "source_id" in rows.columns else [])):
        blank = blank | F.col(c).isNull() | (F.trim(c) == "")
    return rows.where(blank | (F.col("repository_id") != repository))


def parity(stored: DataFrame, packed: DataFrame) -> DataFrame:
    """``problem`` and ``id`` of rows that only one of both has, or that differ."""
    columns = [c for c in stored.columns if c != "id"]
    every = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    a, b = stored.select("id", every.alias("x")), packed.select("id", every.alias("y"))
    problem = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "different")
    return a.join(b, "id", "full_outer").select(problem.alias("problem"), "id").where("problem is not null")


def resolve_by_name(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges led to the first symbol that has their target's name, modules left out."""
    first = symbols.where("kind <> 'module'").groupBy("name").agg(F.min("id").alias("resolved_id"))
    named = edges.select(F.col("id").alias("edge_id"), F.col("target_id")).join(symbols.select(F.col("id").alias("target_id"), "name"), "target_id")
    return named.join(first, "name").select("edge_id", "name", "resolved_id")


#: Blocks of 1 to 2^31 lines: any range of ints from 0 on.
LEVELS = 32


def enclosing(declarations: DataFrame, uses: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """For each use (``id``, ``file_path``, ``line``) the shortest declaration of its file around it.

    With ``modules``, a use outside any declaration has its file's module symbol, or null where
    the file has none; without, it is left out. A declaration is cut into the aligned blocks
    of 2^k lines that make it up, and each line looks its blocks up, so that no file's uses meet all
    of its declarations.
    """
    blocks = F.expr(
        f"""filter(flatten(transform(sequence(0, {LEVELS - 1}), k -> transform(
              array(named_struct('l', shiftright(cast(start_line as bigint) + shiftleft(1L, k) - 1, k), 'r', shiftright(cast(end_line as bigint) + 1, k))),
              x -> array(named_struct('level', k, 'block', if(x.l < x.r and x.l % 2 <> 0, x.l, null)),
                         named_struct('level', k, 'block', if(x.l < x.r and x.r % 2 <> 0, x.r - 1, null))))[0])), b -> b.block is not null)"""
    )
    rank = F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), (-F.col("start_line")).alias("start"), F.col("id").alias("owner_id"))
    cut = declarations.select("file_path", rank.alias("rank"), F.explode(blocks).alias("b")).select("file_path", "rank", "b.*")
    cut = cut.groupBy("file_path", "level", "block").agg(F.min("rank").alias("rank"))
    lines = uses.select("file_path", "line").where("line is not null").distinct()
    up = F.expr(f"transform(sequence(0, {LEVELS - 1}), k -> named_struct('level', k, 'block', shiftright(cast(line as bigint), k)))")
    lines = lines.select("file_path", "line", F.explode(up).alias("b")).select("file_path", "line", "b.*")
    owners = lines.join(cut, ["file_path", "level", "block"]).groupBy("file_path", "line").agg(F.min("rank")["owner_id"].alias("owner_id"))
    found = uses.select(F.col("id").alias("edge_id"), "file_path", "line").join(owners, ["file_path", "line"], "inner" if modules is None else "left")
    if modules is not None:
        own = modules.groupBy("file_path").agg(F.min("id").alias("__module"))
        found = found.join(own, "file_path", "left").withColumn("owner_id", F.coalesce("owner_id", "__module"))
    return found.select("edge_id", "owner_id")


#: What a specifier may leave out, in the order that is tried.
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts")


def resolve_paths(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``importer``, ``spec`` and ``resolved``: the file a resolved specifier names, by the
    first suffix that fits without regard to case."""
    tries = imports.select("importer", "spec", F.posexplode(F.array(*[F.concat(F.lower("spec"), F.lit(s)) for s in IMPORT_SUFFIXES])).alias("k", "wanted"))
    files = paths.select("file_path", F.lower("file_path").alias("wanted"))
    found = tries.join(files, "wanted").groupBy("importer", "spec").agg(F.min_by("file_path", F.struct("k", "file_path")).alias("resolved"))
    return found


def resolve_imports(symbols: DataFrame) -> DataFrame:
    """Each file imported by a specifier that is its path in upper case, without ``.ts``."""
    files = symbols.select("file_path").distinct()
    imports = files.select(F.col("file_path").alias("importer"), F.upper(F.regexp_replace("file_path", r"\.ts$", "")).alias("spec"))
    return resolve_paths(imports, files)


def textual_evidence(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Identifiers of four characters or more with a capital or underscore, and how often."""
    plain = F.regexp_replace(F.col(text), r"[^\x00-\x7F]", " ")
    words = F.expr(r"regexp_extract_all(plain, '\\b[A-Za-z_][A-Za-z0-9_]{3,}\\b', 0)")
    rows = docs.select(key, plain.alias("plain")).select(key, F.explode(words).alias("token"))
    return rows.where(F.col("token").rlike("[A-Z_]")).groupBy(key, "token").agg(F.count("*").alias("n"))


def project_scores(symbols: DataFrame) -> DataFrame:
    """The score of every file as the project to open: solutions first, then the least deep."""
    depth = F.size(F.split("file_path", "/")) - 1
    score = F.when(F.lower("file_path").endswith(".sln"), 20).otherwise(0) - F.greatest(F.lit(0), depth - 1)
    return symbols.select("file_path").distinct().select("file_path", score.alias("score"))


def project_score(symbols: DataFrame) -> DataFrame:
    """The project to open: the best of ``project_scores``, the shortest and first path of equals."""
    return project_scores(symbols).orderBy(F.desc("score"), F.length("file_path"), "file_path").limit(1)


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(rank)).where("rn = 1").drop("rn")
