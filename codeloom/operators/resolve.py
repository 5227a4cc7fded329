"""Import resolution: candidate paths in probing order, joined with the listing of what exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import append_extension, normalize_path, parent, to_snake_case
from codeloom.schema import SCRIPT_EXTENSIONS, SKIPPED_DIRECTORIES
from codeloom.session import durable, durable_counted, spread_join
from codeloom.sources.listing import existing

_NONE = "array<string>"


def _script(source: Column, specifier: Column) -> Column:
    """Relative specifiers only: as written if it has a known extension, then with one, then an index file."""
    base = normalize_path(F.concat(parent(source), F.lit("/"), specifier))
    exact = F.when(F.lit(False), base)
    for ext in SCRIPT_EXTENSIONS:
        exact = exact.when(F.endswith(base, F.lit(ext)), base)
    probes = [append_extension(base, e) for e in SCRIPT_EXTENSIONS]
    probes += [F.concat(base, F.lit("/index" + e)) for e in SCRIPT_EXTENSIONS]
    return F.when(specifier.rlike(r"^\.\.?/"), F.array_compact(F.array(exact, *probes)))


def _rust_use(source: Column, specifier: Column, crate_root: Column) -> Column:
    rest = F.regexp_replace(F.regexp_extract(specifier, r"^(?:crate|self|super)::([\s\S]*)$", 1), "::", "/")
    base = (
        F.when(F.startswith(specifier, F.lit("crate::")), crate_root)
        .when(F.startswith(specifier, F.lit("self::")), parent(source))
        .when(F.startswith(specifier, F.lit("super::")), parent(parent(source)))
    )
    whole = F.concat(base, F.lit("/"), rest)
    return F.when(whole.isNotNull(), F.array(F.concat(whole, F.lit(".rs")), F.concat(whole, F.lit("/mod.rs"))))


def _rust_mod(source: Column, specifier: Column) -> Column:
    whole = F.concat(parent(source), F.lit("/"), F.regexp_replace(specifier, "^mod ", ""))
    return F.array(F.concat(whole, F.lit(".rs")), F.concat(whole, F.lit("/mod.rs")))


def _ruby_relative(source: Column, specifier: Column) -> Column:
    joined = F.when(F.startswith(specifier, F.lit("/")), specifier).otherwise(
        F.concat(parent(source), F.lit("/"), specifier)
    )
    base = normalize_path(joined)
    return F.array(base, append_extension(base, ".rb"))


def _elixir(specifier: Column, mix_root: Column) -> Column:
    path = F.array_join(F.transform(F.split(specifier, r"\."), to_snake_case), "/")
    shorter = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "^[^/]*/", ""))
    probes = [F.concat(mix_root, F.lit("/lib/"), p, F.lit(".ex")) for p in (path, shorter)]
    return F.when(mix_root.isNotNull(), F.array_compact(F.array(*probes)))


def _ancestors(path: Column) -> Column:
    parts = F.split(parent(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


# Keeps the rows of a (project, path, …) frame whose path exists.
Exists = Callable[[DataFrame], DataFrame]


def _held(probes: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The probes whose path is ``found``; each different path is asked for once, and may be asked for by any share of the probes."""
    held, rows = durable_counted(found(probes.select("project", "path").distinct()))
    return spread_join(probes, held, ["project", "path"], F.xxhash64(*probes.columns), rows, "left_semi")


def in_listing(listing: DataFrame) -> Exists:
    """Existence by a (project, path) listing of every file and directory, indexed or not."""
    known = listing.select("project", "path").distinct()
    return lambda probes: _held(probes, lambda asked: asked.join(known, ["project", "path"], "left_semi"))


def on_disk(probes: DataFrame) -> DataFrame:
    """Existence by asking the file system about the probed paths only."""
    return _held(probes, existing)


def in_tree(listing: DataFrame) -> Exists:
    """Existence by a listing without skipped folders; these, hidden names and what is inside are asked of the file system."""
    known = listing.select("project", "path").distinct()
    names = "|".join(re.escape(n) for n in sorted(SKIPPED_DIRECTORIES))
    inside = F.expr("substring(path, length(project) + 1)").rlike(rf"/(?:{names}|\.[^/]+)(?:/|$)")

    def found(asked: DataFrame) -> DataFrame:
        listed = asked.filter(~inside).join(known, ["project", "path"], "left_semi")
        return listed.unionByName(existing(asked.filter(inside)))

    return lambda probes: _held(probes, found)


def nearest_roots(paths: DataFrame, exists: Exists, markers: dict[str, str]) -> DataFrame:
    """(project, folder, and a column for each of ``markers``): the closest directory at or above each path's folder that holds the marker.

    Each different folder is looked at once, for all markers together.
    """
    folders = paths.select("project", parent(F.col("source_path")).alias("folder")).distinct()
    marks = F.array(*[F.lit(f"/{m}") for m in markers.values()])
    # A name below the folder, so that the folder itself is among the ancestors.
    above = folders.withColumn("root", F.explode(_ancestors(F.concat("folder", F.lit("/x"))))).withColumn("mark", F.explode(marks))
    marked = exists(above.withColumn("path", F.concat("root", "mark")))
    nearest = [F.max_by(F.when(F.col("mark") == f"/{m}", F.col("root")), F.when(F.col("mark") == f"/{m}", F.length("root"))).alias(c) for c, m in markers.items()]
    return marked.groupBy("project", "folder").agg(*nearest)


def resolve_imports(raw: DataFrame, exists: Exists, strict_compat: bool = False) -> DataFrame:
    """Resolved edges (project, source_path, target_path, specifier, symbols, ord).

    ``raw`` is (project, source_path, specifier, kind, symbols, ord) and is read twice,
    so it should come from a stored parse. Unresolved imports are dropped and the first of
    several equal edges wins.

    ``crate::`` paths start at the crate's ``src`` folder, found beside Cargo.toml; with
    ``strict_compat`` they start at the importing file and so never resolve.
    """
    source, specifier, kind = F.col("source_path"), F.col("specifier"), F.col("kind")
    rooted = raw.withColumn("folder", parent(source))
    roots = nearest_roots(raw.filter(kind.isin("elixir", "rust_use")), exists, {"mix_root": "mix.exs", "crate": "Cargo.toml"})
    roots, rows = durable_counted(roots.withColumn("crate_src", F.concat("crate", F.lit("/src"))).drop("crate"))
    rooted = spread_join(rooted, roots, ["project", "folder"], F.xxhash64("source_path", "ord"), rows, "left")
    crate_root = source if strict_compat else F.coalesce(F.col("crate_src"), source)
    candidates = (
        F.when(kind == "script", _script(source, specifier))
        .when(kind == "rust_use", _rust_use(source, specifier, crate_root))
        .when(kind == "rust_mod", _rust_mod(source, specifier))
        .when(kind == "ruby_require_relative", _ruby_relative(source, specifier))
        .when(kind == "elixir", _elixir(specifier, F.col("mix_root")))
    )
    probes = rooted.select(
        "project", "source_path", "specifier", "symbols", "ord", F.posexplode(candidates).alias("probe", "path")
    )
    hits = exists(durable(probes))
    # The best probe of each written import, then the first of equal edges: one grouping
    # each, both pre-aggregated, and the second on a key that extends the first.
    best = hits.groupBy("project", "source_path", "specifier", "ord").agg(
        F.min_by(F.struct("path", "symbols"), "probe").alias("hit")
    )
    return (
        best.groupBy("project", "source_path", F.col("hit.path").alias("target_path"), "specifier")
        .agg(F.min_by(F.col("hit.symbols"), "ord").alias("symbols"), F.min("ord").alias("ord"))
        .select("project", "source_path", "target_path", "specifier", "symbols", "ord")
    )
