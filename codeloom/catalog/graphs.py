"""Walks, cycles and change impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import fixture as fx
from codeloom.catalog import Catalog
from codeloom.catalog.counts import HOT, hot_files
from codeloom.functions.paths import relative_path
from codeloom.operators import components, cycles, graph, search
from codeloom.schema import ENTRY_SEARCH_LIMIT

catalog = Catalog()
W = fx.with_ctes


def _walk_sql(depth: int, max_results: int) -> str:
    """Level-by-level walk as unrolled CTEs over ``entries(walk, project, path, ord)``."""
    sql = """, e as (select distinct project, source_path s, target_path t from edges),
 l0 as (select walk, project, path n, 0::bigint depth, 'entry' reason, row_number() over (partition by walk order by min(ord)) pos
  from entries group by walk, project, path)"""
    seen = ["l0"]
    for d in range(1, depth + 1):
        union = " union all ".join(f"select walk, n, pos from {x}" for x in seen)
        sql += f""",
 v{d} as ({union}), h{d} as (select walk, max(pos) held from v{d} group by walk),
 c{d} as (select z.walk, z.project, z.nb, min(k) k from (
   select f.walk, f.project, e.t nb, f.pos * 2 k from l{d-1} f join e on e.project = f.project and e.s = f.n
   union all select f.walk, f.project, e.s, f.pos * 2 + 1 from l{d-1} f join e on e.project = f.project and e.t = f.n) z
  join h{d} h on h.walk = z.walk and h.held < {max_results}
  where not exists (select 1 from v{d} v where v.walk = z.walk and v.n = z.nb) group by all),
 l{d} as (select c.walk, c.project, nb n, {d}::bigint depth, case k % 2 when 0 then 'dependency' else 'dependent' end reason,
   held + row_number() over (partition by c.walk order by k, nb) pos from c{d} c join h{d} h on h.walk = c.walk)"""
        seen.append(f"l{d}")
    union = " union all ".join(f"select * from {x}" for x in seen)
    return sql + f""",
 walked as (select * from ({union}) z where pos <= {max_results})
"""


_WALK_ROWS = """select walk, w.project, n as path, ltrim(substr(n, length(w.project) + 1), '/') relative_path, depth, reason, pos,
 coalesce(symbol_names, '') as names from walked w left join files f on f.project = w.project and f.file_path = w.n"""

_HOT_ENTRIES = HOT + ",\nentries as (select project walk, project, file_path path, 0 ord from hot)"
_MANY_ENTRIES = (
    "entries as (select project walk, project, unnest([min(source_path), max(source_path), max(target_path), project || '/not/indexed.ts',"
    " min(source_path)]) path, unnest([0, 1, 2, 3, 4]) ord from edges group by project)"
)


def _walk_rows(walked, files):
    names = F.array_join(F.transform("symbols", lambda s: s["name"]), " ")
    return graph.attach_symbols(walked, files).select(
        "walk", "project", F.col("file_path").alias("path"),
        relative_path(F.col("file_path"), F.col("project")).alias("relative_path"), "depth", "reason", "pos", names.alias("names"),
    )


def _hot_walk(spark, sf, depth, max_results):
    imports = fx.stored_imports(spark, sf)
    entries = hot_files(imports).select(
        F.col("project").alias("walk"), "project", F.col("file_path").alias("path"), F.lit(0).cast("bigint").alias("ord")
    )
    return _walk_rows(graph.walk_many(imports, entries, depth, max_results), fx.files(spark, sf))


@catalog.add("walk_depth1", W("edges", "files", extra=_HOT_ENTRIES) + _walk_sql(1, 20) + _WALK_ROWS)
def walk_depth1(spark, sf):
    return _hot_walk(spark, sf, 1, 20)


@catalog.add("walk_depth2", W("edges", "files", extra=_HOT_ENTRIES) + _walk_sql(2, 20) + _WALK_ROWS)
def walk_depth2(spark, sf):
    return _hot_walk(spark, sf, 2, 20)


@catalog.add("walk_depth3", W("edges", "files", extra=_HOT_ENTRIES) + _walk_sql(3, 500) + _WALK_ROWS)
def walk_depth3(spark, sf):
    return _hot_walk(spark, sf, 3, 500)


@catalog.add("walk_multi_entry", W("edges", "files", extra=_MANY_ENTRIES) + _walk_sql(2, 50) + _WALK_ROWS)
def walk_multi_entry(spark, sf):
    imports = fx.stored_imports(spark, sf)
    ends = imports.groupBy("project").agg(
        F.min("source_path").alias("a"), F.max("source_path").alias("b"), F.max("target_path").alias("c")
    )
    listed = F.array("a", "b", "c", F.concat("project", F.lit("/not/indexed.ts")), "a")
    entries = ends.select("project", F.posexplode(listed).alias("ord", "path")).select(
        F.col("project").alias("walk"), "project", "path", F.col("ord").cast("bigint").alias("ord")
    )
    return _walk_rows(graph.walk_many(imports, entries, 2, 50), fx.files(spark, sf))


def bm25_sql(table: str, key: str, terms: list[str]) -> str:
    """BM25 of ``table(…, text)``: whole-corpus statistics, all terms required."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""tk as (select {key}, regexp_extract_all(lower(text), '[\\p{{L}}]+|[\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]') t from {table}),
 st as (select count(*) n, avg(len(t)) avgdl from tk),
 ps as (select {key}, len(t) dl, u.w, len(list_filter(t, lambda x: x = u.w)) tf from tk, (select unnest([{listed}]) w) u),
 df as (select w, count(*) df from ps where tf > 0 group by w),
 sc as (select {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from ps join df using (w), st where tf > 0 group by {key} having count(*) = {len(terms)})"""


_FILE_TEXT = "corpus as (select project, file_path, searchable as text from files)"
_FOUND_ENTRIES = (
    _FILE_TEXT + ",\n" + bm25_sql("corpus", "project, file_path", ["red", "widget"])
    + f""",
 top as (select *, row_number() over (partition by project order by score desc, file_path) r from sc),
 entries as (select project walk, project, file_path path, r ord from top where r <= {ENTRY_SEARCH_LIMIT})"""
)


@catalog.add("walk_from_search", W("edges", "files", extra=_FOUND_ENTRIES) + _walk_sql(2, 20) + _WALK_ROWS)
def walk_from_search(spark, sf):
    files = fx.files(spark, sf)
    found = search.search(
        files.select("project", "file_path", "searchable"), "searchable", "file_path", "red widget",
        ENTRY_SEARCH_LIMIT, by=["project"],
    )
    entries = found.select(
        F.col("project").alias("walk"), "project", F.col("file_path").alias("path"), F.col("rank").cast("bigint").alias("ord")
    )
    return _walk_rows(graph.walk_many(fx.stored_imports(spark, sf), entries, 2, 20), files)


@catalog.add(
    "search_files",
    W("files", extra=_FILE_TEXT + ",\n" + bm25_sql("corpus", "project, file_path", ["hot", "ts"]))
    + """select project, file_path, ltrim(substr(file_path, length(project) + 1), '/') relative_path, score, r as rank from (
 select *, row_number() over (partition by project order by score desc, file_path) r from sc) z where r <= 10""",
)
def search_files(spark, sf):
    files = fx.files(spark, sf).select("project", "file_path", "searchable")
    found = search.search(files, "searchable", "file_path", "Hot ts", 10, by=["project"])
    return found.select(
        "project", "file_path", relative_path(F.col("file_path"), F.col("project")).alias("relative_path"), "score",
        F.col("rank").cast("bigint").alias("rank"),
    )


@catalog.add(
    "search_documents",
    "with corpus as (select doc_id, text from documents),\n" + bm25_sql("corpus", "doc_id", [",", "the"])
    + "\nselect doc_id, score from sc order by score desc, doc_id limit 10",
)
def search_documents(spark, sf):
    corpus = fx.read(spark, sf, "documents").select("doc_id", "text")
    return search.search(corpus, "text", "doc_id", "The,", 10).select("doc_id", "score")


@catalog.add(
    "search_postings",
    "with corpus as (select doc_id, text from documents),\n" + bm25_sql("corpus", "doc_id", ["de", "la"])
    + "\nselect doc_id, score from sc order by score desc, doc_id limit 10",
)
def search_postings(spark, sf):
    corpus = fx.read(spark, sf, "documents").select("doc_id", "text")
    index = search.postings(corpus, "text", ["doc_id"])
    return search.search_postings(index, search.corpus_size(corpus, "text"), ["doc_id"], "La de", 10)


_PATHS = """e as (select distinct project, source_path s, target_path t from edges where source_path <> target_path),
 p(project, start, cur, path) as (
  select project, s, t, [s, t] from e where t > s
  union all
  select p.project, p.start, e.t, list_append(p.path, e.t) from p join e on e.project = p.project and e.s = p.cur
  where e.t > p.start and not list_contains(p.path, e.t) and len(p.path) < 20),
 cycles as (select p.project, p.path from p join e on e.project = p.project and e.s = p.cur and e.t = p.start)
"""


@catalog.add(
    "cycles_complete",
    W("edges", extra=_PATHS, recursive=True)
    + """select project, array_to_string(list_transform(list_append(path, path[1]), lambda x: ltrim(substr(x, length(project) + 1), '/')), '|') as cycle,
 len(path) as length from cycles""",
)
def cycles_complete(spark, sf):
    found = cycles.relative_cycles(cycles.find_cycles(fx.imports(spark, sf)))
    return found.withColumn("cycle", F.array_join("cycle", "|"))


@catalog.add(
    "cycle_membership",
    W("edges", extra=_PATHS, recursive=True)
    + """select project, file_path, count(*) n_cycles, min(len) shortest from (
 select project, unnest(path) file_path, len(path) len from cycles) z group by all""",
)
def cycle_membership(spark, sf):
    return cycles.cycle_members(cycles.find_cycles(fx.imports(spark, sf)))


@catalog.add(
    "cycle_components",
    W("edges", recursive=True)
    + """, d0 as (select distinct project, source_path s, target_path t from edges where source_path <> target_path),
 d1 as (select * from d0 semi join (select project, s t from d0) x using (project, t) semi join (select project, t s from d0) y using (project, s)),
 d2 as (select * from d1 semi join (select project, s t from d1) x using (project, t) semi join (select project, t s from d1) y using (project, s)),
 d3 as (select * from d2 semi join (select project, s t from d2) x using (project, t) semi join (select project, t s from d2) y using (project, s)),
 r(project, a, b) as (select project, s, t from d3 union select r.project, r.a, d3.t from r join d3 on d3.project = r.project and d3.s = r.b),
 c as (select x.project, x.a file_path, min(x.b) component from r x join r y on y.project = x.project and y.a = x.b and y.b = x.a group by all)
select project, file_path, component, count(*) over (partition by project, component) size from c""",
)
def cycle_components(spark, sf):
    return components.strong_components(fx.imports(spark, sf))


@catalog.add(
    "blast_radius",
    W("edges", extra=HOT, recursive=True)
    + """, e as (select distinct project, source_path s, target_path t from edges),
 r(project, start, n, depth) as (select project, file_path, file_path, 0 from hot
  union select r.project, r.start, e.s, r.depth + 1 from r join e on e.project = r.project and e.t = r.n where r.depth < 19),
 d as (select project, start, n, min(depth) depth from r group by all),
 c as (select project, start, count(*) filter (depth = 1) direct_dependents,
  count(*) filter (depth between 1 and 5) transitive_dependents from d group by all),
 k as (select distinct d.project from d join e on e.project = d.project and e.s = d.start and e.t = d.n where d.depth between 1 and 19)
select project walk, project, start file_path, direct_dependents, transitive_dependents, project in (select project from k) in_cycle,
 case when transitive_dependents >= 10 then 'critical' when direct_dependents >= 6 or project in (select project from k) then 'high'
 when direct_dependents >= 3 then 'medium' else 'low' end risk from c""",
)
def blast_radius(spark, sf):
    imports = fx.stored_imports(spark, sf)
    starts = hot_files(imports).select(F.col("project").alias("walk"), "project", F.col("file_path").alias("path"))
    return graph.blast_radius(imports, starts)


@catalog.add(
    "deps_by_level",
    W("edges", "files", recursive=True)
    + """, s as (select project, min(source_path) path from edges group by project),
 e as (select distinct project, source_path s, target_path t from edges),
 r(project, n, depth) as (select project, path, 0 from s
  union select r.project, e.t, r.depth + 1 from r join e on e.project = r.project and e.s = r.n where r.depth < 3),
 d as (select project, n, min(depth)::bigint depth from r group by all)
select d.project walk, d.project, depth, count(*) n_files, (count(f.file_path) * 2)::bigint n_symbols,
 case depth when 1 then 'direct' else 'transitive' end "level"
from d left join files f on f.project = d.project and f.file_path = d.n where depth > 0 group by all""",
)
def deps_by_level(spark, sf):
    imports = fx.stored_imports(spark, sf)
    first = imports.groupBy("project").agg(F.min("source_path").alias("path"))
    entries = first.select(F.col("project").alias("walk"), "project", "path")
    return graph.dependencies_by_level(fx.files(spark, sf), imports, entries)

