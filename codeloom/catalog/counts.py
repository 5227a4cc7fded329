"""Counts, symbol reports, lookups and path expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import fixture as fx
from codeloom.catalog import Catalog
from codeloom.functions import paths, text
from codeloom.operators import detail, lookup, stats

catalog = Catalog()
W = fx.with_ctes

# The most imported file of each project: a small, data-derived set of lookup keys.
HOT = (
    "fan as (select project, target_path, count(*) n from edges group by all),\n"
    "hot as (select project, target_path as file_path from fan"
    " qualify row_number() over (partition by project order by n desc, target_path) = 1)"
)


def hot_files(imports):
    n = stats.degree(imports, "target_path", "n")
    lead = n.groupBy("project").agg(F.min(F.struct((-F.col("n")).alias("n"), "file_path")).alias("hot"))
    return lead.select("project", F.col("hot.file_path").alias("file_path"))


@catalog.add("project_file_counts", W("files") + "select project, count(*) n_files from files group by project")
def project_file_counts(spark, sf):
    return stats.project_overview(fx.files(spark, sf))


@catalog.add("language_counts", W("files") + "select project, language, count(*) n_files from files group by all")
def language_counts(spark, sf):
    return stats.language_counts(fx.files(spark, sf))


@catalog.add("import_count", W("edges") + "select project, count(*) n_edges from edges group by project")
def import_count(spark, sf):
    return stats.edge_counts(fx.imports(spark, sf))


@catalog.add(
    "project_stats",
    W("edges", "files")
    + """, l as (select project, language, count(*) n from files group by all),
 f as (select project, sum(n)::bigint total_files, string_agg(language || '=' || n, ',' order by language) languages from l group by project),
 e as (select project, count(*) total_import_edges from edges group by project)
select project, coalesce(total_files, 0) total_files, coalesce(total_import_edges, 0) total_import_edges,
 coalesce(languages, '') languages from f full join e using (project)""",
)
def project_stats(spark, sf):
    got = stats.project_stats(fx.files(spark, sf), fx.imports(spark, sf))
    entries = F.array_sort(F.map_entries("languages"))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.withColumn("languages", joined)


@catalog.add(
    "fan_in",
    W("edges") + "select project, target_path, count(*) fan_in, count(distinct source_path) distinct_importers"
    " from edges group by all",
)
def fan_in(spark, sf):
    return stats.fan_in(fx.imports(spark, sf), fx.edge_rows(spark, sf))


_REPORT = W("symbols") + """, r as (select project, file_path, count(*) n_symbols,
 count(*) filter (visibility in ('public', 'exported', 'default_export', 'pub_crate')) n_public,
 count(doc_comment) n_documented from symbols group by all)
"""


@catalog.add("public_symbols", _REPORT + "select project, file_path, n_symbols, n_public from r")
def public_symbols(spark, sf):
    return stats.symbol_report(fx.files(spark, sf)).select("project", "file_path", "n_symbols", "n_public")


@catalog.add("undocumented_files", _REPORT + "select project, file_path, n_symbols from r where n_documented = 0")
def undocumented_files(spark, sf):
    report = stats.symbol_report(fx.files(spark, sf))
    return report.filter("none_documented").select("project", "file_path", "n_symbols")


@catalog.add(
    "doc_coverage",
    _REPORT + "select project, sum(n_documented)::bigint documented, sum(n_symbols - n_documented)::bigint undocumented"
    " from r group by project",
)
def doc_coverage(spark, sf):
    report = stats.symbol_report(fx.files(spark, sf))
    return report.groupBy("project").agg(
        F.sum("n_documented").alias("documented"), F.sum("n_undocumented").alias("undocumented")
    )


@catalog.add(
    "file_summary",
    W("edges", "files")
    + """, o as (select project, source_path file_path, count(*) n_imports from edges group by all),
 i as (select project, target_path file_path, count(*) n_dependents from edges group by all)
select project, file_path, language, 2::bigint n_symbols, coalesce(n_imports, 0) n_imports,
 coalesce(n_dependents, 0) n_dependents
from files left join o using (project, file_path) left join i using (project, file_path)""",
)
def file_summary(spark, sf):
    return detail.file_summary(fx.files(spark, sf), fx.imports(spark, sf))


@catalog.add(
    "imports_from",
    W("edges", extra=HOT) + "select e.project, e.source_path, e.target_path from edges e join hot h"
    " on e.project = h.project and e.source_path = h.file_path",
)
def imports_from(spark, sf):
    imports = fx.stored_imports(spark, sf)
    return lookup.imports_from(imports, hot_files(imports))


@catalog.add(
    "importers_of",
    W("edges", extra=HOT) + "select e.project, e.target_path, e.source_path from edges e join hot h"
    " on e.project = h.project and e.target_path = h.file_path",
)
def importers_of(spark, sf):
    imports = fx.stored_imports(spark, sf)
    return lookup.importers_of(imports, hot_files(imports))


_LISTS = """, o as (select project, source_path file_path, count(*) n, string_agg(target_path || ':' || sym, ',' order by target_path, specifier) l from edges group by all),
 i as (select project, target_path file_path, count(*) n, string_agg(source_path || ':' || sym, ',' order by source_path, specifier) l from edges group by all)
"""


def _pairs(items: str):
    return F.array_join(
        F.transform(items, lambda i: F.concat(i["path"], F.lit(":"), F.array_join(i["symbols"], "+"))), ","
    )


def _flat_detail(got):
    return got.select(
        "project", "file_path", "language", F.array_join(F.transform("symbols", lambda s: s["name"]), " ").alias("names"),
        _pairs("imports").alias("imports"), _pairs("dependents").alias("dependents"), "n_imports", "n_dependents",
    )


_FLAT_DETAIL = (
    "select f.project, f.file_path, f.language, f.symbol_names as names, coalesce(o.l, '') imports,"
    " coalesce(i.l, '') dependents, coalesce(o.n, 0) n_imports, coalesce(i.n, 0) n_dependents"
    " from files f left join o using (project, file_path) left join i using (project, file_path)"
)


@catalog.add("file_detail", W("edges", "files") + _LISTS + _FLAT_DETAIL)
def file_detail(spark, sf):
    return _flat_detail(detail.file_detail(fx.files(spark, sf), fx.imports(spark, sf)))


@catalog.add(
    "file_detail_hot",
    W("edges", "files", extra=HOT) + _LISTS + _FLAT_DETAIL
    + " where (f.project, f.file_path) in (select (project, file_path) from hot)",
)
def file_detail_hot(spark, sf):
    imports = fx.stored_imports(spark, sf)
    return _flat_detail(detail.detail_of(fx.files(spark, sf), imports, detail.distinct_keys(hot_files(imports))))


# A suffix per nation; the leading '_' is a one-character wildcard.
@catalog.add(
    "suffix_search",
    W("files")
    + """, s as (select distinct project, '_' || n_nationkey || '.ts' suffix from files, nation
 union select distinct project, n_nationkey || '.rs' from files, nation)
select project, suffix, file_path, rank from (
 select s.project, suffix, file_path, row_number() over (partition by s.project, suffix order by file_path) rank
 from s join files f on f.project = s.project and f.file_path like '%' || suffix) z where rank <= 3""",
)
def suffix_search(spark, sf):
    files = fx.files(spark, sf)
    nation = fx.read(spark, sf, "nation").select(
        F.explode(F.array(F.expr("'_' || n_nationkey || '.ts'"), F.expr("n_nationkey || '.rs'"))).alias("suffix")
    )
    projects = files.select("project").distinct().withColumn(
        "suffixes", nation.agg(F.collect_set("suffix").alias("suffixes")).scalar()
    )
    return lookup.suffix_matches(files, projects.select("project", F.explode("suffixes").alias("suffix")))


# '/w/p1' is also a string prefix of '/w/p10…', so the cut crosses a path boundary there.
@catalog.add(
    "relative_paths",
    W("files")
    + """select file_path, ltrim(case when starts_with(file_path, '/w/p1') then substr(file_path, 6) else file_path end, '/') relative_path,
 case when starts_with(symbol_names, '/') then symbol_names else '/w/p1/' || symbol_names end absolute_path from files""",
)
def relative_paths(spark, sf):
    root = F.lit("/w/p1")
    return fx.files(spark, sf).select(
        "file_path",
        paths.relative_path(F.col("file_path"), root).alias("relative_path"),
        paths.absolute_path(F.col("symbol_names"), root).alias("absolute_path"),
    )


_HUB = "/src/m6/f6.ts"


@catalog.add(
    "file_detail_hub",
    W("edges", "files")
    + f"""select project, project || '{_HUB}' file_path, count(*) n_dependents,
 string_agg(source_path || ':' || sym, ',' order by source_path, specifier) dependents
 from edges where (project, project || '{_HUB}') in (select (project, file_path) from files) group by project""",
)
def file_detail_hub(spark, sf):
    """All edges of a project bent to one file: a list far longer than any other, in path order."""
    bent = fx.imports(spark, sf).withColumn("target_path", F.concat("project", F.lit(_HUB)))
    hubs = fx.files(spark, sf).filter(F.col("file_path") == F.concat("project", F.lit(_HUB)))
    got = detail.detail_of(hubs, bent, detail.distinct_keys(hubs)).filter("n_dependents > 0")
    return got.select("project", "file_path", "n_dependents", _pairs("dependents").alias("dependents"))


# A file that is there and one that is not.
_ASKED_FILES = [("/w/p0", "/w/p0/src/m6/f6.ts"), ("/w/p0", "/w/p0/src/none.ts")]


def _asked(select: str) -> str:
    return " union all ".join(
        f"select '{path}' asked, {select} from files where project = '{project}' and file_path = '{path}'" for project, path in _ASKED_FILES
    )


@catalog.add("file_symbols", W("files") + _asked("coalesce(max(symbol_names), '') as names"))
def file_symbols(spark, sf):
    files = fx.files(spark, sf)
    parts = [
        lookup.file_symbols(files, project, path).select(
            F.lit(path).alias("asked"), F.array_join(F.transform("symbols", lambda s: s["name"]), " ").alias("names")
        )
        for project, path in _ASKED_FILES
    ]
    return parts[0].unionByName(parts[1])


@catalog.add("file_hash", W("files") + _asked("content_hash"))
def file_hash(spark, sf):
    files = fx.files(spark, sf)
    parts = [lookup.file_hash(files, project, path).select(F.lit(path).alias("asked"), "content_hash") for project, path in _ASKED_FILES]
    return parts[0].unionByName(parts[1])


_URLS = "select page_id, case page_id % 4 when 0 then url || '.ts' when 1 then url || '/.rs' when 2 then url || '/.x.rb' else url || '.md' end path from pages"


@catalog.add(
    "ext_filter",
    f"with u as ({_URLS}), x as (select *, regexp_extract(path, '[^/]\\.([^./]+)$', 1) ext from u)\n"
    "select page_id, path, ext, case ext when 'ts' then 'typescript' when 'rb' then 'ruby' end as language from x"
    " where ext in ('ts','tsx','js','jsx','mjs','cjs','rs','rb','ex','exs')",
)
def ext_filter(spark, sf):
    urls = fx.read(spark, sf, "pages").selectExpr(*_URLS[len("select "):_URLS.index(" from pages")].split(", ", 1))
    path = F.col("path")
    return urls.filter(paths.is_supported(path)).select(
        "page_id", "path", paths.extension(path).alias("ext"), paths.language_of(path).alias("language")
    )


@catalog.add("content_hash", "select doc_id, md5(text) content_hash from documents")
def content_hash(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
