"""Text and JSON expressions, and the context views."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import fixture as fx
from codeloom.catalog import Catalog
from codeloom.catalog.counts import HOT, hot_files
from codeloom.functions import paths, text
from codeloom.functions.paths import relative_path
from codeloom.plans import views
from codeloom.schema import MENTION_EXTENSIONS

catalog = Catalog()
W = fx.with_ctes


@catalog.add(
    "strip_quotes",
    """with q as (select page_id, case page_id % 4 when 0 then '''' || url || '''' when 1 then '"''' || url when 2 then '`' || url || '``' else url end raw from pages)
select page_id, regexp_replace(raw, '^[''"`]+|[''"`]+$', '', 'g') bare from q""",
)
def strip_quotes(spark, sf):
    raw = F.expr(
        """case page_id % 4 when 0 then concat("'", url, "'") when 1 then concat('"', "'", url)
        when 2 then concat('`', url, '``') else url end"""
    )
    return fx.read(spark, sf, "pages").select("page_id", text.strip_quotes(raw).alias("bare"))


@catalog.add(
    "signatures",
    "with s as (select doc_id, case when contains(text, '{') then split_part(text, '{', 1) else split_part(text, chr(10), 1) end h from documents)\n"
    "select doc_id, regexp_replace(h, '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g') signature from s",
)
def signatures(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", text.signature(F.col("text")).alias("signature"))


_CAMEL = "p_brand || p_type || split_part(p_name, ' ', 1)"


@catalog.add(
    "snake_case",
    f"with s as (select p_partkey, {_CAMEL} n from part), u as (select *, lower(regexp_replace(n, '([A-Z])', '_\\1', 'g')) r from s)\n"
    "select p_partkey, case when regexp_matches(n, '^[A-Z]') then substr(r, 2) else r end snake from u",
)
def snake_case(spark, sf):
    return fx.read(spark, sf, "part").select("p_partkey", paths.to_snake_case(F.expr(_CAMEL)).alias("snake"))


_DOTTED = (
    "case s_suppkey % 5 when 0 then '/w/./a/../b' when 1 then '/../x' when 2 then 'a/b/../../..' when 3 then '/a/..//b/.' else './n/..' end"
    " || '/' || s_name || '/../' || s_nationkey"
)


@catalog.add(
    "normalize_path",
    f"""with s as (select s_suppkey, {_DOTTED} p from supplier),
 f as (select s_suppkey, list_reduce(list_transform(string_split(p, '/'), lambda x: [x]),
   lambda a, b: case when b[1] in ('', '.') then a when b[1] = '..' then a[1:greatest(len(a) - 1, 0)] else list_concat(a, b) end,
   case when starts_with(p, '/') then [''] else []::varchar[] end) parts from s)
select s_suppkey, case when len(parts) = 0 then '' when len(parts) = 1 and parts[1] = '' then '/' else array_to_string(parts, '/') end folded from f""",
)
def normalize_path(spark, sf):
    return fx.read(spark, sf, "supplier").select("s_suppkey", paths.normalize_path(F.expr(_DOTTED)).alias("folded"))


# Every error event carries damaged JSON.
_PROPS = "case event_type when 'error' then '{' || props else props end"


@catalog.add(
    "json_defaults",
    f"with j as (select event_id, {_PROPS} p from events)\n"
    "select event_id, case when json_valid(p) then len(json_keys(p))::bigint else 0 end n_entries,"
    " case when json_valid(p) then json_extract_string(p, '$.k') end k from j",
)
def json_defaults(spark, sf):
    status = text.json_status(F.expr(_PROPS))
    rows = fx.read(spark, sf, "events").select("event_id", status.alias("m"))
    return rows.select("event_id", F.size("m").cast("bigint").alias("n_entries"), F.try_element_at("m", F.lit("k")).alias("k"))


_PAYLOAD = (
    "case c_nationkey % 3 when 0 then '{\"cwd\": \"/w\"}' when 1 then '{\"tool_input\": {\"file_path\": \"\"}}'"
    " else '{\"tool_input\": {\"file_path\": \"src/' || c_name || '.ts\"}}' end"
)


@catalog.add(
    "json_file_path",
    f"select c_custkey, nullif(json_extract_string({_PAYLOAD}, '$.tool_input.file_path'), '') file_path from customer",
)
def json_file_path(spark, sf):
    return fx.read(spark, sf, "customer").select("c_custkey", text.json_file_path(F.expr(_PAYLOAD)).alias("file_path"))


@catalog.add(
    "symbols_json",
    W("symbols")
    + """select project, file_path, '[' || string_agg('{"name":"' || name || '","kind":"' || kind || '","signature":"' || kind || ' ' || name
 || '","docComment":' || coalesce('"' || doc_comment || '"', 'null') || ',"visibility":"' || visibility || '","line":' || ord || '}', ',' order by ord) || ']' as json,
 2::bigint decoded from symbols group by all""",
)
def symbols_json(spark, sf):
    encoded = fx.files(spark, sf).select("project", "file_path", text.symbols_json(F.col("symbols")).alias("json"))
    return encoded.withColumn("decoded", F.size(text.json_symbols(F.col("json"))).cast("bigint"))


_ASKED = "text || ' See `src/m1/f' || conv_id || '.ts`, (lib/' || conv_id || '.rb) README.md. v1.2.3 ' || conv_id || '.ts'"
_EXT = "|".join(MENTION_EXTENSIONS)
_BLANK = "\\s\\x0b\\x{85}\\p{Z}"
_MENTIONS_SQL = f"""asked as (select conv_id, turn, {_ASKED} t from conversations),
 words as (select conv_id, turn, regexp_replace(unnest(regexp_split_to_array(t, '[{_BLANK}`''"]')),
   '^[^\\p{{L}}\\p{{N}}./_-]+|[^\\p{{L}}\\p{{N}}./_-]+$', '', 'g') w from asked),
 mentions as (select distinct conv_id, turn, w mention from words where regexp_matches(w, '\\.({_EXT})$'))
"""


@catalog.add("mentions", f"with {_MENTIONS_SQL} select * from mentions")
def mentions(spark, sf):
    asked = fx.read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_ASKED).alias("t"))
    return asked.select("conv_id", "turn", F.explode(text.file_mentions(F.col("t"))).alias("mention"))


_REL = "ltrim(substr({p}, length({q}) + 1), '/')"
_VIEW_CTES = f"""rel as (select project, source_path, target_path, {_REL.format(p='source_path', q='project')} s, {_REL.format(p='target_path', q='project')} t, specifier from edges),
 o as (select project, source_path file_path, count(*) n_out, string_agg(t, ', ' order by target_path, specifier) out_list from rel group by all),
 i as (select project, target_path file_path, count(*) n_in, string_agg(s, ', ' order by source_path, specifier) in_list,
  array_to_string(list(s order by source_path, specifier)[1:8], ', ') in8, array_to_string(list(s order by source_path, specifier)[1:5], ', ') in5 from rel group by all),
 y as (select project, file_path, count(*) n_sym, count(doc_comment) n_doc,
  count(*) filter (visibility in ('public', 'exported', 'default_export', 'pub_crate')) n_pub from symbols group by all),
 facts as (select f.project, f.file_path, {_REL.format(p='f.file_path', q='f.project')} r, coalesce(n_out, 0) n_out, out_list, coalesce(n_in, 0) n_in, in_list, in8, in5,
  coalesce(n_sym, 0) n_sym, coalesce(n_doc, 0) n_doc, coalesce(n_pub, 0) n_pub
  from files f left join o using (project, file_path) left join i using (project, file_path) left join y using (project, file_path))"""


@catalog.add(
    "prompt_context",
    W("edges", "files", "symbols", extra=_VIEW_CTES + ",\n" + _MENTIONS_SQL)
    + """, wanted as (select conv_id * 1000 + turn prompt_id, '/w/p' || (conv_id % 30) project, mention from mentions),
 hits as (select prompt_id, w.project, file_path from wanted w join files f on f.project = w.project and f.file_path like '%' || mention
  qualify row_number() over (partition by prompt_id, w.project, mention order by file_path) <= 3)
select distinct prompt_id, h.project, h.file_path, concat_ws(chr(10), '### ' || r,
 case when n_in > 5 then 'Careful: ' || n_in || ' files depend on this one' end,
 case when n_sym > 0 and n_doc = 0 then 'Undocumented: all ' || n_sym || ' symbols' end,
 case when n_out > 0 then 'Imports: ' || out_list end, case when n_in > 0 then 'Used by: ' || in_list end) context
from hits h join facts using (project, file_path) where n_in + n_out + n_sym > 0""",
)
def prompt_context(spark, sf):
    prompts = fx.read(spark, sf, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("prompt_id"), F.expr("'/w/p' || (conv_id % 30)").alias("project"),
        F.expr(_ASKED).alias("prompt"),
    )
    return views.prompt_context(fx.files(spark, sf), fx.imports(spark, sf), prompts)


@catalog.add(
    "tool_context",
    W("edges", "files", "symbols", extra=HOT + ",\n" + _VIEW_CTES)
    + """select project, file_path, concat_ws(chr(10), '## Editing ' || r,
 case when n_in > 5 then 'Careful: ' || n_in || ' files depend on this one' when n_in > 0 then 'Dependents: ' || n_in end,
 case when n_out > 0 then 'Imports: ' || out_list end,
 case when n_in > 0 then 'Used by: ' || in8 || case when n_in > 8 then ' + ' || (n_in - 8) || ' more' else '' end end) context
from hot join facts using (project, file_path) where n_in + n_out > 0""",
)
def tool_context(spark, sf):
    imports = fx.stored_imports(spark, sf)
    return views.tool_context(fx.files(spark, sf), imports, hot_files(imports), "Editing")


def _changed(imports):
    return hot_files(imports).select(
        "project", F.lit("3").alias("added"), F.lit("1").alias("removed"),
        relative_path(F.col("file_path"), F.col("project")).alias("file"),
    )


@catalog.add(
    "compact_context",
    W("edges", "files", "symbols", extra=HOT + ",\n" + _VIEW_CTES)
    + """select project, file_path, concat_ws(chr(10), '### ' || r || ' (+3/-1)',
 case when n_in > 0 then 'Dependents (' || n_in || '): ' || in5 || case when n_in > 5 then ' + ' || (n_in - 5) || ' more' else '' end end,
 case when n_out > 0 then 'Imports: ' || out_list end,
 case when n_sym > 0 then 'Symbols: ' || n_sym || ' total, ' || n_pub || ' public' end) context
from hot join facts using (project, file_path)""",
)
def compact_context(spark, sf):
    imports = fx.stored_imports(spark, sf)
    return views.compact_context(fx.files(spark, sf), imports, _changed(imports))


@catalog.add(
    "post_edit_lines",
    W("edges", "files", "symbols", extra=HOT + ",\n" + _VIEW_CTES)
    + f"""select h.project, h.file_path, coalesce(n_in, 0) n_dependents, '- ' || {_REL.format(p='h.file_path', q='h.project')} || ' (+3/-1)'
 || case when n_in > 0 then ', ' || n_in || ' dependents' else '' end line from hot h left join facts using (project, file_path)""",
)
def post_edit_lines(spark, sf):
    imports = fx.stored_imports(spark, sf)
    return views.post_edit_lines(imports, fx.files(spark, sf), _changed(imports))


@catalog.add(
    "session_context",
    W("edges", "files")
    + """, p as (select distinct project from edges union select '/w/none'), f as (select project, count(*) n from files group by project),
 e as (select project, count(*) m from edges group by project)
select project, case when coalesce(n, 0) = 0 then 'Not indexed yet: ' || project || '. Index the project first.'
 else 'Project: ' || project || chr(10) || 'Files indexed: ' || n || chr(10) || 'Import edges: ' || coalesce(m, 0) end context
from p left join f using (project) left join e using (project)""",
)
def session_context(spark, sf):
    imports = fx.stored_imports(spark, sf)
    none = spark.range(1).select(F.lit("/w/none").alias("project"))
    return views.session_context(fx.files(spark, sf), imports, imports.select("project").distinct().union(none))
