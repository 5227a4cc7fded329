"""Parsing and import resolution over source text written out of the part table.

Every part is one source file; its language follows from its key, its declarations from its
name, and it imports the file of half its key. The SQL side states what must be found.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import fixture as fx
from codeloom.catalog import Catalog
from codeloom.operators.resolve import in_listing, resolve_imports
from codeloom.parse.project import parse_statements, split_parse
from codeloom.session import durable, shared_folder
from codeloom.sources.tree import read_trees

catalog = Catalog()

_ROOT = "/w/src"
# a, b: the two words of the name; h: the imported part; d: a documented file's comment.
_BASE = (
    "select p_partkey as k, cast(floor(p_partkey / 2) as bigint) as h, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b,"
    " case p_size % 3 when 0 then null else p_type end as d from part"
)
_PATH = f"'{_ROOT}' || {fx.path_sql('k')}"
_REF = "'m' || (h % 10) || '/f' || h"
_NL = "chr(10)"


def _lines(*lines: str) -> str:
    return f" || {_NL} || ".join(lines) + f" || {_NL}"


_SCRIPT = _lines(
    f"'import {{ ' || a || ', helper as other }} from ''../' || {_REF} || ''';'",
    "'import fs from ''fs'';'",
    "coalesce('/** ' || d, '/* none') || ' */'",
    "'export function ' || a || '(x) {'",
    "'  return \"}{\" + `$' || '{x}`; // }'",
    "'}'",
    "'// ' || b",
    "'class ' || b || ' { run() { const inner = import(\"./f' || k || '\"); } }'",
    "'const ' || a || '_c = 1, ' || b || '_c = [1, 2];'",
    "'export { ' || b || ' as ' || b || '_out };'",
    # Elements, which plain TypeScript has none of: their text has quotes, slashes and comment marks that are none.
    "case k % 6 when 0 then '' else 'const ' || a || '_v = c => <p>Don''t {c && <b>it''s</b>} see http://x.y {`$'"
    " || '{import(\"./../m' || (k % 10) || '/f' || k || '\")}`} /* {c > /[{]/.x(c)}</p>;' end",
    f"'export * from ''./../' || {_REF} || ''';'",
    "'export interface ' || a || '_last { x: 1 }'",
)
_RUST = _lines(
    f"'use super::m' || (h % 10) || '::f' || h || ';'",
    "'mod f' || h || ';'",
    "case when d is null then '' else '/// ' || d end",
    "'pub fn ' || a || '() -> char { ''}'' }'",
    "'pub(crate) struct ' || b || ' { x: i32 }'",
    "'impl ' || b || ' {'",
    "'    fn hidden() {}'",
    "'}'",
)
_RUBY = _lines(
    f"'require_relative ''../' || {_REF} || ''''",
    "'require ''json'''",
    "case when d is null then '' else '# ' || d end",
    "'class K' || a",
    "'  attr_reader :' || b",
    "'  def ' || b || '(x)'",
    "'    x = 1 if x'",
    "'    if x then \"end\" end'",
    "'  end'",
    "'end'",
)
_ELIXIR = _lines(
    "'defmodule App.F' || k || ' do'",
    "'  alias App.F' || h || ', as: H'",
    "case when d is null then '' else '  @doc \"' || d || '\"' end",
    "'  def ' || a || '(x) do'",
    "'    if x, do: alias(Not.Seen)'",
    "'  end'",
    "'  defp ' || b || ', do: 1'",
    "'end'",
)
_CONTENT = f"case when k % 6 in (0, 1, 2) then {_SCRIPT} when k % 6 = 3 then {_RUST} when k % 6 = 4 then {_RUBY} else {_ELIXIR} end"
# Elixir modules live below lib; mix.exs marks the project.
_LISTING = (
    f"select '{_ROOT}' as project, {_PATH} as path from base union all"
    f" select '{_ROOT}', '{_ROOT}/lib/app/f' || k || '.ex' from base where k % 6 = 5 union all select distinct '{_ROOT}', '{_ROOT}/mix.exs' from base"
)


def _base(spark, sf) -> DataFrame:
    return fx.read(spark, sf, "part").selectExpr(
        "p_partkey as k", "cast(floor(p_partkey / 2) as bigint) as h", "split_part(p_name, ' ', 1) as a",
        "split_part(p_name, ' ', 2) as b", "case p_size % 3 when 0 then null else p_type end as d",
    )


def sources(spark, sf) -> DataFrame:
    """(project, file_path, content), written once as a stored tree would be."""
    spread = _base(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    return durable(spread.selectExpr(f"'{_ROOT}' as project", f"{_PATH} as file_path", f"{_CONTENT} as content"))


def listing(spark, sf) -> DataFrame:
    base = _base(spark, sf)
    project = F.lit(_ROOT).alias("project")
    files = base.select(project, F.expr(_PATH).alias("path"))
    modules = base.filter("k % 6 = 5").select(project, F.expr(f"'{_ROOT}/lib/app/f' || k || '.ex'").alias("path"))
    marker = spark.range(1).select(project, F.lit(f"{_ROOT}/mix.exs").alias("path"))
    return files.unionByName(modules).unionByName(marker)


def _symbol(where: str, name: str, kind: str, signature: str, doc: str, visibility: str, line: int) -> str:
    return (
        f"select {_PATH} as file_path, {name} as name, '{kind}' as kind, {signature} as signature, {doc} as doc_comment,"
        f" '{visibility}' as visibility, {line}::integer as line from base where {where}"
    )


_JS, _RS, _RB, _EX = "k % 6 in (0, 1, 2)", "k % 6 = 3", "k % 6 = 4", "k % 6 = 5"
_CONST = "'const ' || a || '_c = 1, ' || b || '_c = [1, 2];'"
_SYMBOLS = " union all ".join(
    [
        # A one-line doc block keeps its closing mark; a plain block comment is no doc.
        _symbol(_JS, "a", "function", "'export function ' || a || '(x)'", "d || ' */'", "exported", 4),
        _symbol(_JS, "b", "class", "'class ' || b", "b", "private", 8),
        _symbol(_JS, "a || '_c'", "const", _CONST, "null", "private", 9),
        _symbol(_JS, "b || '_c'", "const", _CONST, "null", "private", 9),
        _symbol(_JS, "b || '_out'", "unknown", "b || ' as ' || b || '_out'", "null", "exported", 10),
        _symbol("k % 6 in (1, 2)", "a || '_v'", "const", "'const ' || a || '_v = c => <p>Don''t'", "null", "private", 11),
        _symbol(_JS, "a || '_last'", "interface", "'export interface ' || a || '_last'", "null", "exported", 13),
        _symbol(_RS, "'f' || h", "module", "'mod f' || h || ';'", "null", "private", 2),
        _symbol(_RS, "a", "function", "'pub fn ' || a || '() -> char'", "d", "public", 4),
        _symbol(_RS, "b", "struct", "'pub(crate) struct ' || b", "null", "pub_crate", 5),
        _symbol(_RS, "b", "impl", "'impl ' || b", "null", "private", 6),
        _symbol(_RB, "'K' || a", "class", "'class K' || a", "d", "public", 4),
        _symbol(_RB, "b", "function", "'attr_reader :' || b", "null", "public", 5),
        _symbol(_RB, "b", "function", "'def ' || b || '(x)'", "null", "public", 6),
        _symbol(_EX, "'App.F' || k", "module", "'defmodule App.F' || k", "null", "public", 1),
        _symbol(_EX, "a", "function", "'def ' || a || '(x) do'", "d", "public", 4),
        _symbol(_EX, "b", "function", "'defp ' || b || ', do: 1'", "null", "private", 7),
    ]
)


@catalog.add("parse_symbols", f"with base as ({_BASE}) {_SYMBOLS}")
def parse_symbols(spark, sf):
    parsed = parse_statements(sources(spark, sf))
    return parsed.select("file_path", F.inline("symbols"))


_EDGES = f"""with base as ({_BASE}), listing as ({_LISTING}),
 r as (
  select {_PATH} s, k, 0 probe, '../' || {_REF} spec, '{_ROOT}/src/' || {_REF} || x.e p, a || ',helper' syms, x.n from base, (values ('.ts', 1), ('.tsx', 2), ('.js', 3)) x(e, n) where {_JS}
  union all select {_PATH}, k, 0, './f' || k, {_PATH}, '*', 1 from base where {_JS}
  union all select {_PATH}, k, 0, './../m' || (k % 10) || '/f' || k, {_PATH}, '*', 1 from base where k % 6 in (1, 2)
  union all select {_PATH}, k, 0, './../' || {_REF}, '{_ROOT}/src/' || {_REF} || x.e, '*', x.n from base, (values ('.ts', 1), ('.tsx', 2), ('.js', 3)) x(e, n) where {_JS}
  union all select {_PATH}, k, 0, 'super::m' || (h % 10) || '::f' || h, '{_ROOT}/src/' || {_REF} || '.rs', 'f' || h, 1 from base where {_RS}
  union all select {_PATH}, k, 0, 'mod f' || h, '{_ROOT}/src/m' || (k % 10) || '/f' || h || '.rs', 'f' || h, 1 from base where {_RS}
  union all select {_PATH}, k, 0, '../' || {_REF}, '{_ROOT}/src/' || {_REF} || '.rb', '*', 1 from base where {_RB}
  union all select {_PATH}, k, 0, 'App.F' || h, '{_ROOT}/lib/app/f' || h || '.ex', '*', 1 from base where {_EX})
select s source_path, p target_path, spec specifier, syms from r where p in (select path from listing)"""


@catalog.add("resolve_imports", _EDGES)
def resolve(spark, sf):
    text = sources(spark, sf)
    _, raw = split_parse(text, durable(parse_statements(text)))
    edges = resolve_imports(raw, in_listing(listing(spark, sf)))
    return edges.select("source_path", "target_path", "specifier", F.array_join("symbols", ",").alias("syms"))


def _write_files(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(content)
        yield batch[["path"]]


@catalog.add(
    "tree_files",
    f"""with base as ({_BASE}), c as (select {_PATH} file_path, {_CONTENT} content from base)
select file_path, true as indexable, md5(content) content_hash from c where file_path not like '%/m1/%'""",
)
def tree_files(spark, sf):
    """All files as a tree in the shared folder, beside copies in skipped directories, read back by the data source."""
    root = re.sub("^file:/+", "/", f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}")
    text = sources(spark, sf).select("file_path", "content")
    kept = text.filter("file_path not like '%/m1/%'")
    skipped = text.select(F.concat(F.lit("/.cache"), "file_path").alias("file_path"), "content")
    for files in (kept, skipped):
        files.select(F.concat(F.lit(root), "file_path").alias("path"), "content").mapInPandas(_write_files, "path string").write.format("noop").mode("overwrite").save()
    found = read_trees(spark, [root], contents=True).filter("not is_dir")
    return found.select(F.expr(f"substr(path, {len(root) + 1})").alias("file_path"), "indexable", F.md5("content").alias("content_hash"))


@catalog.add(
    "index_tree",
    f"""with base as ({_BASE}), c as (select {_PATH} file_path, k, {_CONTENT} content from base), s as ({_SYMBOLS}),
 n as (select file_path, count(*) n_symbols, string_agg(name, ' ' order by line, name) names from s group by file_path)
select file_path, case when k % 6 = 0 then 'typescript' when k % 6 = 1 then 'tsx' when k % 6 = 2 then 'javascript'
 when k % 6 = 3 then 'rust' when k % 6 = 4 then 'ruby' else 'elixir' end as language, n_symbols, names, md5(content) content_hash
from c join n using (file_path)""",
)
def index_tree(spark, sf):
    text = sources(spark, sf)
    files, _ = split_parse(text, durable(parse_statements(text)))
    by_line = F.array_sort(F.transform("symbols", lambda s: F.struct(s["line"].alias("line"), s["name"].alias("name"))))
    names = F.array_join(F.transform(by_line, lambda s: s["name"]), " ")
    return files.select("file_path", "language", F.size("symbols").cast("bigint").alias("n_symbols"), names.alias("names"), "content_hash")
