"""Code-graph projections of the shared benchmark tables.

The benchmark tables hold no source code, so a graph is read out of them: every part is a
file in each of ``PROJECTS`` projects and every line item is an import edge. The SQL
fragments run unchanged in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.session import durable, placed

PROJECTS = 30


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def path_sql(k: str) -> str:
    return (
        f"'/src/m' || (({k}) % 10) || '/f' || ({k}) || case ({k}) % 6 when 0 then '.ts' when 1 then '.tsx'"
        " when 2 then '.js' when 3 then '.rs' when 4 then '.rb' else '.ex' end"
    )


LANGUAGE_SQL = (
    "case k % 6 when 0 then 'typescript' when 1 then 'tsx' when 2 then 'javascript' when 3 then 'rust'"
    " when 4 then 'ruby' else 'elixir' end"
)
PROJECT_SQL = f"'/w/p' || (l_orderkey % {PROJECTS})"
# The last suppliers' later lines point past the last part, to files that are not indexed.
TARGET_KEY_SQL = "(l_suppkey * 20 + l_linenumber * 5)"
EDGE_COLUMNS_SQL = (
    f"{PROJECT_SQL} as project, {PROJECT_SQL} || {path_sql('l_partkey')} as source_path,"
    f" {PROJECT_SQL} || {path_sql(TARGET_KEY_SQL)} as target_path,"
    f" (case l_linestatus when 'O' then './f' else '../f' end) || {TARGET_KEY_SQL} as specifier, l_returnflag as sym"
)
VISIBILITY_SQL = (
    "case (p_size + {ord}) % 6 when 0 then 'exported' when 1 then 'default_export' when 2 then 'public'"
    " when 3 then 'pub_crate' when 4 then 'pub_super' else 'private' end"
)
DOC_SQL = "case p_size % 3 when 0 then null else p_type end"
HASH_SQL = "md5(p_name || p_brand || p_type)"


def edge_rows(spark: SparkSession, sf_dir: str) -> int:
    """No fewer than the rows of ``imports``; Parquet knows the number."""
    return read(spark, sf_dir, "lineitem").count()


def file_rows(spark: SparkSession, sf_dir: str) -> int:
    """The rows of ``files``."""
    return PROJECTS * read(spark, sf_dir, "part").count()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an edge, one row per (project, source, target, specifier).

    Duplicates are resolved on the integer keys the paths are made of, so the shuffle
    carries numbers and the strings are built once per surviving edge. Hardly any are there,
    so nothing is grouped before the shuffle, where a task would hold its whole split.
    """
    keyed = read(spark, sf_dir, "lineitem").selectExpr(
        f"l_orderkey % {PROJECTS} as p", "l_partkey as a", f"{TARGET_KEY_SQL} as b", "l_linestatus = 'O' as same_dir", "l_returnflag"
    )
    return (
        placed(keyed, edge_rows(spark, sf_dir), "p", "a", "b", "same_dir")
        .groupBy("p", "a", "b", "same_dir")
        .agg(F.min("l_returnflag").alias("sym"))
        .selectExpr(
            "'/w/p' || p as project",
            f"'/w/p' || p || {path_sql('a')} as source_path",
            f"'/w/p' || p || {path_sql('b')} as target_path",
            "if(same_dir, './f', '../f') || b as specifier",
            "array(sym) as symbols",
        )
    )


def stored_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``imports`` written once, for operators that read the edges level after level."""
    return durable(imports(spark, sf_dir))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, k, part columns): every part in every project."""
    # Spread before every row becomes many: the parts file alone may be a single split.
    parts = read(spark, sf_dir, "part").drop("p_retailprice").withColumn("k", F.col("p_partkey"))
    parts = parts.repartition(spark.sparkContext.defaultParallelism)
    # A join, not an explode: Spark takes the rows of an explode for as many as went in, and would broadcast the result.
    projects = spark.range(PROJECTS).select(F.col("id").cast("int").alias("p"))
    return parts.crossJoin(F.broadcast(projects)).withColumn("project", F.expr("'/w/p' || p"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def symbol(n: int) -> str:
        kind = "function" if n == 1 else "class"
        return (
            f"named_struct('name', split_part(p_name, ' ', {n}), 'kind', '{kind}',"
            f" 'signature', '{kind} ' || split_part(p_name, ' ', {n}), 'doc_comment', {DOC_SQL},"
            f" 'visibility', {VISIBILITY_SQL.format(ord=n)}, 'line', {n})"
        )

    symbols = F.col("symbols")
    return (
        part_files(spark, sf_dir)
        .selectExpr(
            "project",
            f"project || {path_sql('k')} as file_path",
            f"{LANGUAGE_SQL} as language",
            f"array({symbol(1)}, {symbol(2)}) as symbols",
            f"{HASH_SQL} as content_hash",
        )
        .withColumn("symbol_names", S.names(symbols))
        .withColumn("searchable", S.searchable(F.col("file_path"), symbols))
    )


# ---- The same projections as DuckDB common table expressions. ----

_PARTS = f"(select *, p_partkey as k, '/w/p' || p as project from part cross join range({PROJECTS}) r(p))"

CTES = {
    "edges": f"edges as (select project, source_path, target_path, specifier, min(sym) as sym from"
    f" (select {EDGE_COLUMNS_SQL} from lineitem) z group by all)",
    "files": f"files as (select project, project || {path_sql('k')} as file_path, {LANGUAGE_SQL} as language,"
    f" p_name as symbol_names, project || {path_sql('k')} || ' ' || p_name as searchable, {HASH_SQL} as content_hash,"
    f" k from {_PARTS} z)",
    "symbols": f"symbols as (select project, project || {path_sql('k')} as file_path, ord, split_part(p_name, ' ', ord) as name,"
    f" case ord when 1 then 'function' else 'class' end as kind, {VISIBILITY_SQL.format(ord='ord')} as visibility,"
    f" {DOC_SQL} as doc_comment from {_PARTS} z cross join (select unnest([1, 2]) as ord) o)",
}


def with_ctes(*names: str, extra: str = "", recursive: bool = False) -> str:
    """'with …' prefix made of the named projections and further expressions."""
    parts = [CTES[n] for n in names] + ([extra] if extra else [])
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"
