"""Change detection, table maintenance and version-control text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom import fixture as fx
from codeloom.catalog import Catalog
from codeloom.operators import changes
from codeloom.session import shared_folder
from codeloom.sources import gittext
from codeloom.streaming.keyed import code_changes

catalog = Catalog()
W = fx.with_ctes

# Status rows out of events: one path per user and hour, one code per event type. What
# happened before the cut is the last snapshot, what happened since is the current one.
_EVENT = (
    "'/w/p' || (user_id % 30) as project, '/w/p' || (user_id % 30) || '/src/u' || user_id || '_' || hour(ts) || '.ts' as path,"
    " case event_type when 'view' then 'M' when 'signup' then '??' when 'purchase' then 'A' when 'error' then 'D' else 'R' end as code"
)
_CUT = "timestamp '2024-01-15 00:00:00'"
_STATUS_SQL = f"""with s as (select {_EVENT}, ts, event_id from events),
 l as (select project, path, arg_max(code, (ts, event_id)) code from s where ts < {_CUT} group by all),
 c as (select project, path, arg_max(code, (ts, event_id)) code from s where ts >= {_CUT} group by all),
 disk as (select distinct project, path from s where code = 'A'),
 j as (select coalesce(c.project, l.project) project, coalesce(c.path, l.path) path, c.code cur, l.code was
  from c full join l on c.project = l.project and c.path = l.path),
 d as (select j.project, j.path, case when cur = 'D' or (cur is null and k.path is null) then 'deleted'
   when cur is not null and cur <> 'D' and cur is distinct from was then 'modified' end change,
   k.path is not null as present
  from j left join disk k on k.project = j.project and k.path = j.path)
"""


def _statuses(spark, sf):
    code = _EVENT.rsplit(", case ", 1)
    project, path = code[0].split(", ", 1)
    return fx.read(spark, sf, "events").selectExpr(project, path, "case " + code[1], "ts as at", "event_id as seq")


def _snapshots(spark, sf):
    rows = _statuses(spark, sf)
    cut = F.expr(_CUT.replace("timestamp ", "timestamp_ntz "))
    last = changes.latest_status(rows.filter(F.col("at") < cut))
    current = changes.latest_status(rows.filter(F.col("at") >= cut))
    return last, current, rows.filter("code = 'A'").select("project", "path").distinct()


@catalog.add("status_diff", _STATUS_SQL + "select project, path, change from d where change is not null")
def status_diff(spark, sf):
    return changes.diff_status(*_snapshots(spark, sf))


@catalog.add(
    "incremental_counts",
    _STATUS_SQL + "select project, count(*) filter (change = 'modified' and present) indexed,"
    " count(*) filter (change = 'deleted' or not present) removed from d where change is not null group by project",
)
def incremental_counts(spark, sf):
    last, current, disk = _snapshots(spark, sf)
    return changes.action_counts(changes.split_changes(changes.diff_status(last, current, disk), disk))


_BATCHES = 3


@catalog.add(
    "stream_changes",
    f"""with s as (select {_EVENT}, event_id from events),
 b as (select project, path, event_id % {_BATCHES} batch, max(event_id) seq, arg_max(code, event_id) code from s group by all),
 m as (select *, max(seq) over (partition by project, path order by batch rows between unbounded preceding and 1 preceding) seen from b),
 a as (select *, lag(code) over (partition by project, path order by batch) was from m where seen is null or seq > seen)
select project, path, batch, code, change from (select *, case when code = 'D' then 'deleted'
  when code is distinct from was then 'modified' end change from a) z where change is not null""",
)
def stream_changes(spark, sf):
    """The events as a stream in three batches, many of their rows late; the stream is restarted for each."""
    rows = _statuses(spark, sf).drop("at")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for batch in range(_BATCHES):
        rows.filter(F.col("seq") % _BATCHES == batch).write.mode("append").parquet(f"{folder}/in")
        found = code_changes(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).withColumn("batch", F.lit(batch).cast("bigint"))
        sink = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# New versions of every file whose first symbol is exported, also copied to a new project.
_NEW_FILES = (
    "firsts as (select project, file_path from symbols where ord = 1 and visibility = 'exported'),\n"
    "fresh as (select project, file_path, md5(file_path) content_hash from firsts"
    " union all select distinct '/w/extra', file_path, md5(file_path) from firsts)"
)


def _new_files(files):
    first = F.col("symbols")[0]["visibility"]
    chosen = files.filter(first == "exported").select("project", "file_path", F.md5("file_path").alias("content_hash"))
    return chosen.unionByName(chosen.withColumn("project", F.lit("/w/extra")).distinct())


@catalog.add(
    "upsert_files",
    W("files", "symbols", extra=_NEW_FILES)
    + "select project, file_path, content_hash from files f where not exists (select 1 from fresh n"
    " where n.project = f.project and n.file_path = f.file_path) union all select * from fresh",
)
def upsert_files(spark, sf):
    files = fx.files(spark, sf)
    return changes.upsert_files(files.select("project", "file_path", "content_hash"), _new_files(files), fx.file_rows(spark, sf))


@catalog.add(
    "needs_parse",
    W("files", "symbols", extra=_NEW_FILES)
    + "select n.project, n.file_path, n.content_hash from fresh n left join files f"
    " on f.project = n.project and f.file_path = n.file_path where n.content_hash is distinct from f.content_hash",
)
def needs_parse(spark, sf):
    files = fx.files(spark, sf)
    return changes.needs_parse(_new_files(files), files)


_NEW_EDGE = (
    f"'/w/p' || (o_orderkey % {fx.PROJECTS}) as project, '/w/p' || (o_orderkey % {fx.PROJECTS}) || {fx.path_sql('o_custkey')} as source_path,"
    f" '/w/p' || (o_orderkey % {fx.PROJECTS}) || {fx.path_sql('cast(floor(o_totalprice / 100000) as bigint)')} as target_path"
)


@catalog.add(
    "replace_imports",
    W("edges", extra=f"raw as (select {_NEW_EDGE}, o_orderstatus sym, o_orderkey ord from orders)")
    + """select project, source_path, target_path, specifier, sym from edges e where not exists
 (select 1 from raw r where r.project = e.project and r.source_path = e.source_path)
union all select project, source_path, target_path, './o', arg_min(sym, ord) from raw group by all""",
)
def replace_imports(spark, sf):
    columns = _NEW_EDGE.split(", ", 2)
    new = fx.read(spark, sf, "orders").selectExpr(
        *columns, "'./o' as specifier", "array(o_orderstatus) as symbols", "o_orderkey as ord"
    )
    merged = changes.replace_imports(fx.imports(spark, sf), new.select("project", "source_path"), new)
    return merged.select("project", "source_path", "target_path", "specifier", F.get("symbols", F.lit(0)).alias("sym"))


_GONE = "gone as (select project, file_path from symbols where ord = 2 and visibility = 'private')"


def _gone(files):
    return files.filter(F.col("symbols")[1]["visibility"] == "private").select("project", "file_path")


_EDGE_STAYS = "not exists (select 1 from gone g where g.project = e.project and (g.file_path = e.source_path or g.file_path = e.target_path))"


@catalog.add(
    "remove_file",
    W("files", "edges", "symbols", extra=_GONE)
    + f"""select 'file' as kind, project, file_path, null::varchar as target_path, null::varchar as specifier
 from files where (project, file_path) not in (select (project, file_path) from gone)
union all select 'import', project, source_path, target_path, specifier from edges e where {_EDGE_STAYS}""",
)
def remove_file(spark, sf):
    """What is left of both tables: a removed file takes the edges at either end of it along."""
    files = fx.files(spark, sf)
    rows = fx.file_rows(spark, sf) + fx.edge_rows(spark, sf)
    left, edges = changes.remove_file(files.select("project", "file_path"), fx.imports(spark, sf), _gone(files), rows)
    none = F.lit(None).cast("string")
    return left.select(F.lit("file").alias("kind"), "project", "file_path", none.alias("target_path"), none.alias("specifier")).unionByName(
        edges.select(F.lit("import").alias("kind"), "project", F.col("source_path").alias("file_path"), "target_path", "specifier")
    )


@catalog.add(
    "remove_edges",
    W("edges", "symbols", extra=_GONE)
    + """select project, source_path, target_path, specifier from edges e where not exists
 (select 1 from gone g where g.project = e.project and (g.file_path = e.source_path or g.file_path = e.target_path))""",
)
def remove_edges(spark, sf):
    rows = fx.edge_rows(spark, sf) + fx.file_rows(spark, sf)
    left = changes.remove_edges(fx.imports(spark, sf), _gone(fx.files(spark, sf)), rows)
    return left.select("project", "source_path", "target_path", "specifier")


_STATUS_LINE = (
    f"'/w/p' || (o_orderkey % {fx.PROJECTS}) as project, case o_orderstatus when 'O' then ' M ' when 'F' then '?? ' else 'R  ' end ||"
    " case o_orderpriority when '1-URGENT' then 'dir/' when '2-HIGH' then 'notes' || o_orderkey || '.txt'"
    " when '3-MEDIUM' then '\"src/a ' || o_orderkey || '.ts\"' when '4-NOT SPECIFIED' then 'src/o' || o_orderkey || '.rs -> src/n' || o_orderkey || '.rs'"
    " else 'src/f' || o_orderkey || '.ts' end as line"
)


@catalog.add(
    "status_parse",
    f"""with t as (select {_STATUS_LINE} from orders), p as (select project, project || '/' || substr(line, 4) path, trim(substr(line, 1, 2)) code from t)
select project, path, code from p where regexp_extract(path, '[^/]\\.([^./]+)$', 1) in ('ts','tsx','js','jsx','mjs','cjs','rs','rb','ex','exs')""",
)
def status_parse(spark, sf):
    project, line = _STATUS_LINE.split(", ", 1)
    return gittext.parse_status(fx.read(spark, sf, "orders").selectExpr(project, line))


_NUMSTAT_LINE = (
    "'/w/p' || (l_orderkey % 30) as project, case l_returnflag when 'N' then '-' || chr(9) || '-' else l_suppkey || chr(9) || l_linenumber end"
    " || chr(9) || 'src/f' || l_partkey || '.ts' as line"
)


@catalog.add(
    "numstat_parse",
    f"""with t as (select {_NUMSTAT_LINE} from lineitem)
select project, split_part(line, chr(9), 1) added, split_part(line, chr(9), 2) removed, split_part(line, chr(9), 3) file
from t where split_part(line, chr(9), 1) <> '-'""",
)
def numstat_parse(spark, sf):
    project, line = _NUMSTAT_LINE.split(", ", 1)
    return gittext.parse_numstat(fx.read(spark, sf, "lineitem").selectExpr(project, line))
