"""The stored tables after changes: search from the kept index, and status snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom import fixture as fx
from codeloom.catalog import Catalog
from codeloom.catalog.graphs import bm25_sql
from codeloom.session import shared_folder
from codeloom.sources.store import CodeStore

catalog = Catalog()
W = fx.with_ctes


def _filled(spark, sf):
    """A store of all files, in a folder of its own."""
    store = CodeStore(spark, location=f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=2)
    files = fx.files(spark, sf).withColumn("last_parsed_epoch", F.lit(0).cast("bigint"))
    store.upsert_files(files)
    return store, files


def _top_sql(corpus: str, terms: list[str]) -> str:
    found = W("files", extra=f"corpus as ({corpus}),\n" + bm25_sql("corpus", "project, file_path", terms))
    return found + """select project, file_path, score, r as rank from (
 select *, row_number() over (partition by project order by score desc, file_path) r from sc) z where r <= 10"""


def _ranked(found):
    return found.select("project", "file_path", "score", F.col("rank").cast("bigint").alias("rank"))


_CHANGED = "select project, file_path, case language when 'ruby' then file_path || ' renamed widget' else searchable end as text from files"


@catalog.add("search_after_update", _top_sql(_CHANGED, ["renamed", "widget"]))
def search_after_update(spark, sf):
    store, files = _filled(spark, sf)
    store.upsert_files(files.filter("language = 'ruby'").withColumn("searchable", F.expr("file_path || ' renamed widget'")))
    return _ranked(store.view().search(["Renamed widget"], 10, by_project=True))


@catalog.add(
    "search_after_remove", _top_sql("select project, file_path, searchable as text from files where language <> 'rust'", ["red", "widget"])
)
def search_after_remove(spark, sf):
    store, files = _filled(spark, sf)
    store.remove(files.filter("language = 'rust'").select("project", "file_path"))
    return _ranked(store.view().search(["red widget"], 10, by_project=True))


@catalog.add(
    "stored_status",
    f"""with s as (select distinct '/w/p' || (o_orderkey % {fx.PROJECTS}) project, o_orderkey % 97 path, o_orderkey % 3 code from orders),
 t as (select project, path, max(code) code from s group by all)
select project, project || '/f' || path as path, case code when 0 then 'M' when 1 then 'D' else '??' end as code from t
where project <> '/w/p1' and not (project = '/w/p2' and path % 2 = 0)""",
)
def stored_status(spark, sf):
    """Snapshots as saved last: one project was cleared, another saved anew with fewer paths."""
    project = F.expr(f"'/w/p' || (o_orderkey % {fx.PROJECTS})")
    orders = fx.read(spark, sf, "orders").select(project.alias("project"), (F.col("o_orderkey") % 97).alias("n"), (F.col("o_orderkey") % 3).alias("c"))
    status = orders.groupBy("project", "n").agg(F.max("c").alias("c")).select(
        "project", F.expr("project || '/f' || n").alias("path"), F.expr("case c when 0 then 'M' when 1 then 'D' else '??' end").alias("code"), "n"
    )
    store = CodeStore(spark, location=f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=2)
    store.save_status(status.select("project"), status.drop("n"))
    again = status.filter("project in ('/w/p1', '/w/p2')")
    store.save_status(again.select("project"), again.filter("project = '/w/p2' and n % 2 = 1").drop("n"))
    return store.snapshots().select("project", "path", "code")
