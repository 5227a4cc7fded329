"""Joins with sides that Spark takes for smaller than they are: none is broadcast uncounted."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from codeloom import fixture as fx
from codeloom.operators import changes, detail, stats
from codeloom.parse import elixir, ruby, rust, script
from codeloom.plans import views
from codeloom.schema import SYMBOL
from codeloom.session import TASK_ROWS, may_hold

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def exploded(spark):
    """One row to Spark's estimate, 1,000 in truth."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("n"))
    return rows.selectExpr("'p' as project", "'/p/f' || n as file_path", "md5('' || n % 10) as content_hash")


def test_files_are_estimated_with_all_projects(spark):
    def size(df):
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    assert size(fx.files(spark, SF)) >= fx.PROJECTS * size(fx.read(spark, SF, "part"))


def test_needs_parse_does_not_broadcast_the_stored_files(exploded):
    other = exploded.withColumn("content_hash", F.md5(F.lit("0")))
    found = changes.needs_parse(exploded, other)
    assert "Broadcast" not in plan(found)
    assert found.count() == 1000 - 100


def test_post_edit_lines_does_not_broadcast_the_files(spark, exploded):
    changed = spark.createDataFrame([("p", "3", "1", "/p/f7")], "project string, added string, removed string, file string")
    target = "'/p/f' || if(content_hash < '8', 7, 8) as target_path"
    imports = exploded.selectExpr("project", "file_path as source_path", target, "'./f7' as specifier", "array('x') as symbols")
    found = views.post_edit_lines(imports, exploded, changed)
    # The counted keys are broadcast, once to the edges and once to the files, and nothing else.
    assert plan(found).count("BroadcastExchange") == 2
    n = imports.filter("target_path = '/p/f7'").count()
    assert [r.line for r in found.collect()] == [f"- /p/f7 (+3/-1), {n} dependents"]


def test_upsert_files_does_not_broadcast_the_new_files(exploded):
    merged = changes.upsert_files(exploded, exploded.filter("file_path < '/p/f2'"))
    assert "Broadcast" not in plan(merged)
    assert merged.count() == 1000


def test_removed_files_are_not_broadcast(exploded):
    left = changes.remove_files(exploded, exploded.filter("file_path < '/p/f2'"))
    assert "Broadcast" not in plan(left)
    assert left.count() == exploded.filter("file_path >= '/p/f2'").count()


def test_removed_files_are_not_broadcast_to_edges(exploded):
    edges = exploded.selectExpr("project", "file_path as source_path", "'/p/f' || left(content_hash, 1) as target_path")
    left = changes.remove_edges(edges, exploded.filter("file_path < '/p/f2'"))
    assert "Broadcast" not in plan(left)
    assert left.count() == edges.filter("source_path >= '/p/f2' and target_path >= '/p/f2'").count()


def test_prompt_context_matches_the_files_once(spark, exploded):
    files = exploded.withColumns({"language": F.lit("typescript"), "symbols": F.array().cast(f"array<{SYMBOL.simpleString()}>")})
    imports = exploded.selectExpr("project", "file_path as source_path", "'/p/f7.ts' as target_path", "'./f7' as specifier", "array('x') as symbols")
    files = files.withColumn("file_path", F.concat("file_path", F.lit(".ts")))
    prompts = spark.createDataFrame([(1, "p", "see f7.ts")], "prompt_id long, project string, prompt string")
    found = views.prompt_context(files, imports, prompts)
    assert "WindowGroupLimit" not in plan(found)
    assert [r.file_path for r in found.collect()] == ["/p/f7.ts"]


@pytest.mark.parametrize("extract, name", [(script.extract, "a.ts"), (rust.extract, "a.rs"), (ruby.extract, "a.rb"), (elixir.extract, "a.ex")])
def test_texts_are_scanned_once_and_tokens_stay_where_they_are(spark, extract, name):
    sources = spark.createDataFrame([("p", f"/p/{name}", "")], "project string, file_path string, content string")
    found = plan(extract(sources))
    assert found.count("regexp_extract_all" if extract is elixir.extract else "ArrowEvalPython") == 1
    # Texts and contents are placed, nothing else moves.
    assert "ENSURE_REQUIREMENTS" not in found and "Broadcast" not in found


def test_a_task_that_removes_edges_gets_a_bounded_number_of_rows(spark, exploded):
    """Parts follow the rows, not the session's number of shuffle partitions."""
    files = exploded.withColumn("project", F.expr("'p' || substr(file_path, 5, 1)"))
    edges = files.selectExpr("project", "file_path as source_path", "'/p/f' || left(content_hash, 1) as target_path")
    gone = files.filter("file_path < '/p/f2'")
    left = changes.remove_edges(edges, gone, 40 * TASK_ROWS)
    exchanges = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan(left))
    assert exchanges == ["40"] * 4
    assert sorted(left.collect()) == sorted(changes.remove_edges(edges, gone).collect())


def test_duplicate_edges_are_not_grouped_before_they_are_placed(spark):
    found = plan(fx.imports(spark, SF))
    assert "Aggregate" in found and "Aggregate" not in found.split("Exchange", 1)[1]


@pytest.mark.parametrize("change", [changes.remove_files, changes.upsert_files])
def test_a_task_that_removes_or_replaces_files_gets_a_bounded_number_of_rows(change, exploded):
    files = exploded.withColumn("project", F.expr("'p' || substr(file_path, 5, 1)"))
    new = files.filter("file_path < '/p/f2'")
    left = change(files, new, 40 * TASK_ROWS)
    assert re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan(left)) == ["40"] * 2
    assert sorted(left.collect()) == sorted(change(files, new).collect())


def test_a_task_that_counts_importers_gets_a_bounded_number_of_rows(spark):
    edges = fx.imports(spark, SF)
    found = stats.fan_in(edges, 40 * TASK_ROWS)
    assert re.search(r"Exchange hashpartitioning\(project#\d+, target_path#\d+, source_path#\d+, 40\)", plan(found))
    assert sorted(found.collect()) == sorted(stats.fan_in(edges).collect())


def test_remove_file_takes_the_edges_at_either_end_along(spark):
    files = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "project string, file_path string")
    pairs = [("p", "a", "b"), ("p", "b", "a"), ("p", "b", "c"), ("q", "b", "a"), ("p", "b", None)]
    edges = spark.createDataFrame([(*e, "./x") for e in pairs], "project string, source_path string, target_path string, specifier string")
    gone = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "none")], "project string, file_path string")
    left, kept = changes.remove_file(files, edges, gone, 10)
    assert sorted(map(tuple, left.collect())) == [("p", "b"), ("q", "a")]
    assert sorted((r.project, r.source_path, r.target_path or "") for r in kept.collect()) == [("p", "b", ""), ("p", "b", "c"), ("q", "b", "a")]


def test_the_remove_file_query_deletes_edges_of_removed_files(spark):
    left = queries()["remove_file"](spark, SF)
    files, edges = left.filter("kind = 'file'"), left.filter("kind = 'import'")
    assert edges.count() == queries()["remove_edges"](spark, SF).count() < fx.imports(spark, SF).count()
    gone = fx.files(spark, SF).join(files, ["project", "file_path"], "left_anti").select("project", "file_path")
    assert gone.count() > 0
    for end in ("file_path", "target_path"):
        assert edges.join(gone.toDF("project", end), ["project", end]).count() == 0


def test_prompt_context_moves_no_edges_of_other_files(spark):
    """What it stores of the edges are those near the files asked about."""
    files = fx.files(spark, SF)
    some = files.select("project", "file_path").orderBy("project", "file_path").limit(20)
    imports = fx.imports(spark, SF)
    near = detail.edges_near(imports, detail.distinct_keys(some))
    # The test is below the shuffle that makes the edges.
    assert plan(near).index("Exchange hashpartitioning(p#") < plan(near).index("getbit")
    kept = imports.join(some.toDF("project", "source_path"), ["project", "source_path"], "left_semi").unionByName(
        imports.join(some.toDF("project", "target_path"), ["project", "target_path"], "left_semi")
    )
    assert kept.count() > 0 and kept.exceptAll(near.unionByName(near)).count() == 0
    assert near.count() < imports.count() / 10


def test_may_hold_rejects_no_key_that_is_there(spark):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 7, null, 'p' || id % 3) as project", "'f' || id as file_path")
    small = rows.filter("file_path like '%77'")
    found = rows.filter(may_hold(small, ["project", "file_path"], small.count())(F.col("project"), F.col("file_path")))
    assert small.exceptAll(found).count() == 0 and found.count() < 1_000
    nothing = rows.filter(may_hold(rows.limit(0), ["file_path"], 0)(F.col("file_path")))
    assert nothing.count() == 0
