"""Source trees read as a data source."""

import os

import pytest

from codeloom.sources.listing import list_tree
from codeloom.sources.tree import FORMAT, PUSHDOWN, FilteringTreeReader, SourceTree, read_trees

NAMES = ["a.ts", "src/b.rs", "src/deep/er/c.rb", "src/notes.md", ".dotfile.js", ".hidden/x.ts", "node_modules/l/i.js", "src/node_modules/y.js", "_app/p.tsx"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("trees") / "one"
    for name in NAMES:
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}\n")
    (base / "bad.js").write_bytes(b"\xff")
    os.symlink(base, base / "src" / "loop")
    (base / "empty").mkdir()
    return base


@pytest.mark.parametrize("partitions", [1, 3, 256])
def test_same_as_listing_by_level(spark, root, partitions):
    spark.dataSource.register(SourceTree)
    rows = spark.read.format(FORMAT).option("partitions", partitions).load(str(root))
    found = sorted(map(tuple, rows.collect()))
    listed = list_tree(spark, [str(root)], skipped=False).collect()
    skipped = {"node_modules", ".hidden"}
    assert found == sorted(tuple(r) for r in listed if not skipped & set(r.path.split("/")))
    assert {r[1] for r in found if r[3]} == {str(root / n) for n in ("a.ts", "src/b.rs", "src/deep/er/c.rb", ".dotfile.js", "_app/p.tsx", "bad.js")}


def test_contents(spark, root):
    rows = {r.path: r.content for r in read_trees(spark, [str(root), str(root / "src")], contents=True).filter("indexable").collect()}
    assert rows[str(root / "a.ts")] == "// a.ts\n"
    assert rows[str(root / "bad.js")] is None
    assert read_trees(spark, [str(root), str(root / "src")]).filter("indexable").count() == 8  # two below both


def test_missing_and_none(spark, root):
    assert read_trees(spark, [str(root / "missing")]).count() == 0
    assert read_trees(spark, []).count() == 0


def test_pushed_filters(spark, root):
    spark.conf.set(PUSHDOWN, "true")
    try:
        rows = read_trees(spark, [str(root), str(root / "src")])
        some = rows.filter(f"project = '{root}' and indexable and path like '{root}/src/%' and path not like '%.rb'")
        assert [r.path for r in some.collect()] == [str(root / "src/b.rs")]
        assert rows.filter("is_dir and indexable").count() == 0
        assert rows.filter("project is null").count() == 0
        dirs = rows.filter(f"is_dir and project in ('{root}', 'x')").collect()
        assert {os.path.relpath(r.path, root) for r in dirs} == {"src", "src/deep", "src/deep/er", "_app", "empty"}
    finally:
        spark.conf.unset(PUSHDOWN)


def test_only_what_may_hold_the_path_is_planned(root):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    reader = FilteringTreeReader([str(root)], False, 256)
    left = list(reader.pushFilters([StringStartsWith(("path",), f"{root}/src/d"), EqualTo(("content",), "x")]))
    assert left == [EqualTo(("content",), "x")]
    assert {p.path for p in reader.partitions()} == {str(root), str(root / "src"), str(root / "src/deep"), str(root / "src/deep/er")}
