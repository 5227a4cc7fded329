"""Versions of the store: all tables change at once, readers keep theirs, and the index follows."""

import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions.text import analyze
from codeloom.operators import search
from codeloom.schema import FILES, IMPORTS
from codeloom.sources import store as store_module
from codeloom.sources.store import CodeStore
from codeloom.sources.versions import Conflict

EDGES = "project string, source_path string, target_path string, specifier string, symbols array<string>, ord bigint"


def files(spark, texts, project="/p"):
    return spark.createDataFrame([(project, f"{project}/{n}", "ruby", [], "", t, "h", 0) for n, t in texts.items()], FILES)


def edges(spark, pairs, project="/p"):
    return spark.createDataFrame([(project, f"{project}/{s}", f"{project}/{t}", "./x", ["s"], k) for k, (s, t) in enumerate(pairs)], EDGES)


def sources(spark, names, project="/p"):
    return spark.createDataFrame([(project, f"{project}/{n}") for n in names], "project string, source_path string")


@pytest.fixture
def place(spark, tmp_path):
    return CodeStore(spark, location=str(tmp_path / "db"), buckets=3)


def held(view):
    return sorted(r.searchable for r in view.files().collect()), sorted(r.target_path for r in view.imports().collect())


def test_a_reader_sees_old_or_new_of_both_tables(spark, place):
    with place.change() as change:
        change.upsert_files(files(spark, {"a": "one", "b": "two"}))
        change.replace_imports(sources(spark, ["a"]), edges(spark, [("a", "b")]))
    old = place.view()
    with place.change() as change:
        change.upsert_files(files(spark, {"a": "three"}))
        assert held(place.view()) == (["one", "two"], ["/p/b"])  # nothing is published yet
        assert held(change) == (["three", "two"], ["/p/b"])
        change.replace_imports(sources(spark, ["a"]), edges(spark, [("a", "c")]))
    assert held(place.view()) == (["three", "two"], ["/p/c"])
    assert held(old) == (["one", "two"], ["/p/b"]) and held(place.view(old.version)) == held(old)
    assert [r["rank"] for r in old.search(["one", "three"], 5).collect()] == [1]
    assert {r["query"] for r in place.view().search(["one", "three"], 5).collect()} == {1}
    place.view().create_views()
    assert spark.sql("select count(*) from code_file join code_import on file_path = source_path").first()[0] == 1


def test_a_change_that_fails_or_meets_another_changes_nothing(spark, place):
    place.upsert_files(files(spark, {"a": "one"}))
    with pytest.raises(ZeroDivisionError), place.change() as change:
        change.upsert_files(files(spark, {"a": "two"}))
        raise ZeroDivisionError
    assert held(place.view())[0] == ["one"]
    with pytest.raises(Conflict), place.change() as slow:
        slow.upsert_files(files(spark, {"a": "slow"}))
        place.upsert_files(files(spark, {"b": "quick"}))
    assert held(place.view())[0] == ["one", "quick"]
    before = place.view().version
    with place.change():
        pass
    assert place.view().version == before
    assert not [n for n in os.listdir(f"{place.location}/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_sweeping_keeps_what_the_newest_versions_name(spark, place):
    for k in range(4):
        place.upsert_files(files(spark, {"a": f"text {k}"}))
    place.sweep(keep=2)
    assert place.versions.numbers() == [3, 4]
    assert held(place.view(3))[0] == ["text 2"] and held(place.view())[0] == ["text 3"]
    assert len(os.listdir(f"{place.location}/data/code_file")) == 2


def test_opening_again(spark, place):
    place.upsert_files(files(spark, {"a": "one"}))
    assert CodeStore(spark, location=place.location).buckets == 3
    assert held(CodeStore(spark, location=place.location).view())[0] == ["one"]
    with pytest.raises(ValueError):
        CodeStore(spark, location=place.location, buckets=4)


def test_the_index_follows_updates_removals_and_merges(spark, place, monkeypatch):
    monkeypatch.setattr(store_module, "SEGMENTS", 3)
    place.upsert_files(files(spark, {f"f{k}": f"red {'blue ' * k} t{k}" for k in range(6)}))
    place.upsert_files(files(spark, {"x": "red green", "y": "", "z": "blue"}, "/q"))
    for k in range(4):
        place.upsert_files(files(spark, {"f1": f"green blue {k}", f"n{k}": "red blue blue"}))
        place.remove(spark.createDataFrame([("/p", f"/p/f{k + 2}"), ("/p", "/p/none")], "project string, file_path string"))
        view = place.view()
        corpus = view.files().select("project", "file_path", "searchable")
        queries = ["red", "Blue red", "green", "nowhere", "", "blue blue"]
        got = view.search(queries, 4).collect()
        for q, text in enumerate(queries):
            wanted = [(r.project, r.file_path, r.score) for r in search.search(corpus, "searchable", "file_path", text, 4).collect()]
            assert [(r.project, r.file_path, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == wanted
    # At most so many segments, and no scan of the texts.
    assert max(len(c) for c in view._manifest["tables"]["code_token"].values()) <= 3
    plan = view.search(["red"], 4)._jdf.queryExecution().toString()
    assert "searchable" not in plan
    only = view.search(["red"], 9, project="/q").collect()
    assert [(r.project, r.file_path) for r in only] == [("/q", "/q/x")]
    by_project = view.search(["red"], 1, by_project=True).collect()
    assert sorted(r.project for r in by_project) == ["/p", "/q"]


def test_empty_store(spark, place):
    view = place.view()
    assert view.files().count() == view.imports().count() == view.search(["a"], 3).count() == view.search([], 3).count() == 0
    assert view.files().schema.fieldNames() == FILES.fieldNames() and view.imports().schema.fieldNames() == IMPORTS.fieldNames()
    place.remove(spark.createDataFrame([("/p", "/p/a")], "project string, file_path string"))
    place.replace_imports(sources(spark, []), edges(spark, []))
    assert held(place.view()) == ([], [])


def test_posting_lists_hold_what_postings_do(spark):
    every = "".join(map(chr, range(1, 128)))
    rows = ["a b a", "", None, "   ", "Foo_bar1 2", every, every + "x", "Äpfel 12 äpfel\u2003x", "\u0130x", "ab" * 50, "x" + "1" * 9, "a\x0bb\x85c", "no\nmore ", "red"]
    texts = spark.createDataFrame([(f"b{k % 3}", k, t) for k, t in enumerate(rows * 40)], "block string, place bigint, text string").repartition(3)
    lists = search.posting_lists(texts, "text")
    wanted = sorted((r.token, r.block, r.place, r.tf) for r in search.postings(texts, "text", ["block", "place"]).collect())
    assert sorted(map(tuple, search.listed(lists).collect())) == wanted
    merged = search.as_lists(search.listed(lists))
    assert sorted(map(tuple, search.listed(merged).collect())) == wanted and merged.count() < len(wanted) / 10
    counted = texts.select(search.token_count(F.col("text")).alias("n"), F.coalesce(F.size(analyze(F.col("text"))), F.lit(0)).alias("m"))
    assert counted.filter("n <> m or n is null").count() == 0


def test_new_files_are_written_once_and_no_posting_is_moved(spark, place, monkeypatch):
    """The files are stored where they stay, not beside it, and the index is made from there without a shuffle."""
    written, plans = [], []
    write, stored = store_module.Change._write, store_module.durable

    def watched(self, name, rows, spread=True):
        plans.append((name, rows._jdf.queryExecution().executedPlan().toString()))
        return write(self, name, rows, spread)

    monkeypatch.setattr(store_module.Change, "_write", watched)
    monkeypatch.setattr(store_module, "durable", lambda df: written.append(df.columns) or stored(df))
    place.upsert_files(files(spark, {"a": "red", "b": "blue", "c": "red blue"}))
    plans.clear()
    place.upsert_files(files(spark, {"a": "green", "d": "blue"}))
    assert not [c for c in written if "searchable" in c]
    assert [p for n, p in plans if n == "code_token"] and "Exchange" not in "".join(p for n, p in plans if n == "code_token")
    # Of the files that stay, those that no new file's key can be are copied as they lie.
    assert [n for n, p in plans].count("code_file") == 3 and "Exchange" not in [p for n, p in plans if n == "code_file"][1]
    assert held(place.view())[0] == ["blue", "blue", "green", "red blue"]
    assert [(r["query"], r.file_path) for r in place.view().search(["red", "green"], 5).orderBy("query").collect()] == [(0, "/p/c"), (1, "/p/a")]


def test_many_hits_are_found_as_few_are(spark, place, monkeypatch):
    place.upsert_files(files(spark, {f"f{k}": f"red {'blue ' * (k % 4)}" for k in range(40)}))
    place.remove(spark.createDataFrame([("/p", f"/p/f{k}") for k in range(0, 40, 3)], "project string, file_path string"))
    few = place.view().search(["red", "red blue"], 50).orderBy("query", "rank").collect()
    monkeypatch.setattr(store_module, "BROADCAST_ROWS", 0)
    assert place.view().search(["red", "red blue"], 50).orderBy("query", "rank").collect() == few and len(few) > 30


def test_a_file_that_comes_twice_counts_once_in_the_ranking(spark, place):
    row = ("/p", "/p/a", "ruby", [], "", "red blue", "h", 0)
    place.upsert_files(spark.createDataFrame([row, row, ("/p", "/p/b", "ruby", [], "", "red", "h", 0), ("/p", "/p/c", "ruby", [], "", "red", "h", 0)], FILES))
    assert place.view().files().count() == 4
    assert [r.file_path for r in place.view().search(["red blue"], 5).collect()] == ["/p/a"]
    assert len(place.view().search(["red"], 5).collect()) == 3
