"""Expressions, suffix matching, search and change rules on small inputs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from codeloom import session
from codeloom.functions import paths, text
from codeloom.operators import changes, lookup, search
from codeloom.operators.resolve import in_listing, resolve_imports
from codeloom.sources import gittext


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "given,expected",
    [
        ("look at src/main.rs and src/server.rs", ["src/main.rs", "src/server.rs"]),
        ("check `src/parser/mod.rs` for the issue", ["src/parser/mod.rs"]),
        ("the version is 1.2.3 and we should upgrade", []),
        ("update components/Button.tsx and utils/helpers.ts", ["components/Button.tsx", "utils/helpers.ts"]),
        ("src/main.rs and src/main.rs again", ["src/main.rs"]),
        ("(see 'a.py', \"b.md\")! main.rs. .ts", [".ts", "a.py", "b.md"]),
    ],
)
def test_file_mentions(spark, given, expected):
    assert value(spark, text.file_mentions(F.lit(given))) == expected


@pytest.mark.parametrize(
    "given,expected",
    [("/a/./b/../c", "/a/c"), ("/../x", "x"), ("a/b/../../..", ""), ("/", "/"), ("/a//b/", "/a/b"), ("./x", "x")],
)
def test_normalize_path(spark, given, expected):
    assert value(spark, paths.normalize_path(F.lit(given))) == expected


def test_small_expressions(spark):
    lit = F.lit
    assert value(spark, paths.to_snake_case(lit("HTTPClient"))) == "h_t_t_p_client"
    assert value(spark, paths.relative_path(lit("/w/ab/x"), lit("/w/a"))) == "b/x"
    assert value(spark, paths.extension(lit("/a/.ts"))) == "" and value(spark, paths.extension(lit("/a/.e.js"))) == "js"
    assert value(spark, paths.language_of(lit("/a/b.jsx"))) == "javascript" and value(spark, paths.language_of(lit("/a/b.py"))) is None
    assert value(spark, paths.is_relative_import(lit("./a"))) and not value(spark, paths.is_relative_import(lit("..")))
    assert value(spark, text.strip_quotes(lit("'`\"a'b\"`"))) == "a'b"
    assert value(spark, text.signature(lit("fn a() {\n}"))) == "fn a()" and value(spark, text.signature(lit(" a\nb"))) == "a"
    assert value(spark, text.capped_list(F.array(lit("a"), lit("b")), lit(5), 2)) == "a, b + 3 more"
    assert value(spark, text.json_strings(lit("[bad"))) == [] and value(spark, text.json_strings(lit('["a"]'))) == ["a"]
    assert value(spark, text.json_status(lit(None).cast("string"))) == {}
    assert value(spark, text.json_file_path(lit('{"tool_input":{"file_path":""}}'))) is None
    assert value(spark, text.analyze(lit("src/UserStore2.ts"))) == ["src", "/", "userstore", "2", ".", "ts"]
    assert value(spark, text.content_hash(lit("abc"))) == "900150983cd24fb0d6963f7d28e17f72"


@pytest.mark.parametrize("limit", [50_000, -1])
def test_suffix_matches(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    names = ["/p/a_b.ts", "/p/axb.ts", "/p/b.ts", "/p/deep/very/long/directory/name/b.ts", "/p/c.rs"]
    files = spark.createDataFrame([("p", n) for n in names] + [("q", "/q/b.ts")], "project string, file_path string")
    asked = ["_b.ts", "b.ts", "very/long/directory/name/b.ts", "none.ts", "%/c.rs", "b.ts"]
    suffixes = spark.createDataFrame([("p", s) for s in asked], "project string, suffix string")
    got = {}
    for r in lookup.suffix_matches(files, suffixes).orderBy("rank").collect():
        got.setdefault(r.suffix, []).append(r.file_path)
    like = lambda s: re.compile(".*" + re.escape(s).replace("_", ".").replace("%", ".*") + "$")
    assert got == {s: hits for s in asked if (hits := sorted(n for n in names if like(s).match(n))[:3])}


def brute_bm25(docs, query):
    tok = lambda s: re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", s.lower())
    tokens = {k: tok(v) for k, v in docs.items()}
    n, avgdl, terms = len(docs), sum(map(len, tokens.values())) / len(docs), set(tok(query))
    scores = {}
    for k, t in tokens.items():
        if all(w in t for w in terms):
            s = 0.0
            for w in terms:
                df, tf = sum(w in x for x in tokens.values()), t.count(w)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
            scores[k] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def test_search(spark):
    docs = {"a": "src/user.ts User login", "b": "src/user_store.ts UserStore user user", "c": "lib/x.rb user", "d": "src/other.ts Other"}
    corpus = spark.createDataFrame(list(docs.items()), "id string, body string")
    for query in ("user", "src .ts", "user ts user", "absent user"):
        expected = brute_bm25(docs, query)
        assert [(r.id, r.score) for r in search.search(corpus, "body", "id", query, 10).collect()] == expected
        index, size = search.postings(corpus, "body", ["id"]), search.corpus_size(corpus, "body")
        assert [(r.id, r.score) for r in search.search_postings(index, size, ["id"], query, 10).collect()] == expected
    assert search.search(corpus, "body", "id", "  ").count() == 0
    assert [r.id for r in search.search(corpus, "body", "id", "user", 10, keep="id <> 'b'").collect()] == [
        k for k, _ in brute_bm25(docs, "user") if k != "b"
    ]


def status(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project string, path string, code string")


def test_status_text(spark):
    lines = [" M src/a.ts", "?? src/b.rs", " D src/c.rb", "R  src/d.ts -> src/e.ts", "?? dir/", "?? notes.txt", ' M "src/f g.ts"', "M", ""]
    frame = spark.createDataFrame([("/w", x) for x in lines], "project string, line string")
    got = {(r.path, r.code) for r in gittext.parse_status(frame).collect()}
    assert got == {("/w/src/a.ts", "M"), ("/w/src/b.rs", "??"), ("/w/src/c.rb", "D"), ("/w/src/d.ts -> src/e.ts", "R")}
    renamed = {(r.path, r.code) for r in gittext.split_renames(gittext.parse_status(frame)).collect()}
    assert {("/w/src/d.ts", "D"), ("/w/src/e.ts", "A")} <= renamed
    stat = spark.createDataFrame([("/w", x) for x in ("3\t1\tsrc/a.ts", "-\t-\tlogo.png", "0\t5\tsrc/c.rb", "x")], "project string, line string")
    assert {(r.added, r.removed, r.file) for r in gittext.parse_numstat(stat).collect()} == {("3", "1", "src/a.ts"), ("0", "5", "src/c.rb")}


def test_status_diff(spark):
    last = status(spark, [("/same", "M"), ("/new_code", "M"), ("/gone", "M"), ("/reverted", "M"), ("/was_d", "D")])
    now = status(spark, [("/same", "M"), ("/new_code", "A"), ("/added", "??"), ("/del", "D"), ("/was_d", "D")])
    disk = status(spark, [("/reverted", ""), ("/new_code", "")])
    found = {(r.path, r.change) for r in changes.diff_status(last, now, disk).collect()}
    assert found == {("/new_code", "modified"), ("/gone", "deleted"), ("/added", "modified"), ("/del", "deleted"), ("/was_d", "deleted")}
    actions = changes.split_changes(changes.diff_status(last, now, disk), disk)
    assert {r.path for r in actions.filter("action = 'index'").collect()} == {"/new_code"}
    assert changes.diff_status(now, now, disk).filter("change = 'modified'").count() == 0
    stored = spark.createDataFrame([("p", "/same", "1")], "project string, path string, content_hash string")
    present = spark.createDataFrame([("p", "/same", "2")], "project string, path string, content_hash string")
    by_hash = changes.diff_status(last, now, disk, (stored, present)).filter("path = '/same'").collect()
    assert [r.change for r in by_hash] == ["modified"]


def test_table_upkeep(spark):
    schema = "project string, file_path string, content_hash string"
    old = spark.createDataFrame([("p", "/a", "1"), ("p", "/b", "2"), ("q", "/a", "3")], schema)
    new = spark.createDataFrame([("p", "/a", "9"), ("p", "/c", "4")], schema)
    once = changes.upsert_files(old, new)
    assert sorted(map(tuple, once.collect())) == [("p", "/a", "9"), ("p", "/b", "2"), ("p", "/c", "4"), ("q", "/a", "3")]
    assert sorted(map(tuple, changes.upsert_files(once, new).collect())) == sorted(map(tuple, once.collect()))
    edges = spark.createDataFrame(
        [("p", "/a", "/b", "./b", ["x"]), ("p", "/b", "/a", "./a", ["y"]), ("p", "/c", "/b", "./b", ["z"])],
        "project string, source_path string, target_path string, specifier string, symbols array<string>",
    )
    fresh = spark.createDataFrame(
        [("p", "/a", "/c", "./c", ["second"], 7), ("p", "/a", "/c", "./c", ["first"], 2)],
        "project string, source_path string, target_path string, specifier string, symbols array<string>, ord bigint",
    )
    swapped = changes.replace_imports(edges, fresh.select("project", "source_path"), fresh)
    assert sorted((r.source_path, r.target_path, tuple(r.symbols)) for r in swapped.collect()) == [
        ("/a", "/c", ("first",)), ("/b", "/a", ("y",)), ("/c", "/b", ("z",)),
    ]
    gone = spark.createDataFrame([("p", "/a")], "project string, file_path string")
    assert [(r.source_path, r.target_path) for r in changes.remove_edges(edges, gone).collect()] == [("/c", "/b")]


def test_resolution_order(spark):
    raw = spark.createDataFrame(
        [
            ("p", "/p/src/index.ts", "./utils.ts", "script", ["a"], 1),
            ("p", "/p/src/index.ts", "./utils", "script", ["b"], 2),
            ("p", "/p/src/index.ts", "./components", "script", ["c"], 3),
            ("p", "/p/src/index.ts", "lodash", "script", ["d"], 4),
            ("p", "/p/src/index.ts", "./x.js", "script", ["e"], 5),
            ("p", "/p/src/index.ts", "./legacy.cjs", "script", ["f"], 6),
            ("p", "/p/src/main.rs", "crate::auth", "rust_use", ["auth"], 1),
            ("p", "/p/src/main.rs", "tokio::runtime", "rust_use", ["runtime"], 2),
            ("p", "/p/src/main.rs", "mod db", "rust_mod", ["db"], 3),
            ("p", "/p/src/a/b.rs", "super::auth", "rust_use", ["auth"], 1),
            ("p", "/p/src/m.rb", "./utils.ts", "ruby_require_relative", ["*"], 1),
            ("p", "/p/src/m.rb", "json", "ruby_require", ["*"], 2),
        ],
        "project string, source_path string, specifier string, kind string, symbols array<string>, ord bigint",
    )
    have = ["src/utils.ts", "src/utils.tsx", "src/components", "src/components/index.ts", "src/x.ts", "src/legacy.cjs",
            "src/auth.rs", "src/db/mod.rs", "Cargo.toml"]
    listing = spark.createDataFrame([("p", f"/p/{x}") for x in have], "project string, path string")
    got = {(r.source_path[3:], r.specifier, r.target_path[3:]) for r in resolve_imports(raw, in_listing(listing)).collect()}
    assert got == {
        ("src/index.ts", "./utils.ts", "src/utils.ts"), ("src/index.ts", "./utils", "src/utils.ts"),
        ("src/index.ts", "./components", "src/components/index.ts"), ("src/main.rs", "crate::auth", "src/auth.rs"),
        ("src/main.rs", "mod db", "src/db/mod.rs"), ("src/a/b.rs", "super::auth", "src/auth.rs"),
        ("src/m.rb", "./utils.ts", "src/utils.ts"),
    }
    strict = resolve_imports(raw, in_listing(listing), strict_compat=True)
    assert "crate::auth" not in {r.specifier for r in strict.collect()}
