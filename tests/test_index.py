"""Indexing real trees end to end: listing, parsing, resolution, storage, change detection."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.plans import hooks
from codeloom.plans.tools import Toolbox
from codeloom.sources.listing import list_tree, looks_like_project, read_sources
from codeloom.sources.rules import checked_root, project_path
from codeloom.sources.store import CodeStore

TREE = {
    "src/index.ts": 'import { a } from "./utils";\nimport d from "./components";\nexport const main = 1;\n',
    "src/utils.ts": 'import "./index";\n/** Adds. */\nexport function a() {}\nfunction hidden() {}\n',
    "src/components/index.tsx": "export default class Panel {}\n",
    "__tests__/u.test.js": "const u = require('../src/utils');\nimport('../src/utils.ts');\n",
    ".eslintrc.js": "var rules = 1;\n",
    ".hidden/x.ts": "export const no = 1;\n",
    "node_modules/lib/index.js": "export const no = 1;\n",
    "rs/src/main.rs": "mod db;\nuse crate::db::query;\nuse crate::db;\nfn main() {}\n",
    "rs/src/db.rs": "pub fn query() {}\n",
    "rs/Cargo.toml": "[package]\n",
    "rb/main.rb": "require_relative 'helper'\nrequire 'json'\n",
    "rb/helper.rb": "module Helper; end\n",
    "ex/mix.exs": "defmodule App.MixProject do\nend\n",
    "ex/lib/app/user_store.ex": "defmodule App.UserStore do\n  alias App.Mailer\n  alias Other.Thing\n  use GenServer\nend\n",
    "ex/lib/mailer.ex": "defmodule App.Mailer do\nend\n",
    "README.md": "# no\n",
    "CLAUDE.md": "be kind\n",
    ".claude/rules/b/style.md": "style\n",
    ".claude/skills/a.md": "skill\n",
}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text) if isinstance(text, str) else path.write_bytes(text)


def git(root, *args):
    subprocess.run(["git", "-c", "user.email=t@t", "-c", "user.name=t", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    write(root, {"bad.js": b"\xff\xfe"})
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "start")
    return root


@pytest.fixture(scope="module")
def indexed(spark, tree, tmp_path_factory):
    store = CodeStore(spark, "indexed", str(tmp_path_factory.mktemp("db")))
    tools = Toolbox(spark, store)
    counts = tools.index_project(str(tree)).first()
    return tools, counts


def test_listing(spark, tree):
    rows = list_tree(spark, [str(tree)]).collect()
    indexable = {r.path[len(str(tree)) + 1 :] for r in rows if r.indexable}
    expected = {n for n in TREE if n.rsplit(".", 1)[-1] in ("ts", "tsx", "js", "rs", "rb", "ex", "exs")}
    assert indexable == (expected | {"bad.js"}) - {".hidden/x.ts", "node_modules/lib/index.js"}
    assert any(r.path.endswith("node_modules/lib/index.js") and not r.indexable for r in rows)
    assert list_tree(spark, [str(tree / "missing")]).count() == 0


def test_unreadable_content_is_null(spark, tree):
    paths = spark.createDataFrame([("p", str(tree / "bad.js")), ("p", str(tree / "none.js"))], "project string, file_path string")
    assert [r.content for r in read_sources(paths).collect()] == [None, None]


def test_full_index(indexed, tree):
    tools, counts = indexed
    assert (counts.indexed, counts.skipped) == (12, 1)
    edges = {
        (r.source_path[len(str(tree)) + 1 :], r.target_path[len(str(tree)) + 1 :], r.specifier, tuple(r.symbols))
        for r in tools.store.imports().collect()
    }
    assert edges == {
        ("src/index.ts", "src/utils.ts", "./utils", ("a",)),
        ("src/index.ts", "src/components/index.tsx", "./components", ("default",)),
        ("src/utils.ts", "src/index.ts", "./index", ()),
        ("__tests__/u.test.js", "src/utils.ts", "../src/utils.ts", ("*",)),
        ("rs/src/main.rs", "rs/src/db.rs", "mod db", ("db",)),
        ("rs/src/main.rs", "rs/src/db.rs", "crate::db", ("db",)),
        ("rb/main.rb", "rb/helper.rb", "helper", ("*",)),
        ("ex/lib/app/user_store.ex", "ex/lib/mailer.ex", "App.Mailer", ("*",)),
    }


def test_tools(indexed, tree):
    tools, _ = indexed
    project = str(tree)
    s = tools.stats(project).first()
    assert (s.totalFiles, s.totalImportEdges) == (12, 8)
    assert s.languages["typescript"] == 2 and s.languages["tsx"] == 1
    assert tools.stats("/nowhere").first().totalFiles == 0

    walk = tools.query(project, [f"{project}/src/index.ts"]).collect()
    assert [(r.path, r.reason, r.depth) for r in walk] == [
        ("src/index.ts", "entry", 0),
        ("src/components/index.tsx", "dependency", 1),
        ("src/utils.ts", "dependency", 1),
        ("__tests__/u.test.js", "dependent", 2),
    ]
    assert walk[2].symbols[0].docComment == "Adds. */"
    assert {r.path for r in tools.query(project, ["mailer"]).collect()} == {"ex/lib/mailer.ex", "ex/lib/app/user_store.ex"}
    assert tools.query(project, ["zzz"]).count() == 0

    assert [r.relativePath for r in tools.search(project, "Panel OR".split()[0]).collect()] == []
    assert [r.relativePath for r in tools.search(project, "Helper").collect()] == ["rb/helper.rb"]

    info = tools.get_file_info(project, f"{project}/src/utils.ts").collect()
    assert len(info) == 1
    assert [x.name for x in info[0].symbols] == ["a", "hidden"]
    assert [d.source for d in info[0].dependents] == [f"{project}/__tests__/u.test.js", f"{project}/src/index.ts"]
    assert tools.get_file_info(project, "/none").count() == 0

    found = tools.find_cycles(project).collect()
    assert [(list(r.cycle), r.length) for r in found] == [(["src/index.ts", "src/utils.ts", "src/index.ts"], 2)]
    assert [(r.project, r["count"]) for r in tools.overview().collect()] == [(project, 12)]

    parsed = tools.parse_file(project, f"{project}/rs/src/main.rs").first()
    assert parsed.language == "rust" and [i.specifier for i in parsed.imports] == ["mod db", "crate::db"]


def test_parse_only(spark, tree):
    tools = Toolbox(spark)
    counts = tools.index_project(str(tree)).first()
    assert (counts.indexed, counts.skipped) == (12, 1)
    with pytest.raises(RuntimeError):
        tools.stats(str(tree))


def test_rules(spark, tree):
    blocks = [r.block for r in Toolbox(spark).rules(str(tree)).collect()]
    assert blocks == [
        "--- CLAUDE.md ---\nbe kind\n\n\n",
        "--- .claude/rules/b/style.md ---\nstyle\n\n\n",
        "--- .claude/skills/a.md ---\nskill\n\n\n",
    ]
    assert project_path({"PROJECT_ROOT": "/", "ZED_WORKTREE_ROOT": "/z"}, "/c") == "/z"
    assert project_path({}, "/c") == "/c"
    with pytest.raises(ValueError):
        checked_root(None, {}, "/")
    assert looks_like_project("/home/u/x", "/home/u")
    assert not looks_like_project("/tmp/x", "/home/u") and not looks_like_project("/", "/root")


def test_hooks(spark, indexed, tree):
    tools, _ = indexed
    project = str(tree)
    ask = lambda command, **payload: json.loads(hooks.run(spark, tools.store, command, json.dumps({"cwd": project, **payload})))
    context = lambda answer: answer["hookSpecificOutput"]["additionalContext"]
    assert "Files indexed: 12" in context(ask("hook:context"))
    assert "### src/utils.ts" in context(ask("hook:prompt", prompt="look at `src/utils.ts`"))
    edit = context(ask("hook:pre-edit", tool_input={"file_path": "src/utils.ts"}))
    assert edit.startswith("## Editing src/utils.ts\nDependents: 2")
    assert "hookSpecificOutput" not in ask("hook:pre-read", tool_input={"file_path": "rb/nothing.rb"})
    assert ask("hook:post-edit") == {"continue": True, "suppressOutput": True}
    assert json.loads(hooks.run(spark, tools.store, "hook:prompt", "{")) == {"continue": True, "suppressOutput": True}
    with pytest.raises(SystemExit):
        hooks.run(spark, tools.store, "hook:none", "{}")


def test_detect_changes(spark, tmp_path, tmp_path_factory):
    write(tmp_path, {"a.ts": 'import "./b";\n', "b.ts": "export const b = 1;\n", "c.ts": 'import "./b";\n'})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "start")
    store = CodeStore(spark, "changing", str(tmp_path_factory.mktemp("db2")), buckets=3)
    other = store.files().schema
    rows = [("/elsewhere", "/elsewhere/x.ts", "typescript", [], "", "/elsewhere/x.ts ", "h", 1)]
    store.upsert_files(spark.createDataFrame(rows, other))
    tools = Toolbox(spark, store)
    project = str(tmp_path)
    tools.index_project(project)
    found, counts = tools.detect_changes(project)
    assert found.count() == 0 and counts.count() == 0

    (tmp_path / "b.ts").unlink()
    write(tmp_path, {"c.ts": "export const c = 2;\n", "d.ts": 'import "./a";\n'})
    found, counts = tools.detect_changes(project)
    assert {(r.path[len(project) + 1 :], r.change) for r in found.collect()} == {
        ("b.ts", "deleted"), ("c.ts", "modified"), ("d.ts", "modified"),
    }
    assert [(r.indexed, r.removed) for r in counts.collect()] == [(2, 1)]
    mine = store.files().filter(F.col("project") == project)
    assert {r.file_path[len(project) + 1 :] for r in mine.collect()} == {"a.ts", "c.ts", "d.ts"}
    assert {(r.source_path[-4:], r.target_path[-4:]) for r in store.imports().collect()} == {("d.ts", "a.ts")}
    # A second edit under the same status code goes unseen; the deletion is reported again.
    write(tmp_path, {"c.ts": "export const c = 3;\n"})
    found, _ = tools.detect_changes(project)
    assert {(r.path[-4:], r.change) for r in found.collect()} == {("b.ts", "deleted")}
    parse_only, counts = Toolbox(spark).detect_changes(project)
    assert parse_only.count() == 3 and counts.first().indexed == 2

    # Removing every file empties the project's partition and leaves other projects alone.
    store.remove(store.files().filter(F.col("project") == project).select("project", "file_path"))
    assert [r.project for r in store.files().collect()] == ["/elsewhere"]
    assert store.imports().count() == 0
