"""Symbol and raw import extraction for each language."""

import pytest

from codeloom.parse.project import parse_statements

FILES = {
    "basic.ts": "\nexport function greet(name: string): string {\n    return `Hello, ${name}`;\n}\n\nconst x = 42;\n\nexport class Foo {\n    bar() { const inner = 1; }\n}\n",
    "imports.ts": (
        'import { a, b as c } from "./utils";\nimport config from "./config";\nimport * as ns from "./ns";\n'
        'import "./side";\nimport express from "express";\nimport def, { type T } from \'./both\'\n'
        'export { Foo } from "./types";\nexport * from "./all";\n'
        "async function load() {\n  await import('./lazy');\n  const s = \"import('./text')\";\n}\n"
    ),
    "types.ts": "export interface Config {\n  a: string;\n}\nexport type Id = string | number;\nexport enum Color { Red }\nexport const enum Fast { A }\n",
    "exports.ts": "function a() {}\nconst b = 1;\nexport {\n  a,\n  b as c,\n};\nexport default function main() {}\n",
    "anon.js": "export default () => 1;\n",
    "klass.js": "export default class extends Base {}\n",
    "vars.ts": "const one = 1, two = [1, 2];\nlet three = 3\nvar four;\nexport const five = (x) => { return { x }; }, six = 6;\n",
    "docs.ts": (
        "/**\n * Adds numbers.\n *\n * Carefully.\n */\nexport function add(a, b) { return a + b; }\n\n"
        "// Lone note\n\nfunction undocumented() {}\n/** single */\nfunction single() {}\n/* plain */\nclass Plain {}\n"
    ),
    "tricky.ts": (
        "const re = /[{'\"]\\/{/g;\nconst t = `a ${ `b{` } }`;\nfunction after() {}\n"
        "@Dec({ a: 1 })\nclass Decorated {}\nfunction over(x: number): void;\nfunction over(x: any) {}\n"
        "declare const ambient: number;\nabstract class Abs {}\nconst multi =\n  function () {};\nlet tail\n"
    ),
    "lib.rs": (
        "/// A greeter\n/// with lines\npub fn greet(name: &str) -> String {\n    format!(\"Hello, {}\", name)\n}\n"
        "#[derive(Debug)]\npub(crate) struct Config {\n    debug: bool,\n}\n"
        "impl<T: Into<Vec<u8>>> std::fmt::Display for Wrapper<T>\nwhere\n    T: Copy,\n{\n    fn fmt(&self) {}\n}\n"
        "impl Config {\n    pub fn new() -> Self { Config { debug: false } }\n}\n"
        "pub enum Color { Red }\npub trait Drawable { fn draw(&self); }\npub const MAX: usize = 1024;\nstatic mut C: char = '{';\n"
        "pub type R<T> = std::result::Result<T, E>;\nmacro_rules! hello {\n    () => { println!(\"}\"); };\n}\n"
        "pub(super) async unsafe fn parent<'a>(x: &'a str) {}\nmod tests {\n    fn t() {}\n}\nmod db;\n"
        "use crate::auth;\nuse self::x::{a, b};\npub use super::foo::*;\nuse std::io as stdio;\nextern crate alloc;\n"
    ),
    "text.tsx": "function First() { return <p>Don't</p>; }\nfunction second(s) { return /[{']/.test(s) }\nfunction third() {}\n",
    "raw.rs": 'const A: &str = r###"}"##{"###;\npub fn middle() {}\n/* a /* { */ b */\npub fn last() {}\n',
    "data.rb": "class Kept\nend\n__END__\nclass Data\nend\n",
    "lines.rs": "pub fn first() {}\n\npub fn third() {}\n",
    "app.rb": (
        "# A greeter class\nclass Greeter < Base\n  include Comparable, A::B\n  extend self\n  attr_accessor :a, :b\n  MAX_SIZE = 1024\n"
        "  # Greets.\n  # Twice.\n  def greet(name)\n    if name\n      y = 1 if z\n    end\n    CONST = 5\n    \"Hello, #{name}\"\n  end\n"
        "  def self.helper; true; end\n  def name=(v)\n    while v do\n      v.each do |q| q end\n    end\n  end\n  def ok?\n    {a: 1}\n  end\n"
        "  class << self\n    def hidden; end\n  end\n  module Inner\n    def deep\n      case 1\n      when 1 then 2\n      end\n    end\n  end\nend\n"
        "require 'json'\nrequire_relative 'helper'\nrequire_relative(\"paren\")\n"
        "def tail\n  <<~EOS\n    class NotMe\n    end\n  EOS\nend\nmodule Last; end\n"
    ),
    "app.ex": (
        "defmodule MyApp.Greeter do\n  @moduledoc \"\"\"\n  Mod doc.\n  \"\"\"\n  use GenServer\n  alias MyApp.Foo.Bar, as: B\n  alias MyApp.{A, C}\n"
        "  import Ecto.Query, only: [from: 2]\n\n  @doc \"\"\"\n  Greets a person by name.\n\n  Returns text.\n  \"\"\"\n  def greet(name) do\n    if name do\n"
        "      alias Hidden.Mod\n      fn x -> x end\n    end\n    \"Hello, #{name}\"\n  end\n\n  @doc false\n  def quiet, do: 1\n\n  # A helper\n\n"
        "  defp internal(a) when is_integer(a) do\n    :ok\n  end\n\n  @doc \"one line\"\n  defmacro mac(arg) do\n    quote do: unquote(arg)\n  end\n"
        "  defmacrop hid(x), do: x\n  defstruct [:name, :email]\n\n  defmodule Nested do\n    def a + b, do: a\n  end\nend\n"
    ),
    "empty.js": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("p", f"/p/{name}", text) for name, text in FILES.items()]
    frame = spark.createDataFrame(rows, "project string, file_path string, content string")
    symbols, imports = {n: [] for n in FILES}, {n: [] for n in FILES}
    for row in parse_statements(frame).orderBy("file_path", "ord").collect():
        name = row.file_path[3:]
        symbols[name] += row.symbols
        imports[name] += row.imports
    for name in imports:
        imports[name] = [(i.specifier, list(i.symbols)) for i in sorted(imports[name], key=lambda i: i.ord)]
    return symbols, imports


def brief(symbols):
    return [(s.name, s.kind, s.visibility, s.line) for s in symbols]


def by_name(symbols, name):
    return next(s for s in symbols if s.name == name)


def test_script_declarations(parsed):
    symbols, _ = parsed
    assert brief(symbols["basic.ts"]) == [
        ("greet", "function", "exported", 2), ("x", "const", "private", 6), ("Foo", "class", "exported", 8),
    ]
    assert brief(symbols["types.ts"]) == [
        ("Config", "interface", "exported", 1), ("Id", "type", "exported", 4), ("Color", "enum", "exported", 5), ("Fast", "enum", "exported", 6),
    ]
    assert by_name(symbols["basic.ts"], "greet").signature == "export function greet(name: string): string"
    assert by_name(symbols["basic.ts"], "x").signature == "const x = 42;"
    assert symbols["empty.js"] == []


def test_script_exports(parsed):
    symbols, _ = parsed
    assert brief(symbols["exports.ts"]) == [
        ("a", "function", "private", 1), ("b", "const", "private", 2), ("a", "unknown", "exported", 4),
        ("c", "unknown", "exported", 5), ("default", "function", "default_export", 7),
    ]
    assert symbols["exports.ts"][3].signature == "b as c"
    assert brief(symbols["anon.js"]) == [("default", "unknown", "default_export", 1)]
    assert brief(symbols["klass.js"]) == [("default", "class", "default_export", 1)]


def test_script_variables(parsed):
    symbols, _ = parsed
    assert brief(symbols["vars.ts"]) == [
        ("one", "const", "private", 1), ("two", "const", "private", 1), ("three", "let", "private", 2),
        ("four", "var", "private", 3), ("five", "const", "exported", 4), ("six", "const", "exported", 4),
    ]
    assert symbols["vars.ts"][0].signature == "const one = 1, two = [1, 2];"
    assert symbols["vars.ts"][4].signature == "export const five = (x) =>" or symbols["vars.ts"][4].signature == "const five = (x) =>"


def test_script_docs(parsed):
    symbols, _ = parsed
    docs = {s.name: s.doc_comment for s in symbols["docs.ts"]}
    assert docs == {
        "add": "Adds numbers.\nCarefully.", "undocumented": None, "single": "single */", "Plain": None,
    }


def test_script_imports(parsed):
    _, imports = parsed
    assert imports["imports.ts"] == [
        ("./utils", ["a", "b"]), ("./config", ["default"]), ("./ns", ["*"]), ("./side", []), ("express", ["default"]),
        ("./both", ["default", "T"]), ("./types", ["*"]), ("./all", ["*"]), ("./lazy", ["*"]),
    ]


def test_nothing_is_lost_behind_odd_tokens(parsed):
    symbols = parsed[0] if isinstance(parsed, tuple) else parsed
    assert [s.name for s in symbols["text.tsx"]] == ["First", "second", "third"]
    assert [s.name for s in symbols["raw.rs"]] == ["A", "middle", "last"]
    assert [s.name for s in symbols["data.rb"]] == ["Kept"]


def test_script_tricky(parsed):
    symbols, _ = parsed
    assert [(s.name, s.kind, s.line) for s in symbols["tricky.ts"]] == [
        ("re", "const", 1), ("t", "const", 2), ("after", "function", 3), ("Decorated", "class", 4), ("over", "function", 7),
        ("multi", "const", 10), ("tail", "let", 12),
    ]


def test_rust(parsed):
    symbols, imports = parsed
    assert [(s.name, s.kind, s.visibility) for s in symbols["lib.rs"]] == [
        ("greet", "function", "public"), ("Config", "struct", "pub_crate"), ("Wrapper<T>", "impl", "private"),
        ("Config", "impl", "private"), ("Color", "enum", "public"), ("Drawable", "trait", "public"), ("MAX", "const", "public"),
        ("C", "const", "private"), ("R", "type", "public"), ("hello", "macro", "private"), ("parent", "function", "pub_super"),
        ("tests", "module", "private"), ("db", "module", "private"),
    ]
    assert symbols["lib.rs"][0].doc_comment == "A greeter\nwith lines"
    assert symbols["lib.rs"][1].doc_comment is None
    assert symbols["lib.rs"][0].signature == "pub fn greet(name: &str) -> String"
    assert [s.line for s in symbols["lines.rs"]] == [1, 3]
    assert imports["lib.rs"] == [
        ("mod db", ["db"]), ("crate::auth", ["auth"]), ("self::x::{a, b}", ["{a, b}"]), ("super::foo::*", ["*"]),
        ("std::io as stdio", ["io as stdio"]),
    ]


def test_ruby(parsed):
    symbols, imports = parsed
    assert brief(symbols["app.rb"]) == [
        ("Greeter", "class", "public", 2), ("include Comparable", "unknown", "private", 3), ("include A::B", "unknown", "private", 3),
        ("a", "function", "public", 5), ("b", "function", "public", 5), ("MAX_SIZE", "const", "public", 6),
        ("greet", "function", "public", 9), ("self.helper", "function", "public", 16), ("name=", "function", "public", 17),
        ("ok?", "function", "public", 22), ("Inner", "module", "public", 28), ("deep", "function", "public", 29),
        ("tail", "function", "public", 39), ("Last", "module", "public", 45),
    ]
    assert by_name(symbols["app.rb"], "Greeter").doc_comment == "A greeter class"
    assert by_name(symbols["app.rb"], "greet").doc_comment == "Greets.\nTwice."
    # The signature reaches to the first brace anywhere in the node, else it is one line.
    assert by_name(symbols["app.rb"], "greet").signature.endswith('"Hello, #')
    assert by_name(symbols["app.rb"], "deep").signature == "def deep"
    assert by_name(symbols["app.rb"], "a").signature == "attr_accessor :a"
    assert imports["app.rb"] == [("json", ["*"]), ("helper", ["*"]), ("paren", ["*"])]


def test_elixir(parsed):
    symbols, imports = parsed
    assert [(s.name, s.kind, s.visibility) for s in symbols["app.ex"]] == [
        ("MyApp.Greeter", "module", "public"), ("greet", "function", "public"), ("quiet", "function", "public"),
        ("internal", "function", "private"), ("mac", "macro", "public"), ("hid", "macro", "private"),
        ("defstruct", "struct", "public"), ("Nested", "module", "public"), ("a", "function", "public"),
    ]
    docs = {s.name: s.doc_comment for s in symbols["app.ex"]}
    assert docs["greet"] == "Greets a person by name.\n\nReturns text."
    assert docs["quiet"] is None and docs["internal"] == "A helper" and docs["mac"] == "one line"
    assert imports["app.ex"] == [("GenServer", ["*"]), ("MyApp.Foo.Bar", ["*"]), ("Ecto.Query", ["*"])]
