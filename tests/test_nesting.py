"""Nesting of any depth and regular expressions by what came before: nothing behind them is lost."""

import random

import pytest

from codeloom.parse.project import parse_statements
from codeloom.parse.scanner import script_scanner


def deep_template(levels):
    return "`a ${ f({ b: " * levels + "`{`" + " }) } c`" * levels


SCRIPTS = {
    "blanks.ts": "function a(s) {\n  return s.replace(\n      /[{]/g, '')\n}\nfunction last() {}\n",
    "header.ts": "function a(s) { if (s) /[{]/.test(s); while ((s)) /[{]/.exec(s); for (const x of (s)) /[(]/.test(x) }\nfunction last() {}\n",
    "comment.ts": "const a = /* why */ /[{]/, b = x =>\n\n        /[{]/;\nfunction last() {}\n",
    "word.ts": "function a() { return        /[{]/ }\nfunction last() {}\n",
    "block.ts": "function a(s) { if (s) { s() }\n          /[{]/.test(s) }\nfunction last() {}\n",
    "divide.ts": "const a = (1) / f({ b: 2 }) / 3, c = { d: 4 }.d / e[0] / g({}), h = s.if(1) / f({}) / 2\nfunction last() {}\n",
    "deep.ts": f"const a = {deep_template(40)};\nfunction last() {{}}\n",
    "template.ts": "const a = `${ b.replace(/[`{]/g, '}') } ${ '`' /* ` */ }`;\nfunction last() {}\n",
    "stray.ts": "const a = <p>it is ` here</p>;\nfunction last() {}\n",
    "quote.tsx": "const a = c => <p>Don't {c && <b>it's</b>}</p>\nfunction last() {}\n",
    "slashes.tsx": "function A() { return <a>see http://x.y {z}</a> }\nfunction last() {}\n",
    "star.jsx": "const a = <p>a /* b {c}</p>\nfunction last() {}\n",
    "more.js": "const a = c > /[{]/.exec(d)\nfunction last() {}\n",
    "words.tsx": "const a = <><B x={`a${b}`} {...c} d='e\"' />{a}({b})import{c}function{d},{e}\n  const f {d}</>;\nfunction last() {}\n",
    "generic.tsx": "const f = <T,>(x: T) => <p>{x}</p>, g = <T extends {}>(x: T) => x\nfunction last() {}\n",
    "generic.ts": "const f = <T>(x: T) => { return a < b }, g = <any>f;\nfunction last() {}\n",
    "list.tsx": "export default () => <ul>{l.map(i => <li key={i}>{i > 0 ? <b>'</b> : null}</li>)}</ul>\nfunction last() {}\n",
    "open.tsx": "const a = <p>never closed {a}\nfunction last() {}\n",
    "deep.rs": "/* " * 40 + "{" + " */" * 40 + "\npub fn middle() {}\n/* { /* */ { */\npub fn last() {}\n",
    "blanks.rb": "class A\n  def a(s)\n    s.sub(        /(class|[(]) /, '')\n    if /[(]/ =~ s\n    end\n  end\nend\ndef last\nend\n",
}


@pytest.fixture(scope="module")
def names(spark):
    rows = [("p", f"/p/{n}", text) for n, text in SCRIPTS.items()]
    found = {}
    for row in parse_statements(spark.createDataFrame(rows, "project string, file_path string, content string")).orderBy("file_path", "ord").collect():
        found.setdefault(row.file_path[3:], []).extend(s.name for s in row.symbols)
    return found


@pytest.mark.parametrize("name", sorted(SCRIPTS))
def test_the_last_declaration_is_found(names, name):
    assert names[name][-1] == "last"


MARKS = ["<p>", "</p>", "<b ", "/>", "{", "}", "`", "${", "'", "a", "\n", " ", "/", "(", ")", "<", ">", "=", "</>", "<>", "//x\n", "/*", "*/", '"', "import"]


def test_every_sign_is_in_one_token():
    scan = script_scanner()
    draw = random.Random(3)
    mixed = ["".join(draw.choices(MARKS, k=draw.randint(1, 25))) for _ in range(5000)]
    for text in [*SCRIPTS.values(), *mixed, "", " ", "`", "`${", "a`${`", "}`", "${}`", "é🙂`${'🙂'}`/", None]:
        for tags in (True, False):
            assert "".join(a + b for a, b in scan(text, tags)) == (text or "")
    assert len(scan("`${" * 5000 + "}`" * 5000)) == 20_001
    assert len(scan("a=<p>{" * 3000 + "}</p>" * 3000)) == 18_001


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("x = `a${`b`}c` / 2", "x|=|`a$|{|`b`|}|c`|/|2"),
        ("a = <p>Don't {c && <b>it's</b>}</p>", "a|=|<p>Don't |{|c|&|&|<b>it's</b>|}|</p>"),
        ("a = <a>see http://x.y {z}</a>; }", "a|=|<a>see http://x.y |{|z|}|</a>|;|}"),
        ("a = <p>a /* b {c}</p>; d", "a|=|<p>a /* b |{|c|}|</p>|;|d"),
        ("c > /[{]/.exec(d)", "c|>|/[{]/|.|exec|(|d|)"),
        ("f = <T,>(x: T) => 1", "f|=|<|T|,|>|(|x|:|T|)|=>|1"),
        ("a = <p>open {b", "a|=|<|p|>|open|{|b"),
        ("a = <></><b/>", "a|=|<></>|<|b|/|>"),
    ],
)
def test_elements_and_templates_are_cut_at_their_expressions(text, tokens):
    assert "|".join(a for a, _ in script_scanner()(text)[1:]) == tokens


def test_imports_inside_templates_and_elements(spark):
    text = "const a = `${ import('./x') } ${ <p a={() => import('./y')}>it's {import('./z')}</p> }`;\nimport b from './b';\n"
    rows = spark.createDataFrame([("p", "/p/a.tsx", text)], "project string, file_path string, content string")
    found = [i.specifier for r in parse_statements(rows).collect() for i in r.imports]
    assert sorted(found) == ["./b", "./x", "./y", "./z"]
