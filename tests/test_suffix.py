"""Suffixes that end in wildcards against a plain match."""

import re

from codeloom import session
from codeloom.operators import lookup

PATHS = ["/w/src/user_store.ts", "/w/src/userXstore.ts", "/w/lib/a.rb", "/w/lib/ab.rb", "a", "", "/w/äöü/store", "/w/store/store_x"]
SUFFIXES = ["user_store.t_", "store%", "store_", "lib/_.r_", "%", "_", "a", "__", "äöü%", "%ore%ts", "st%x_", "none%", "", "user%store.ts"]


def test_against_plain_match(spark):
    files = spark.createDataFrame([(p, f) for p in ("p", "q") for f in PATHS], "project string, file_path string")
    asked = spark.createDataFrame([("p", s) for s in SUFFIXES], "project string, suffix string")
    found = lookup.suffix_matches(files, asked, limit=3).collect()
    for s in SUFFIXES:
        pattern = ".*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in s)
        expected = sorted(f for f in PATHS if re.fullmatch(pattern, f))[:3]
        assert [r.file_path for r in sorted(found, key=lambda r: r["rank"]) if r.suffix == s] == expected, s
    assert {r.project for r in found} == {"p"}


def test_many_suffixes_are_matched_as_few_are(spark, monkeypatch):
    """Beyond what is broadcast, ends of paths that are no suffix are left out before they are joined."""
    files = spark.range(200).selectExpr("'p' || id % 2 as project", "'/p/src/a_' || id || if(id % 3 = 0, '.ts', '.rb') as file_path")
    rows = [("p0", "4.rb"), ("p1", "a_3.ts"), ("p0", "src/%"), ("p1", "/_1.ts"), ("p1", "none.ts"), ("p0", "%"), (None, "4.rb")]
    suffixes = spark.createDataFrame(rows, "project string, suffix string")
    few = sorted(lookup.suffix_matches(files, suffixes).collect())
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    many = lookup.suffix_matches(files, suffixes)
    assert "getbit" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(many.collect()) == few and len(few) > 6
