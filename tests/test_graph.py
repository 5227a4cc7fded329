"""Graph operators against plain Python searches, through the broadcast and the salted join."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codeloom import session
from codeloom.operators import components, cycles, detail, graph, stats


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"/p/{rng.randrange(n):02}", f"/p/{rng.randrange(n):02}") for _ in range(m)})


def frame(spark, edges, project="p"):
    rows = [(project, s, t, "./x", ["s"]) for s, t in edges]
    return spark.createDataFrame(rows, "project string, source_path string, target_path string, specifier string, symbols array<string>")


@pytest.fixture(params=["broadcast", "salted"])
def joins(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(session, "SALTS", 3)
        monkeypatch.setattr(session, "HOT_ROWS", 4)
        monkeypatch.setattr(graph, "BROADCAST_ROWS", -1)


def queue_walk(edges, entries, max_depth, max_results):
    """The queue formulation: dependencies before dependents, each in path order."""
    deps, users = {}, {}
    for s, t in edges:
        deps.setdefault(s, []).append(t)
        users.setdefault(t, []).append(s)
    visited, queue = {}, deque()
    for e in entries:
        if e not in visited:
            visited[e] = (0, "entry")
            queue.append((e, 0))
    while queue:
        node, depth = queue.popleft()
        if depth >= max_depth or len(visited) >= max_results:
            break
        for reason, table in (("dependency", deps), ("dependent", users)):
            for other in sorted(table.get(node, [])):
                if other not in visited:
                    visited[other] = (depth + 1, reason)
                    queue.append((other, depth + 1))
    ordered = sorted(visited.items(), key=lambda kv: kv[1][0])
    return [(node, depth, reason) for node, (depth, reason) in ordered][:max_results]


@pytest.mark.parametrize("seed,depth,limit", [(1, 2, 20), (2, 3, 7), (3, 5, 100)])
def test_walk_matches_queue(spark, joins, seed, depth, limit):
    edges = random_edges(seed, 40, 60)
    entries = ["/p/03", "/p/missing", "/p/17", "/p/03"]
    got = graph.walk_many(frame(spark, edges), graph.entry_frame(spark, "p", entries), depth, limit).orderBy("pos").collect()
    assert [(r.node, r.depth, r.reason) for r in got] == queue_walk(edges, entries, depth, limit)


def test_walk_without_entries(spark):
    assert graph.walk_many(frame(spark, random_edges(1, 5, 5)), graph.entry_frame(spark, "p", [])).count() == 0


def test_separate_walks_do_not_mix(spark):
    edges = random_edges(4, 30, 50)
    both = graph.entry_frame(spark, "p", ["/p/01"], "one").union(graph.entry_frame(spark, "p", ["/p/02"], "two"))
    got = graph.walk_many(frame(spark, edges), both, 3, 9).orderBy("walk", "pos").collect()
    for walk, entry in (("one", "/p/01"), ("two", "/p/02")):
        assert [(r.node, r.depth, r.reason) for r in got if r.walk == walk] == queue_walk(edges, [entry], 3, 9)


def brute_cycles(edges, cap):
    table = {}
    for s, t in edges:
        table.setdefault(s, []).append(t)
    found = set()

    def extend(path):
        for t in table.get(path[-1], []):
            if t == path[0] and len(path) > 1:
                found.add(tuple(path))
            elif t > path[0] and t not in path and len(path) < cap:
                extend([*path, t])

    for s in table:
        extend([s])
    return found


@pytest.mark.parametrize("cap", [20, 4])
def test_cycles_match_brute_force(spark, joins, cap):
    edges = random_edges(7, 16, 30)
    got = cycles.find_cycles(frame(spark, edges), cap).collect()
    assert all(r.cycle[0] == r.cycle[-1] == min(r.cycle) and r.length == len(r.cycle) - 1 for r in got)
    expected = brute_cycles(edges, cap)
    assert len(expected) > 3
    assert sorted(tuple(r.cycle[:-1]) for r in got) == sorted(expected)
    members = {r.file_path: r.n_cycles for r in cycles.cycle_members(cycles.find_cycles(frame(spark, edges), cap)).collect()}
    assert members == {v: sum(v in c for c in expected) for c in expected for v in c}


def brute_components(edges):
    ahead = {}
    for s, t in edges:
        ahead.setdefault(s, set()).add(t)

    def reached(v):
        seen, todo = set(), [v]
        while todo:
            for t in ahead.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    far = {v: reached(v) for v in {v for e in edges for v in e}}
    both = {v: {v} | {u for u in far[v] if v in far[u]} for v in far}
    return {(v, min(c), len(c)) for v, c in both.items() if len(c) > 1}


@pytest.mark.parametrize("seed,n,m,spread", [(1, 40, 60, False), (2, 60, 90, False), (3, 30, 20, False), (4, 25, 80, False), (5, 20, 28, True)])
def test_components_match_brute_force(spark, monkeypatch, seed, n, m, spread):
    if spread:  # no broadcast, and no end in one task
        monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    edges = random_edges(seed, n, m)
    got = components.strong_components(frame(spark, edges)).collect()
    assert {(r.file_path, r.component, r["size"]) for r in got} == brute_components(edges)
    assert len(got) == len({r.file_path for r in got})


def test_components_of_two_projects_and_of_a_long_ring(spark):
    ring = [(f"/p/{k:02}", f"/p/{(k + 1) % 9:02}") for k in range(9)] + [("/p/08", "/q/a"), ("/q/a", "/q/b"), ("/q/b", "/q/b")]
    both = frame(spark, ring).union(frame(spark, [("/p/00", "/p/01"), ("/p/01", "/p/00"), ("/p/01", "/p/02")], "other"))
    got = {(r.project, r.file_path, r.component, r["size"]) for r in components.strong_components(both).collect()}
    assert got == {("p", f"/p/{k:02}", "/p/00", 9) for k in range(9)} | {("other", f"/p/0{k}", "/p/00", 2) for k in (0, 1)}
    assert components.strong_components(both.limit(0)).count() == 0


def test_many_starts_share_rows(spark, joins):
    edges = random_edges(12, 50, 90)
    nodes = sorted({v for e in edges for v in e})
    starts = spark.createDataFrame([(f"{k}", "p", nodes[k % len(nodes)]) for k in range(150)], "walk string, project string, path string")
    numbered = graph.numbered_starts(starts)
    levels = graph.reach(frame(spark, edges), numbered, 3)
    words = numbered.select("word").distinct().count()
    assert levels.count() <= words * len(nodes) * 4
    users = {}
    for s, t in edges:
        users.setdefault(t, set()).add(s)
    expected = set()
    for k in range(150):
        seen, level = {nodes[k % len(nodes)]}, {nodes[k % len(nodes)]}
        expected.add((str(k), 0, 1))
        for depth in range(1, 4):
            level = {u for v in level for u in users.get(v, ())} - seen
            seen |= level
            if level:
                expected.add((str(k), depth, len(level)))
    got = graph.per_start(levels, numbered, {"n": F.lit(1)}).collect()
    assert {(r.walk, r.depth, r.n) for r in got} == expected and len(got) == len(expected)


def test_no_cycles(spark):
    assert cycles.find_cycles(frame(spark, [("/p/a", "/p/b"), ("/p/b", "/p/c"), ("/p/c", "/p/c")])).count() == 0


def test_blast_radius(spark, joins):
    edges = random_edges(9, 30, 45)
    starts = spark.createDataFrame([(v, "p", v) for v in ("/p/00", "/p/05", "/p/11")], "walk string, project string, path string")
    users = {}
    for s, t in edges:
        users.setdefault(t, set()).add(s)
    in_cycle = {v for c in brute_cycles(edges, 20) for v in c} | {s for s, t in edges if s == t}
    for r in graph.blast_radius(frame(spark, edges), starts).collect():
        seen, level = {r.file_path: 0}, {r.file_path}
        for depth in range(1, 6):
            level = {u for v in level for u in users.get(v, ())} - set(seen)
            seen.update(dict.fromkeys(level, depth))
        direct, total = sum(d == 1 for d in seen.values()), len(seen) - 1
        assert (r.direct_dependents, r.transitive_dependents) == (direct, total)
        if r.file_path not in {s for s, t in edges if s == t}:
            assert r.in_cycle == (r.file_path in in_cycle)
        band = "critical" if total >= 10 else "high" if direct >= 6 or r.in_cycle else "medium" if direct >= 3 else "low"
        assert r.risk == band


def test_detail_of_a_hub(spark, joins):
    edges = [(f"/p/{k:03}", "/p/hub") for k in range(50)] + [("/p/hub", "/p/001"), ("/p/002", "/p/003")]
    files = spark.createDataFrame(
        [("p", f, "typescript", None) for f in ("/p/hub", "/p/001", "/p/alone")],
        "project string, file_path string, language string, symbols array<struct<name:string,kind:string,signature:string,doc_comment:string,visibility:string,line:int>>",
    )
    rows = detail.file_detail(files, frame(spark, edges)).collect()
    (hub,) = [r for r in rows if r.file_path == "/p/hub"]
    assert hub.n_dependents == 50
    assert [d.path for d in hub.dependents] == [f"/p/{k:03}" for k in range(50)]
    assert [i.path for i in hub.imports] == ["/p/001"]
    alone = [r for r in rows if r.file_path == "/p/alone"]
    assert [(r.imports, r.dependents, r.symbols) for r in alone] == [([], [], [])]
    assert {r.file_path for r in rows} == {"/p/hub", "/p/001", "/p/alone"}
    keys = detail.distinct_keys(files.filter("file_path = '/p/001'"))
    one = detail.detail_of(files, frame(spark, edges), keys).collect()
    assert [(r.file_path, [i.path for i in r.imports], [d.path for d in r.dependents]) for r in one] == [("/p/001", ["/p/hub"], ["/p/hub"])]


def test_first_neighbours_and_fan_in(spark):
    edges = [(f"/p/{k:03}", "/p/hub") for k in range(20)]
    doubled = frame(spark, edges).union(frame(spark, edges).selectExpr("project", "source_path", "target_path", "'./y'", "symbols"))
    few = detail.first_neighbours(frame(spark, edges), "target_path", "source_path", 8, "few").first()
    assert few.few == [f"/p/{k:03}" for k in range(8)]
    hub = stats.fan_in(doubled).first()
    assert (hub.fan_in, hub.distinct_importers) == (40, 20)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_only_hot_keys_are_copied(spark, monkeypatch, how):
    monkeypatch.setattr(session, "HOT_ROWS", 100)
    monkeypatch.setattr(session, "SALTS", 4)
    big = spark.createDataFrame([(0 if k % 2 else k % 40 + 1, k) for k in range(600)], "key int, n int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60, 2)], "key int, v string")
    spread = session.spread_join(big, small, ["key"], F.col("n"), session.BROADCAST_ROWS + 1, how)
    assert sorted(map(tuple, spread.select(*big.columns, *(["v"] if how in ("inner", "left") else [])).collect()), key=repr) == sorted(
        map(tuple, big.join(small, "key", how).select(*big.columns, *(["v"] if how in ("inner", "left") else [])).collect()), key=repr
    )
    plan = spread._jdf.queryExecution().toString()
    assert "_hot" in plan and "explode" in plan


def test_hot_keys_of_a_loop_are_counted_once(spark, monkeypatch):
    counted = []

    def count(big, keys, found=session.hot_keys):
        counted.append(keys)
        return found(big, keys)

    for module in (session, graph, components):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(module, "hot_keys", count)
    ring = [("/p", f"/p/{i:02d}", f"/p/{(i + 1) % 12:02d}", "./x", ["a"]) for i in range(12)]
    edges = spark.createDataFrame(ring, "project string, source_path string, target_path string, specifier string, symbols array<string>")
    assert {r["size"] for r in components.strong_components(edges).collect()} == {12}
    assert counted == [["v"]]
    starts = graph.numbered_starts(spark.createDataFrame([("w", "/p", "/p/00")], "walk string, project string, path string"))
    assert sorted(r["depth"] for r in graph.reach(edges, starts, 5).collect()) == list(range(6))
    assert counted == [["v"], ["project", "at"]]
