import pytest

from loomgraph.operators import chunks, incremental, lookups, reachability
from loomgraph.plans.build import build
from loomgraph.sources import files
from loomgraph.streaming import watch


def make(spark, sources, entry="./index", **more):
    df = spark.createDataFrame(list(sources.items()), "path string, source string")
    return build(df, files.entries(spark, entry), "src", **more)


def edges(graph):
    return {(r.origin, r.module, r.dep_type) for r in graph.edges.where("dep_type IN ('entry', 'import_side_effect', 'import')").collect()}


def test_static_and_dynamic_imports_to_the_end(spark):
    g = make(spark, {
        "src/index.js": "import {x} from './label';\nimport('./feature');\nx();",
        "src/label.js": "export const x = 1; import './index.js';",
        "src/feature.ts": "import d from '../data.json'; import './gone';",
        "data.json": '{"a": 1}', "src/unused.js": "",
    })
    assert {(r.path, r.module_type, r.depth, r.error) for r in g.modules.collect()} == {
        ("src/index.js", "javascript/auto", 0, None), ("src/label.js", "javascript/auto", 1, None),
        ("src/feature.ts", "javascript/auto", 1, None), ("data.json", "json", 2, None),
    }
    assert edges(g) == {
        (None, "src/index.js", "entry"), ("src/index.js", "src/label.js", "import_side_effect"), ("src/index.js", "src/feature.ts", "import"),
        ("src/label.js", "src/index.js", "import_side_effect"), ("src/feature.ts", "data.json", "import_side_effect"), ("src/feature.ts", None, "import_side_effect"),
    }
    assert [tuple(r) for r in g.missing.collect()] == [("src", "./gone")]


def test_broken_modules_stay_and_loaders_change_sources(spark):
    sources = {"src/index.js": "import('./broken'); import './bad.json'", "src/broken.js": "import {", "src/bad.json": "{"}
    g = make(spark, sources)
    assert {r.path: r.error is None for r in g.modules.collect()} == {"src/index.js": True, "src/broken.js": False, "src/bad.json": False}
    fixed = make(spark, sources, loader=lambda df: df.selectExpr("path", "replace(replace(source, 'import {', ''), './bad.json', './broken') AS source"))
    assert {r.path: r.error for r in fixed.modules.collect()} == {"src/index.js": None, "src/broken.js": None}
    assert make(spark, {"src/other.js": ""}).modules.count() == 0


def test_lookups(spark):
    c = spark.createDataFrame([(1, None, "a"), (2, "a", "b"), (3, "a", "c"), (4, "b", "c")], "conn_id int, origin string, module string")
    a = spark.createDataFrame([("a",)], "module string")
    assert sorted(r.conn_id for r in lookups.outgoing(c, a).collect()) == [2, 3]
    assert [r.conn_id for r in lookups.incoming(c, a).collect()] == [1]
    members = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "chunk string, module string")
    ids = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "module string, id string")
    got = {r.module: (r.id, r.chunks, r.targets) for r in lookups.references(members.select("module"), ids, c, members).collect()}
    assert got == {"a": ("A", "m", "B,C"), "b": ("B", "m", "C"), "c": ("C", "n", None)}
    assert {tuple(r) for r in lookups.ordered_modules(members, ids, [ids["id"].desc()]).collect()} == {("m", "b", 0), ("m", "a", 1), ("n", "c", 0)}
    assert [tuple(r) for r in lookups.entry_modules(members, a).collect()] == [("m", "a")]
    flags = [(True, False, None, None, True), (None, False, True, None, False), (None, None, None, True, True), (None,) * 4 + (False,)]
    df = spark.createDataFrame(flags, "rule_free boolean, package_free boolean, type_free boolean, parser_free boolean, want boolean")
    assert df.where(files.side_effect_flag() != df["want"]).count() == 0


def test_edges_back_are_not_materialised(spark):
    rows = [("e", "a", 1), ("e", "b", 2), ("a", "b", 3), ("b", "a", 4), ("a", "a", 5), ("x", "y", 1), ("y", "x", 2)]
    got = {r[:2]: r.kept for r in chunks.materialised(spark.createDataFrame(rows, "parent string, child string, seq int")).collect()}
    assert got == {("e", "a"): True, ("e", "b"): True, ("a", "b"): True, ("b", "a"): False, ("a", "a"): False, ("x", "y"): True, ("y", "x"): False}


def test_concatenation_needs_the_roots_chunks_only(spark):
    modules = spark.createDataFrame([("r", True, True), ("i", True, True), ("o", True, True)], "module string, candidate boolean, known boolean")
    links = spark.createDataFrame([("r", "i", True), ("r", "o", True)], "src string, dst string, ok boolean")
    members = spark.createDataFrame([("m", "r"), ("m", "i"), ("n", "i"), ("n", "o")], "chunk string, module string")
    entries = spark.createDataFrame([("r",)], "module string")
    got = {tuple(x) for x in chunks.concatenation_sets(modules, links, members, entries).collect()}
    assert got == {("r", "r"), ("r", "i")}


def test_deep_directories(spark):
    deep = "/".join(["r"] + [f"d{i}" for i in range(40)])
    files_ = [(f"{deep}/f", "1"), ("r/d0/g", "2"), ("r/h", None)]
    one = {r.path: r.digest for r in incremental.directory_digests(spark.createDataFrame(files_, "path string, hash string")).collect()}
    two = {r.path: r.digest for r in incremental.directory_digests(spark.createDataFrame([(f"{deep}/f", "x"), *files_[1:]], "path string, hash string")).collect()}
    assert len(one) == 41 and set(one) == set(two) and not set(one.values()) & set(two.values())
    assert incremental.directory_digests(spark.createDataFrame([], "path string, hash string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 64])
def test_waits_along_long_chains(spark, n):
    waits = [(i, i + 1) for i in range(70)] + [(70 + i, 70 + (i + 1) % n) for i in range(n)] + [(500, 501)]
    got = {r.node for r in reachability.waits_in_cycle(spark.createDataFrame(waits, "src long, dst long")).collect()}
    assert got == set(range(70, 70 + n))


def test_builds_and_logs(spark):
    runs = spark.createDataFrame([(1, False), (2, False), (3, True), (4, None)], "run int, manual boolean")
    changes = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "a")], "run int, path string")
    assert sorted(tuple(r) for r in watch.builds(changes, runs).collect()) == [(1, True, 0), (2, False, 2), (3, True, 0), (4, True, 0)]
    events = spark.createDataFrame([("error",), ("info",), ("verbose",)], "level string")
    assert [watch.logged(events, x).count() for x in ("none", "error", "info", "verbose")] == [0, 1, 2, 3]
