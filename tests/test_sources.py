import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hashing, text
from loomgraph.sources import files, javascript
from loomgraph.streaming import watch


def kinds(source):
    return [(r["dep_type"], r.get("request"), tuple(r["ids"]), r.get("name")) for r in javascript.extract(source)]


def test_imports_and_uses():
    got = kinds('import d, { a as b, "c-d" as e } from "./x";\nimport * as ns from "./y";\nimport "./z";\nb(); ns.run(d);')
    assert [k for k in got if k[0] == "import_side_effect"] == [("import_side_effect", f"./{x}", (), None) for x in "xyz"]
    uses = [k[1:] for k in got if k[0] == "import_specifier"]
    assert uses == [("./x", ("a",), "b"), ("./y", ("run",), "ns"), ("./x", ("default",), "d")]


def test_exports():
    source = """export const a = 1, { b, c: { d }, ...e } = f, [g = 2] = h;
export function fn() {}
export default class {}
export { a as z };
export { q as w, default } from "./m";
export * from "./s";
export * as all from "./t";
import { i } from "./u";
export { i as j };"""
    got = {(k, n, r, i) for k, r, i, n in kinds(source) if k.startswith("export")}
    names = {n for k, n, _, _ in got if k == "export_specifier"}
    assert names == {"a", "b", "d", "e", "g", "fn", "z"}
    assert ("export_expression", "default", None, ()) in got
    assert {("export_imported", "w", "./m", ("q",)), ("export_imported", "default", "./m", ("default",))} <= got
    assert ("export_star", None, "./s", ()) in got and ("export_imported", "all", "./t", ()) in got
    assert ("export_imported", "j", "./u", ("i",)) in got


def test_dynamic_imports_and_what_is_none():
    got = kinds("""// import "no"
const s = 'import("no")', t = `import("${x}")`, r = /import("no")/;
import("./a").then(() => import(`./b`)); import("./" + x); import(`./${x}`); import.meta.url; o.import("no");""")
    assert [(k, r) for k, r, _, _ in got][:2] == [("import", "./a"), ("import", "./b")]
    assert sum(1 for r in javascript.extract('import("./" + x); import(`./${x}`)') if r["error"]) == 2


def test_type_only_is_skipped_and_order_counts():
    rows = javascript.extract('import type { T } from "./t"; import { type U, v } from "./v"; export { v };')
    assert [(r["dep_type"], r["request"], r["source_order"]) for r in rows] == [("import_side_effect", "./v", 1), ("export_imported", "./v", 1)]


def test_offsets_are_bytes():
    source = 'const é = "ü"; import("./a")'
    row = javascript.extract(source)[0]
    assert source.encode()[row["start"] : row["end"]] == b'import("./a")'


def test_unreadable_sources_are_rows(spark):
    df = spark.createDataFrame([(1, "import {"), (2, None), (3, 'import "./a"'), (4, "'open"), (5, "eval(x); a.b")], "module_id long, source string")
    got = {(r.module_id, r.dep_type) for r in javascript.dependencies(df).collect()}
    assert got == {(1, "error"), (4, "error"), (3, "import_side_effect")}
    facts = {r.module_id: r for r in javascript.module_facts(df).collect()}
    assert facts[5].uses_eval and facts[3].harmony and facts[1].harmony is None
    assert javascript.json_module('﻿{"a": 1, "default": 2}') == ["default", "a"]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "want"), [("/a/./b/../c", "/a/c"), ("a/../../b", "../b"), ("/../a", "/a"), ("", ""), ("./x//y/", "x/y"), ("../..", "../..")]
)
def test_normalize(spark, path, want):
    assert one(spark, text.normalize_path(F.col("p")), p=path) == want


def test_scalars(spark):
    assert one(spark, text.data_uri(F.col("p"), F.col("c")), p="x.bin", c=bytearray([0, 1, 2, 250, 255])) == "data:application/octet-stream;base64,AAEC+v8="
    assert "\n" not in one(spark, text.data_uri(F.col("p"), F.col("c")), p="x.png", c=bytearray(300))
    assert one(spark, text.sanitize_identifier(F.col("p")), p="./1a-b") == "_1a_b"
    assert one(spark, text.property_access(F.col("p")), p='a"b') == '["a\\"b"]'
    assert one(spark, text.property_access(F.col("p")), p="$ok") == ".$ok"
    assert one(spark, text.module_type(F.col("p")), p="/a/B.JSON") == "json"
    assert one(spark, text.free_suffix(F.col("p"), "n"), p=["n0", "n1", "n3"]) == 2
    assert hashing.fnv(b"abc") == 16654208175385433931
    assert one(spark, hashing.fnv64("p"), p="abc") == f"{hashing.fnv(b'abc' + bytes([255])):016x}"


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("*.js", "./a/b.js", True), ("./a/*.js", "./a/b.js", True), ("a/*.js", "a/b/c.js", False), ("a/**/c.js", "./a/c.js", True), ("?.css", "ab.css", False), ("**", "x", True)],
)
def test_globs(spark, glob, path, fits):
    assert one(spark, F.col("p").rlike(text.glob_regex(glob)), p=path) == fits


def test_resolution(spark):
    listing = spark.createDataFrame([("/s/a.js",), ("/s/a.ts",), ("/s/d/index.js",), ("/s/e.json",)], "path string")
    asked = [(1, "/s", "./a"), (2, "/s", "./a.js?q#f"), (3, "/s/x", "../d"), (4, "/s", "./none"), (5, "/", "/s/e")]
    df = spark.createDataFrame(asked, "id int, directory string, request string")
    got = {r.id: (r.path, r.query, r.fragment) for r in files.resolve(df, listing).collect()}
    assert got == {1: ("/s/a.ts", None, None), 2: ("/s/a.js", "?q", "#f"), 3: ("/s/d/index.js", None, None), 4: (None, None, None), 5: ("/s/e.json", None, None)}


def test_files_and_packages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert rows["a.txt"].source == "é" and rows["b.txt"].source is None and rows["b.txt"].error
    packages = spark.createDataFrame([("/r", "far"), ("/r/p", "near")], "root string, data string")
    found = files.nearest_package(spark.createDataFrame([("/r/p/q/x.js",), ("/r/y.js",)], "path string"), packages)
    assert {(r.path, r.data) for r in found.collect()} == {("/r/p/q/x.js", "near"), ("/r/y.js", "far")}
    assert [tuple(r) for r in files.entries(spark, "./i").collect()] == [(0, "main", "./i")]


def changes(spark, rows):
    start = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(milliseconds=t), p, k) for t, p, k in rows], "ts timestamp, path string, kind string")


def test_debounce_ties_and_latest(spark):
    df = changes(spark, [(0, "a", "modified"), (20, "a", "removed"), (41, "b", "modified"), (15, "b", "removed")])
    assert sorted((r.n, r.paths) for r in watch.debounce(df).collect()) == [(1, "b:modified"), (3, "a:removed,b:removed")]


def test_stream_of_batches(spark, tmp_path):
    rows = [(0, "a", "modified"), (10, "b", "modified"), (500, "a", "removed"), (60000, "z", "modified")]
    changes(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string, kind string").parquet(str(tmp_path / "in"))
    seen = []
    q = watch.run_batches(stream, lambda df: seen.extend(r.paths for r in df.collect()), str(tmp_path / "state"), late="1 second")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a:modified,b:modified", "a:removed"]


def test_polling_targets_and_ignores(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime int, size int")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("w", 1, 1)], "path string, mtime int, size int")
    assert {tuple(r) for r in watch.poll_diff(a, b).collect()} == {("y", "modified"), ("w", "modified"), ("z", "removed")}
    t = spark.createDataFrame([("p", "file"), ("p", "missing"), ("q", "file"), ("q", "context")], "path string, kind string")
    assert {tuple(r) for r in watch.watch_targets(t).collect()} == {("p", "missing"), ("q", "context")}
    c = changes(spark, [(0, p, "modified") for p in ("/out", "/out/x", "/outer", "/node_modules/x", "/a.tmp")])
    assert [r.path for r in watch.not_ignored(c, "/out", ("node_modules",), (r"\.tmp$",)).collect()] == ["/outer"]
    records = spark.createDataFrame([("m", "p"), ("m", "q"), ("n", "r")], "owner string, path string")
    assert [r.owner for r in watch.reusable(records, spark.createDataFrame([("q",)], "path string")).collect()] == ["n"]
