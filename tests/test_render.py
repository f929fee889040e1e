import random

import pytest

from loomgraph.operators import incremental, render
from loomgraph.plans import hooks
from loomgraph.sources import store


def test_replacements_against_brute_force(spark):
    rng = random.Random(3)
    sources, rows, expected = [], [], {}
    for m in range(40):
        source = "".join(rng.choice("abcé\U0001f600 \n") for _ in range(rng.randrange(0, 30)))
        edges = [len(source[:i].encode()) for i in range(len(source) + 1)]
        own = sorted((*sorted(rng.choices(edges, k=2)), seq, rng.choice(["", "X", "yé", None])) for seq in range(rng.randrange(0, 5)))
        raw, out, at = source.encode(), b"", 0
        for start, end, _, text in own:
            out += raw[at:start] + (text or "").encode() if start > at else (text or "").encode()
            at = max(at, end)
        expected[m] = (out + raw[at:]).decode()
        sources.append((m, source))
        rows += [(m, *r) for r in own]
    got = render.apply_replacements(
        spark.createDataFrame([*sources, (99, None)], "module long, source string"),
        spark.createDataFrame(rows, "module long, start long, end long, seq int, text string"),
    )
    assert {r.module: r.text for r in got.collect()} == expected | {99: None}


def test_fragments_and_failed_modules(spark):
    rows = [(1, "import", 1, "c"), (1, "compatibility", 5, "a"), (1, "star_reexport", 0, "e"), (1, "import", 3, "d"), (1, "export", 9, "b")]
    assert render.init_fragments(spark.createDataFrame(rows, "module int, stage string, seq int, content string")).first().prefix == "abcde"
    df = spark.createDataFrame([("code", None), ("code", 'bad "x"\n')], "code string, error string")
    assert [r[0] for r in df.select(render.module_code(df.code, df.error)).collect()] == ["code", 'throw new Error("bad \\"x\\"\\n");']


def test_json_code(spark):
    df = spark.createDataFrame([('﻿{"b": 1, "default": 2}',), ("[1, 2]",), ("{",), (None,)], "t string")
    keyed, plain, bad, null = (r[0] for r in df.select(render.json_code(df.t)).collect())
    assert 'JSON.parse("{\\"b\\":1,\\"default\\":2}")' in keyed and keyed.count("default: ()") == 1 and '["b"]: ()' in keyed
    assert plain.startswith('var __WEBPACK_JSON_MODULE__ = JSON.parse("[1,2]");') and "[" not in plain.split(".d(")[1]
    assert bad is None and null is None


def test_resources_come_once_and_only_from_chunks(spark):
    res = spark.createDataFrame([(3, "a", "x"), (2, "a", "y"), (1, "a", "z"), (4, "b", "w")], "module int, filename string, content string")
    members = spark.createDataFrame([(2,), (3,), (3,)], "module int")
    assert [tuple(r) for r in render.resource_assets(res, members).collect()] == [("a", "y")]
    empty = res.limit(0)
    kinds = render.manifest(res, empty, res.where("module = 4")).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"initial": 4, "resource": 1}


def test_guards_and_flush_times(spark):
    old = spark.createDataFrame([("version", "1"), ("config", "a"), ("gone", "x")], "name string, value string")
    now = spark.createDataFrame([("version", "1"), ("config", "b"), ("new", "y")], "name string, value string")
    assert {r.name for r in incremental.guard_failures(old, now).collect()} == {"config", "gone", "new"}
    builds = spark.createDataFrame([("a", "initial", 0), ("a", "large", 3000), ("b", "ordinary", 1)], "cache string, kind string, end_ms long")
    assert {tuple(r) for r in incremental.flush_times(builds).collect()} == {("a", 4000), ("b", 60001)}


def test_store_publishes_whole_revisions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert store.read(spark, root) is None and store.revision(spark, root) == 0
    assert store.publish(spark.range(3), root, 0) == 1
    assert store.publish(spark.range(5), root, 1) == 2
    with pytest.raises(store.Conflict):
        store.publish(spark.range(9), root, 1)
    assert store.read(spark, root).count() == 5 and store.read(spark, root, 1).count() == 3
    store.discard_old(spark, root, keep=1)
    assert store.read(spark, root).count() == 5 and store.revision(spark, root) == 2


def test_filename_map(spark):
    rows = [("a", None, 10, "ten.js"), ("a", None, 9, "nine.js"), ("a", "z", None, "z.js"), ("a", 'b"', None, "b.js"), ("a", "z", None, "zz.js"), ("c", None, 0, 'q".js')]
    df = spark.createDataFrame(rows, "app string, id string, number long, filename string")
    got = {r.app: r.entries for r in render.filename_map(df).collect()}
    assert got == {"a": '"b\\"": "b.js", "z": "zz.js", 9: "nine.js", 10: "ten.js"', "c": '0: "q\\".js"'}
    assert render.filename_map(df.limit(0)).collect() == []


def test_plugins_run_in_order(spark):
    seen = []

    class Named:
        def apply(self, h):
            h.tap("done", "named", lambda v: seen.append("named"))

    h = hooks.apply_plugins(hooks.Hooks(), [None, False, 0, "", lambda h: h.tap("done", "f", lambda v: seen.append("f") or v + 1), Named()])
    assert h.call("done", 1) == 2 and seen == ["f", "named"]
    with pytest.raises(TypeError):
        hooks.apply_plugins(h, [3])
    assets = spark.createDataFrame([("a", "1"), ("b", "2")], "filename string, content string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "filename string, content string")
    assert {tuple(r) for r in hooks.emit_assets(assets, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {tuple(r) for r in hooks.update_assets(assets, new.where("filename = 'b'")).collect()} == {("a", "1"), ("b", "3")}
    assert [r.filename for r in hooks.missing_assets(assets, new).collect()] == ["c"]
