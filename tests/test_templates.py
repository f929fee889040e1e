"""Code of dependencies and modules, run-time helpers, module types, hooks, the writer marker."""

from __future__ import annotations

import pytest

from loomgraph.functions import text
from loomgraph.operators import chunks, naming, templates
from loomgraph.plans import fixpoint
from loomgraph.plans.registry import ModuleTypes, ParserHooks, hooked_dependencies
from loomgraph.sources import store
from pyspark.sql import functions as F

COLUMNS = (
    "module int, seq int, dep_type string, request string, source_order int, ids array<string>, name string, start int, end int, "
    "used_name string, target_id string, ordinal int, scope int, chunk_ids array<string>, shorthand boolean"
)


def row(seq, kind, request=None, order=None, ids=(), name=None, at=(0, 0), used=None, target=None, ordinal=None, chunks=None, short=None, module=1):
    return (module, seq, kind, request, order, list(ids) if ids is not None else None, name, *at, used, target, ordinal, 0, chunks, short)


def test_a_module_is_generated_whole(spark):
    source = "import a from './a';\nexport default a + é;\n"
    first = source.index(";")
    rows = [
        row(0, "import_side_effect", "./a", 1, target='"m"'),
        row(1, "constant", at=(0, first + 1)),
        row(2, "export_expression", name="default", at=(source.index("export"), source.index("a + ")), used="default"),
        row(3, "import_specifier", "./a", 1, ["default"], "a", at=(source.index("a + "), source.index(" + "))),
    ]
    code = templates.dependency_code(spark.createDataFrame(rows, COLUMNS))
    modules = spark.createDataFrame([(1, source, True), (2, "x", False), (3, None, None)], "module int, source string, harmony boolean")
    got = {r.module: r for r in templates.generated(modules, code).collect()}
    assert got[1].text == (
        "__webpack_require__.r(__webpack_exports__);\n"
        "__webpack_require__.d(__webpack_exports__, { default: () => (__WEBPACK_DEFAULT_EXPORT__) });\n"
        '/* harmony import */ var _a__WEBPACK_IMPORTED_MODULE_0__ = __webpack_require__("m");\n'
        "\n/* harmony default export */ const __WEBPACK_DEFAULT_EXPORT__ = _a__WEBPACK_IMPORTED_MODULE_0__.default + é;\n"
    )
    assert got[1].mask == chunks.bit("require") | chunks.bit("define_getters") | chunks.bit("make_namespace")
    assert (got[2].text, got[2].mask, got[3].text) == ("x", 0, None)


def test_odd_dependencies(spark):
    rows = [
        row(0, "export_imported", "./a", 1, ["x"], "x", used=None, target="1"),  # unused
        row(1, "export_imported", "./a", 1, ["x"], "x", used="x"),  # target not rendered
        row(2, "import", target="7", chunks=[]),
        row(3, "import", target="7", chunks=['"a"', "2"]),
        row(4, "error"),
        row(5, None, None, None, None),
        row(6, "import_specifier", "./1 b", 0, ["a-b", "c"], "n", short=True),
        row(7, "export_specifier", None, None, ["f"], "f", used="not valid"),
        row(8, "export_star", "./a", 2, ordinal=3),
    ]
    got = {r.seq: r for r in templates.dependency_code(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(got[i].text is None and got[i].content is None for i in (0, 1, 4, 5))
    assert got[2].text == "Promise.resolve().then(__webpack_require__.bind(__webpack_require__, 7))" and got[2].mask == chunks.bit("require")
    assert got[3].text.startswith('Promise.all([__webpack_require__.e("a"), __webpack_require__.e(2)]).then(') and got[3].mask == chunks.bit("require") | chunks.bit("ensure_chunk")
    assert got[6].text == 'n: __1_b__WEBPACK_IMPORTED_MODULE_0__["a-b"].c'
    assert got[7].content == '__webpack_require__.d(__webpack_exports__, { ["not valid"]: () => (f) });\n'
    assert got[8].stage == "star_reexport" and got[8].content.count("__webpack_concatenation_exports__0[3]") == 2
    empty = spark.createDataFrame([], COLUMNS)
    assert templates.dependency_code(empty).collect() == []


def test_scope_names_are_free(spark):
    rows = [(1, ["__webpack_concatenation_exports__0"]), (1, ["__webpack_concatenation_initialized__1", "__webpack_concatenation_exports__03"]), (2, []), (3, None), (4, ["__webpack_concatenation_initializers__1"])]
    members = spark.createDataFrame(rows, "root int, identifiers array<string>")
    assert {tuple(r) for r in templates.scope_suffixes(members).collect()} == {(1, 2), (2, 0), (3, 0), (4, 0)}


def test_helpers_come_by_stage_with_their_texts(spark):
    masks = spark.createDataFrame([(1, chunks.bit("ensure_chunk")), (2, 0)], "entry int, mask int")
    helpers = templates.runtime_helpers(masks.select("entry", chunks.close_mask(F.col("mask")).alias("mask")))
    names = [r.requirement for r in helpers.orderBy("entry", "place").collect()]
    assert names == ["chunk_filename", "has_own", "factories_add_only", "ensure_chunk", "ensure_chunk_handlers"]
    entries = spark.createDataFrame([(1, 'm"ain', '"a": "a.js"'), (2, "b", "")], "entry int, id string, files string")
    (found,) = templates.helper_texts(helpers, entries).collect()
    assert found.entry == 1 and 'return ({"a": "a.js"})[chunkId];' in found.text and 'var installedChunks = {\n  "m\\"ain": 1\n};' in found.text
    assert "{map}" not in found.text and "{chunk}" not in found.text


def test_names(spark):
    df = spark.createDataFrame([("./a/b.js", 3), ("", None), ("9", 0)], "r string, n int")
    assert [r[0] for r in df.select(text.import_variable(df.r, df.n)).collect()] == [
        "_a_b_js__WEBPACK_IMPORTED_MODULE_2__", "_module__WEBPACK_IMPORTED_MODULE_0__", "__9__WEBPACK_IMPORTED_MODULE_0__",
    ]


def test_module_types(spark):
    types = ModuleTypes()
    with pytest.raises(ValueError):
        types.parse(spark.range(1).withColumn("module_type", F.lit("a")))
    types.register("a", lambda m: m.withColumn("by", F.lit("a")), lambda m: m)
    types.register("b", lambda m: m.withColumn("by", F.lit("b")), lambda m: m)
    with pytest.raises(ValueError):
        types.register("a", lambda m: m, lambda m: m)
    types.rule("b", lambda p: p.endswith(".b"))
    types.rule("a", lambda p: p.startswith("x"))
    df = spark.createDataFrame([("x.b",), ("x",), ("y",), (None,)], "path string")
    assert [r[0] for r in df.select(types.type_of(df.path)).collect()] == ["b", "a", None, None]
    types.default("c")
    with pytest.raises(ValueError):
        types.default("a")
    typed = df.select("path", types.type_of(df.path).alias("module_type"))
    assert {(r.path, r.by) for r in types.parse(typed).collect()} == {("x.b", "b"), ("x", "a")}
    assert {r.path for r in types.unregistered(typed).collect()} == {"y", None}


def test_parser_hooks(spark):
    hooks = ParserHooks()
    plain = hooks.fingerprint()
    hooks.tap("program", "first", b"1", lambda source, rows: [*rows, {"dep_type": "entry", "ids": []}])
    hooks.tap("finish", "no types", b"2", lambda source, rows: [r for r in rows if "type" not in (r.get("request") or "")])
    hooks.tap("finish", "looks", b"", lambda source, rows: None)
    modules = spark.createDataFrame([(1, "import './type'; import './b';"), (2, None)], "module_id long, source string")
    got = [(r.module_id, r.dep_index, r.dep_type, r.request) for r in hooked_dependencies(modules, hooks).orderBy("module_id", "dep_index").collect()]
    assert got == [(1, 0, "entry", None), (1, 1, "import_side_effect", "./b"), (2, 0, "entry", None)]
    one, two = ParserHooks(), ParserHooks()
    one.tap("program", "ab", b"c", print)
    two.tap("program", "a", b"bc", print)
    assert len({plain, hooks.fingerprint(), one.fingerprint(), two.fingerprint()}) == 4


def test_one_writer_at_a_time(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with store.sole_writer(spark, root, "a"):
        with pytest.raises(store.Conflict), store.sole_writer(spark, root, "b"):
            pass
        assert store.publish(spark.range(3), root, 0, compression="gzip") == 1
    with store.sole_writer(spark, root, "b"):
        assert store.read(spark, root).count() == 3
    (tmp_path / "t" / "_writer" / "owner").write_text("lost")
    with store.sole_writer(spark, root, "b", most_age_s=-1):
        pass
    assert not (tmp_path / "t" / "_writer" / "owner").exists()


def test_chunks_do_not_take_the_ids_of_entries(spark):
    entries = spark.createDataFrame([(1, "main"), (2, "admin")], "chunk int, name string")
    roots = spark.createDataFrame([(3, "main", "k1"), (4, "./b/c.js", "k3"), (4, "./a.js", "k2"), (5, "./x.js", "k4")], "chunk int, name string, key string")
    ids = {r.chunk: r.id for r in naming.chunk_ids(entries, roots).collect()}
    assert ids[1] == "main" and ids[2] == "admin" and ids[4] == "a_js-b_c_js" and ids[5] == "x_js"
    assert ids[3].startswith("main-") and len(ids) == len(set(ids.values()))
    assert naming.chunk_ids(entries.limit(0), roots.limit(0)).collect() == []


def test_an_entry_needs_what_its_runtime_tree_needs(spark):
    entries = spark.createDataFrame([(1,), (9,)], "entry int")
    children = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    tree = chunks.runtime_tree(entries, children)
    assert {tuple(r) for r in tree.collect()} == {(1, 1), (1, 2), (1, 3), (9, 9)}
    masks = spark.createDataFrame([(7, chunks.bit("define_getters"))], "module int, mask int")
    members = spark.createDataFrame([(3, 7), (4, 7)], "chunk int, module int")
    (found,) = chunks.requirement_tree(masks, members, tree, chunks.STARTUP).collect()
    assert found.entry == 1 and found.mask == chunks.STARTUP | chunks.bit("define_getters") | chunks.bit("has_own")


def test_a_runtime_tree_is_not_written_pair_by_pair(spark, monkeypatch):
    written = []

    def noted(df, settle=fixpoint.settle):
        written.append(settle(df))
        return written[-1]

    monkeypatch.setattr(fixpoint, "settle", noted)
    ring = [(i, (i * 7 + k) % 300) for i in range(300) for k in (1, 2)] + [(5, 5), (400, 401), (402, None), (None, 7)]
    entries = [*range(150), 400, 402, 500, None]
    tree = chunks.runtime_tree(spark.createDataFrame([(e,) for e in [*entries, 3]], "entry int"), spark.createDataFrame(ring, "src int, dst int"))
    want = set()
    for e in entries:
        seen, todo = {e}, [e]
        while todo:
            here = todo.pop()
            new = {b for a, b in ring if a == here and a is not None} - seen
            seen |= new
            todo += new
        want |= {(e, x) for x in seen}
    got = [tuple(r) for r in tree.collect()]
    assert len(got) == len(want) > 30_000 and set(got) == want
    assert max(map(fixpoint.rows, written)) < len(want) / 16
