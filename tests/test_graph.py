import random

import pytest

from loomgraph.operators import chunks, exports, incremental, lookups, naming, reachability
from loomgraph.plans.fixpoint import fixpoint


def edges(spark, pairs, names="src string, dst string"):
    return spark.createDataFrame(pairs, names)


def plan(spark, entries, static, dynamic):
    parents, members = chunks.chunk_plan(
        edges(spark, static), edges(spark, dynamic, "origin string, target string"), spark.createDataFrame([(e,) for e in entries], "entry string")
    )
    found: dict = {}
    for r in members.collect():
        found.setdefault(r.target, set()).add(r.module)
    up: dict = {}
    for r in parents.collect():
        up.setdefault(r.target, set()).add(r.parent)
    return found, up


def test_shared_stays_where_one_parent_lacks_it(spark):
    found, _ = plan(spark, ["a", "b"], [("a", "shared"), ("feature", "shared")], [("a", "feature"), ("b", "feature")])
    assert found == {"feature": {"feature", "shared"}}


def test_available_in_the_only_parent(spark):
    found, _ = plan(spark, ["a"], [("a", "shared"), ("feature", "shared")], [("a", "feature"), ("a", "extra")])
    assert found == {"feature": {"feature"}, "extra": {"extra"}}


def test_nested_targets_settle(spark):
    static = [("p", "x"), ("c", "x")]
    dynamic = [("index", "p"), ("index", "r"), ("p", "c"), ("r", "q"), ("q", "c"), ("x", "y")]
    found, up = plan(spark, ["index"], static, dynamic)
    assert found == {"p": {"p", "x"}, "r": {"r"}, "q": {"q"}, "c": {"c", "x"}, "y": {"y"}}
    assert up["c"] == {"p", "q"} and up["y"] == {"c", "p"}


def test_back_edges(spark):
    found, up = plan(spark, ["index"], [("index", "index")], [("index", "a"), ("a", "b"), ("b", "a")])
    assert found == {"a": {"a"}, "b": {"b"}} and up == {"a": {"index"}, "b": {"a"}}


def brute_plan(entries, static, dynamic):
    def closure(x):
        seen, todo = {x}, [x]
        while todo:
            here = todo.pop()
            for a, b in static:
                if a == here and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    up, least = {}, {}
    result = {("entry", e): closure(e) for e in entries}
    own = dict(result)
    while True:
        before = ({k: set(v) for k, v in up.items()}, {k: set(v) for k, v in least.items()})
        for p, mods in list(own.items()):
            for a, t in dynamic:
                if a in mods and t not in result[p]:
                    up.setdefault(t, set()).add(p)
        for t, ps in up.items():
            least[t] = set.intersection(*(result[p] for p in ps if p in result))
            result["async", t] = least[t] | closure(t)
            own["async", t] = closure(t) - least[t]
        if before == (up, least):
            return {t: closure(t) - least[t] for t in up}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_plans(spark, seed):
    r = random.Random(seed)
    nodes = [f"m{i}" for i in range(10)]
    static = [tuple(r.sample(nodes, 2)) for _ in range(9)]
    dynamic = [tuple(r.sample(nodes, 2)) for _ in range(8)]
    entries = nodes[:2]
    want = {t: m for t, m in brute_plan(entries, static, dynamic).items() if m}
    assert plan(spark, entries, static, dynamic)[0] == want


@pytest.mark.parametrize("part", ["parents", "chunks"])
def test_what_nobody_asks_for_is_not_written(spark, monkeypatch, part):
    written = []

    def noted(df, settle=chunks.settle):
        written.append(settle(df))
        return written[-1]

    monkeypatch.setattr(chunks, "settle", noted)
    monkeypatch.setattr(chunks, "SLICE_EDGES", 50)
    static = [("e", f"m{i}") for i in range(60)] + [(f"t{i}", f"m{i}") for i in range(60)]
    dynamic = [("e", f"t{i}") for i in range(60)] + [(f"t{i}", f"t{i + 1}") for i in range(59)]
    args = edges(spark, static), edges(spark, dynamic, "origin string, target string"), spark.createDataFrame([("e",)], "entry string")
    parents = {("e", f"t{i}") for i in range(60)} | {(f"t{i}", f"t{i + 1}") for i in range(59)}
    if part == "parents":
        assert sorted(map(tuple, chunks.chunk_parents(*args).collect())) == sorted(parents)
    else:
        assert sorted(map(tuple, chunks.chunk_plan(*args)[1].collect())) == sorted((f"t{i}", f"t{i}") for i in range(60))
    assert max(map(chunks.rows, written)) < 400  # all that is available to the targets: 3,600 pairs


def test_split_named_and_unnamed(spark):
    members = edges(spark, [("a", "ab"), ("b", "ab"), ("b", "bc"), ("c", "bc"), ("c", "own")], "chunk string, module string")
    assert {(r.chunks, r.module) for r in chunks.split_shared(members).collect()} == {("a,b", "ab"), ("b,c", "bc")}
    after = {(r.chunk, r.module) for r in chunks.without_shared(members, name="shared").collect()}
    assert after == {("c", "own"), ("shared", "ab"), ("shared", "bc")}
    one = edges(spark, [("a", "ab")], "chunk string, module string")
    assert chunks.connect(members, one).count() == 5 and chunks.disconnect(members, one).count() == 4
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "group int, chunk string")
    new = spark.createDataFrame([("a", "n")], "source string, chunk string")
    assert {tuple(r) for r in chunks.inherit_groups(groups, new).collect()} >= {(1, "n"), (2, "n")}


def test_requirements_close(spark):
    assert chunks.closure_of("ensure_chunk") == sum(map(chunks.bit, ["ensure_chunk", "ensure_chunk_handlers", "chunk_filename", "factories_add_only", "has_own"]))


def test_purity_and_cycles(spark):
    mods = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("e", None)], "module string, self_pure boolean")
    pure = reachability.pure_modules(mods, edges(spark, [("a", "b"), ("b", "a"), ("c", "d")]))
    assert {r.module for r in pure.collect()} == {"a", "b"}
    waits = edges(spark, [("x", "y"), ("y", "z"), ("z", "y"), ("w", "x")])
    assert {r.node for r in reachability.waits_in_cycle(waits).collect()} == {"y", "z"}


def test_fixpoint_limit(spark):
    start = spark.createDataFrame([(0,)], "n int")
    with pytest.raises(RuntimeError):
        fixpoint(start, lambda new: new.selectExpr("n + 1 AS n"), max_rounds=3)


def test_reexports_through_a_cycle_and_a_star(spark):
    rows = [("i", "p", "imp", None, "x"), ("p", "q", "reexp", "x", "y"), ("q", "r", "star", None, None), ("s", "t", "reexp", "x", "x"), ("t", "s", "reexp", "x", "x")]
    e = spark.createDataFrame(rows, "src string, dst string, kind string, name string, id string")
    pure = spark.createDataFrame([(m,) for m in "pqst"], "module string")
    asked = spark.createDataFrame([("p", "x"), ("s", "x"), ("r", "y"), ("q", "default")], "module string, name string")
    got = {tuple(r) for r in exports.resolve_reexports(asked, e, pure).collect()}
    assert got == {("p", "x", "r", "y")}


def test_named_ids_do_not_depend_on_order(spark):
    rows = [(1, "same", "alpha"), (2, "same", "beta"), (3, "own", "gamma"), (4, "", "zeta"), (5, "", "eta"), (6, "kept", "theta")]
    ids = []
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "item int, short string, full string")
        ids.append({r.item: r.id if r.id is not None else r.number for r in naming.named_ids(df, ["kept", "0"]).collect()})
    assert ids[0] == ids[1] and ids[0][3] == "own" and ids[0][1] != ids[0][2]
    assert (ids[0][5], ids[0][4]) == (1, 2) and ids[0][6].startswith("kept-")


@pytest.mark.parametrize("n", [0, 1, 200, 3000])
def test_numbered_in_ranges(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, "", "hot", "hot", f"é{r.randrange(900)}"]), r.choice([None, r.randrange(2000)]), r.random()) for _ in range(n)]
    df = spark.createDataFrame(rows, "full string, item long, other double").repartition(5)
    got = sorted(naming.numbered(df, ["full", "item"], "number").collect(), key=lambda x: x.number)
    assert [x.number for x in got] == list(range(n))
    first = lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0)
    assert [tuple(x)[:2] for x in got] == [tuple(x)[:2] for x in sorted(rows, key=first)]
    assert sorted(x.other for x in got) == sorted(x[2] for x in rows)


def test_readable_name(spark):
    row = [(1, "/r/src/value.js", "?one", "#alpha", "client", ["/r/loaders/first.js"])]
    df = spark.createDataFrame(row, "module int, resource string, query string, fragment string, layer string, loaders array<string>")
    assert naming.readable_names(df, "/r").first().name == "loaders/first.js!./src/value.js?one#alpha|layer:client"


def test_issuer(spark):
    c = spark.createDataFrame([(1, None, "a"), (2, "x", "a"), (3, "y", "a"), (4, None, "b")], "conn_id int, origin string, module string")
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    assert {tuple(r) for r in lookups.issuer(m, c).collect()} == {("a", True, "x"), ("b", True, None), ("c", False, None)}


def test_frames_fill_packs(spark):
    rows = [(1, 0, True, 60), (1, 1, True, 50), (1, 2, False, 10), (1, 3, True, 50), (2, 0, True, 500)]
    df = spark.createDataFrame(rows, "shard long, seq long, used boolean, length long")
    got = {(r.shard, r.seq): r.pack for r in incremental.pack_frames(df, 100).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 3): 1, (1, 2): 2, (2, 0): 0}


def test_signatures_tell_null_from_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None)], "x string, y string").select(incremental.signature(F.col("x"), F.col("y")).alias("s"))
    assert df.distinct().count() == 3


def test_memo_stages(spark):
    old = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", "1", "1")], "module string, graph string, ids string")
    new = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "2", "1"), ("d", "1", "1")], "module string, graph string, ids string")
    got = {r.module: (r.graph_ok, r.codegen_ok) for r in incremental.memo_validity(old, new).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (False, False), "d": (False, False)}


def test_digests_change_upwards(spark):
    def of(h):
        df = spark.createDataFrame([("/a/b/x", h), ("/a/c/y", "2")], "path string, hash string")
        return {r.path: r.digest for r in incremental.directory_digests(df).collect()}

    one, two = of("1"), of("9")
    assert set(one) == {"/a/b", "/a/c", "/a", ""} and {p for p in one if one[p] != two[p]} == {"/a/b", "/a", ""}


def test_concatenation(spark):
    def sets(mods, es, entries):
        df = spark.createDataFrame([(m, True, True) for m in mods], "module string, candidate boolean, known boolean")
        e = spark.createDataFrame([(a, b, ok) for a, b, ok in es], "src string, dst string, ok boolean")
        members = spark.createDataFrame([("main", m) for m in mods], "chunk string, module string")
        out = chunks.concatenation_sets(df, e, members, spark.createDataFrame([(x,) for x in entries], "module string"))
        found: dict = {}
        for r in out.collect():
            found.setdefault(r.root, set()).add(r.module)
        return found

    assert sets("abc", [("a", "b", True), ("b", "c", True)], "a") == {"a": {"a", "b", "c"}}
    assert sets("abc", [("a", "b", True), ("b", "c", False)], "a") == {"a": {"a", "b"}}
    assert sets("abcd", [("a", "b", True), ("d", "b", True)], "ad") == {}
