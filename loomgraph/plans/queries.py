"""Named queries of the graph operators over the star-schema tables, and their SQL for DuckDB.

Each entry of SQL may read the views of :mod:`views`; they are put in front of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import chunks, exports, incremental, lookups, naming, reachability, render, templates
from ..sources import files
from ..streaming import watch
from .build import build
from .fixpoint import settle
from .registry import ModuleTypes
from .views import duckdb_sql, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Fixed point in time of age rules, epoch seconds.
NOW_S = 1_767_225_600


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duckdb_sql(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark, d, *extra):
    return table(spark, d, "part").select(F.col("p_partkey").alias("module"), *extra)


def _entries(spark, d):
    return table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("module"))


def _known(spark, d):
    edges = view(spark, d, "export_edges")
    return _parts(spark, d).join(edges.where("kind = 'star'").select(F.col("src").alias("module")), "module", "left_anti")


def _provided(spark, d):
    named = view(spark, d, "export_edges").where("kind = 'reexp'").select(F.col("src").alias("module"), "name")
    return view(spark, d, "own_names").unionByName(named).distinct()


def _connections(spark, d):
    e = table(spark, d, "lineitem")
    return e.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("conn_id"),
        F.when(F.col("l_linestatus") == "F", F.col("l_orderkey")).alias("origin"),
        F.col("l_partkey").alias("module"), F.col("l_partkey").alias("resolved_module"),
        F.col("l_suppkey").cast("string").alias("request"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("block_index"), F.col("l_linenumber").alias("dep_index"),
    )


_CONN = """(SELECT l_orderkey * 100 + l_linenumber AS conn_id, CASE WHEN l_linestatus = 'F' THEN l_orderkey END AS origin, l_partkey AS module,
  CAST(l_suppkey AS VARCHAR) AS request, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS block_index, l_linenumber AS dep_index FROM lineitem)"""


@query("""
WITH RECURSIVE r(node, depth) USING KEY (node) AS (
  SELECT p_partkey, 0 FROM part WHERE p_size = 1
  UNION SELECT dst, min(depth) + 1 FROM r JOIN part_edges ON src = node WHERE dyn = 0 AND dst NOT IN (SELECT node FROM recurring.r) GROUP BY dst
) SELECT node, CAST(depth AS INTEGER) AS depth FROM r""")
def static_reachability(spark, d):
    edges = view(spark, d, "part_edges").where("dyn = 0")
    return reachability.reachable(edges, _entries(spark, d).select(F.col("module").alias("node")))


@query("""
WITH RECURSIVE r AS (
  SELECT entry AS root, entry AS node, 0 AS depth FROM sales_entries
  UNION SELECT root, dst, depth + 1 FROM r JOIN sales_static ON src = node
) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, node""")
def static_reachability_multi_depth(spark, d):
    return reachability.static_closure(view(spark, d, "sales_static"), view(spark, d, "sales_entries").select(F.col("entry").alias("root")))


_PROVIDED = """named AS (SELECT module, name FROM own_names UNION SELECT src, name FROM export_edges WHERE kind = 'reexp'),
  unknown AS (SELECT DISTINCT src AS module FROM export_edges WHERE kind = 'star')"""


@query(f"""
WITH {_PROVIDED}
SELECT p_partkey AS module, u.module IS NULL AS known, CASE WHEN u.module IS NULL THEN coalesce(names, '') END AS names
FROM part LEFT JOIN unknown u ON u.module = p_partkey
LEFT JOIN (SELECT module, string_agg(name, ',' ORDER BY name) AS names FROM named GROUP BY module) n ON n.module = p_partkey""")
def provided_exports(spark, d):
    return exports.provided_exports(_parts(spark, d), view(spark, d, "own_names"), view(spark, d, "export_edges"))


_USED = f"""{_PROVIDED}, seeds AS (
  SELECT p_partkey AS module, n.name FROM part JOIN named n ON n.module = p_partkey LEFT JOIN unknown u ON u.module = p_partkey
  WHERE p_size = 1 AND u.module IS NULL
  UNION SELECT p_partkey, '*' FROM part JOIN unknown u ON u.module = p_partkey WHERE p_size = 1
  UNION SELECT dst, '*' FROM export_edges WHERE kind = 'dyn' UNION SELECT dst, id FROM export_edges WHERE kind = 'imp'
), r AS (
  SELECT module, name FROM seeds
  UNION SELECT e.dst, CASE WHEN e.kind = 'reexp' THEN e.id ELSE r.name END FROM r JOIN export_edges e ON e.src = r.module
  LEFT JOIN unknown u ON u.module = e.dst LEFT JOIN named p ON p.module = e.dst AND p.name = r.name
  WHERE (e.kind = 'reexp' AND r.name IN (e.name, '*'))
     OR (e.kind = 'star' AND (r.name = '*' OR (r.name <> 'default' AND (u.module IS NOT NULL OR p.name IS NOT NULL))))
), used AS (
  SELECT module, bool_or(name = '*') AS all_used, CASE WHEN NOT bool_or(name = '*') THEN string_agg(name, ',' ORDER BY name) END AS names
  FROM r GROUP BY module
)"""


@query(f"WITH RECURSIVE {_USED} SELECT * FROM used")
def used_exports_fixpoint(spark, d):
    return exports.used_exports(_provided(spark, d), _known(spark, d), view(spark, d, "export_edges"), _entries(spark, d))


@query(f"""
WITH {_PROVIDED}, asked AS (SELECT DISTINCT dst AS module, id AS name FROM export_edges)
SELECT a.module, a.name, CASE WHEN u.module IS NULL THEN n.name IS NOT NULL END AS provided
FROM asked a LEFT JOIN unknown u ON u.module = a.module LEFT JOIN named n ON n.module = a.module AND n.name = a.name""")
def export_state(spark, d):
    asked = view(spark, d, "export_edges").select(F.col("dst").alias("module"), F.col("id").alias("name")).distinct()
    return exports.export_state(_parts(spark, d), _provided(spark, d), _known(spark, d), asked)


@query("""
WITH RECURSIVE hops AS (SELECT src, dst FROM export_edges WHERE kind = 'dyn'), bad AS (
  SELECT p_partkey AS node FROM part WHERE p_size > 45 UNION SELECT src FROM bad JOIN hops ON dst = node
) SELECT p_partkey AS module FROM part WHERE p_partkey NOT IN (SELECT node FROM bad)""")
def transitive_purity(spark, d):
    pure = (F.col("p_size") <= 45).alias("self_pure")
    return reachability.pure_modules(_parts(spark, d, pure), view(spark, d, "export_edges").where("kind = 'dyn'"))


_CHASE = """pure AS (SELECT p_partkey AS module FROM part WHERE p_size <= 40),
by_name AS (SELECT src AS at, name, min(dst) AS nxt, min(id) AS id FROM export_edges JOIN pure ON module = src WHERE kind = 'reexp' GROUP BY src, name HAVING count(*) = 1),
stars AS (SELECT src AS at, min(dst) AS nxt FROM export_edges JOIN pure ON module = src WHERE kind = 'star' GROUP BY src HAVING count(*) = 1),
c AS (
  SELECT module, name, module AS at, name AS as_name, [module] AS seen FROM (SELECT DISTINCT dst AS module, id AS name FROM export_edges)
  UNION ALL
  SELECT c.module, c.name, coalesce(n.nxt, s.nxt), coalesce(n.id, c.as_name), list_append(seen, coalesce(n.nxt, s.nxt))
  FROM c LEFT JOIN by_name n ON n.at = c.at AND n.name = c.as_name LEFT JOIN stars s ON s.at = c.at AND c.as_name <> 'default'
  WHERE coalesce(n.nxt, s.nxt) IS NOT NULL AND NOT list_contains(seen, coalesce(n.nxt, s.nxt))
), resolved AS (
  SELECT c.module, c.name, c.at AS final_module, c.as_name AS final_name
  FROM c LEFT JOIN by_name n ON n.at = c.at AND n.name = c.as_name LEFT JOIN stars s ON s.at = c.at AND c.as_name <> 'default'
  WHERE coalesce(n.nxt, s.nxt) IS NULL AND len(seen) > 1
)"""


def _resolved(spark, d):
    edges = view(spark, d, "export_edges")
    asked = edges.select(F.col("dst").alias("module"), F.col("id").alias("name"))
    return exports.resolve_reexports(asked, edges, table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("module")))


@query(f"WITH RECURSIVE {_CHASE} SELECT * FROM resolved")
def reexport_resolution(spark, d):
    return _resolved(spark, d)


@query(f"""
WITH RECURSIVE {_CHASE}, single AS (SELECT src, dst FROM export_edges WHERE kind = 'imp' GROUP BY src, dst HAVING count(DISTINCT id) = 1)
SELECT e.src, e.dst AS resolved_module, CASE WHEN m THEN final_module ELSE e.dst END AS module, kind, e.name, CASE WHEN m THEN final_name ELSE e.id END AS id
FROM (SELECT e.*, final_module, final_name, final_module IS NOT NULL AND (kind = 'reexp' OR (kind = 'imp' AND s.src IS NOT NULL)) AS m
  FROM export_edges e LEFT JOIN resolved r ON r.module = e.dst AND r.name = e.id LEFT JOIN single s ON s.src = e.src AND s.dst = e.dst) e""")
def edge_rewrite(spark, d):
    return exports.rewrite_edges(view(spark, d, "export_edges"), _resolved(spark, d))


_MOVED = """single AS (SELECT src, dst FROM export_edges WHERE kind = 'imp' GROUP BY src, dst HAVING count(DISTINCT id) = 1),
e AS (
  SELECT src, CASE WHEN m THEN final_module ELSE dst END AS dst, CASE WHEN kind = 'dyn' THEN 'side' ELSE kind END AS kind, name, CASE WHEN m THEN final_name ELSE id END AS id
  FROM (SELECT x.*, final_module, final_name, final_module IS NOT NULL AND (kind = 'reexp' OR (kind = 'imp' AND s.src IS NOT NULL)) AS m
    FROM export_edges x LEFT JOIN resolved r ON r.module = x.dst AND r.name = x.id LEFT JOIN single s ON s.src = x.src AND s.dst = x.dst)
)"""


@query(f"""
WITH RECURSIVE {_USED}, {_CHASE}, {_MOVED}
SELECT e.src, e.dst, e.kind, e.name, e.id, CASE
  WHEN kind = 'side' THEN p_size > 40 OR EXISTS (SELECT 1 FROM e i WHERE i.kind = 'imp' AND i.src = e.src AND i.dst = e.dst)
  WHEN kind = 'reexp' THEN coalesce(s.all_used OR list_contains(string_split(s.names, ','), e.name), FALSE)
  WHEN kind = 'star' THEN t.module IS NOT NULL ELSE TRUE END AS active
FROM e JOIN part ON p_partkey = e.dst LEFT JOIN used s ON s.module = e.src LEFT JOIN used t ON t.module = e.dst""")
def edge_activity(spark, d):
    """On the graph after the rewrite; usage was decided on the one before."""
    edges = settle(view(spark, d, "export_edges"))
    used = exports.used_exports(_provided(spark, d), _known(spark, d), edges, _entries(spark, d))
    pure = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("module"))
    moved = exports.rewrite_edges(edges, _resolved(spark, d)).select("src", F.col("module").alias("dst"), "kind", "name", "id")
    side = moved.withColumn("kind", F.when(F.col("kind") == "dyn", "side").otherwise(F.col("kind")))
    return exports.edge_activity(side, used, pure)


@query("SELECT DISTINCT origin, target FROM sales_dynamic")
def dynamic_origins(spark, d):
    return chunks.dynamic_origins(view(spark, d, "sales_dynamic"))


_PLAN = """closure AS (
  SELECT target AS t, target AS node FROM sales_dynamic UNION SELECT t, dst FROM closure JOIN sales_static ON src = node
), entry AS (SELECT entry AS t, entry AS node FROM sales_entries UNION SELECT t, dst FROM entry JOIN sales_static ON src = node),
l1 AS (SELECT DISTINCT e.t AS parent, target FROM entry e JOIN sales_dynamic ON origin = node),
n1 AS (SELECT target, count(*) AS n FROM l1 GROUP BY target),
min1 AS (SELECT l1.target, e.node FROM l1 JOIN entry e ON e.t = l1.parent JOIN n1 ON n1.target = l1.target GROUP BY l1.target, e.node, n HAVING count(*) = n),
res1 AS (SELECT target, node FROM min1 WHERE node IN (SELECT node FROM closure) UNION SELECT t, node FROM closure WHERE t IN (SELECT target FROM l1)),
l2 AS (SELECT DISTINCT c.t AS parent, d.target FROM closure c JOIN l1 ON l1.target = c.t JOIN sales_dynamic d ON d.origin = c.node
  LEFT JOIN min1 m ON m.target = c.t AND m.node = c.node LEFT JOIN res1 r ON r.target = c.t AND r.node = d.target WHERE m.node IS NULL AND r.node IS NULL),
parents AS (SELECT * FROM l1 UNION SELECT * FROM l2),
n2 AS (SELECT target, count(*) AS n FROM l2 GROUP BY target),
min2 AS (SELECT l2.target, r.node FROM l2 JOIN res1 r ON r.target = l2.parent JOIN n2 ON n2.target = l2.target GROUP BY l2.target, r.node, n HAVING count(*) = n),
mins AS (SELECT * FROM min1 UNION SELECT * FROM min2),
chunks AS (SELECT c.t AS target, c.node AS module FROM closure c LEFT JOIN mins m ON m.target = c.t AND m.node = c.node
  WHERE m.node IS NULL AND c.t IN (SELECT target FROM parents))"""


def _plan(spark, d):
    return view(spark, d, "sales_static"), view(spark, d, "sales_dynamic"), view(spark, d, "sales_entries")


@query(f"WITH RECURSIVE {_PLAN} SELECT target, module FROM chunks")
def chunk_plan_full(spark, d):
    return chunks.chunk_plan(*_plan(spark, d))[1]


@query(f"WITH RECURSIVE {_PLAN} SELECT parent, target FROM parents")
def chunk_parents(spark, d):
    return chunks.chunk_parents(*_plan(spark, d))


@query("""
WITH sets AS (SELECT l_partkey AS module, string_agg(DISTINCT l_suppkey, ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS chunks, count(DISTINCT l_suppkey) AS k
  FROM (SELECT l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem) GROUP BY l_partkey)
SELECT chunks, module, count(*) OVER (PARTITION BY chunks) AS shared FROM sets WHERE k >= 2""")
def split_shared_modules(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("chunk"), F.col("l_partkey").alias("module"))
    return chunks.split_shared(members)


_MASK = "CASE WHEN l_returnflag = 'R' THEN 8 WHEN l_returnflag = 'A' THEN 64 ELSE 32 END"


@query(f"""
WITH t AS (SELECT o_custkey AS entry, bit_or({_MASK}) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT entry, CAST(m | (CASE WHEN m & 8 <> 0 THEN 16 ELSE 0 END) | (CASE WHEN m & 64 <> 0 THEN 128 + 256 + 512 + 16 ELSE 0 END) AS INTEGER) AS mask FROM t""")
def requirement_tree(spark, d):
    line = table(spark, d, "lineitem").withColumn("module", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    masks = line.groupBy("module").agg(F.bit_or(F.expr(_MASK)).alias("mask"))
    tree = table(spark, d, "orders").select(F.col("o_custkey").alias("entry"), F.col("o_orderkey").alias("chunk"))
    return chunks.requirement_tree(masks, line.select(F.col("l_orderkey").alias("chunk"), "module"), tree)


@query("""
WITH RECURSIVE r(node, depth) USING KEY (node) AS (
  SELECT p_partkey, 0 FROM part WHERE p_retailprice > 0 AND p_size = 7
  UNION SELECT src, min(depth) + 1 FROM r JOIN part_edges ON dst = node WHERE src NOT IN (SELECT node FROM recurring.r) GROUP BY src
) SELECT node, CAST(depth AS INTEGER) AS depth FROM r""")
def affected_closure(spark, d):
    old = _parts(spark, d, F.col("p_size").alias("signature"))
    new = old.withColumn("signature", F.when(F.col("signature") == 7, 70).otherwise(F.col("signature")))
    return reachability.affected(old, new, view(spark, d, "part_edges"))


@query(f"SELECT * EXCLUDE (k) FROM (SELECT origin, module, request, conn_id, row_number() OVER (PARTITION BY module, request ORDER BY conn_id, origin NULLS FIRST) AS k FROM {_CONN}) WHERE k = 1")
def edge_dedup(spark, d):
    c = _connections(spark, d).select("origin", "module", "request", "conn_id")
    return lookups.edge_dedup(c, ["module", "request"], ["conn_id", "origin"])


@query(f"SELECT origin, request, count(*) AS n, min(conn_id) AS first FROM {_CONN} GROUP BY origin, request")
def request_grouping(spark, d):
    return lookups.request_groups(_connections(spark, d))


@query(f"SELECT module, origin, count(*) AS n FROM {_CONN} GROUP BY module, origin")
def group_incoming(spark, d):
    return lookups.group_incoming(_connections(spark, d))


@query(f"""SELECT p_partkey AS module, c.module IS NOT NULL AS has_incoming, issuer FROM part LEFT JOIN (
  SELECT module, arg_min(origin, conn_id) FILTER (origin IS NOT NULL) AS issuer FROM {_CONN} GROUP BY module) c ON c.module = p_partkey""")
def issuer(spark, d):
    return lookups.issuer(_parts(spark, d), _connections(spark, d))


@query(f"""
SELECT c.conn_id, c.module FROM {_CONN} c WHERE EXISTS (SELECT 1 FROM {_CONN} a
  WHERE a.block_index IS NULL AND a.origin = c.origin AND a.dep_index = c.dep_index AND c.block_index IS NOT DISTINCT FROM a.block_index)""")
def edge_by_position(spark, d):
    c = _connections(spark, d)
    return lookups.by_position(c, c.where("block_index IS NULL").select("origin", "block_index", "dep_index")).select("conn_id", "module")


@query("""SELECT l_partkey AS module, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS chunks
FROM lineitem GROUP BY l_partkey""")
def module_chunks(spark, d):
    return lookups.module_chunks(table(spark, d, "lineitem").select(F.col("l_partkey").alias("module"), F.col("l_suppkey").cast("string").alias("chunk")))


@query("""
WITH p AS (SELECT p_partkey AS item, CASE WHEN p_size > 45 THEN '' ELSE p_brand END AS short, p_name AS full FROM part)
SELECT item, CAST(row_number() OVER (ORDER BY "full", item) - 1 AS BIGINT) AS number FROM p WHERE short = ''""")
def unnamed_ids(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.expr("CASE WHEN p_size > 45 THEN '' ELSE p_brand END AS short"), F.col("p_name").alias("full"))
    return naming.named_ids(part).where("number IS NOT NULL").select("item", "number")


def _fnv_sql(text: str) -> str:
    """The FNV-1a hash of ASCII text and the end mark, as 16 hex digits."""
    step = "lambda s, b: CAST((CAST(xor(s, b) AS UHUGEINT) * 1099511628211) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"
    codes = f"list_append(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT)), CAST(255 AS UBIGINT))"
    return f"lpad(lower(to_hex(list_reduce(list_prepend(CAST(14695981039346656037 AS UBIGINT), {codes}), {step}))), 16, '0')"


@query(f"""
WITH p AS (SELECT p_partkey AS item, p_name AS short, concat(p_name, '|', p_type) AS "full", count(*) OVER (PARTITION BY p_name) AS n FROM part),
b AS (SELECT *, CASE WHEN n = 1 THEN short ELSE concat(short, '-', substr({_fnv_sql('"full"')}, 11, 6)) END AS base FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY base <> short, short, "full", item) - 2 AS k FROM b)
SELECT item, CASE WHEN k < 0 THEN base ELSE concat(base, '-', CAST(k AS VARCHAR)) END AS id, CAST(NULL AS BIGINT) AS number FROM r""")
def named_ids(spark, d):
    return naming.named_ids(table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("short"), F.concat("p_name", F.lit("|"), "p_type").alias("full")))


@query("""
SELECT page_id AS module, concat('./', regexp_replace(path, '^/', ''), CASE WHEN contains(url, '?') THEN regexp_extract(url, '[?][^#]*') ELSE '' END,
  CASE WHEN contains(url, '#') THEN regexp_extract(url, '#.*$') ELSE '' END) AS name FROM page_paths""")
def readable_names(spark, d):
    p = view(spark, d, "page_paths")
    none = F.lit(None).cast("string")
    part = lambda regex: F.nullif(F.regexp_extract("url", regex, 0), F.lit(""))
    m = p.select(F.col("page_id").alias("module"), F.regexp_replace("path", "^", "/root").alias("resource"), part("[?][^#]*").alias("query"), part("#.*$").alias("fragment"),
                 none.alias("layer"), F.array().cast("array<string>").alias("loaders"))
    return naming.readable_names(m, "/root")


@query("SELECT page_id, CAST(row_number() OVER (ORDER BY string_split(path, '/'), page_id) AS BIGINT) AS place FROM page_paths")
def identity_order(spark, d):
    # the place of each identity, counted by ranges: no task sees all rows
    p = view(spark, d, "page_paths").select("page_id", F.split("path", "/").alias("parts"))
    return naming.numbered(p, ["parts", "page_id"], "before").select("page_id", (F.col("before") + 1).alias("place"))


RULES = [("/en/", "text/en"), ("[.]html$", "page"), ("/[0-9]{4,}$", "numbered")]


@query("""
WITH rules(test, module_type) AS (VALUES ('/en/', 'text/en'), ('[.]html$', 'page'), ('/[0-9]{4,}$', 'numbered')), paths AS (SELECT DISTINCT path FROM page_paths)
SELECT path, count(test) AS n_rules, CASE WHEN count(test) = 1 THEN max(module_type) END AS module_type, count(test) > 1 AS error
FROM paths LEFT JOIN rules ON regexp_matches(path, test) GROUP BY path""")
def rule_match(spark, d):
    return files.match_rules(view(spark, d, "page_paths").select("path").distinct(), spark.createDataFrame(RULES, "test string, module_type string"))


@query(r"SELECT page_id, CASE WHEN lower(regexp_extract(path, '\.([^./]+)$', 1)) = 'json' THEN 'json' ELSE 'javascript/auto' END AS module_type FROM page_paths")
def module_type_route(spark, d):
    return view(spark, d, "page_paths").select("page_id", text.module_type(F.col("path")).alias("module_type"))


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) <= 8096 THEN 'asset/inline' ELSE 'asset/resource' END AS kind FROM pages")
def asset_inline_threshold(spark, d):
    return table(spark, d, "pages").select("page_id", text.asset_kind(F.col("html")).alias("kind"))


@query("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def json_keys(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(text.json_keys(F.col("props"))), ",").alias("keys"))


@query("""
SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)""")
def link_extraction(spark, d):
    return files.links(table(spark, d, "pages"))


@query("""
SELECT path, CASE WHEN contains(path, '/view/') THEN 'unmanaged' WHEN contains(path, '/purchase/') THEN 'immutable'
  WHEN contains(path, '/click/') THEN 'managed' ELSE 'none' END AS class FROM (SELECT DISTINCT path FROM file_events)""")
def path_classify(spark, d):
    return incremental.classify_paths(view(spark, d, "file_events").select("path").distinct(), "/view/", "/purchase/", "/click/")


@query("SELECT path, arg_max(value, event_id) AS hash FROM file_events GROUP BY path")
def snapshot_merge(spark, d):
    return incremental.merge_snapshots(view(spark, d, "file_events").select("path", F.col("event_id").alias("seq"), F.col("value").alias("hash")))


@query("""
WITH a AS (SELECT path, arg_max(value, event_id) AS hash FROM file_events WHERE kind <> 'context' GROUP BY path),
n AS (SELECT path, arg_max(value, event_id) AS hash FROM file_events WHERE kind <> 'removed' GROUP BY path)
SELECT a.path FROM a LEFT JOIN n USING (path) WHERE n.path IS NULL OR a.hash IS DISTINCT FROM n.hash""")
def snapshot_invalid(spark, d):
    e = view(spark, d, "file_events").select("path", "kind", F.col("event_id").alias("seq"), F.col("value").alias("hash"))
    return incremental.invalid_files(incremental.merge_snapshots(e.where("kind != 'context'")), incremental.merge_snapshots(e.where("kind != 'removed'")))


@query("SELECT DISTINCT path FROM file_events WHERE kind = 'removed' AND path NOT IN (SELECT path FROM file_events WHERE kind = 'modified')")
def missing_valid(spark, d):
    e = view(spark, d, "file_events").select("path", "kind").distinct()
    return incremental.still_missing(e.where("kind = 'removed'"), e.where("kind = 'modified'"))


@query("""
WITH p AS (SELECT DISTINCT path FROM file_events), c AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM file_events WHERE kind = 'context'),
m AS (SELECT DISTINCT path FROM file_events WHERE kind = 'removed')
SELECT path FROM p WHERE path IN (SELECT path FROM m) OR EXISTS (SELECT 1 FROM c WHERE p.path = c.path OR starts_with(p.path, c.path || '/') OR starts_with(c.path, p.path || '/'))""")
def change_hit(spark, d):
    e = view(spark, d, "file_events").select("path", "kind")
    contexts = e.where("kind = 'context'").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), "kind")
    return incremental.change_hits(e.select("path").distinct(), contexts.unionByName(e.where("kind = 'removed'")))


@query("""
WITH a AS (SELECT path AS key, max(event_type) AS etag FROM file_events GROUP BY path),
m AS (SELECT path AS key, max(event_type) AS etag, max(CAST(event_id AS VARCHAR)) AS payload FROM file_events WHERE value > 50 GROUP BY path),
k AS (SELECT path AS key, max(CASE WHEN value > 10 THEN event_type END) AS etag, min(CAST(event_id AS VARCHAR)) AS payload FROM file_events GROUP BY path)
SELECT a.key, a.etag, CAST(CASE WHEN m.key IS NOT NULL THEN 0 WHEN k.key IS NOT NULL THEN 1 END AS INTEGER) AS layer, coalesce(m.payload, k.payload) AS payload
FROM a LEFT JOIN m ON a.key = m.key AND a.etag IS NOT DISTINCT FROM m.etag LEFT JOIN k ON a.key = k.key AND a.etag IS NOT DISTINCT FROM k.etag""")
def cache_lookup_layers(spark, d):
    e = view(spark, d, "file_events").withColumn("id", F.col("event_id").cast("string"))
    asked = e.groupBy(F.col("path").alias("key")).agg(F.max("event_type").alias("etag"))
    memory = e.where("value > 50").groupBy(F.col("path").alias("key")).agg(F.max("event_type").alias("etag"), F.max("id").alias("payload"))
    disk = e.groupBy(F.col("path").alias("key")).agg(F.max(F.when(F.col("value") > 10, F.col("event_type"))).alias("etag"), F.min("id").alias("payload"))
    return incremental.layered_lookup(asked, [memory, disk])


_USE = "SELECT user_id AS key, max(event_id) AS last_used, max(CASE WHEN event_type = 'error' THEN event_id END) AS unused_since, max(epoch(ts)) AS last_access_s FROM events GROUP BY user_id"


def _use(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(
        F.max("event_id").alias("last_used"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("unused_since"),
        F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last_access_s"))


@query(f"SELECT key, last_used FROM ({_USE}) WHERE 900 - last_used < 500")
def memory_gc(spark, d):
    return incremental.memory_kept(_use(spark, d), 900, 500).select("key", "last_used")


@query(f"SELECT key FROM ({_USE}) WHERE unused_since < 5000 AND {NOW_S} - last_access_s > 60 * 86400")
def pack_expiry(spark, d):
    return incremental.expired(_use(spark, d), 5000, NOW_S).select("key")


@query("""
WITH e AS (SELECT user_id AS file, CAST(sum(value) OVER (PARTITION BY user_id) * 2000 AS BIGINT) AS pack_size, CAST(value * 1000 AS BIGINT) AS length,
  CASE WHEN event_type = 'error' THEN event_id END AS unused FROM events),
p AS (SELECT file, max(pack_size) AS size, CAST(sum(length) AS BIGINT) AS live, bool_or(unused IS NULL) AS used FROM e GROUP BY file),
n AS (SELECT count(*) FILTER (size <= 262144 AND used) AS n FROM p)
SELECT file, CASE WHEN greatest(size - live, 0) >= 131072 AND greatest(size - live, 0) * 100 >= size * 25 THEN 'waste' WHEN size > 4194304 THEN 'oversized'
  WHEN size <= 262144 AND used AND n >= 2 THEN 'small' END AS reason FROM p, n
WHERE (greatest(size - live, 0) >= 131072 AND greatest(size - live, 0) * 100 >= size * 25) OR size > 4194304 OR (size <= 262144 AND used AND n >= 2)""")
def pack_compaction(spark, d):
    e = table(spark, d, "events")
    sizes = e.groupBy("user_id").agg(F.round(F.sum("value") * 2000).cast("long").alias("pack_size"))
    return incremental.compaction(
        e.join(sizes, "user_id").select(
            F.col("user_id").alias("file"), "pack_size", F.round(F.col("value") * 1000).cast("long").alias("length"),
            F.when(F.col("event_type") == "error", F.col("event_id")).alias("unused_since"))
    )


@query("""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM file_events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM g),
l AS (SELECT user_id, batch, path, arg_max(kind, (ts, kind)) AS kind FROM s GROUP BY user_id, batch, path)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n, any_value(paths) AS paths FROM s
JOIN (SELECT user_id, batch, string_agg(path || ':' || kind, ',' ORDER BY path) AS paths FROM l GROUP BY user_id, batch) p USING (user_id, batch)
GROUP BY user_id, batch""")
def debounce_batches(spark, d):
    return watch.debounce(view(spark, d, "file_events").select("ts", "user_id", "path", "kind"), "1 hour", ("user_id",))


@query("SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM file_events GROUP BY path")
def latest_change_kind(spark, d):
    return watch.latest_kind(view(spark, d, "file_events"))


@query("SELECT page_id, concat('data:text/html;base64,', to_base64(encode(html))) AS uri FROM pages")
def data_uri(spark, d):
    return table(spark, d, "pages").select("page_id", text.data_uri(F.lit("page.html"), F.col("html")).alias("uri"))


@query("SELECT doc_id, concat(substr(sha256(text), 1, 20), '.txt') AS filename FROM documents")
def content_hash_name(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_name(F.col("text"), F.lit(".txt")).alias("filename"))


@query("SELECT p_partkey AS module, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS ident, CASE WHEN regexp_matches(p_name, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN concat('.', p_name) ELSE concat('[\"', p_name, '\"]') END AS access FROM part")
def identifiers(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("module"), text.sanitize_identifier(F.col("p_name")).alias("ident"), text.property_access(F.col("p_name")).alias("access"))


@query(f"""
WITH e AS (SELECT origin, '{{"block_index":' || coalesce(CAST(block_index AS VARCHAR), 'null') || ',"dep_index":' || dep_index || ',"dst":' || module || '}}' AS j,
  block_index, dep_index, module FROM {_CONN} WHERE origin IS NOT NULL),
l AS (SELECT origin, '[' || string_agg(j, ',' ORDER BY block_index NULLS FIRST, dep_index, module) || ']' AS j FROM e GROUP BY origin)
SELECT o_orderkey AS module, sha256('{{"source_hash":"' || sha256(o_orderpriority) || '","error":null,"edges":' || coalesce(j, 'null') || '}}') AS signature
FROM orders LEFT JOIN l ON origin = o_orderkey""")
def module_signatures(spark, d):
    edges = _connections(spark, d).select(F.col("origin").alias("src"), "block_index", "dep_index", F.col("module").alias("dst")).where("src IS NOT NULL")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("module"), F.sha2(F.col("o_orderpriority"), 256).alias("source_hash"), F.lit(None).cast("string").alias("error"))
    return incremental.module_signatures(orders, edges)


@query()
def concat_sets(spark, d):
    edges = view(spark, d, "part_supplier").select(F.concat(F.lit("s"), "s").alias("src"), F.concat(F.lit("p"), "p").alias("dst"), F.lit(True).alias("ok"))
    nodes = edges.select(F.col("src").alias("module")).union(edges.select("dst")).distinct()
    modules = nodes.select("module", F.lit(True).alias("candidate"), F.lit(True).alias("known"))
    return chunks.concatenation_sets(modules, edges, nodes.select(F.lit("main").alias("chunk"), "module"), nodes.where("module = 's1'"))


@query("""
WITH f AS (SELECT path, CAST(arg_max(value, event_id) AS VARCHAR) AS digest FROM file_events GROUP BY path),
l3 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(regexp_extract(path, '[^/]*$') || ':' || digest, chr(10) ORDER BY regexp_extract(path, '[^/]*$') || ':' || digest)) AS digest FROM f GROUP BY 1),
l2 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(regexp_extract(path, '[^/]*$') || ':' || digest, chr(10) ORDER BY regexp_extract(path, '[^/]*$') || ':' || digest)) AS digest FROM l3 GROUP BY 1),
l1 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(regexp_extract(path, '[^/]*$') || ':' || digest, chr(10) ORDER BY regexp_extract(path, '[^/]*$') || ':' || digest)) AS digest FROM l2 GROUP BY 1)
SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1""")
def directory_digests(spark, d):
    e = view(spark, d, "file_events").select("path", F.col("event_id").alias("seq"), F.col("value").cast("string").alias("hash"))
    return incremental.directory_digests(incremental.merge_snapshots(e))


@query("SELECT p_partkey AS module, replace(p_name, ' ', '::') AS text FROM part")
def source_replacements(spark, d):
    """Each space of a name, as one byte range."""
    parts = _parts(spark, d, F.col("p_name").alias("source"))
    at = F.expr("filter(sequence(1, octet_length(source)), i -> substring(encode(source, 'utf-8'), i, 1) = X'20')")
    spaces = parts.where("source != ''").select("module", F.posexplode(at).alias("seq", "i"))
    spaces = spaces.select("module", (F.col("i") - 1).cast("long").alias("start"), F.col("i").cast("long").alias("end"), "seq", F.lit("::").alias("text"))
    return render.apply_replacements(parts, spaces)


_JSON_CODE = """concat('var __WEBPACK_JSON_MODULE__ = JSON.parse("{\\"name\\":\\"', p_name, '\\",\\"size\\":', p_size,
  '}");', chr(10), '__webpack_require__.d(__webpack_exports__, { default: () => (__WEBPACK_JSON_MODULE__), ["name"]: () => (__WEBPACK_JSON_MODULE__["name"]), ["size"]: () => (__WEBPACK_JSON_MODULE__["size"]) });')"""


@query(f"SELECT p_partkey AS module, {_JSON_CODE} AS code FROM part")
def json_module_code(spark, d):
    source = F.format_string('{"size": %d, "name": "%s"}', "p_size", "p_name")
    return _parts(spark, d, render.json_code(source).alias("code"))


@query("""
WITH m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS chunk, CAST(l_partkey AS VARCHAR) AS id FROM lineitem)
SELECT concat(chunk, '.js') AS filename, concat('"use strict";', chr(10), 'exports.id = "', chunk, '";', chr(10), 'exports.ids = ["', chunk, '"];', chr(10),
  'exports.modules = ({', chr(10), string_agg(concat('"', id, '": ((__unused_webpack_module, __webpack_exports__, __webpack_require__) => {', chr(10),
  '"use strict";', chr(10), 'run(', id, ')', chr(10), '})'), concat(',', chr(10)) ORDER BY id), chr(10), '});', chr(10)) AS content FROM m GROUP BY chunk""")
def chunk_assets(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("chunk"), F.col("l_partkey").cast("string").alias("id")).distinct()
    return render.chunk_assets(m.withColumn("code", F.concat(F.lit("run("), "id", F.lit(")"))))


@query("""
WITH c AS (SELECT o_custkey AS app, CASE WHEN o_totalprice > 150000 THEN concat(o_orderstatus, '"', o_orderkey) END AS id, o_orderkey AS number,
  concat('chunk-', o_orderkey, '.js') AS filename FROM orders)
SELECT app, string_agg(concat(CASE WHEN id IS NULL THEN CAST(number AS VARCHAR) ELSE CAST(to_json(id) AS VARCHAR) END, ': "', filename, '"'), ', '
  ORDER BY id IS NULL, id, number) AS entries FROM c GROUP BY app""")
def filename_map(spark, d):
    named = F.col("o_totalprice") > 150000
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("app"), F.when(named, F.concat("o_orderstatus", F.lit('"'), "o_orderkey")).alias("id"),
        F.when(~named, F.col("o_orderkey")).alias("number"), F.concat(F.lit("chunk-"), "o_orderkey", F.lit(".js")).alias("filename"),
    )
    return render.filename_map(o)


@query("SELECT concat(substr(sha256(text), 1, 20), '.txt') AS filename, CAST(max(strlen(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def resource_asset_sizes(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    resources = docs.select(F.col("doc_id").alias("module"), hashing.content_name(F.col("text"), F.lit(".txt")).alias("filename"), F.col("text").alias("content"))
    return render.asset_sizes(render.resource_assets(resources, docs.where("lang IS NOT NULL").select(F.col("doc_id").alias("module"))))


@query("""
SELECT user_id AS cache, min(epoch_us(ts) // 1000 + CASE event_type WHEN 'signup' THEN 5000 WHEN 'error' THEN 1000 ELSE 60000 END) AS flush_ms FROM events GROUP BY user_id""")
def flush_schedule(spark, d):
    kind = F.when(F.col("event_type") == "signup", "initial").when(F.col("event_type") == "error", "large").otherwise("ordinary")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return incremental.flush_times(table(spark, d, "events").select(F.col("user_id").alias("cache"), kind.alias("kind"), ms.alias("end_ms")))


_MEMBERS = "(SELECT DISTINCT l_suppkey AS chunk, l_partkey AS module FROM lineitem)"


def _members(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chunk"), F.col("l_partkey").alias("module")).distinct()


@query(f"SELECT conn_id, origin, module FROM {_CONN} WHERE origin IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def outgoing_edges(spark, d):
    m = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("module"))
    return lookups.outgoing(_connections(spark, d), m).select("conn_id", "origin", "module")


@query(f"SELECT conn_id, origin, module FROM {_CONN} WHERE module IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def incoming_edges(spark, d):
    return lookups.incoming(_connections(spark, d), _entries(spark, d)).select("conn_id", "origin", "module")


@query(f"SELECT origin, module, count(*) AS n FROM {_CONN} GROUP BY origin, module")
def group_outgoing(spark, d):
    return lookups.group_outgoing(_connections(spark, d))


@query(f"SELECT conn_id, module AS resolved_module, module FROM {_CONN}")
def edge_targets(spark, d):
    return lookups.targets(_connections(spark, d))


@query(f"SELECT chunk, count(*) AS n, string_agg(CAST(module AS VARCHAR), ',' ORDER BY CAST(module AS VARCHAR)) AS modules FROM {_MEMBERS} GROUP BY chunk")
def chunk_modules(spark, d):
    return lookups.chunk_modules(_members(spark, d))


@query(f"""SELECT chunk, module, CAST(row_number() OVER (PARTITION BY chunk ORDER BY p_size DESC, p_name, module) - 1 AS INTEGER) AS place
FROM {_MEMBERS} JOIN part ON p_partkey = module""")
def ordered_chunk_modules(spark, d):
    return lookups.ordered_modules(_members(spark, d), _parts(spark, d, "p_size", "p_name"), [F.desc("p_size"), "p_name"])


@query(f"SELECT chunk, module FROM {_MEMBERS} WHERE module IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def chunk_entry_modules(spark, d):
    return lookups.entry_modules(_members(spark, d), _entries(spark, d))


@query("SELECT p_partkey AS module, CASE WHEN p_size > 25 THEN p_name END AS id FROM part")
def module_id_lookup(spark, d):
    return lookups.module_id(_parts(spark, d), table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("module"), F.col("p_name").alias("id")))


@query(f"""
WITH t AS (SELECT origin AS module, string_agg(p_name, ',' ORDER BY conn_id, p_name) AS targets FROM {_CONN} JOIN part ON p_partkey = module WHERE origin IS NOT NULL GROUP BY origin),
c AS (SELECT module, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY CAST(chunk AS VARCHAR)) AS chunks FROM {_MEMBERS} GROUP BY module)
SELECT p_partkey AS module, p_name AS id, chunks, targets FROM part LEFT JOIN c ON c.module = p_partkey LEFT JOIN t ON t.module = p_partkey""")
def module_references(spark, d):
    ids = _parts(spark, d, F.col("p_name").alias("id"))
    return lookups.references(ids, ids, _connections(spark, d), _members(spark, d).withColumn("chunk", F.col("chunk").cast("string")))


@query("""
WITH a AS (SELECT DISTINCT user_id AS owner, path FROM file_events WHERE kind <> 'removed'), b AS (SELECT DISTINCT user_id AS owner, path FROM file_events WHERE kind <> 'context')
SELECT coalesce(a.owner, b.owner) AS owner, bool_and(a.path IS NOT NULL AND b.path IS NOT NULL) AS same FROM a FULL JOIN b ON a.owner = b.owner AND a.path = b.path GROUP BY 1""")
def same_paths(spark, d):
    e = view(spark, d, "file_events").select(F.col("user_id").alias("owner"), "path", "kind")
    return lookups.same_paths(e.where("kind != 'removed'"), e.where("kind != 'context'"))


@query(f"""
WITH RECURSIVE {_USED}, asked AS (SELECT DISTINCT dst AS module, id AS name FROM export_edges)
SELECT a.module, a.name, CASE WHEN u.all_used OR list_contains(string_split(u.names, ','), a.name) THEN a.name END AS used_name FROM asked a LEFT JOIN used u USING (module)""")
def used_name(spark, d):
    edges = settle(view(spark, d, "export_edges"))
    used = exports.used_exports(_provided(spark, d), _known(spark, d), edges, _entries(spark, d))
    return exports.used_names(edges.select(F.col("dst").alias("module"), F.col("id").alias("name")).distinct(), used)


@query("""
WITH m AS (SELECT path AS key, max(event_type) AS etag, max(CAST(event_id AS VARCHAR)) AS payload FROM file_events WHERE value > 50 GROUP BY path),
n AS (SELECT path AS key, max(event_type) AS etag, min(CAST(event_id AS VARCHAR)) AS payload FROM file_events WHERE value <= 20 GROUP BY path)
SELECT * FROM n UNION ALL SELECT * FROM m WHERE key NOT IN (SELECT key FROM n)""")
def cache_store(spark, d):
    e = view(spark, d, "file_events").withColumn("id", F.col("event_id").cast("string"))
    layer = e.where("value > 50").groupBy(F.col("path").alias("key")).agg(F.max("event_type").alias("etag"), F.max("id").alias("payload"))
    new = e.where("value <= 20").groupBy(F.col("path").alias("key")).agg(F.max("event_type").alias("etag"), F.min("id").alias("payload"))
    return incremental.stored([layer], new)[0]


@query("""
SELECT s_suppkey AS root FROM supplier LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = s_suppkey
WHERE c_custkey IS NULL OR s_nationkey <> c_nationkey""")
def managed_packages(spark, d):
    was = table(spark, d, "supplier").select(F.col("s_suppkey").alias("root"), F.lit("p").alias("name"), F.col("s_nationkey").alias("version"))
    now = table(spark, d, "customer").where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("root"), F.lit("p").alias("name"), F.col("c_nationkey").alias("version"))
    return incremental.invalid_managed(was, now)


@query("""
WITH runs AS (SELECT o_custkey AS run, bool_or(o_orderstatus = 'P') AS manual FROM orders GROUP BY o_custkey),
c AS (SELECT user_id AS run, count(DISTINCT path) AS n FROM file_events WHERE kind = 'removed' GROUP BY user_id), f AS (SELECT min(run) AS first FROM runs)
SELECT run, full_build AS "full", CASE WHEN full_build THEN 0 ELSE n END AS n FROM (SELECT run, n, run = first OR manual OR n IS NULL AS full_build FROM runs LEFT JOIN c USING (run), f)""")
def rebuild_rows(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("manual"))
    return watch.builds(view(spark, d, "file_events").where("kind = 'removed'").select(F.col("user_id").alias("run"), "path"), runs)


@query("SELECT event_id, path FROM file_events WHERE NOT starts_with(path, '/click/') AND path <> '/click' AND NOT contains(path, '/u1/') AND NOT regexp_matches(path, '/f4[0-9]$')")
def ignored_changes(spark, d):
    return watch.not_ignored(view(spark, d, "file_events"), "/click", ("/u1/",), ("/f4[0-9]$",)).select("event_id", "path")


@query("SELECT path, CASE max(CASE kind WHEN 'removed' THEN 2 WHEN 'context' THEN 1 ELSE 0 END) WHEN 2 THEN 'missing' WHEN 1 THEN 'context' ELSE 'file' END AS kind FROM file_events GROUP BY path")
def watch_targets(spark, d):
    kind = F.expr("CASE kind WHEN 'removed' THEN 'missing' WHEN 'context' THEN 'context' ELSE 'file' END")
    return watch.watch_targets(view(spark, d, "file_events").select("path", kind.alias("kind")))


_LISTED = "SELECT path, max(event_id) AS mtime, CAST(count(*) AS BIGINT) AS size FROM file_events WHERE {} GROUP BY path"


@query(f"""
WITH b AS ({_LISTED.format("kind <> 'context'")}), n AS ({_LISTED.format("kind <> 'removed'")})
SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM b FULL JOIN n ON b.path = n.path
WHERE n.path IS NULL OR b.mtime IS DISTINCT FROM n.mtime OR b.size IS DISTINCT FROM n.size""")
def polled_changes(spark, d):
    e = view(spark, d, "file_events")
    listed = lambda what: e.where(what).groupBy("path").agg(F.max("event_id").alias("mtime"), F.count("*").alias("size"))
    return watch.poll_diff(listed("kind != 'context'"), listed("kind != 'removed'"))


@query("""SELECT DISTINCT user_id AS owner FROM file_events WHERE user_id NOT IN
  (SELECT user_id FROM file_events WHERE path IN (SELECT path FROM file_events WHERE kind = 'removed' AND value > 90))""")
def reusable_records(spark, d):
    e = view(spark, d, "file_events")
    return watch.reusable(e.select(F.col("user_id").alias("owner"), "path"), e.where("kind = 'removed' AND value > 90").select("path"))


@query("""
WITH a AS (SELECT p_partkey AS module, p_size AS graph, p_name AS ids FROM part WHERE p_size <> 3), b AS (SELECT p_partkey AS module, CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS graph, CASE WHEN p_size = 9 THEN 'x' ELSE p_name END AS ids FROM part)
SELECT b.module, coalesce(a.graph = b.graph, FALSE) AS graph_ok, coalesce(a.graph = b.graph AND a.ids = b.ids, FALSE) AS codegen_ok FROM b LEFT JOIN a USING (module)""")
def memo_validity(spark, d):
    p = _parts(spark, d, F.col("p_size").alias("graph"), F.col("p_name").alias("ids"))
    new = p.withColumns({"graph": F.when(F.col("graph") == 7, 70).otherwise(F.col("graph")), "ids": F.when(F.col("graph") == 9, "x").otherwise(F.col("ids"))})
    return incremental.memo_validity(p.where("graph != 3"), new)


@query("""
SELECT coalesce(s_suppkey, c_custkey) AS name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey IS DISTINCT FROM c_nationkey""")
def guard_failures(spark, d):
    was = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("value"))
    return incremental.guard_failures(was, table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("value")))


@query("""
WITH h AS (SELECT p_partkey AS module, sha256(p_name) AS hash FROM part)
SELECT chunk, sha256(string_agg(hash, ',' ORDER BY module)) AS etag FROM (SELECT DISTINCT l_suppkey AS chunk, l_partkey AS module FROM lineitem) JOIN h USING (module) GROUP BY chunk""")
def asset_etags(spark, d):
    return incremental.asset_etags(_members(spark, d), _parts(spark, d, F.sha2("p_name", 256).alias("hash")))


@query("""
WITH t AS (SELECT origin, '[' || string_agg('{"seq":' || conn_id || ',"target":' || coalesce('"' || p_name || '"', 'null') || '}', ',' ORDER BY conn_id, p_name NULLS FIRST) || ']' AS j
  FROM (SELECT l_orderkey * 100 + l_linenumber AS conn_id, l_orderkey AS origin, l_partkey AS module FROM lineitem) LEFT JOIN part ON p_partkey = module AND p_size > 25 GROUP BY origin)
SELECT o_orderkey AS module, sha256('{"identity":' || o_orderkey || ',"source_hash":"' || o_orderpriority || '","error":null,"used":"' || o_orderstatus || '","id":' ||
  coalesce('"' || p_name || '"', 'null') || ',"targets":' || coalesce(j, 'null') || '}') AS hash
FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND p_size > 25 LEFT JOIN t ON origin = o_orderkey""")
def module_hashes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("module"), F.col("o_orderkey").alias("identity"), F.col("o_orderpriority").alias("source_hash"), F.lit(None).cast("string").alias("error"), F.col("o_orderstatus").alias("used"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("dst"))
    return incremental.module_hashes(o, e, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("module"), F.col("p_name").alias("id")))


@query(f"SELECT p_partkey AS module, {_fnv_sql('p_name')} AS hash FROM part")
def stable_hash(spark, d):
    return _parts(spark, d, hashing.fnv64("p_name").alias("hash"))


@query("""
WITH RECURSIVE w AS (SELECT l_partkey AS src, min(l_suppkey) AS dst FROM lineitem GROUP BY l_partkey),
r AS (SELECT src AS root, dst AS node FROM w UNION SELECT root, dst FROM r JOIN w ON src = node) SELECT root AS node FROM r WHERE root = node""")
def wait_cycles(spark, d):
    return reachability.waits_in_cycle(table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src")).agg(F.min("l_suppkey").alias("dst")))


@query("""
WITH g AS (SELECT DISTINCT c_nationkey AS "group", o_orderkey AS chunk FROM orders JOIN customer ON c_custkey = o_custkey), n AS (SELECT o_orderkey AS source, -o_orderkey AS chunk FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM g UNION SELECT g."group", n.chunk FROM g JOIN n ON n.source = g.chunk""")
def inherited_groups(spark, d):
    o = table(spark, d, "orders")
    groups = o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("group"), F.col("o_orderkey").alias("chunk")).distinct()
    return chunks.inherit_groups(groups, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source"), (-F.col("o_orderkey")).alias("chunk")))


@query(f"SELECT * FROM {_MEMBERS} WHERE module % 5 <> 0 UNION SELECT 0, p_partkey FROM part WHERE p_size = 1 AND p_partkey % 5 <> 0")
def membership_edits(spark, d):
    joined = chunks.connect(_members(spark, d), _entries(spark, d).select(F.lit(0).cast("long").alias("chunk"), "module"))
    return chunks.disconnect(joined, joined.where("module % 5 = 0"))


@query("""
SELECT page_id, concat('r/', CAST(page_id % 7 AS VARCHAR)) AS root FROM pages WHERE page_id % 7 < 5 UNION ALL SELECT page_id, 'r' FROM pages WHERE page_id % 7 >= 5""")
def nearest_package(spark, d):
    f = table(spark, d, "pages").select("page_id", F.concat(F.lit("r/"), F.expr("page_id % 7"), F.lit("/src/f"), "page_id").alias("path"))
    roots = spark.createDataFrame([("r", "{}"), *((f"r/{i}", "{}") for i in range(5))], "root string, data string")
    return files.nearest_package(f, roots).join(f, "path").select("page_id", "root")


@query("SELECT p_partkey AS module, concat('javascript/auto|', CASE WHEN p_size > 25 THEN 'a.js!' ELSE '' END, p_name, CASE WHEN p_size % 2 = 0 THEN '?q' ELSE '' END) AS identifier FROM part")
def module_identifiers(spark, d):
    none = F.lit(None).cast("string")
    p = _parts(spark, d, F.lit("javascript/auto").alias("module_type"), F.col("p_name").alias("resource"), F.when(F.col("p_size") % 2 == 0, "?q").alias("query"), none.alias("fragment"),
               F.when(F.col("p_size") > 25, F.array(F.lit("a.js"))).alias("loaders"))
    return p.select("module", naming.module_identifier().alias("identifier"))


@query("SELECT page_id, './' || page_id || '.js' AS request, 'a/' || page_id || '.js' AS path FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, './' || page_id, 'a/' || page_id || '.ts' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, '../a/b/../' || page_id, 'a/' || page_id || '/index.json' FROM pages WHERE page_id % 3 = 2")
def resolved_paths(spark, d):
    p, k = table(spark, d, "pages").select("page_id"), F.col("page_id") % 3
    request = F.when(k == 0, F.concat(F.lit("./"), "page_id", F.lit(".js"))).when(k == 1, F.concat(F.lit("./"), "page_id")).otherwise(F.concat(F.lit("../a/b/../"), "page_id"))
    path = F.concat(F.lit("a/"), "page_id", F.when(k == 0, ".js").when(k == 1, ".ts").otherwise("/index.json"))
    asked = p.select(F.col("page_id").alias("id"), F.lit("a").alias("directory"), request.alias("request"))
    found = files.resolve(asked, p.select(path.alias("path")).union(p.where(k == 1).select(F.concat(F.lit("a/"), "page_id", F.lit(".json")))))
    return asked.join(found, "id").select(F.col("id").alias("page_id"), "request", "path")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM part_edges WHERE dyn = 0),
r(node, depth) USING KEY (node) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 1
  UNION SELECT dst, min(depth) + 1 FROM r JOIN e ON src = node WHERE dst NOT IN (SELECT node FROM recurring.r) GROUP BY dst)
SELECT 'm/' || node || '.js' AS path, CAST(depth AS INTEGER) AS depth, count(dst) AS n FROM r LEFT JOIN e ON src = node GROUP BY node, depth""")
def build_loop(spark, d):
    """Modules whose sources import each other as parts follow each other, from all entries to the end."""
    lists = view(spark, d, "part_edges").where("dyn = 0").groupBy(F.col("src").alias("module")).agg(F.collect_set("dst").alias("to"))
    line = F.transform("to", lambda x: F.concat(F.lit("import './"), x.cast("string"), F.lit("';")))
    sources = _parts(spark, d).join(lists, "module", "left").select(F.concat(F.lit("m/"), "module", F.lit(".js")).alias("path"), F.coalesce(F.array_join(line, "\n"), F.lit("")).alias("source"))
    entries = _entries(spark, d).select(F.col("module").cast("int").alias("entry_index"), F.col("module").cast("string").alias("name"), F.concat(F.lit("./"), "module").alias("request"))
    graph = build(settle(sources), entries, "m")
    out = graph.edges.where("origin IS NOT NULL AND module IS NOT NULL").groupBy(F.col("origin").alias("path")).agg(F.count("*").alias("n"))
    return graph.modules.join(out, "path", "left").select("path", "depth", F.coalesce("n", F.lit(0)).alias("n"))


_TYPES = ["import_side_effect", "import_specifier", "export_specifier", "export_imported", "export_star", "export_expression", "import"]


@query("""
WITH d AS (SELECT l_orderkey AS module, l_linenumber AS seq, l_linenumber AS n, 's' || l_suppkey AS request, '.m' || l_suppkey || '["' || l_returnflag || '-x"]' AS path,
  'm' || l_suppkey AS local, CASE WHEN l_returnflag = 'A' THEN l_returnflag WHEN l_returnflag = 'R' THEN '["' || l_returnflag || '-"]' END AS used,
  CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS target, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS ordinal,
  l_suppkey % 3 AS k, l_linestatus = 'F' AS short FROM lineitem),
v AS (SELECT *, CASE WHEN ordinal IS NULL THEN '_' || request || '__WEBPACK_IMPORTED_MODULE_' || (n - 1) || '__' ELSE '__webpack_concatenation_exports__0[' || ordinal || ']' END AS var,
  ordinal IS NOT NULL OR target IS NOT NULL AS reached FROM d)
SELECT module, seq,
  CASE n WHEN 2 THEN CASE WHEN short THEN 'n: ' ELSE '' END || var || path WHEN 6 THEN '/* harmony default export */ '
    WHEN 7 THEN CASE k WHEN 0 THEN 'Promise.resolve()' WHEN 1 THEN '__webpack_require__.e("c1")' ELSE 'Promise.all([__webpack_require__.e("c1"), __webpack_require__.e("c2")])' END
      || '.then(__webpack_require__.bind(__webpack_require__, ' || target || '))' END AS text,
  CASE n WHEN 1 THEN CASE WHEN ordinal IS NOT NULL THEN '__webpack_concatenation_initializers__0[' || ordinal || ']();' || chr(10) ELSE '/* harmony import */ var ' || var || ' = __webpack_require__(' || target || ');' || chr(10) END
    WHEN 3 THEN '__webpack_require__.d(__webpack_exports__, { ' || used || ': () => (' || local || ') });' || chr(10)
    WHEN 4 THEN CASE WHEN reached THEN '__webpack_require__.d(__webpack_exports__, { ' || used || ': () => (' || var || path || ') });' || chr(10) END
    WHEN 5 THEN CASE WHEN reached THEN '/* harmony reexport (unknown) */ for(const __WEBPACK_IMPORT_KEY__ in ' || var || ') if(__WEBPACK_IMPORT_KEY__ !== "default" && __WEBPACK_IMPORT_KEY__ !== "__esModule") __webpack_require__.d(__webpack_exports__, { [__WEBPACK_IMPORT_KEY__]: () => (' || var || '[__WEBPACK_IMPORT_KEY__]) });' || chr(10) END
    WHEN 6 THEN '__webpack_require__.d(__webpack_exports__, { ' || used || ': () => (' || local || ') });' || chr(10) END AS content,
  CAST(CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 0 WHEN n = 7 THEN CASE WHEN k = 0 THEN 1 ELSE 65 END ELSE 8 END AS INTEGER) AS mask
FROM v""")
def dependency_templates(spark, d):
    c, chunks_of = F.col, F.array(F.lit('"c1"'), F.lit('"c2"'))
    e = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("module"), c("l_linenumber").alias("seq"), F.get(F.array(*map(F.lit, _TYPES)), c("l_linenumber") - 1).alias("dep_type"),
        F.concat(F.lit("./s"), "l_suppkey").alias("request"), c("l_linenumber").alias("source_order"), F.array(F.concat(F.lit("m"), "l_suppkey"), F.concat("l_returnflag", F.lit("-x"))).alias("ids"),
        F.lit("n").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.when(c("l_returnflag") == "A", c("l_returnflag")).when(c("l_returnflag") == "R", "R-").alias("used_name"),
        F.when(c("l_partkey") % 3 != 0, c("l_partkey").cast("string")).alias("target_id"), F.when(c("l_partkey") % 5 == 0, c("l_linenumber")).alias("ordinal"), F.lit(0).alias("scope"),
        F.slice(chunks_of, F.lit(1), (c("l_suppkey") % 3).cast("int")).alias("chunk_ids"), (c("l_linestatus") == "F").alias("shorthand"),
    )
    return templates.dependency_code(e).select("module", "seq", "text", "content", "mask")


@query("""
WITH h(bit, stage, name, requirement) AS (VALUES (8, 0, 'define property getters', 'define_getters'), (64, 1, 'ensure chunk', 'ensure_chunk'), (256, 0, 'get javascript chunk filename', 'chunk_filename'),
  (16, 0, 'hasOwnProperty shorthand', 'has_own'), (32, 0, 'make namespace object', 'make_namespace'), (512, 0, 'module factories add only', 'factories_add_only'), (128, 2, 'require chunk loading', 'ensure_chunk_handlers')),
m AS (SELECT o_orderkey AS entry, 1 << CAST(o_orderkey % 11 AS INTEGER) AS mask FROM orders), a AS (SELECT entry, mask | CASE WHEN mask & 8 <> 0 THEN 16 ELSE 0 END | CASE WHEN mask & 64 <> 0 THEN 912 ELSE 0 END | CASE WHEN mask & 128 <> 0 THEN 784 ELSE 0 END AS mask FROM m)
SELECT entry, CAST(row_number() OVER (PARTITION BY entry ORDER BY stage, name) - 1 AS INTEGER) AS place, 'webpack/runtime/' || name AS name, requirement FROM a JOIN h ON mask & bit <> 0""")
def runtime_helpers(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), F.expr("shiftleft(1, CAST(o_orderkey % 11 AS INT))").alias("mask"))
    return templates.runtime_helpers(m.select("entry", chunks.close_mask(F.col("mask")).alias("mask")))


@query("""
WITH m AS (SELECT root, row_number() OVER (PARTITION BY root ORDER BY n) - 1 AS ordinal FROM (SELECT DISTINCT l_orderkey AS root, l_linenumber AS n FROM lineitem)), s AS (SELECT root, CASE WHEN root % 4 = 1 THEN 1 ELSE 0 END AS k, count(*) AS n FROM m GROUP BY root),
x AS (SELECT root, n, '__webpack_concatenation_exports__' || k AS e, '__webpack_concatenation_initialized__' || k AS d, '__webpack_concatenation_initializers__' || k AS i FROM s)
SELECT root, '// webpack-style concatenated module' || chr(10) || 'var ' || any_value(e) || ' = [' || string_agg(CASE WHEN ordinal = 0 THEN '__webpack_exports__' ELSE '{}' END, ', ' ORDER BY ordinal) || '];' || chr(10)
  || 'var ' || any_value(d) || ' = Array(' || any_value(n) || ').fill(false);' || chr(10) || 'var ' || any_value(i) || ' = Array(' || any_value(n) || ');' || chr(10)
  || string_agg(i || '[' || ordinal || '] = () => {' || chr(10) || '  if (' || d || '[' || ordinal || ']) return ' || e || '[' || ordinal || '];' || chr(10) || '  ' || d || '[' || ordinal || '] = true;' || chr(10)
    || '  return ((__webpack_exports__, __webpack_require__) => {' || chr(10) || 'f(' || ordinal || ')' || chr(10) || '    return __webpack_exports__;' || chr(10) || '  })(' || e || '[' || ordinal || '], __webpack_require__);' || chr(10) || '};' || chr(10), '' ORDER BY ordinal)
  || any_value(i) || '[0]();' || chr(10) AS text FROM m JOIN x USING (root) GROUP BY root""")
def concatenated_code(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("root"), F.col("l_linenumber").alias("n")).distinct()
    m = m.select("root", (F.row_number().over(Window.partitionBy("root").orderBy("n")) - 1).alias("ordinal"))
    taken = F.when(F.col("root") % 4 == 1, F.array(F.lit("x"), F.lit("__webpack_concatenation_initialized__0"))).otherwise(F.array(F.lit("__webpack_concatenation_exports__1"))).alias("identifiers")
    module = F.when(F.col("ordinal") == 0, F.col("root")).otherwise(-F.col("root") * 10 - F.col("ordinal")).alias("module")
    members = m.select("root", "ordinal", module, F.concat(F.lit("f("), "ordinal", F.lit(")")).alias("text"))
    return templates.concatenated(members, templates.scope_suffixes(m.select("root", taken)))


@query("SELECT doc_id AS module, concat(substr(sha256(text), 1, 20), '.txt', CASE WHEN doc_id % 2 = 0 THEN '?v=' || doc_id ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '#top' ELSE '' END) AS url FROM documents WHERE text IS NOT NULL")
def resource_urls(spark, d):
    k = F.col("doc_id")
    url = hashing.content_url(F.col("text"), F.lit(".txt"), F.when(k % 2 == 0, F.concat(F.lit("?v="), k)), F.when(k % 3 == 0, "#top"))
    return table(spark, d, "documents").where("text IS NOT NULL").select(k.alias("module"), url.alias("url"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'asset' ELSE 'javascript' END AS module_type, CASE page_id % 4 WHEN 0 THEN 'J' WHEN 1 THEN 'A' ELSE 'S' END || page_id AS code FROM pages")
def typed_generation(spark, d):
    types, id_ = ModuleTypes(), F.col("page_id")
    for kind, mark in (("json", "J"), ("asset", "A"), ("javascript", "S")):
        types.register(kind, lambda m: m, lambda m, mark=mark: m.withColumn("code", F.concat(F.lit(mark), "page_id")))
    types.rule("json", lambda path: path.endswith(".json"))
    types.rule("asset", lambda path: path.rlike(r"\.(png|svg)$"))
    types.default("javascript")
    path = F.concat(id_, F.when(id_ % 4 == 0, ".json").when(id_ % 4 == 1, ".png").otherwise(".js"))
    return types.generate(table(spark, d, "pages").select("page_id", types.type_of(path).alias("module_type")))


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS entry, p_partkey AS chunk FROM part WHERE p_size = 1
  UNION SELECT entry, dst FROM t JOIN part_edges ON src = chunk WHERE dyn = 1 AND src % 3 = 0) SELECT * FROM t""")
def runtime_tree(spark, d):
    children = view(spark, d, "part_edges").where("dyn = 1 AND src % 3 = 0")
    return chunks.runtime_tree(_entries(spark, d).select(F.col("module").alias("entry")), children)


@query(f"""
WITH a AS (SELECT s_suppkey AS chunk, s_name AS name FROM supplier), x AS (SELECT -p_partkey AS chunk, regexp_replace(CASE WHEN p_partkey % 9 = 0 AND s_name IS NOT NULL THEN s_name ELSE p_name END, '[^A-Za-z0-9]', '_', 'g') AS short,
  'async:k' || p_partkey AS "full" FROM part LEFT JOIN supplier ON s_suppkey = p_partkey),
n AS (SELECT *, count(*) OVER (PARTITION BY short) = 1 AND short NOT IN (SELECT name FROM a) AS alone FROM x),
b AS (SELECT *, CASE WHEN alone THEN short ELSE concat(short, '-', substr({_fnv_sql('"full"')}, 11, 6)) END AS base FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY base <> short, short, "full", chunk) - 2 AS k FROM b)
SELECT chunk, name AS id, CAST(NULL AS BIGINT) AS number FROM a UNION ALL SELECT chunk, CASE WHEN k < 0 THEN base ELSE concat(base, '-', CAST(k AS VARCHAR)) END, NULL FROM r""")
def chunk_ids(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chunk"), F.col("s_name").alias("name"))
    p = _parts(spark, d, "p_name").join(s, F.col("module") == F.col("chunk"), "left")
    name = F.when((F.col("module") % 9 == 0) & F.col("name").isNotNull(), F.col("name")).otherwise(F.col("p_name"))
    return naming.chunk_ids(s, p.select((-F.col("module")).alias("chunk"), name.alias("name"), F.concat(F.lit("k"), "module").alias("key")))
