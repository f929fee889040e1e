"""Code of dependencies: what replaces their place in a source, what is put before it, what it needs at run time.

Every rule is one expression over a row that holds its dependency's context already, so a
table of dependencies is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import free_suffix, import_variable, json_quote, property_access, property_name
from .chunks import bit
from .render import apply_replacements, init_fragments

#: Texts of the output format.
REQUIRE, EXPORTS, DEFAULT = "__webpack_require__", "__webpack_exports__", "__WEBPACK_DEFAULT_EXPORT__"
NAMESPACE = "__webpack_require__.r(__webpack_exports__);\n"
STAR = (
    '/* harmony reexport (unknown) */ for(const __WEBPACK_IMPORT_KEY__ in %s) if(__WEBPACK_IMPORT_KEY__ !== "default" && __WEBPACK_IMPORT_KEY__ !== "__esModule") '
    "__webpack_require__.d(__webpack_exports__, { [__WEBPACK_IMPORT_KEY__]: () => (%s[__WEBPACK_IMPORT_KEY__]) });\n"
)
SCOPE = "__webpack_concatenation_"
SCOPE_HEAD = (
    "// webpack-style concatenated module\nvar %1$s = [%4$s];\nvar %2$s = Array(%5$d).fill(false);\nvar %3$s = Array(%5$d);\n"
)
SCOPE_MODULE = (
    "%3$s[%4$d] = () => {\n  if (%2$s[%4$d]) return %1$s[%4$d];\n  %2$s[%4$d] = true;\n  return ((__webpack_exports__, __webpack_require__) => {\n"
    "%5$s\n    return __webpack_exports__;\n  })(%1$s[%4$d], __webpack_require__);\n};\n"
)

CONTEXT = ["used_name", "target_id", "ordinal", "scope", "chunk_ids", "shorthand"]


def _scope(name: str, suffix: Column) -> Column:
    return F.concat(F.lit(f"{SCOPE}{name}__"), suffix.cast("string"))


def _path(base: Column, ids: Column) -> Column:
    return F.concat(base, F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<string>")), property_access), ""))


def _getter(name: Column, value: Column) -> Column:
    return F.concat(F.lit(f"{REQUIRE}.d({EXPORTS}, {{ "), property_name(name), F.lit(": () => ("), value, F.lit(") });\n"))


def dependency_code(dependencies: DataFrame) -> DataFrame:
    """(module, seq, start, end, text, stage, content, mask) of each dependency; text or content null where it has none.

    dependencies holds the extractor's dep_type, request, source_order, ids, name, start and end (the bytes to replace)
    with module and seq, and of its context: used_name (what its export is called outside, null if unused), target_id
    (the target's id as JSON, null where it isn't rendered), ordinal (the target's place in the module's own
    concatenation, else null), scope (the number in that concatenation's names), chunk_ids (as JSON, of the group
    that a dynamic import loads; null or empty without one), shorthand. A ``constant`` is replaced by its name.
    A dependency with an error, or of a type not known here, has neither text nor content.
    """
    c = F.col
    kind, inner = c("dep_type"), c("ordinal").isNotNull()
    place = F.concat(F.lit("["), c("ordinal").cast("string"), F.lit("]"))
    target = F.when(inner, F.concat(_scope("exports", c("scope")), place)).otherwise(import_variable(c("request"), c("source_order")))
    use = _path(target, c("ids"))
    local = F.get(c("ids"), F.lit(0))
    bound = F.concat(F.lit(f"{REQUIRE}.bind({REQUIRE}, "), c("target_id"), F.lit(")"))
    loads = F.transform("chunk_ids", lambda x: F.concat(F.lit(f"{REQUIRE}.e("), x, F.lit(")")))
    grouped = F.coalesce(F.size("chunk_ids") > 0, F.lit(False))
    load = F.when(~grouped, "Promise.resolve()").when(F.size("chunk_ids") == 1, F.get(loads, F.lit(0))).otherwise(F.concat(F.lit("Promise.all(["), F.array_join(loads, ", "), F.lit("])")))
    reached = inner | c("target_id").isNotNull()
    text = (
        F.when(kind == "constant", F.coalesce("name", F.lit("")))
        .when(kind == "export_header", "")
        .when((kind == "export_expression") & local.isNotNull(), "/* harmony default export */ ")
        .when(kind == "export_expression", f"/* harmony default export */ const {DEFAULT} = ")
        .when(kind == "import_specifier", F.when(F.coalesce("shorthand", F.lit(False)), F.concat("name", F.lit(": "), use)).otherwise(use))
        .when(kind == "import", F.concat(load, F.lit(".then("), bound, F.lit(")")))
    )
    required = F.concat(F.lit("/* harmony import */ var "), target, F.lit(f" = {REQUIRE}("), c("target_id"), F.lit(");\n"))
    content = (
        F.when((kind == "import_side_effect") & inner, F.concat(_scope("initializers", c("scope")), place, F.lit("();\n")))
        .when(kind == "import_side_effect", required)
        .when((kind == "export_star") & reached, F.format_string(STAR, target, target))
        .when((kind == "export_imported") & reached & c("used_name").isNotNull(), _getter(c("used_name"), use))
        .when((kind == "export_specifier") & c("used_name").isNotNull(), _getter(c("used_name"), local))
        .when((kind == "export_expression") & c("used_name").isNotNull(), _getter(c("used_name"), F.coalesce(local, F.lit(DEFAULT))))
    )
    stage = F.when(kind == "import_side_effect", "import").when(kind == "export_star", "star_reexport").otherwise("export")
    mask = (
        F.when(kind == "import_side_effect", bit("require"))
        .when(kind == "import", F.when(grouped, bit("require") | bit("ensure_chunk")).otherwise(bit("require")))
        .when(kind.isin("export_star", "export_imported", "export_specifier", "export_expression"), bit("define_getters"))
        .otherwise(0)
    )
    return dependencies.select("module", "seq", "start", "end", text.alias("text"), F.when(content.isNotNull(), stage).alias("stage"), content.alias("content"), mask.alias("mask"))


def generated(sources: DataFrame, code: DataFrame) -> DataFrame:
    """(module, text, mask) of sources(module, source, harmony): fragments first, then the source with its replacements.

    code: of :func:`dependency_code`. A harmony module marks its exports as a namespace before all else.
    """
    sources = sources.select("module", "source", F.coalesce("harmony", F.lit(False)).alias("harmony"))
    put = code.where("text IS NOT NULL").select("module", "start", "end", "seq", "text")
    marks = sources.where("harmony").select("module", F.lit("compatibility").alias("stage"), F.lit(-1).alias("seq"), F.lit(NAMESPACE).alias("content"))
    first = init_fragments(marks.unionByName(code.where("content IS NOT NULL").select("module", "stage", "seq", "content")))
    needs = code.groupBy("module").agg(F.bit_or("mask").alias("needs"))
    out = apply_replacements(sources, put).join(first, "module", "left").join(needs, "module", "left").join(sources.select("module", "harmony"), "module")
    mask = F.coalesce("needs", F.lit(0)).bitwiseOR(F.when(F.col("harmony"), bit("make_namespace")).otherwise(0))
    return out.select("module", F.concat(F.coalesce("prefix", F.lit("")), F.col("text")).alias("text"), mask.alias("mask"))


def scope_suffixes(members: DataFrame) -> DataFrame:
    """(root, scope): the least number with which none of a concatenation's three names is an identifier of its members.

    members: (root, identifiers). Only identifiers that look like such a name are gathered.
    """
    names = members.select("root", F.explode_outer("identifiers").alias("name"))
    # all three prefixes are one, so that a number taken by any of them is taken
    number = F.regexp_extract("name", f"^{SCOPE}(?:exports|initialized|initializers)__(0|[1-9][0-9]*)\\z", 1)
    taken = names.select("root", F.when(number != "", number).alias("taken"))
    return taken.groupBy("root").agg(free_suffix(F.collect_set("taken"), "").alias("scope"))


def concatenated(members: DataFrame, scopes: DataFrame) -> DataFrame:
    """(root, text): one module of members(root, module, ordinal, text), each behind a guarded initializer.

    scopes: (root, scope). A concatenation is one text, so its members are gathered.
    """
    rows = F.array_sort(F.collect_list(F.struct("ordinal", F.when(F.col("module") == F.col("root"), EXPORTS).otherwise("{}").alias("start"), "text")))
    parts = members.groupBy("root").agg(rows.alias("parts"), F.max(F.when(F.col("module") == F.col("root"), F.col("ordinal"))).alias("own"))
    parts = parts.join(scopes, "root")
    names = [_scope(x, F.col("scope")) for x in ("exports", "initialized", "initializers")]
    head = F.format_string(SCOPE_HEAD, *names, F.array_join(F.col("parts")["start"], ", "), F.size("parts"))
    each = F.transform("parts", lambda p: F.format_string(SCOPE_MODULE, *names, p["ordinal"], p["text"]))
    last = F.concat(names[2], F.lit("["), F.col("own").cast("string"), F.lit("]();\n"))
    return parts.select("root", F.concat(head, F.array_join(each, ""), last).alias("text"))


#: The run-time helpers' requirement, stage, name and text; {map} and {chunk} stand for the files of all chunks and the entry's id.
NORMAL, BASIC, ATTACH = 0, 1, 2
HELPERS = [
    ("define_getters", NORMAL, "webpack/runtime/define property getters", """__webpack_require__.d = function(exports, definition) {
  for(var key in definition) {
    if(__webpack_require__.o(definition, key) && !__webpack_require__.o(exports, key)) {
      Object.defineProperty(exports, key, { enumerable: true, get: definition[key] });
    }
  }
};
"""),
    ("ensure_chunk", BASIC, "webpack/runtime/ensure chunk", """__webpack_require__.f = {};
__webpack_require__.e = function(chunkId) {
  return Promise.all(Object.keys(__webpack_require__.f).reduce(function(promises, key) {
    __webpack_require__.f[key](chunkId, promises);
    return promises;
  }, []));
};
"""),
    ("chunk_filename", NORMAL, "webpack/runtime/get javascript chunk filename", """__webpack_require__.u = function(chunkId) {
  return ({{map}})[chunkId];
};
"""),
    ("has_own", NORMAL, "webpack/runtime/hasOwnProperty shorthand", """__webpack_require__.o = function(obj, prop) { return Object.prototype.hasOwnProperty.call(obj, prop); };
"""),
    ("make_namespace", NORMAL, "webpack/runtime/make namespace object", """__webpack_require__.r = function(exports) {
  if(typeof Symbol !== "undefined" && Symbol.toStringTag) {
    Object.defineProperty(exports, Symbol.toStringTag, { value: "Module" });
  }
  Object.defineProperty(exports, "__esModule", { value: true });
};
"""),
    ("factories_add_only", NORMAL, "webpack/runtime/module factories add only", """__webpack_require__.m = __webpack_modules__;
"""),
    ("ensure_chunk_handlers", ATTACH, "webpack/runtime/require chunk loading", """var installedChunks = {
  {chunk}: 1
};
var installChunk = function(chunk) {
  var moreModules = chunk.modules, chunkIds = chunk.ids, runtime = chunk.runtime;
  for(var moduleId in moreModules) {
    if(__webpack_require__.o(moreModules, moduleId)) {
      __webpack_require__.m[moduleId] = moreModules[moduleId];
    }
  }
  if(runtime) runtime(__webpack_require__);
  for(var i = 0; i < chunkIds.length; i++) {
    installedChunks[chunkIds[i]] = 1;
  }
};
__webpack_require__.f.require = function(chunkId, promises) {
  if(!installedChunks[chunkId]) {
    var installedChunk = require("./" + __webpack_require__.u(chunkId));
    if(!installedChunks[chunkId]) {
      installChunk(installedChunk);
    }
  }
};
"""),
]


def runtime_helpers(masks: DataFrame) -> DataFrame:
    """(entry, place, name, requirement): the helpers that a closed mask of masks(entry, mask) asks for, by stage, then name."""
    ordered = sorted(HELPERS, key=lambda h: (h[1], h[2]))
    rows = F.array(*[F.struct(F.lit(bit(h[0])).alias("bit"), F.lit(h[2]).alias("name"), F.lit(h[0]).alias("requirement")) for h in ordered])
    asked = F.filter(rows, lambda h: F.col("mask").bitwiseAND(h["bit"]) != 0)
    return masks.select("entry", F.posexplode(asked).alias("place", "h")).select("entry", "place", "h.name", "h.requirement")


def helper_texts(helpers: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, text): all helpers of an entry in their order. entries: (entry, id, files): its chunk's id, and the inside of the map of files."""
    texts = F.create_map(*[F.lit(x) for h in HELPERS for x in (h[0], h[3])])
    rows = F.array_sort(F.collect_list(F.struct("place", texts[F.col("requirement")].alias("text"))))
    text = F.array_join(F.col("rows")["text"], "")
    text = F.replace(F.replace(text, F.lit("{chunk}"), json_quote(F.col("id"))), F.lit("{map}"), F.col("files"))
    return helpers.groupBy("entry").agg(rows.alias("rows")).join(entries, "entry").select("entry", text.alias("text"))
