"""From modules to output: replacements in sources, module code, chunk assets, their sizes.

A chunk's asset is one text, so assembling it gathers the code of that chunk's modules;
nothing here gathers more than one chunk or one module in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_quote

#: Texts of the output format.
MODULE_HEAD = ': ((__unused_webpack_module, __webpack_exports__, __webpack_require__) => {\n"use strict";\n'
MODULE_TAIL = "\n})"
CHUNK_HEAD = '"use strict";\nexports.id = %1$s;\nexports.ids = [%1$s];\nexports.modules = ({\n'
CHUNK_TAIL = "\n});\n"
JSON_VALUE = "__WEBPACK_JSON_MODULE__"
DEFINE = "__webpack_require__.d(__webpack_exports__, { "
#: The order of what is put before a module's source.
STAGES = {"compatibility": 0, "export": 1, "import": 2, "star_reexport": 3}


def _text(raw: Column) -> Column:
    return F.decode(raw, "utf-8")


def apply_replacements(sources: DataFrame, replacements: DataFrame) -> DataFrame:
    """(module, text): sources(module, source) with the byte ranges of replacements(module, start, end, seq, text) replaced.

    In the order of start, end and seq. Of ranges that overlap each text is put in, and no
    byte of the source comes twice. An insertion has start = end; a null text removes.
    """
    order = Window.partitionBy("module").orderBy("start", "end", "seq")
    done = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = replacements.withColumn("done", done).groupBy("module").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "seq", "done", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"),
        F.max("end").alias("last"),
    )
    raw = F.encode(F.col("source"), "utf-8")
    joined = sources.select("module", "source", raw.alias("raw")).join(parts, "module", "left")

    def piece(r: Column) -> Column:
        kept = F.substring(F.col("raw"), (r["done"] + 1).cast("int"), F.greatest(r["start"] - r["done"], F.lit(0)).cast("int"))
        return F.concat(_text(kept), r["text"])

    tail = _text(F.substring(F.col("raw"), (F.col("last") + 1).cast("int"), F.octet_length("raw")))
    text = F.when(F.col("parts").isNull(), F.col("source")).otherwise(F.concat(F.array_join(F.transform("parts", piece), ""), tail))
    return joined.select("module", text.alias("text"))


def init_fragments(fragments: DataFrame) -> DataFrame:
    """(module, prefix): the contents of fragments(module, stage, seq, content) by stage, then seq."""
    rank = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    rows = F.array_sort(F.collect_list(F.struct(rank[F.col("stage")].alias("rank"), "seq", "content")))
    return fragments.groupBy("module").agg(F.array_join(rows["content"], "").alias("prefix"))


def json_code(text: Column) -> Column:
    """Code of a JSON module: the value, and getters of it and, for an object, of its keys; null where it isn't JSON."""
    value = F.to_json(F.try_parse_json(F.regexp_replace(text, "^﻿", "")))
    keys = F.filter(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), lambda k: k != "default")
    names = F.transform(keys, lambda k: F.concat(F.lit("["), json_quote(k), F.lit(f"]: () => ({JSON_VALUE}["), json_quote(k), F.lit("])")))
    getters = F.array_join(F.concat(F.array(F.lit(f"default: () => ({JSON_VALUE})")), names), ", ")
    code = F.concat(F.lit(f"var {JSON_VALUE} = JSON.parse("), json_quote(value), F.lit(");\n" + DEFINE), getters, F.lit(" });"))
    return F.when(value.isNotNull(), code)


def module_code(code: Column, error: Column) -> Column:
    """A module's code, or for one that failed code that throws its error."""
    return F.when(error.isNotNull(), F.concat(F.lit("throw new Error("), json_quote(error), F.lit(");"))).otherwise(code)


def module_tables(modules: DataFrame) -> DataFrame:
    """(chunk, table): the functions of modules(chunk, id, code), ids being strings, in their order."""
    entry = F.concat(json_quote(F.col("id")), F.lit(MODULE_HEAD), F.col("code"), F.lit(MODULE_TAIL))
    rows = F.array_sort(F.collect_list(F.struct("id", entry.alias("entry"))))
    return modules.groupBy("chunk").agg(F.array_join(rows["entry"], ",\n").alias("table"))


def chunk_assets(modules: DataFrame) -> DataFrame:
    """(filename, content) of each chunk that is loaded on demand."""
    head = F.format_string(CHUNK_HEAD.replace("%1$s", "%s"), json_quote(F.col("chunk")), json_quote(F.col("chunk")))
    return module_tables(modules).select(F.concat("chunk", F.lit(".js")).alias("filename"), F.concat(head, F.col("table"), F.lit(CHUNK_TAIL)).alias("content"))


def filename_map(chunks: DataFrame) -> DataFrame:
    """(app, entries): the id and file of all chunks(app, id, number, filename) of an app, as the inside of an object.

    String ids come first, then numbers, each in their order; of rows with one id the last
    file name counts. An app's map is one text, so its chunks are gathered.
    """
    one = chunks.groupBy("app", "id", "number").agg(F.max("filename").alias("filename"))
    key = F.when(F.col("id").isNull(), F.col("number").cast("string")).otherwise(json_quote(F.col("id")))
    shown = F.concat(key, F.lit(": "), json_quote(F.col("filename")))
    rows = F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("numbered"), F.coalesce("id", F.lit("")).alias("id"), "number", shown.alias("shown"))))
    return one.groupBy("app").agg(F.array_join(rows["shown"], ", ").alias("entries"))


def resource_assets(resources: DataFrame, members: DataFrame) -> DataFrame:
    """(filename, content): of resources(module, filename, content) in any chunk, the first module's of each name."""
    placed = resources.join(members.select("module"), "module", "left_semi")
    return placed.groupBy("filename").agg(F.min_by("content", "module").alias("content"))


def manifest(initial: DataFrame, on_demand: DataFrame, resources: DataFrame) -> DataFrame:
    """(filename, content, kind) of all that is put out."""
    parts = [(initial, "initial"), (on_demand, "async"), (resources, "resource")]
    out = [df.select("filename", "content", F.lit(kind).alias("kind")) for df, kind in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def asset_sizes(assets: DataFrame) -> DataFrame:
    """(filename, size) in bytes."""
    return assets.select("filename", F.octet_length("content").cast("long").alias("size"))
