"""Scalars over paths, identifiers and assets, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes up to which an asset is put inline, and extensions in the order they are tried.
INLINE_BYTES = 8096
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".json"]


def normalize_path(path: Column) -> Column:
    """Without ``.``, empty and resolved ``..`` components; ``..`` above the root stays out, above a relative start in."""
    rooted = F.startswith(path, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        can = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(up & can, F.slice(acc, 1, F.size(acc) - 1))
            .when(up & rooted, acc)
            .otherwise(F.array_append(acc, part))
        )

    # element_at fails on empty arrays in ANSI mode, so a mark stands below all components
    parts = F.aggregate(F.split(path, "/"), F.array(F.lit("..")), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.slice(parts, 2, 1 << 20), "/"))


def module_type(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) == "json", "json").otherwise("javascript/auto")


def asset_kind(content: Column) -> Column:
    return F.when(F.octet_length(content) <= INLINE_BYTES, "asset/inline").otherwise("asset/resource")


#: Media types by extension.
MEDIA = {"css": "text/css", "gif": "image/gif", "html": "text/html", "jpg": "image/jpeg", "js": "text/javascript", "json": "application/json", "png": "image/png", "svg": "image/svg+xml", "txt": "text/plain", "woff2": "font/woff2"}


def data_uri(path: Column, content: Column) -> Column:
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    found = F.try_element_at(media, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return F.concat(F.lit("data:"), F.coalesce(found, F.lit("application/octet-stream")), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\\r\\n]", ""))


def sanitize_identifier(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(value, r"^(\./)+", ""), "[^A-Za-z0-9]", "_")
    return F.when(plain == "", "module").when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def is_identifier(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z")


def json_quote(value: Column) -> Column:
    """The value as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def property_access(value: Column) -> Column:
    return F.when(is_identifier(value), F.concat(F.lit("."), value)).otherwise(F.concat(F.lit("["), json_quote(value), F.lit("]")))


def property_name(value: Column) -> Column:
    return F.when(is_identifier(value), value).otherwise(F.concat(F.lit("["), json_quote(value), F.lit("]")))


def import_variable(request: Column, order: Column) -> Column:
    """The name that an imported module gets in a source; orders count from one, a null or 0 is the first."""
    index = F.greatest(F.coalesce(order, F.lit(0)) - 1, F.lit(0)).cast("string")
    return F.concat(F.lit("_"), sanitize_identifier(request), F.lit("__WEBPACK_IMPORTED_MODULE_"), index, F.lit("__"))


def json_keys(text: Column) -> Column:
    """Keys of a JSON object behind an optional byte order mark; null where it isn't one."""
    return F.json_object_keys(F.regexp_replace(text, "^﻿", ""))


def glob_regex(pattern: str) -> str:
    """A pattern of side-effect metadata as a regular expression: bare names fit in any directory."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern if "/" in pattern else "**/" + pattern)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^(?:\\./)?" + "".join(known.get(p, re.escape(p)) for p in parts) + r"\z"


def free_suffix(taken: Column, prefix: str) -> Column:
    """The least n for which prefix + n is not in an array: at most as many are taken as the array holds."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), _numbers(taken, prefix)))


def _numbers(taken: Column, prefix: str) -> Column:
    """The numbers behind the prefix, as they would be written."""
    behind = F.transform(F.filter(taken, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.substring(x, len(prefix) + 1, 1 << 30))
    return F.transform(F.filter(behind, lambda x: x.rlike(r"^(0|[1-9][0-9]{0,8})\z")), lambda x: x.cast("int"))
