"""One query per operator, over its whole table, and the SQL that DuckDB can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import piece_codec
from .embedding_neardup import vector_duplicates
from .language_id import identify
from .lm_scoring import lattice_scores
from .minhash_neardup import near_duplicates
from .packing import pieces, place
from .quality_rules import quality_rules
from .storage import table
from .substring_dedup import remove_repeats
from .toxicity import classify
from .url_filter import judge


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS p FROM w
), g AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 19], ' ')) AS h FROM starts
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM g) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS out FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM later) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(out), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(
    list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(out, []), i)), lambda i: words[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query
def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op5_minhash_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[p:p + 4], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT node, b FROM reach JOIN links ON other = a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL["op3_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), lines AS (
  SELECT doc_id, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
), real AS (
  SELECT doc_id, source, text, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY doc_id
), common AS (
  SELECT source, norm, count(DISTINCT text) AS k, min(doc_id) AS first FROM real GROUP BY source, norm HAVING k > 100
), hosts AS (
  SELECT source, count(DISTINCT text) AS texts FROM real GROUP BY source
), gone AS (
  SELECT doc_id, sum(n) AS n_line_words FROM real JOIN common USING (source, norm) JOIN hosts USING (source)
  WHERE 100 * k > 5 * texts AND doc_id <> first GROUP BY doc_id
), windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM d WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS k FROM windows) WHERE k > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM twice) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(n_line_words, 0) AS BIGINT) AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words > 0 AND 100 * (n_words - n_line_words) < 30 * n_words AS depleted FROM c
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM f
"""


@query
def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op4_embedding_neardup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT node, b FROM reach JOIN links ON other = a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON node = v.vec_id
"""


@query
def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: All that the labels tell: junk, which is toxic or not, then toxicity.
TOXICITY = {"junk": "quality = 0", "toxic": "toxic = 1"}


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXICITY)


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
