"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import _common as C
from .decontamination import decontaminate
from .html_extraction import html_extraction
from .license_scan import license_scan, oracle
from .piece_codec import encode_decode
from .quality import quality
from .simhash_dedup import simhash_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(C.documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(C.documents(spark, sf_dir))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(C.documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(C.documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_license_scan, op4_toxicity, op5_decontamination, op6_sentencepiece, op7_simhash_dedup, op8_suffix_dedup, op9_quality, op10_html_extraction)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_BENCH = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLES = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM d WHERE len(w) >= 13),
x AS (SELECT rid, doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
c AS (SELECT DISTINCT rid, pos + k AS pos FROM x JOIN f USING (h), range(13) r(k) WHERE doc_id > least),
u AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM u ANTI JOIN c USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
    "op3_license_scan": oracle(),
    "op5_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_BENCH} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_BENCH} AS w FROM benchmark),
i AS (SELECT item, least(10, len(w)) AS n, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[pos:pos + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS pos FROM i)),
dw AS (SELECT rid, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS t FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
m AS (SELECT rid, dw.n, pos, item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
h AS (SELECT rid, count(DISTINCT pos + k) AS n_hit FROM m, range(10) r(k) WHERE k < n GROUP BY rid),
g AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN g USING (rid)""",
}
