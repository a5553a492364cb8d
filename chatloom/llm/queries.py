"""The registered queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, byte_bpe, collocations, decontaminate, hard_negatives, html_extract, lm_score, pii, quality, simhash, substring_dedup, token_store, url_filter
from .common import new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_store.write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), lambda: token_store.word_encoder(words), vocabulary=49_408, end_id=2)
    return token_store.digests(token_store.read(spark, manifest))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans("base"), 256).alias("base_sha256"), pii.joined_spans("spans").alias("spans"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


ORACLES["op6_lm_score"] = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
pairs AS (SELECT r, p, w, lag(w) OVER (PARTITION BY r ORDER BY p) AS v FROM words),
one AS (SELECT w, count(*) AS n FROM words GROUP BY 1),
two AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY 1, 2),
total AS (SELECT count(*) AS n FROM words),
scored AS (SELECT r, CASE WHEN two.n >= 2 THEN ln(two.n / ctx.n) WHEN pairs.v IS NOT NULL THEN ln(0.4) + ln(one.n / total.n) ELSE ln(one.n / total.n) END AS s,
                  pairs.v IS NOT NULL AND two.n < 2 AS off
           FROM pairs JOIN one ON one.w = pairs.w LEFT JOIN two ON two.v = pairs.v AND two.w = pairs.w LEFT JOIN one ctx ON ctx.w = pairs.v, total),
sums AS (SELECT r, sum(s) AS s, count(*) FILTER (off) AS off FROM scored GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(off, 0) AS BIGINT) AS n_backed_off, round(s / len(ws), 6) AS score
FROM docs LEFT JOIN sums USING (r)
"""


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decode=True))


@query
def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url_key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


ORACLES["op9_url_reputation"] = r"""
WITH rest AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS r FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
marks AS (SELECT CAST(doc_id AS VARCHAR) AS url_key, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
          FROM labels WHERE doc_id IS NOT NULL AND ((quality = 0 OR toxic = 1) IS NOT NULL) GROUP BY 1),
counted AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', '') AS site, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k
            FROM urls LEFT JOIN marks ON url_key = regexp_extract(path, '^/[^/]*/([0-9]+)', 1) GROUP BY 1),
long AS (SELECT *, regexp_matches(site, '(^|\.)(ac|co|com|edu|gob|go|gov|gv|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$') AS two, regexp_matches(site, '^[0-9]+(\.[0-9]+){3}$|^\[') AS address FROM counted),
hosts AS (SELECT host, n, k, CASE WHEN address THEN site WHEN two THEN regexp_extract(site, '[^.]*\.[^.]*$') ELSE regexp_extract(site, '[^.]*$') END AS suffix,
                 CASE WHEN address THEN site WHEN two THEN regexp_extract(site, '([^.]*\.)?[^.]*\.[^.]*$') ELSE regexp_extract(site, '([^.]*\.)?[^.]*$') END AS domain FROM long),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
levels AS (SELECT 's' AS l, n, k FROM suffixes UNION ALL SELECT 'd', n, k FROM domains UNION ALL SELECT 'h', n, k FROM hosts),
sums AS (SELECT l, count(*) FILTER (n > 0) AS g, sum(n) AS n, sum(k) AS k, sum(k * k / n) FILTER (n > 0) AS q FROM levels GROUP BY 1),
spreads AS (SELECT l, k / n AS p, q / n - (k / n) * (k / n) AS spread, (k / n) * (1 - k / n) * g / n AS chance FROM sums WHERE n > 0),
fitted AS (SELECT l, p, CASE WHEN spread <= chance THEN 10000.0 ELSE least(10000.0, greatest(1.0, (p * (1 - p) - spread) / (spread - chance))) END AS m FROM spreads),
one AS (SELECT max(m) FILTER (l = 's') AS sm, max(m) FILTER (l = 'd') AS dm, max(m) FILTER (l = 'h') AS hm, max(p) FILTER (l = 'h') AS p FROM fitted),
s AS (SELECT suffix, (k + sm * p) / (n + sm) AS mean FROM suffixes, one),
d AS (SELECT domain, (k + dm * s.mean) / (n + dm) AS mean FROM domains JOIN s USING (suffix), one),
h AS (SELECT host, (k + hm * d.mean) / (n + hm) AS mean, n + hm AS size FROM hosts JOIN d USING (domain), one),
judged AS (SELECT u.*, coalesce(h.mean - 1.645 * sqrt(h.mean * (1 - h.mean) / (h.size + 1)) > 0.5, false) AS blocked,
  CASE WHEN host = 'www.example.com' AND starts_with(path, '/en/') OR ends_with(host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls u LEFT JOIN h USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


@query
def op11_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
parts AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
pieces AS (SELECT row_number() OVER () AS i, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM parts),
words AS (SELECT i, lang, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM pieces),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY 1),
one AS (SELECT lang, [w] AS ws, count(*) AS a FROM words GROUP BY lang, w HAVING count(*) >= 100),
seen AS (SELECT words.*, one.a IS NOT NULL AS ok FROM words LEFT JOIN one ON one.lang = words.lang AND one.ws = [words.w]),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5,
                ok AS k1, lead(ok, 1) OVER o AS k2, lead(ok, 2) OVER o AS k3, lead(ok, 3) OVER o AS k4, lead(ok, 4) OVER o AS k5 FROM seen WINDOW o AS (PARTITION BY i ORDER BY pos)),
f AS (SELECT lang, [w1, w2] AS ws, count(*) AS a FROM runs WHERE k1 AND k2 GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE k1 AND k2 AND k3 GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE k1 AND k2 AND k3 AND k4 GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM runs WHERE k1 AND k2 AND k3 AND k4 AND k5 GROUP BY ALL HAVING count(*) >= 100),
known AS (SELECT * FROM one UNION ALL SELECT * FROM f),
cut AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM f),
scored AS (SELECT c.lang, c.ws, c.a, c.k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
           FROM cut c JOIN known l ON l.lang = c.lang AND l.ws = c.ws[:c.k] JOIN known r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:] JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_at AS (SELECT lang, ws, a, unnest(range(2, len(ws))) AS m FROM f),
inner_of AS (SELECT lang, ws[s:s + m - 1] AS ws, max(a) AS most FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS s FROM inner_at) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.ws, ' ') AS phrase FROM best LEFT JOIN inner_of q ON q.lang = best.lang AND q.ws = best.ws WHERE q.most IS NULL OR 100 * q.most < 100 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
