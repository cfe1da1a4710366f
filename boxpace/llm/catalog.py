"""Queries of the corpus operators, with production parameters, and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256_hex, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

BPE_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"
# Fixed values of the url contract: (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark, sf_dir):
    """Token count and digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers as P

    from .bpe import encode
    enc = encode(table(spark, sf_dir, "documents"), P.path(BPE_FILE), P.PATTERN, with_decoded=True)
    return enc.select("doc_id", "n_tokens", sha256_hex(F.col("token_ids")).alias("ids_sha256"),
                      sha256_hex(F.col("decoded")).alias("decoded_sha256"))


@query
def op2_url_filter(spark, sf_dir):
    """Host, path, winning rule and verdict of every page's url."""
    from .urls import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_quality_grade(spark, sf_dir):
    """Expected grade, tail probability and selection of every document.

    The given ratings become three grades: low quality, good but toxic, good.
    """
    from .ordinal import fit, rate
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, F.col("quality") * (2 - F.col("toxic")), 3)
    return rate(docs, model)


@query
def op4_license_scan(spark, sf_dir):
    """Every line that words a license, with its template, size reduction and differences."""
    from .licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op5_mix(spark, sf_dir):
    """Documents replicated to square-root shares of their sources, shuffled globally."""
    from .mixing import mix, temperature_targets
    docs = table(spark, sf_dir, "documents")
    return mix(docs, temperature_targets(docs, 0.5))


@query
def op6_line_dedup(spark, sf_dir):
    """Lines, dropped lines and digest of the kept text of every document."""
    from .lines import dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


@query
def op7_toxicity(spark, sf_dir):
    """Toxicity score of every document by a machine fitted to the labels that are not held out."""
    from .toxicity import fit, score
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_jaccard_join(spark, sf_dir):
    """Set size and group of every document by links of 80 % or more."""
    from .jaccard import jaccard_groups
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("class_id", "group_id")


@query
def op9_exact_dedup(spark, sf_dir):
    """Row that stays, group size and text digest of every document."""
    from .blocks import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark, sf_dir):
    """Word, symbol and repetition figures and the verdict of the line-first rules for every document."""
    from .quality import quality
    return quality(table(spark, sf_dir, "documents")).drop("clean_text")


@query
def op11_centroids(spark, sf_dir):
    """Cluster, squared distance and inertia of every usable vector after ten rounds around eight centroids."""
    from .centroids import cluster
    out = cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)
    digest = sha256_hex(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","))
    return out.withColumn("centroid_sha256", digest).drop("centroid")


@query
def op12_packing(spark, sf_dir):
    """Place of every piece of every document in sequences of at most 2,048 tokens, balanced by attention cost."""
    import public_tokenizers as P

    from .packing import pack
    pieces = pack(table(spark, sf_dir, "documents"), P.path(TOKENIZER_FILE), P.PATTERN, end_id=1, max_tokens=2048)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op13_periodic(spark, sf_dir):
    """Count, greatest run and digests of the periodic runs of every document, and of the text without repeats."""
    from .periodic import periodic_runs, plant_runs
    out = periodic_runs(plant_runs(table(spark, sf_dir, "documents")), min_words=24, min_repeats=3)
    rows = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listing = F.array_join(F.transform(rows, lambda r: F.concat(r, F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      sha256_hex(listing).alias("runs_sha256"), sha256_hex(F.col("collapsed")).alias("collapsed_sha256"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLES["op2_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, """ + _LOWER.format("regexp_extract(rest, '^[^/?#]*')") + r""" AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


# Independent literals of the line rules, so the comparison would show a wrong list.
LLM_ORACLES["op10_quality"] = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM hit) GROUP BY rid),
ln AS (SELECT rid, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
       FROM (SELECT rid, unnest(ls) AS l FROM w)),
lf AS (SELECT rid, l, n,
         length(regexp_replace(l, '[^#*$%&<>]', '', 'g')) AS sy, length(regexp_replace(l, '[^!]', '', 'g')) AS ex,
         length(regexp_replace(l, '[^|»›·•]', '', 'g')) AS se, length(regexp_replace(l, '[^.!?。！？؟।…]', '', 'g')) AS en FROM ln),
lb AS (SELECT rid, n, (n >= 3 AND en = 0) OR (sy >= 3 AND 2 * sy > n) OR (ex >= 3 AND ex >= n) OR (se >= 3 AND 4 * se >= n)
         OR regexp_matches(l, '(?i)all rights reserved|accept cookies|cookie policy|enable javascript|javascript is disabled|privacy policy|terms of service|terms of use|subscribe to our newsletter|share on facebook|back to top|skip to content|lorem ipsum') AS bad FROM lf),
lo AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, coalesce(sum(n) FILTER (bad), 0) AS lost FROM lb GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(ws) AS base_failed,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_bad, 0) AS BIGINT) AS n_bad_lines,
  CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words,
  NOT (len(ws) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(ws)) AND 100 * coalesce(lost, 0) <= 50 * len(ws) AS kept
FROM w LEFT JOIN rep USING (rid) LEFT JOIN lo USING (rid)"""

LLM_ORACLES["op6_line_dedup"] = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, """ + _LOWER.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')") + r""" AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND k.doc_id <> f.last_doc) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (f.key IS NULL OR k.doc_id = f.last_doc), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id"""

LLM_ORACLES["op9_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


def _centroid_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Every round spelled out as two table expressions: the nearest centroid of each vector, the floors of the means."""
    near = """n{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT rid, c, CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM v, c{r}) GROUP BY rid)"""
    move = """c{s} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(means.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS m FROM (
      SELECT c, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
      FROM (SELECT n{r}.c, unnest(range(1, {last})) AS i, unnest(v.x) AS e FROM n{r} JOIN v USING (rid)) GROUP BY c, i)
    GROUP BY c) means ON c{r}.c = means.c)"""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), x) - 1 AS INTEGER) AS c, x AS m FROM v
  ORDER BY c LIMIT {k})"""]
    for r in range(rounds):
        steps += [near.format(r=r), move.format(r=r, s=r + 1, last=dims + 1)]
    steps.append(near.format(r=rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, n.c AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.m, ',')) AS centroid_sha256
FROM n{rounds} n JOIN v USING (rid) JOIN c{rounds} z ON z.c = n.c"""


LLM_ORACLES["op11_centroids"] = _centroid_sql()
