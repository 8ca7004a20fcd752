"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import centroids, extraction, mixing, ngram_join, packing, quality, reputation, sharding, substrings, syncmers, tokenfile, toxicity, whitening
from tidewatch.llm.common import table


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages: a page's url ends in the number of the document it shows; it turned out badly if that
    document is labelled as of low quality or toxic."""
    number = F.regexp_extract("url", r"^[^:]*://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1).try_cast("long")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return table(spark, sf_dir, "pages").select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")


def op6_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, max(level) OVER () * w) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id % {mixing.SALT}, d.doc_id) AS rank, count(*) OVER (PARTITION BY d.source) AS documents FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE documents - rank // 2 + 1 END AS nth FROM r)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * least(floor(nth * rate + {mixing.offset(mixing.SEED)}::DOUBLE) - floor((nth - 1) * rate + {mixing.offset(mixing.SEED)}::DOUBLE), ceil(rate)))::BIGINT AS taken FROM p
"""

_SUFFIX = "CASE WHEN len(parts) >= 3 AND len(parts[-1]) = 2 AND parts[-2] IN (" + ", ".join(f"'{x}'" for x in reputation.SECOND_LEVEL) + ") THEN 2 ELSE 1 END"


def _level(units: str, out: str, keys: str) -> str:
    """SQL for one level: the prior strength from the table `units` (n, k, prior), then the posterior means."""
    return f"""
{out}_s AS (SELECT CASE WHEN sum(n - 1) > 0 THEN (sum(n * pow(k::DOUBLE / n - prior, 2) / (prior * (1 - prior))) - count(*)) / sum(n - 1) ELSE 0.001 END AS rho FROM {units} WHERE n > 0),
{out}_m AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(rho, 0.001))) - 1 AS m FROM {out}_s),
{out} AS (SELECT {keys}, n, k, (k + m * prior) / (n + m) AS mean, k + m * prior AS a, n - k + m * (1 - prior) AS b FROM {units}, {out}_m)"""


OP6_SQL = f"""
WITH p0 AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
lab AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels),
o AS (SELECT page_id, max(bad) AS bad FROM pages JOIN lab ON try_cast(regexp_extract(url, '^[^:]*://[^/?#]*/[^/?#]*/([0-9]{{1,18}})', 1) AS BIGINT) = lab.doc_id GROUP BY page_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT host, n, k, parts, {_SUFFIX} AS cut FROM h0),
h AS (SELECT host, n, k, array_to_string(parts[-cut:], '.') AS suffix, array_to_string(parts[-(cut + 1):], '.') AS domain FROM h1),
g AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS prior FROM h),
su AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(prior) AS prior FROM h, g GROUP BY suffix),{_level("su", "s", "suffix")},
du AS (SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.k) AS k, any_value(s.mean) AS prior FROM h JOIN s USING (suffix) GROUP BY h.suffix, h.domain),{_level("du", "d", "suffix, domain")},
hu AS (SELECT h.host, h.n, h.k, d.mean AS prior FROM h JOIN d USING (suffix, domain)),{_level("hu", "post", "host")},
r AS (SELECT p.page_id, p.host, p.path, (SELECT {reputation.LIFT}::DOUBLE * prior / (1 - prior + {reputation.LIFT}::DOUBLE * prior) FROM g) AS threshold, a / (a + b) - {reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower, CASE
  {" ".join(f"WHEN (p.host = '{h}' OR p.host LIKE '%.{h}') AND starts_with(p.path, '{q}') THEN '{h}{q}'" for _, h, q in sorted(reputation.RULES, key=lambda r: (-len(r[1] + r[2]), r)))} END AS rule
  FROM p LEFT JOIN post USING (host))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{q}' THEN '{v}'" for v, h, q in reputation.RULES)} WHEN lower > threshold THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

QUERIES = {"op2_mixing": op2_mixing, "op6_reputation": op6_reputation, "op7_sharding": op7_sharding}
ORACLE = {"op2_mixing": OP2_SQL, "op6_reputation": OP6_SQL}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.train(docs, labels.filter(~held_out))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES |= {"op1_toxicity": op1_toxicity, "op5_quality": op5_quality}


def op4_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(segments).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES |= {"op4_tokenfile": op4_tokenfile, "op10_packing": op10_packing}


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES |= {"op8_syncmers": op8_syncmers, "op9_extraction": op9_extraction}


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

QUERIES |= {"op3_ngram_join": op3_ngram_join}
ORACLE |= {"op3_ngram_join": OP3_SQL}


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - {substrings.LENGTH} + 2)) AS i, unnest(list_transform(range(1, len(ws) - {substrings.LENGTH} + 2), lambda i: array_to_string(ws[i:i + {substrings.LENGTH - 1}], ' '))) AS win FROM d),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM w) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.LENGTH})) AS at FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at) FILTER (WHERE g.at IS NULL) AS kept, count(g.at) AS n_removed FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op11_whitening": op11_whitening}
QUERIES |= {"op12_substrings": op12_substrings}
ORACLE |= {"op12_substrings": OP12_SQL}


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(table(spark, sf_dir, "embeddings"))


def _distance(v: str, c: str) -> str:
    return f"list_sum(list_transform(list_zip({v}, {c}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _nearest(n: int) -> str:
    """SQL for the n-th assignment: vec_id, v, cluster, distance."""
    return f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, min(struct_pack(d := {_distance('x.v', 'c.v')}, j := c.j)) AS b FROM x, c{n} c GROUP BY vec_id)"


def _means(n: int) -> str:
    """SQL for the centroids after the n-th assignment: j, v."""
    return f"""s{n} AS (SELECT b.j AS j, unnest(range(1, {centroids.DIMENSIONS + 1})) AS i, unnest(v) AS y FROM a{n}),
m{n} AS (SELECT j, i, floor(sum(y) / count(*))::BIGINT AS y FROM s{n} GROUP BY j, i),
l{n} AS (SELECT j, list(y ORDER BY i) AS v FROM m{n} GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(l.v, c.v) AS v FROM c{n} c LEFT JOIN l{n} l USING (j))"""


OP13_SQL = f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({centroids.SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v FROM (SELECT v, sha256('{centroids.SEED}:' || vec_id) AS h FROM x ORDER BY h LIMIT {centroids.K})),
{", ".join(f"{_nearest(n)}, {_means(n)}" for n in range(centroids.ROUNDS))},
{_nearest(centroids.ROUNDS)},
z AS (SELECT vec_id, b.j AS j, b.d::BIGINT AS distance FROM a{centroids.ROUNDS})
SELECT vec_id, z.j::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY z.j)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM z JOIN c{centroids.ROUNDS} c ON c.j = z.j
"""

QUERIES |= {"op13_centroids": op13_centroids}
ORACLE |= {"op13_centroids": OP13_SQL}
