"""The queries of the training-data operators: thin wrappers that name the tables and derive the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.kneser_ney import scored_documents

    return scored_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_kneser_ney": op1_kneser_ney}
ORACLE: dict[str, str] = {}


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op6_simhash_golay"] = op6_simhash_golay


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.language import VOCABULARY, predicted_documents

    return predicted_documents(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


QUERIES["op10_language"] = op10_language


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES["op9_decontamination"] = op9_decontamination
#: Windows by positions of the unnested words.
ORACLE["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1],' ') AS body FROM (SELECT item_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM b2)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1],' ') AS body FROM (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.body = bw.body AND dw.k = bw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items,
       sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AND 20*coalesce(n_hit,0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.packing import packed_pieces

    return packed_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES["op5_best_fit"] = op5_best_fit


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op4_warc"] = op4_warc
#: Base32 of the digest by way of its bits, five at a time.
ORACLE["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> (15 - 5 * k)) % 32, 1), '' ORDER BY i, k) AS payload_digest
      FROM (SELECT h, i, k, ('0x' || substr(h, 5 * i + 1, 5))::INT AS v FROM x, range(8) AS r(i), range(4) AS s(k)) GROUP BY h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM p JOIN x USING (h) JOIN d USING (h)
"""


URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def op8_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: a page is bad where the label with its number has quality 0."""
    from docraster.llm.reputation import judged

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return judged(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


QUERIES["op8_reputation"] = op8_reputation
#: The same estimates; the tables' hosts have suffixes of one label.
ORACLE["op8_reputation"] = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest,''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest,''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT host, count(quality) AS n, count(*) FILTER (quality = 0) AS bad, string_split(host, '.')[-1] AS suffix,
             array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
lv AS (SELECT 'h' AS l, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0 UNION ALL SELECT 's', n, bad FROM s WHERE n > 0),
m AS (SELECT l, count(*) AS g, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n*n)::DOUBLE AS nn, sum(bad*bad/n::DOUBLE) AS b FROM lv GROUP BY l),
r AS (SELECT l, bad / n AS pr, g, n, bad, (b - n*(bad/n)*(bad/n) - (bad/n)*(1-bad/n)*(g-1)) / nullif((bad/n)*(1-bad/n)*(n - nn/n - (g-1)), 0) AS rho FROM m),
k AS (SELECT l, pr, CASE WHEN g < 2 OR bad = 0 OR bad = n OR coalesce(rho, 0) <= 1.0/10001 THEN 10000 ELSE greatest(1.0, 1/rho - 1) END AS k FROM r),
sp AS (SELECT suffix, (s.bad + k.k * k.pr) / (s.n + k.k) AS prior FROM s, k WHERE k.l = 's'),
dp AS (SELECT domain, suffix, (d.bad + k.k * sp.prior) / (d.n + k.k) AS prior FROM d JOIN sp USING (suffix), k WHERE k.l = 'd'),
hp AS (SELECT host, h.n, k.k, (h.bad + k.k * dp.prior) / (h.n + k.k) AS rate FROM h JOIN dp USING (domain, suffix), k WHERE k.l = 'h'),
hv AS (SELECT host, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > 1.5 * (SELECT sum(bad) / sum(n) FROM s) THEN 'block' ELSE 'allow' END AS own FROM hp),
rules AS (SELECT * FROM (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')) AS t(rule, v)),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p, rules
      WHERE (host = split_part(rule, '/', 1) OR host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, position('/' IN rule))) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, hv.own, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id) LEFT JOIN hv USING (host)
"""


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES["op7_adaptive_scan"] = op7_adaptive_scan


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.toxicity import scored_documents

    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op2_toxicity"] = op2_toxicity


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.quality import scored_documents

    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op3_quality"] = op3_quality


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES["op11_norm_buckets"] = op11_norm_buckets
ORACLE["op11_norm_buckets"] = r"""
WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM k a, k c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def op12_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.codes import compressed, digest, with_label_errors

    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


QUERIES["op12_weighted_lloyd"] = op12_weighted_lloyd


def _lloyd(rounds: int = 4) -> str:
    """The rounds one after another: assignments a<r> with books b<r>, and the books that follow from their means."""
    steps = ["b0 AS MATERIALIZED (SELECT p, i - 1 AS j, x AS c FROM parts WHERE i <= 256)"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, p, any_value(x) AS x, arg_min(j, d * 256 + j) AS j, min(d) AS d FROM (SELECT i, p, x, j, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN b{r} USING (p)) GROUP BY i, p)")
        if r < rounds:
            means = f"SELECT p, j, list(m ORDER BY t) AS c FROM (SELECT p, j, t, floor(sum(x) / count(*)) AS m FROM (SELECT p, j, generate_subscripts(x, 1) AS t, unnest(x) AS x FROM a{r}) GROUP BY p, j, t) GROUP BY p, j"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN ({means}) AS m USING (p, j))")
    return ",\n".join(steps)


ORACLE["op12_weighted_lloyd"] = rf"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS i FROM k),
parts AS MATERIALIZED (SELECT i, p, v[(p * len(v)) // 4 + 1 : ((p + 1) * len(v)) // 4] AS x FROM r, range(4) AS t(p)),
{_lloyd()},
e AS (SELECT i, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN e USING (i), h
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docraster.llm.rules import judged_documents

    return judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op13_quality_rules"] = op13_quality_rules
