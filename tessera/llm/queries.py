"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.hosts import ADDRESSES, TAIL


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repeats import measure_repeats

    return measure_repeats(read(spark, sf_dir, "documents"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"), words=3, most=3)


def op6_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_online

    return pack_online(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, last_id=2)


def op10_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row of the packed matrix: its documents and their starts, cumulative lengths, and CRC-32s of ids and positions."""
    import public_tokenizers

    from tessera.llm.packing import pack_matrix

    rows = pack_matrix(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, last_id=2)
    return rows.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_digest

    return mix_digest(read(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import neighbours

    return neighbours(read(spark, sf_dir, "embeddings"), every=50, k=5).drop("digits")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hosts import judge

    return judge(read(spark, sf_dir, "pages")).drop("host_bound")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.syncmers import fingerprint_digest

    return fingerprint_digest(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.audit import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them."""
    import public_tokenizers

    from tessera.llm.bpe import encode

    rows = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _up(members: str, above: str, name: str) -> str:
    """SQL of one level of the host reputation, going up: the strength that siblings share, and the level above."""
    on, group = (f"USING ({above})", f"GROUP BY {above}") if above else ("ON true", "")
    cols = f"{above}, " if above else ""
    return f"""p{name} AS (SELECT {cols}sum(n) AS total, sum(bad) AS total_bad FROM {members} {group}),
j{name} AS (SELECT n, bad, total, total_bad / total AS p, 1 - n / total AS rest FROM {members} JOIN p{name} {on} WHERE n > 0),
k{name} AS (SELECT greatest(0.5, least(1000.0, CAST(count(*) FILTER (rest > 0) AS DOUBLE), coalesce(CASE WHEN sum(n * (bad / n - p) ** 2) > sum(p * (1 - p) * rest) THEN sum(p * (1 - p) * rest * greatest(n - 1, 0.0)) / (sum(n * (bad / n - p) ** 2) - sum(p * (1 - p) * rest)) - 1 END, 1000.0))) AS k FROM j{name}),
u{name} AS (SELECT {cols}sum(n * (k + 1) / (n + k)) AS n, sum(CASE WHEN n > 0 THEN n * (k + 1) / (n + k) * bad / n ELSE 0.0 END) AS bad FROM {members}, k{name} {group})"""


def _down(members: str, keys: str, above: str, on: str, k: str, name: str) -> str:
    """SQL of one level, going down: each member's mean and variance, with the doubt about the level above."""
    return f"""{name} AS (SELECT *, m * (1 - m) / (n + k + 1) + (k / (n + k)) ** 2 * above_v AS v, n + above_seen AS seen FROM (SELECT {keys}, g.n, g.bad, {k}.k, (g.bad + a.m * {k}.k) / (g.n + {k}.k) AS m, a.v AS above_v, a.seen AS above_seen FROM {members} g JOIN {above} a ON {on}, {k}))"""


SQL = {
    "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op7_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' ELSE 'block' END AS ruled FROM r),
b AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS bad FROM v GROUP BY 1, 2),
c AS (SELECT host, n, bad, CASE WHEN address THEN '#' ELSE regexp_extract(name, '(?:^|\\.)({TAIL})$', 1) END AS suffix, CASE WHEN address THEN name ELSE regexp_extract(name, '((?:[^.]*\\.)?(?:{TAIL}))$', 1) END AS domain FROM (SELECT *, regexp_matches(name, '{ADDRESSES}') AS address FROM b)),
{_up("c", "suffix, domain", "3")},
{_up("u3", "suffix", "2")},
{_up("u2", "", "1")},
r0 AS (SELECT m, m * (1 - m) / (n + 3) AS v, 0.0 AS seen FROM (SELECT n, (bad + 1) / (n + 2) AS m FROM u1)),
{_down("u2", "g.suffix", "r0", "true", "k1", "l1")},
{_down("u3", "g.suffix, g.domain", "l1", "a.suffix = g.suffix", "k2", "l2")},
{_down("c", "g.suffix, g.domain, g.host", "l2", "a.suffix = g.suffix AND a.domain = g.domain", "k3", "l3")}
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN l3.m - 1.64 * sqrt(l3.v) > 0.5 AND l3.seen >= 3 THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN l3 ON l3.host = v.host""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) e, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT c.*, filter_order, step, fails[strpos('ABCDE', substr(filter_order, step, 1))] AS own,
  len(list_filter(generate_series(1, step - 1), lambda i: fails[strpos('ABCDE', substr(filter_order, i, 1))])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS many
  FROM c, x, (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS step)),
r AS (SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY 1, 2, 3)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM r""",
}
