"""Plans over registered content and the ingest of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest, registry
from tessera.plans.catalog import query
from tessera.session import table
from tessera.sources import records

_Q = """SELECT p_partkey AS seq, concat('n', CAST(p_size AS VARCHAR(9)), CASE WHEN p_partkey % 17 = 3 THEN '-x' ELSE '-q' END, lpad(CAST(p_partkey % 100 AS VARCHAR(9)), 2, '0')) AS id, concat('n', CAST(CASE WHEN p_partkey % 13 = 5 THEN 99 ELSE p_size END AS VARCHAR(9))) AS node,
CASE p_partkey % 4 WHEN 0 THEN 'mcq' WHEN 1 THEN 'ox' WHEN 2 THEN 'short' ELSE CASE WHEN p_partkey % 8 = 3 THEN 'essay' ELSE 'short' END END AS type, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 7 AS VARCHAR(9)) WHEN 1 THEN CASE WHEN p_partkey % 5 = 0 THEN 'yes' ELSE 'true' END ELSE p_name END AS answer,
CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'code' END AS kind, CAST(p_partkey % 5 AS INTEGER) AS difficulty, p_type AS prompt, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE 'why' END AS explanation FROM part"""


def _questions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = s.sql(_Q.replace("FROM part", "FROM {p}"), p=table(s, d, "part")).withColumn("choices", F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).withColumn("terms", F.when(F.col("seq") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))))
    return q, s.range(1, 41).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"))


@query(f"""WITH q AS ({_Q}), r AS (SELECT *, CASE WHEN id NOT LIKE '%-q%' THEN 'id' WHEN split_part(id, '-', 1) <> node THEN 'node' WHEN CAST(substr(node, 2) AS INTEGER) NOT BETWEEN 1 AND 40 THEN 'tree' WHEN type = 'essay' THEN 'type' WHEN type = 'mcq' AND CAST(answer AS INTEGER) > 3 THEN 'answer' WHEN type = 'ox' AND answer <> 'true' THEN 'answer' END AS r FROM (SELECT *, CASE WHEN type = 'mcq' THEN answer END AS m FROM q)),
n AS (SELECT *, row_number() OVER (PARTITION BY id, r IS NULL ORDER BY seq) AS n FROM r)
SELECT seq, coalesce(r, CASE WHEN n > 1 THEN 'duplicate' END) AS reason, list_filter([CASE WHEN kind IS NULL THEN 'kind' END, CASE WHEN difficulty NOT BETWEEN 1 AND 3 THEN 'difficulty' END, CASE WHEN trim(explanation) = '' THEN 'explanation' END, CASE WHEN seq % 10 = 0 THEN 'terms' END], lambda x: x IS NOT NULL) AS missing FROM n""".replace("CAST(answer AS INTEGER) > 3", "CAST(m AS INTEGER) > 3"))
def registered_questions(s: SparkSession, d: str) -> DataFrame:
    return registry.questions(*_questions(s, d)).select("seq", "reason", "missing")


@query("""WITH p AS (SELECT p_partkey AS seq, 'n' || p_size || '-p' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS id, CASE p_partkey % 5 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer' END AS r, p_partkey % 6 = 0 AS bare, p_size FROM part WHERE p_size <= 40),
n AS (SELECT *, row_number() OVER (PARTITION BY id, r IS NULL ORDER BY seq) AS n FROM p) SELECT seq, coalesce(r, CASE WHEN n > 1 THEN 'duplicate' END) AS reason, CASE WHEN bare THEN ['title'] ELSE [] END AS missing FROM n UNION ALL SELECT p_partkey, 'tree', CASE WHEN p_partkey % 6 = 0 THEN ['title'] ELSE [] END FROM part WHERE p_size > 40""")
def registered_practices(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    node = F.concat(F.lit("n"), F.col("p_size").cast("string"))
    p = table(s, d, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(node, F.lit("-p"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")).alias("id"), node.alias("node"), F.when(k == 0, "int").when(k == 1, "number").when(k == 2, "number").when(k == 3, "int").otherwise("string").alias("answer_type"),
        F.when(k == 0, "2.5").when(k == 1, "many").when(k == 2, "2.5").when(k == 3, "7").otherwise("text").alias("answer"), F.when(F.col("p_partkey") % 6 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("task"),
    )
    return registry.practices(p, _questions(s, d)[1]).select("seq", "reason", "missing")


@query("""SELECT 'term-' || lower(replace(p_brand, '#', '-')) AS id, arg_min(p_type, p_partkey) AS def, list_sort(list(DISTINCT 'n' || (p_size % 9))) AS nodes, list_sort(list(DISTINCT p_name[:3])) AS related, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY 1""")
def registered_terms(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("term-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("id"), F.col("p_type").alias("def"), F.array(F.concat(F.lit("n"), (F.col("p_size") % 9).cast("string"))).alias("nodes"), F.array(F.substring("p_name", 1, 3)).alias("related"))
    bad = t.withColumn("id", F.lit("Not a slug"))
    return registry.terms(t.unionByName(bad))


@query("""WITH RECURSIVE t AS (SELECT r_name AS node, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT node FROM t WHERE parent IS NULL AND node IN ('ASIA', 'EUROPE', 'REGION#1', 'REGION#3', 'REGION_1', 'REGION_3') OR node IN (SELECT min(n_name) FROM nation) UNION SELECT t.node FROM t JOIN d ON t.parent = d.node)
SELECT node, count(o_orderkey) AS practices FROM d JOIN customer ON c_name = node JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def scoped_practices(s: SparkSession, d: str) -> DataFrame:
    """What lies under two regions and one nation, where there is any practice (order)."""
    r, n, c = table(s, d, "region"), table(s, d, "nation"), table(s, d, "customer")
    tree = r.select(F.col("r_name").alias("node"), F.lit(None).cast("string").alias("parent")).unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))).unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("node"), F.col("n_name").alias("parent")))
    scope = r.where(F.col("r_name").isin("ASIA", "EUROPE", "REGION#1", "REGION#3", "REGION_1", "REGION_3")).select(F.col("r_name").alias("node")).unionByName(n.agg(F.min("n_name").alias("node")))
    found = registry.in_scope(tree, scope)
    return found.join(c, F.col("node") == F.col("c_name")).join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("node").agg(F.count("*").alias("practices"))


@query("""SELECT c_custkey, 'see **Big(Nation ' || c_nationkey || ')** or **n' || c_nationkey || '(Nation ' || c_nationkey || ')**, not zz nor label' AS linked, 'see Big or n' || c_nationkey || ', not zz [code] `a` b [[x]]' AS plain, 'see Big o…' AS short FROM customer""")
def linked_texts(s: SparkSession, d: str) -> DataFrame:
    i = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    c = table(s, d, "customer").select("c_custkey", i.alias("i"))
    t = F.concat(F.lit("see [["), F.col("i"), F.lit("|Big]] or [["), F.col("i"), F.lit("]], not [[zz]] nor [[yy|label]]"))
    names = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"))
    out = registry.linked(c.withColumn("text", t), names, "c_custkey")
    raw = F.concat(F.lit("see **Big** or [["), F.col("i"), F.lit("]],\nnot [[zz]] ```py\nx = [[1]]\n``` \\`a\\` b `[[x]]`"))
    p = registry.plain(F.replace(raw, F.lit("\\`"), F.lit("\x02")))
    return out.select("c_custkey", F.col("text").alias("linked"), F.replace(p, F.lit("\x02"), F.lit("`")).alias("plain"), registry.plain(raw, 10).alias("short"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"i":' || user_id || ',"t":"see","k":["a","b"]}' WHEN 2 THEN '{"i":7,"k":["a"]}' ELSE '{"i":1,"t":"ok","k":["b","a"]}' END AS value, event_id % 4 IN (1, 2) AS changed FROM events WHERE user_id IS NOT NULL""")
def conformed_answers(s: SparkSession, d: str) -> DataFrame:
    schema = {"type": "OBJECT", "required": ["i", "k"], "properties": {"i": {"type": "integer"}, "t": {"type": "string", "maxLength": 5}, "k": {"type": "array", "minItems": 1, "items": {"type": "string", "enum": ["a", "b"]}}}}
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = F.when(k == 0, '{"i": 1.5, "k": ["a"]}').when(k == 1, F.concat(F.lit('{"i": "'), u, F.lit('", "t": "see https://x.y", "k": ["a", "c", "b"], "z": 1}'))).when(k == 2, '{"i": 7, "t": "too long", "k": ["a"]}').otherwise('{"i": 1, "t": "ok", "k": ["b", "a"]}')
    return table(s, d, "events").where("user_id IS NOT NULL").select("event_id", registry.conformed(schema)(raw).alias("x")).select("event_id", "x.value", "x.changed")


_PAGES = """docs AS (SELECT o_custkey AS k, count(*) AS pages, max(o_orderkey) % 30 AS current FROM orders GROUP BY 1), d AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderstatus AS st FROM orders),
done AS (SELECT k, page FROM d WHERE st IN ('F', 'P') OR page <= 2), failed AS (SELECT k, page FROM d WHERE st = 'O' AND page % 3 = 0)"""


def _pages(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderstatus").alias("st"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    docs = o.groupBy("k").agg(F.count("*").alias("pages"), (F.max("o_orderkey") % 30).alias("current"))
    return docs, o.where("st IN ('F', 'P') OR page <= 2").select("k", "page"), o.where("st = 'O' AND page % 3 = 0").select("k", "page")


@query(f"""WITH {_PAGES} SELECT k, pages, (SELECT min(p) FROM unnest(generate_series(1, pages + 1)) u(p) WHERE p NOT IN (SELECT page FROM done WHERE done.k = docs.k)) AS cursor, pages = (SELECT count(*) FROM done WHERE done.k = docs.k) AND k NOT IN (SELECT k FROM failed) AS complete FROM docs""")
def ingest_cursors(s: SparkSession, d: str) -> DataFrame:
    docs, done, failed = _pages(s, d)
    return ingest.complete(docs, done, failed, "k").select("k", "pages", F.col("cursor").cast("long").alias("cursor"), "complete")


@query(f"""WITH {_PAGES}, seen AS (FROM done UNION FROM failed), c AS (SELECT k, current + o AS page, CASE WHEN abs(o) <= 1 THEN 0 ELSE 1 END AS pr, CASE WHEN o > 0 THEN 2 * o - 1 ELSE -2 * o END AS ord FROM docs, unnest([0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5]) u(o) WHERE current + o BETWEEN 1 AND pages AND (k, current + o) NOT IN (SELECT (k, page) FROM seen)),
g AS (SELECT k, (SELECT min(p) FROM unnest(generate_series(1, pages + 1)) u(p) WHERE (docs.k, p) NOT IN (SELECT (k, page) FROM seen)) AS page, pages FROM docs), a AS (FROM c UNION ALL SELECT k, page, 2, 0 FROM g WHERE page <= pages UNION ALL SELECT k, page, 3, page FROM failed WHERE (k, page) NOT IN (SELECT (k, page) FROM done))
SELECT k, page, pr AS priority FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY pr, ord, page) = 1""")
def next_pages(s: SparkSession, d: str) -> DataFrame:
    return ingest.next_page(*_pages(s, d), "k")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'algo' WHEN c_nationkey % 3 = 1 THEN 'derived' END AS reason, 'd1:' || printf('%08x', CAST((SELECT list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(generate_series(1, length(x)), lambda i: CAST(ascii(x[i]) AS HUGEINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) FROM (SELECT 'h1|co,non|based' AS x)) AS BIGINT)) AS rules FROM customer""")
def resume_reasons(s: SparkSession, d: str) -> DataFrame:
    h = ingest.rules_hash(("non", "co"), ("based",))
    n = F.col("c_nationkey") % 3
    return table(s, d, "customer").select("c_custkey", ingest.resume(F.when(n == 0, 0).otherwise(ingest.ALGO), F.when(n == 2, h).otherwise("d1:old"), h).alias("reason"), F.lit(h).alias("rules"))


@query("""SELECT c_custkey AS k, CASE WHEN c_nationkey % 4 = 0 THEN 'fresh ' || c_name ELSE c_name END AS v FROM customer WHERE NOT (c_nationkey % 4 = 0 AND c_acctbal < 0) AND c_nationkey <> 7""")
def cache_reread(s: SparkSession, d: str) -> DataFrame:
    """A cache with a dropped document (a nation), whose rows of some others are read again and partly gone."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), "c_nationkey", "c_acctbal")
    cache = c.where("c_nationkey <> 7").select("k", "v")
    fresh = c.where("c_acctbal >= 0").select("k", F.concat(F.lit("fresh "), "v").alias("v"))
    return ingest.reread(cache, fresh, c.where("c_nationkey % 4 = 0"), ["k"])


@query("""SELECT event_id, CASE WHEN event_id % 300 < 100 THEN 'hit' WHEN row_number() OVER (PARTITION BY event_id % 300 ORDER BY event_id) = 1 THEN 'send' ELSE 'share' END AS how, event_id % 300 + 2 AS tokens, event_id % 300 + 2 > 200 AS over FROM events""")
def request_job(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "events").select("event_id", F.col("event_id").alias("seq"), (F.col("event_id") % 300).alias("key"))
    n = ingest.request_tokens(F.col("key"), F.lit(2))
    return ingest.job(r, s.range(100).select(F.col("id").alias("key")), "key").select("event_id", "how", n.alias("tokens"), (n > 200).alias("over"))


@query("""WITH f AS (SELECT c_custkey, repeat(c_name, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 40 + c_nationkey END) AS t FROM customer), n AS (SELECT *, length(t) AS n FROM f),
r AS (SELECT *, list_transform(generate_series(0, 3), lambda i: greatest(50, least(n - 60, 50 + CAST(floor((n - 100) * ((i + 0.5) / 4)) AS BIGINT) - 5))) AS m FROM n)
SELECT c_custkey, CASE WHEN n <= 200 THEN 's256:' || sha256(n || ':1;' || t) ELSE 's256:p:' || n || ':' || sha256(n || ':6;' || substr(t, 1, 50) || substr(t, m[1] + 1, 10) || substr(t, m[2] + 1, 10) || substr(t, m[3] + 1, 10) || substr(t, m[4] + 1, 10) || substr(t, n - 49)) END AS name FROM r""")
def file_identities(s: SparkSession, d: str) -> DataFrame:
    times = F.when(F.col("c_custkey") % 2 == 0, 5).otherwise(F.col("c_nationkey") + 40)
    c = table(s, d, "customer").select("c_custkey", F.repeat(F.col("c_name"), times).cast("binary").alias("t"))
    r = ingest.sample_ranges(F.octet_length("t").cast("long"), full=200, edge=50, samples=4, piece=10)
    return c.select("c_custkey", ingest.identity("t", r).alias("name"))


@query("""SELECT l_orderkey AS k, l_linenumber AS seq, l_returnflag AS text, round(l_extendedprice / 7, 2) AS x, round(l_quantity / 3, 2) AS y, round(l_tax, 2) AS size FROM lineitem""")
def stored_pages(s: SparkSession, d: str) -> DataFrame:
    """Lines written as compact pages and read again."""
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("text"), (F.col("l_extendedprice") / 7).alias("x"), (F.col("l_quantity") / 3).alias("y"), F.col("l_tax").alias("size"))
    return ingest.loaded(ingest.stored(x, ["k"]), ["k"])


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS page, CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 > 0 THEN 3 ELSE 0 END AS chars FROM orders), a AS (SELECT *, count(*) FILTER (chars = 0) OVER (PARTITION BY k) AS e, count(*) OVER (PARTITION BY k) AS n FROM p)
SELECT k, page FROM a WHERE chars = 0 AND e * 4 >= n * 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY page) <= 2""")
def image_pages(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("page"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 3 > 0), 3).otherwise(0).alias("chars"))
    return ingest.image_pages(x, "k")


@query("""SELECT c_custkey AS k, 2 AS v, ['scan', 'text', 'garbled'][c_nationkey % 3 + 1] AS verdict, (c_nationkey % 3 = 0 AND c_custkey % 2 = 0) OR (c_nationkey % 3 = 2 AND c_custkey % 4 = 1) AS noticed, c_nationkey % 2 = 0 AS again FROM customer""")
def scan_records(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    v = F.get(F.array(F.lit("scan"), F.lit("text"), F.lit("garbled")), F.col("c_nationkey") % 3)
    before = c.select("k", F.when(F.col("c_custkey") % 2 == 0, "notext").otherwise("garbled").alias("verdict"), (F.col("c_custkey") % 4 != 3).alias("noticed"))
    r = ingest.scan_records(c.select("k", v.alias("verdict")), before, "k", 2)
    return r.join(c.select("k", ingest.needs_scan(F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(2), 2).alias("again")), "k")


@query("""SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS seq, l_shipmode || l_returnflag AS text, round(l_extendedprice, 2) AS x, round(l_quantity, 2) AS y, round(l_tax, 2) AS size FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) WHERE l_orderkey % 5 < 4""")
def pages_of_all_versions(s: SparkSession, d: str) -> DataFrame:
    """Pages of which some were written by the version before, and some by one to come."""
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), F.concat("l_linestatus", "l_returnflag").alias("text"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_tax").alias("size"))
    old, now = ingest.stored_as_before(x.where("k % 5 = 1"), ["k"]), ingest.stored(x.where("k % 5 <> 1"), ["k"])
    pages = now.unionByName(old, allowMissingColumns=True).withColumn("algo", F.when(F.col("k") % 5 == 4, ingest.ALGO + 1).otherwise(F.col("algo")))
    return ingest.loaded(pages, ["k"]).withColumn("seq", F.col("seq").cast("long"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'newer' WHEN page_id % 4 < 3 AND length(html) % 3 > 0 THEN 'ok' ELSE 'not-dump' END AS gate FROM pages""")
def dump_gates(s: SparkSession, d: str) -> DataFrame:
    """First lines of files: dumps of this version and of a later one, other formats, pages that are no dump at all."""
    p = table(s, d, "pages").withColumn("m", F.col("page_id") % 4)
    named = F.when((F.col("m") == 0) | ((F.col("m") < 3) & (F.length("html") % 3 > 0)), records.FORMAT).otherwise(F.substring("url", 1, 9))
    head = F.to_json(F.struct(F.lit("head").alias("t"), named.alias("format"), F.when(F.col("m") == 0, records.VERSION + 1).otherwise(records.VERSION).alias("version")))
    return records.gates(p.select("page_id", F.when(F.col("m") == 3, F.substring("html", 1, 40)).otherwise(head).alias("value"))).select("page_id", "gate")


@query("""SELECT 'ok' AS gate, count(*) AS n, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS known, true AS truncated FROM customer WHERE c_acctbal > 0""")
def dump_preview(s: SparkSession, d: str) -> DataFrame:
    """What a dump that was cut off would bring: customers, some of whom have orders here."""
    c = table(s, d, "customer").where("c_acctbal > 0")
    head = s.range(1).select(F.lit(f'{{"t":"head","format":"{records.FORMAT}","version":{records.VERSION}}}').alias("value"))
    rec = c.select(F.to_json(F.struct(F.lit("rec").alias("t"), F.lit("customer").alias("s"), F.struct("c_custkey", "c_name").alias("v"))).alias("value"))
    return records.preview(head.unionByName(rec), "customer", "c_custkey", table(s, d, "orders").select(F.col("o_custkey").alias("key")))


@query(r"""SELECT 0 AS n, md5(chr(65279) || 'doc_id,source,lang' || chr(13)) AS line UNION ALL SELECT doc_id + 1, md5(doc_id || ',' || coalesce(source, '') || ',' || coalesce(lang, '') || chr(13)) FROM documents""")
def csv_file_lines(s: SparkSession, d: str) -> DataFrame:
    """A CSV file's lines: a mark at its beginning, carriage returns at the ends."""
    x = table(s, d, "documents").select("doc_id", "source", "lang")
    lines = records.csv_text(x)
    n = F.when(F.col("at") == -1, 0).otherwise(F.split("value", ",")[0].try_cast("long") + 1)
    return lines.select(n.alias("n"), F.md5("value").alias("line"))


@query("""WITH m AS (SELECT conv_id, turn, role, text FROM conversations), g AS (SELECT conv_id, list(role || '-' || turn || '.md' ORDER BY turn, role, text) AS names, min(turn) AS t FROM m GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS path, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS place FROM g WHERE conv_id % 3 < 2""")
def manifest_names(s: SparkSession, d: str) -> DataFrame:
    """Manifests of conversations' turns: a bare list, a list under posts, and an object without one."""
    c = table(s, d, "conversations").select("conv_id", F.struct("turn", "role", "text", F.concat_ws("", "role", F.lit("-"), F.col("turn").cast("string"), F.lit(".md")).alias("name")).alias("x"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    k = F.col("conv_id") % 3
    value = F.when(k == 0, F.to_json("names")).when(k == 1, F.to_json(F.struct(F.col("names").alias("posts")))).otherwise(F.to_json(F.struct(F.col("conv_id").alias("other"))))
    return records.manifest(g.select(F.col("conv_id").cast("string").alias("path"), value.alias("value"))).select("path", "name", F.col("place").cast("long").alias("place"))
