"""Plans over word lists, backups and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import SECRETS
from tessera.operators import backup, notes, vocab
from tessera.plans.catalog import query
from tessera.session import table

_ENTRIES = """SELECT c_custkey AS id, 'term' AS kind, lower(c_name) AS term, CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END AS target, c_mktsegment AS translation, concat('  ', c_name, ' ') AS surface,
CASE WHEN c_nationkey % 5 = 0 THEN 'Noun' WHEN c_nationkey % 5 = 1 THEN 'verbs' ELSE '' END AS pos, CAST(c_nationkey * 100 AS BIGINT) AS updated, CAST(c_nationkey AS VARCHAR(9)) AS doc_id, c_acctbal AS created FROM customer"""


def _entries(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_ENTRIES.replace("FROM customer", "FROM {c}"), c=table(s, d, "customer"))


@query(f"""SELECT id, pos, row_number() OVER (ORDER BY created DESC, term) AS place FROM (SELECT id, created, term, CASE pos WHEN '' THEN '' WHEN 'Noun' THEN 'noun' ELSE 'other' END AS pos FROM ({_ENTRIES}) WHERE doc_id = '7' AND (contains(term, '1') OR contains(lower(translation), '1'))) ORDER BY place""")
def word_list(s: SparkSession, d: str) -> DataFrame:
    rows = vocab.view(_entries(s, d), " 1 ", "added", "7")
    w = Window.orderBy(F.desc("created"), "term")  # one document's words
    return rows.select("id", vocab.normal_pos(F.col("pos")).alias("pos"), F.row_number().over(w).cast("long").alias("place")).orderBy("place")


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (updated > 1200) AS changed FROM ({_ENTRIES}) GROUP BY 1")
def words_by_document(s: SparkSession, d: str) -> DataFrame:
    return _entries(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("updated") > 1200).alias("changed"))


_FILE = """SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN o_custkey + 100000 END AS id, CASE o_orderkey % 11 WHEN 4 THEN ' ' ELSE concat(c_name, CASE o_orderkey % 5 WHEN 2 THEN ' b' ELSE '' END) END AS surface,
CASE o_orderkey % 13 WHEN 6 THEN '' WHEN 7 THEN 'ko' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END END AS target, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE 'other' END AS translation,
CASE o_orderkey % 7 WHEN 3 THEN NULL WHEN 5 THEN 99999 ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS updated, CASE WHEN o_orderkey % 17 = 9 THEN 'quote' END AS flag FROM orders JOIN customer ON o_custkey = c_custkey"""


def _file(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_FILE.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}"), o=table(s, d, "orders"), c=table(s, d, "customer"))


_PLAN = f"""WITH e AS ({_ENTRIES}), f AS (SELECT *, trim(lower(surface)) AS term, CASE WHEN flag IS NOT NULL THEN flag WHEN trim(surface) = '' THEN 'term' WHEN target = '' THEN 'target' END AS bad0 FROM ({_FILE})),
g AS (SELECT f.*, i.id AS iid, k.id AS kid, coalesce(i.id, k.id) AS hit FROM f LEFT JOIN e i ON f.id = i.id AND f.target = i.target AND bad0 IS NULL LEFT JOIN e k ON k.term = f.term AND k.target = f.target AND bad0 IS NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY bad0 IS NULL, coalesce('i' || hit, 'k' || term || '|' || target) ORDER BY row) AS n1, row_number() OVER (PARTITION BY bad0 IS NULL, term, target ORDER BY row) AS n2 FROM g),
p AS (SELECT h.*, coalesce(bad0, CASE WHEN n1 > 1 OR n2 > 1 OR kid <> hit THEN 'dup' END) AS bad, x.updated AS et, x.id AS eid, x.term <> h.term OR x.translation <> h.translation OR trim(x.surface) <> trim(h.surface) AS differs FROM h LEFT JOIN e x ON x.id = hit),
o AS (SELECT *, CASE WHEN bad IS NOT NULL THEN 'reject' WHEN eid IS NULL THEN 'add' WHEN NOT differs OR (updated <= 2000 AND updated < et) THEN 'same' WHEN updated <= 2000 THEN 'change' ELSE 'conflict' END AS op FROM p),
plan AS (SELECT row, op, coalesce(bad, CASE WHEN op = 'conflict' THEN CASE WHEN updated IS NULL THEN 'time' ELSE 'future' END END) AS reason, CASE WHEN bad IS NULL THEN eid END AS id FROM o)"""


@query(_PLAN + " SELECT * FROM plan")
def import_plan(s: SparkSession, d: str) -> DataFrame:
    return vocab.import_plan(_file(s, d).withColumn("surface", F.col("surface")), _entries(s, d), 2000)


@query(_PLAN + " SELECT row, CASE op WHEN 'conflict' THEN 'change' ELSE op END AS op, id FROM plan WHERE op IN ('add', 'change') OR (op = 'conflict' AND id % 2 = 0)")
def import_choices(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d)
    return vocab.to_apply(vocab.import_plan(_file(s, d), e, 2000), e.where("id % 2 = 0")).select("row", "op", "id")


@query(f"""WITH t AS (SELECT *, CASE WHEN id % 3 = 0 THEN translation ELSE ' ' END AS tr FROM ({_ENTRIES})), c AS (SELECT * FROM t WHERE trim(tr) = '' AND target <> 'en'), l AS (SELECT doc_id, target FROM c ORDER BY created, id LIMIT 1)
SELECT id FROM c WHERE (doc_id, target) IN (SELECT (doc_id, target) FROM l) ORDER BY created, id LIMIT 20""")
def next_request(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d).withColumn("translation", F.when(F.col("id") % 3 == 0, F.col("translation")).otherwise(" ")).withColumn("src", F.lit("en"))
    return vocab.next_request(e).select("id")


@query(f"""SELECT -3 AS "at", '#separator:tab' AS value UNION ALL SELECT -2, '#html:false' UNION ALL SELECT -1, '#columns:Front' || chr(9) || 'Back' || chr(9) || 'Context' || chr(9) || 'Note' || chr(9) || 'Source'
UNION ALL SELECT id, concat_ws(chr(9), trim(surface), translation || CASE WHEN pos = '' THEN '' ELSE ' — ' || pos END, term, '', 'Book ' || doc_id || CASE WHEN doc_id = '0' THEN '' ELSE ' p.' || doc_id END) FROM ({_ENTRIES})""")
def card_deck(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d).select("id", "surface", "term", "translation", F.col("pos").alias("gloss"), F.concat("term", F.lit("\n")).alias("context"), F.lit("\t").alias("note"), F.concat(F.lit("Book "), "doc_id").alias("title"), F.col("doc_id").cast("int").alias("page"))
    return vocab.deck(e)


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN epoch_ms(o_orderdate) WHEN 2 THEN epoch_ms(o_orderdate) - 3600000 END AS file_ms, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN epoch_ms(o_orderdate) WHEN 2 THEN epoch_ms(o_orderdate) - 3600000 ELSE epoch_ms(o_orderdate) END AS any_ms,
CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN greatest(0, (epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) // 1000) END AS wait, octet_length(encode(o_orderpriority || 'é中')) AS bytes FROM orders""")
def times_read(s: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis("o_orderdate").cast("string")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, F.lpad(ms, 13, "0")).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+01:00"))).when(k == 3, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    w = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), t.alias("t"), w.alias("w"), F.octet_length(F.concat("o_orderpriority", F.lit("é中"))).cast("long").alias("bytes"))
    return x.select("k", vocab.file_time(F.col("t")).alias("file_ms"), vocab.ms_of(F.col("t")).alias("any_ms"), vocab.retry_after(F.col("w"), F.lit("1995-01-01").cast("timestamp")).alias("wait"), "bytes")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'known ' || c_nationkey WHEN c_custkey % 4 = 1 AND c_nationkey < 12 THEN 'known ' || c_nationkey WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS back FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_nationkey >= 12)
UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey % 4 = 0 AND c_nationkey >= 12""")
def filled_backs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    cards = c.select(F.col("c_custkey").alias("id"), "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, " ").otherwise(F.col("c_mktsegment")).alias("back"))
    answers = table(s, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("known "), F.col("n_nationkey").cast("string")).alias("back"))
    return vocab.fill_back(cards, answers, "c_nationkey").select("id", "back")


@query("""SELECT doc_id, sha256(doc_id || chr(1) || trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS front, 0 AS reps FROM documents""")
def new_cards(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", vocab.sentence_card(F.col("text"), F.col("lang"), F.col("doc_id"), F.current_timestamp()).alias("c"))
    return x.select("doc_id", "c.id", "c.front", "c.sm2.reps")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE [p_brand, 'b'] END AS ids, CASE WHEN p_size % 2 = 0 THEN 'https://x.org/?q={q}&s=' || p_size ELSE 'https://x.org/{q}' END AS first, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END AS n FROM part""")
def search_links(s: SparkSession, d: str) -> DataFrame:
    """Links of which some are no good, and one put in the place of the one with its id."""
    link = lambda i, n, u: F.struct(i.alias("id"), F.lit(n).alias("name"), u.alias("url"))
    p = table(s, d, "part")
    own = F.concat(F.lit("https://x.org/?q={q}&s="), F.col("p_size").cast("string"))
    links = F.array(link(F.col("p_brand"), "one", F.lit("https://x.org/{q}")), link(F.lit("bad"), "two", F.lit("http://x.org/{q}")), link(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("b"), "three", F.lit("https://y.org/{q}")), link(F.lit("none"), " ", F.lit("https://z.org/{q}")))
    e = p.select("p_partkey", "p_brand", "p_size", vocab.effective_links(links).alias("l"))
    target = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("new")
    e = e.withColumn("u", vocab.upsert_link(F.col("l"), link(target, "four", own)))
    return e.select("p_partkey", F.col("l.id").alias("ids"), F.get(F.col("u"), F.lit(0))["url"].alias("first"), F.size("u").alias("n"))


_SECRET_SQL = "|".join(p.replace("'", "''") for p in SECRETS)


@query(f"""WITH r AS (SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'ui.theme' WHEN 1 THEN 'ai.key' ELSE 'tts.rate' END AS key, CASE WHEN c_nationkey % 4 = 0 THEN 'use sk-0123456789abcdefgh' || c_custkey ELSE c_mktsegment END AS value FROM customer)
SELECT id, key, value FROM r WHERE key IN ('ui.theme', 'tts.rate') AND NOT regexp_matches(value, '{_SECRET_SQL}')""")
def settings_for_backup(s: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    r = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(n % 3 == 0, "ui.theme").when(n % 3 == 1, "ai.key").otherwise("tts.rate").alias("key"), F.when(n % 4 == 0, F.concat(F.lit("use sk-0123456789abcdefgh"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_mktsegment")).alias("value"))
    return backup.settings_for_backup(r, ["ui.theme", "tts.rate"])


@query("""SELECT p_partkey, list_sort(list_distinct(['h' || p_size || CASE WHEN p_size % 2 = 0 THEN ':n9' ELSE '' END, 'h' || p_size]) || CASE WHEN p_size = 9 OR p_partkey % 3 = 0 THEN [] ELSE CASE WHEN p_size % 50 = 9 AND p_size % 2 = 0 THEN [] ELSE ['h' || p_size || ':n' || (p_size % 50)] END END) AS hashes,
p_partkey % 50 = 0 OR p_partkey % 3 = 0 OR p_size % 50 = p_partkey % 50 AS same FROM part WHERE p_size % 50 <> 9 AND p_size % 50 <> 0""")
def file_matches(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").where("p_size % 50 <> 9 AND p_size % 50 <> 0")
    h = F.concat(F.lit("h"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ":n9").otherwise(""))
    pages = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size") % 50)
    got = backup.hash_candidates(h, pages)
    return p.select("p_partkey", F.array_sort(got).alias("hashes"), backup.same_pdf(pages, (F.col("p_partkey") % 50).cast("int")).alias("same"))


@query("""SELECT o_orderkey, coalesce(s_suppkey + 1000000, o_custkey) AS doc, coalesce(s_suppkey + 1000000, o_custkey) || '#' || o_orderkey || '#x' AS question, 'term|en|' || coalesce(s_suppkey + 1000000, o_custkey) || '|' || o_shippriority AS cache FROM (SELECT *, 0 AS o_shippriority FROM orders) LEFT JOIN supplier ON s_suppkey = o_custkey""")
def remapped_ids(s: SparkSession, d: str) -> DataFrame:
    """Documents that have another id here: in columns, in composite ids (by joins), in keys (by a map of a few)."""
    k = F.col("o_custkey").cast("string")
    ids = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("old"), (F.col("s_suppkey") + 1000000).cast("string").alias("new"))
    r = table(s, d, "orders").select("o_orderkey", k.alias("doc"), F.concat(k, F.lit("#"), F.col("o_orderkey").cast("string"), F.lit("#x")).alias("question"), k.alias("old"), F.concat(F.lit("term|en|"), k, F.lit("|0")).alias("cache"))
    r = backup.remapped(r, ids, {"doc": "plain", "question": "prefixed"})
    one = F.when(F.col("new").isNotNull(), F.create_map(F.col("old"), F.col("new"))).otherwise(F.create_map().cast("map<string,string>"))
    r = r.join(ids, "old", "left").withColumn("cache", backup.remap_cache_key(F.col("cache"), one))
    return r.select("o_orderkey", F.col("doc").cast("long").alias("doc"), "question", "cache")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k":"[KEY]","n":[1,2]}' WHEN 1 THEN '{"a":{"b":"plain ' || user_id || '"}}' WHEN 2 THEN '"not json [KEY]"' ELSE '[' || user_id || ',null,true]' END AS value FROM events WHERE user_id IS NOT NULL""")
def redacted_json(s: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    secret = "sk-0123456789abcdefghij"
    raw = F.when(k == 0, F.lit(f'{{"k": "{secret}", "n": [1, 2], "{secret}": 3}}')).when(k == 1, F.concat(F.lit('{"a": {"b": "plain '), u, F.lit('"}}'))).when(k == 2, F.lit(f"not json {secret}")).otherwise(F.concat(F.lit("["), u, F.lit(", null, true]")))
    return table(s, d, "events").where("user_id IS NOT NULL").select("event_id", backup.redacted_json(raw).alias("value"))


@query("""SELECT c_custkey, c_nationkey % 5 IN (1, 2) AS number_ok, c_nationkey % 5 NOT IN (4) AS free_ok, CASE WHEN c_nationkey >= 3 THEN c_nationkey END AS pages, CASE c_nationkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'kept' ELSE 'default' END AS setting FROM customer""")
def cleaned_records(s: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    v = F.when(n % 5 == 0, '"x"').when(n % 5 == 1, "1").when(n % 5 == 2, "2.5").when(n % 5 == 3, "null").otherwise("true")
    pages = F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(".0"))).otherwise(n.cast("string"))
    values = F.when(n % 3 == 0, F.create_map(F.lit("ui.theme"), F.lit("old"))).when(n % 3 == 1, F.create_map(F.lit("ui.theme"), F.lit("kept"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    c = table(s, d, "customer").select("c_custkey", F.parse_json(v).alias("v"), F.parse_json(F.lit("7")).alias("seven"), F.parse_json(F.lit("null")).alias("none"), backup.natural(pages, 3).cast("int").alias("pages"), values.alias("values"))
    return c.select("c_custkey", backup.setting_ok(F.col("v"), F.col("seven")).alias("number_ok"), backup.setting_ok(F.col("v"), F.col("none")).alias("free_ok"), "pages", backup.setting(c, "ui.theme", "default", {"old": "new"}).alias("setting"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN o_orderdate WHEN o_orderstatus = 'O' THEN TIMESTAMP '1996-01-01' END AS opened, o_orderstatus = 'O' OR o_orderdate <= TIMESTAMP '1996-01-01' AS place_counts FROM orders""")
def document_times(s: SparkSession, d: str) -> DataFrame:
    opened, counts = backup.doc_times(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp"), F.col("o_orderstatus") == "O")
    return table(s, d, "orders").select("o_orderkey", opened.cast("timestamp_ntz").alias("opened"), counts.alias("place_counts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['a', 'i1', 'i2', 'z'] ELSE ['a', 'i1_', 'i1', 'z'] END AS ids FROM part""")
def cleaned_links(s: SparkSession, d: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    ids = F.array(F.lit("a"), F.when(even, "").otherwise("a"), F.when(even, 'q"x').otherwise("i1"), F.lit("z"))
    links = F.transform(ids, lambda x: F.struct(x.alias("id"), F.col("p_brand").alias("name")))
    return table(s, d, "part").select("p_partkey", backup.clean_links(links)["id"].alias("ids"))


_NOTES = """SELECT l_suppkey AS doc, l_orderkey AS g, l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 300 AS INTEGER) AS page, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 1 THEN ' ' ELSE l_returnflag END AS note, concat(l_returnflag, CAST(l_linenumber AS VARCHAR(9))) AS quote,
CASE WHEN l_linestatus = 'F' THEN 'red' ELSE 'blue' END AS color FROM lineitem"""


def _notes(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_NOTES.replace("FROM lineitem", "FROM {l}"), l=table(s, d, "lineitem")).withColumn("group", F.col("g") * 10 + 2)


_ROWS = f"""n AS (SELECT *, g * 10 + 2 AS "group" FROM ({_NOTES})), r AS (SELECT doc, "group", arg_min(id, (CASE WHEN id = "group" THEN 0 ELSE 1 END, pos, id, page, note)) AS id, arg_min(page, (CASE WHEN id = "group" THEN 0 ELSE 1 END, pos, id, page, note)) AS page,
arg_min(note, (CASE WHEN id = "group" THEN 0 ELSE 1 END, pos, id, page, note)) AS lead_note, coalesce(arg_min(note, (pos, id, note)) FILTER (trim(note) <> ''), '') AS another, string_agg(quote, ' ' ORDER BY pos, id, quote) AS quote, count(*) AS pieces FROM n GROUP BY 1, 2)"""


@query(f"""WITH {_ROWS} SELECT doc, "group", id, page, CASE WHEN trim(lead_note) <> '' THEN lead_note ELSE another END AS note, quote, pieces FROM r""")
def note_rows(s: SparkSession, d: str) -> DataFrame:
    return notes.rows_of(_notes(s, d))


@query(f"""WITH {_ROWS}, x AS (SELECT doc, "group", page, CASE WHEN trim(lead_note) <> '' THEN lead_note ELSE another END AS note FROM r) SELECT doc, "group" FROM x WHERE trim(note) <> '' AND page BETWEEN 10 AND 120 AND (doc NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) OR "group" % 70 = 2)""")
def note_filter(s: SparkSession, d: str) -> DataFrame:
    rows = notes.rows_of(_notes(s, d))
    live = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc"))
    return notes.filtered(rows, noted=True, lost=rows.where(F.col("group") % 70 == 2), live=live, pages=(10, 120)).select("doc", "group")


@query(f"""WITH {_ROWS}, h AS (SELECT DISTINCT s_suppkey AS doc, f FROM supplier, unnest([20, 90, 200]) u(f) WHERE s_suppkey % 2 = 0),
x AS (SELECT r.doc, "group", page, (SELECT count(*) FROM h WHERE h.doc = r.doc AND f <= page) - 1 AS chapter, (SELECT max(f) FROM h WHERE h.doc = r.doc AND f <= page) AS head, s_name AS title FROM r LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = r.doc)
SELECT doc, "group", title, title IS NULL AS gone, chapter, CAST(row_number() OVER (PARTITION BY doc ORDER BY coalesce(head, page), chapter < 0, page, "group") AS INTEGER) AS place FROM x""")
def note_books(s: SparkSession, d: str) -> DataFrame:
    sup = table(s, d, "supplier")
    chapters = sup.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("doc"), F.explode(F.array(F.lit(20), F.lit(90), F.lit(200))).alias("start"))
    docs = sup.where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc"), F.col("s_name").alias("title"))
    return notes.books(notes.rows_of(_notes(s, d)), docs, chapters).select("doc", "group", "title", "gone", "chapter", "place")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'moved' ELSE CAST(o_custkey AS VARCHAR) END AS doc FROM orders""")
def notes_reattached(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderstatus").alias("file_hash"))
    live = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("doc"))
    return notes.reattach(r, live, "F", "moved").select("o_orderkey", "doc")


@query("""WITH p AS (SELECT conv_id AS k, turn AS seq, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2)),
j AS (SELECT k, seq, greatest(5, base) AS s, least(900, base + length(text)) AS e FROM p WHERE 5 < base + length(text) AND 900 > base), c AS (SELECT k, seq, e, unnest(generate_series(s, e - 1, 100)) AS lo FROM j WHERE s < e)
SELECT k, seq, k || ':' || row_number() OVER (PARTITION BY k ORDER BY seq, lo) AS id, k || ':1' AS "group", lo, least(e, lo + 100) AS hi, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY seq, lo) = 1 THEN 'mine' ELSE '' END AS note FROM c""")
def selection_pieces(s: SparkSession, d: str) -> DataFrame:
    """Conversations as pages of paragraphs; on each a selection given backwards, cut into pieces and made notes of."""
    c = table(s, d, "conversations").groupBy(F.col("conv_id").alias("k"), F.col("turn").alias("seq")).agg(F.min("text").alias("text"))
    sel = c.select("k").distinct().select("k", F.col("k").alias("selection"), F.lit(900).alias("lo"), F.lit(5).alias("hi"))
    cut = notes.pieces(sel, notes.placed(c, "k"), "k", 100)
    rec = notes.note_records(cut, F.lit("mine"))
    return rec.join(cut.select("selection", "piece", "seq"), ["selection", "piece"]).select(F.col("selection").alias("k"), "seq", "id", "group", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "note")


@query("""WITH x AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority AS h, o_orderkey % 7 AS para FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_custkey AS k, o_orderpriority AS h, o_orderkey % 7 AS para FROM orders WHERE o_orderstatus <> 'F')
SELECT x.k, x.id, arg_min(p.para, (CASE WHEN p.para = x.para THEN 0 ELSE 1 END, p.para)) AS now FROM x LEFT JOIN p ON x.k = p.k AND x.h = p.h GROUP BY 1, 2""")
def summaries_relocated(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("hash"), (F.col("o_orderkey") % 7).alias("para"), "o_orderstatus")
    return notes.relocate(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "k")


@query("""SELECT o_custkey AS k, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5, CASE o_orderstatus WHEN 'O' THEN o_orderkey % 12 WHEN 'P' THEN -1 ELSE 2147483647 END, o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders""")
def summaries_in_order(s: SparkSession, d: str) -> DataFrame:
    page = F.col("o_orderkey") % 5
    para = F.when(F.col("o_orderstatus") == "O", F.concat(page.cast("string"), F.lit(":p"), (F.col("o_orderkey") % 12).cast("string")))
    order = notes.reading_order(page, para, F.col("o_orderdate"), F.col("o_orderstatus") == "P")
    return table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order, "o_orderkey")).alias("place"))


@query("""SELECT doc_id, n >= 2 AND c >= 60 AND source <> 'web' AS summary, c >= 60 AND source <> 'web' AND NOT regexp_matches(text, '(?i)\\b(pmid|pmcid|doi)\\b') AS quiz FROM (SELECT doc_id, text, source, length(text) AS c, len(regexp_extract_all(text, '[.!?](\\s|$)')) AS n FROM documents)""")
def paragraph_uses(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", "text", F.when(F.col("source") == "web", "table").alias("kind"), F.length("text").alias("c"), F.regexp_count("text", F.lit(r"[.!?](\s|$)")).alias("n"))
    return x.select("doc_id", notes.eligible(F.col("kind"), F.col("n"), F.col("c")).alias("summary"), notes.quizzable(F.col("kind"), F.col("c"), F.col("text")).alias("quiz"))
