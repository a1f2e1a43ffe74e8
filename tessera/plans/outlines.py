"""Plans over outlines, scripts, speech, and checks of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import checks, scripts
from tessera.functions.text import let
from tessera.operators import outline
from tessera.plans.catalog import query
from tessera.session import table

#: Titles by a number, and why each is no entry at its size, in words.
_TITLES = (
    ("Heart Failure", None), ("12", None), ("a.", "noise"), ("It beats.", "sentence"), ("Drugs etc.", None), ("One two. Three", "multi"), ("Price £", "symbol"), ("«Well", "dialog"),
    ("Wait...", None), ("RENAL DISEASE", None), ("The kidney", "weak"), ("— Yes", "dialog"), ("x" * 81, "long"), ("1 2 3 4 a", "noise"),
)


def _title_case(of: int, k: str) -> str:
    return f"CASE {k} " + " ".join("WHEN {} THEN {}".format(i, "NULL" if t[of] is None else "'" + t[of].replace("'", "''") + "'") for i, t in enumerate(_TITLES)) + " END"


@query(f"""SELECT o_orderkey, CASE WHEN s < 0.9 THEN 'small' WHEN w = 'weak' AND s >= 1.15 THEN NULL WHEN w IS NOT NULL THEN w WHEN s < 1.15 AND k IN (0, 4, 8) THEN 'weak' END AS reason
FROM (SELECT o_orderkey, o_orderkey % {len(_TITLES)} AS k, 0.8 + o_custkey % 5 * 0.1 AS s, {_title_case(1, f"o_orderkey % {len(_TITLES)}")} AS w FROM orders)""")
def heading_reasons(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", F.expr(_title_case(0, f"o_orderkey % {len(_TITLES)}")).alias("t"), (F.lit(0.8) + F.col("o_custkey") % 5 * 0.1).alias("size"))
    return o.select("o_orderkey", outline.drop_reason(F.col("t"), F.col("size")).alias("reason"))


_HEADS = """SELECT l_suppkey AS doc, l_orderkey % 40 + 1 AS page, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 9 = 0 THEN 'Running Head' WHEN l_partkey % 9 = 1 THEN CAST(l_partkey AS VARCHAR(9)) WHEN l_partkey % 9 = 2 THEN concat('It ends at ', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(12)), ' mg. Now more')
ELSE concat('CHAPTER ', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(12))) END AS title, CAST(2 + l_quantity % 6 AS DOUBLE) AS size FROM lineitem"""


@query(f"""WITH h AS ({_HEADS}), k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k, lead((page, title)) OVER (PARTITION BY doc ORDER BY page, seq, title) AS nx FROM h),
f AS (SELECT *, count(*) OVER (PARTITION BY doc, k) AS f FROM k), g AS (SELECT *, title LIKE 'It ends%' AS bad FROM f WHERE f < 10), t AS (SELECT doc, size, count(*) FILTER (NOT bad) AS c FROM g GROUP BY 1, 2),
u AS (SELECT *, sum(c) OVER (PARTITION BY doc ORDER BY size DESC) AS run FROM t), x AS (SELECT g.*, CASE WHEN regexp_matches(title, '^[0-9]+$') AND nx[1] = page THEN title || ' ' || nx[2] ELSE title END AS joined FROM g WHERE NOT bad AND (doc, size) IN (SELECT (doc, size) FROM u WHERE run <= 200))
SELECT doc, page, seq, joined AS title, size FROM x WHERE NOT regexp_matches(joined, '^[0-9]+$')""")
def heading_outline(s: SparkSession, d: str) -> DataFrame:
    h = s.sql(_HEADS.replace("FROM lineitem", "FROM {l}"), l=table(s, d, "lineitem"))
    return outline.fallback(h, "doc", F.lit(300))


_OUTLINE = "SELECT o_custkey AS doc, o_orderkey AS page, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 10 <> 0 THEN concat('scan', CAST(o_orderkey AS VARCHAR(12)), '.JPG') WHEN o_custkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'untitled-3' ELSE concat('Part ', CAST(o_orderkey AS VARCHAR(12))) END AS title FROM orders"


@query(f"""WITH o AS ({_OUTLINE}), j AS (SELECT doc, avg(CASE WHEN title LIKE 'Part%' THEN 0.0 ELSE 1.0 END) >= 0.8 AS junk FROM o GROUP BY 1)
SELECT doc, page, title, 'outline' AS source FROM o WHERE doc IN (SELECT doc FROM j WHERE NOT junk) UNION ALL SELECT c_custkey, 1, c_name, 'fallback' FROM customer WHERE c_custkey NOT IN (SELECT doc FROM j WHERE NOT junk)""")
def contents(s: SparkSession, d: str) -> DataFrame:
    o = s.sql(_OUTLINE.replace("FROM orders", "FROM {o}"), o=table(s, d, "orders"))
    fall = table(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.lit(1).cast("long").alias("page"), F.col("c_name").alias("title"))
    return outline.contents(o, fall, "doc")


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 3 THEN ['i', NULL, 'x'][p_size] END AS label FROM part""")
def printed_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", outline.printed_label(F.array(F.lit("i"), F.lit("2"), F.lit("x"), F.lit("")), F.col("p_size")).alias("label"))


_PAGES = "SELECT conv_id AS k, turn AS seq, replace(min(text), chr(10), ' ') AS text, min(role) AS role FROM conversations GROUP BY conv_id, turn"


@query(f"""WITH p AS ({_PAGES}), o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p),
t AS (SELECT k, string_agg(text, chr(10) ORDER BY seq) AS text FROM p GROUP BY 1), h AS (SELECT * FROM o WHERE role = 'user'), a AS (SELECT k, text FROM h WHERE o <= 100 AND o + length(text) > 100)
SELECT t.k, md5(t.text) AS page, a.text AS heading, CASE WHEN t.k % 4 = 0 THEN 'table' WHEN a.text IS NOT NULL AND t.k % 4 <> 1 THEN 'head' ELSE 'body' END AS kind, (SELECT count(*) FROM h WHERE h.k = t.k) AS heads, (SELECT coalesce(CAST(sum(length(text) + 1) AS BIGINT), 0) FROM h WHERE h.k = t.k) AS slim FROM t LEFT JOIN a ON a.k = t.k""")
def page_records(s: SparkSession, d: str) -> DataFrame:
    """Conversations as pages whose user turns are headings: the page's record, the heading at its 100th character, the kind of
    a hit there, and the headings alone."""
    p = s.sql(_PAGES.replace("FROM conversations", "FROM {c}").replace("chr(10)", "'\\n'"), c=table(s, d, "conversations"))
    r = outline.page_record(p.withColumn("kind", F.when(F.col("role") == "user", "heading").otherwise("body")).withColumn("size", F.lit(1.234)), ["k"])
    at = outline.heading_at(F.col("text"), F.col("heads"), F.lit(100))
    r = r.withColumn("heading", at).withColumn("slim", outline.slim(F.col("text"), F.col("heads")))
    last = F.element_at("slim", -1)
    kind = outline.hit_kind(F.col("heading"), F.col("k") % 4 == 0, F.when(F.col("k") % 4 == 1, 10).otherwise(1))
    return r.select("k", F.md5("text").alias("page"), "heading", kind.alias("kind"), F.size("heads").alias("heads"), F.when(F.size("slim") == 0, 0).otherwise(last["o"] + F.length(last["t"]) + 1).cast("long").alias("slim"))


#: Texts in several scripts, by a number: the language each is read in, in a French document; does it miss a Korean one as a
#: query; its runs of Latin letters.
_UNITS = (("Le coeur bat", None, True, 3), ("심장 heart 이다 또 한", "ko", False, 1), ("القلب ينبض", "ar", True, 0), ("a 가", None, False, 1), ("é", None, True, 1), ("12 %", None, False, 0), ("心臓", None, True, 0))


def _units_sql(of: int) -> str:
    say = {None: "NULL", True: "true", False: "false"}
    return "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {say[u[of]] if u[of] in (None, True, False) and not isinstance(u[of], int) or isinstance(u[of], bool) else u[of] if isinstance(u[of], int) else chr(39) + u[of] + chr(39)}" for i, u in enumerate(_UNITS)) + " END"


@query(f"SELECT o_orderkey, {_units_sql(1)} AS lang, {_units_sql(2)} AS mismatch, {_units_sql(3)} AS latin FROM orders")
def unit_languages(s: SparkSession, d: str) -> DataFrame:
    t = F.expr(_units_sql(0))
    return table(s, d, "orders").select("o_orderkey", scripts.unit_language(t, F.lit("fr")).alias("lang"), scripts.mismatch(t, F.lit("ko")).alias("mismatch"), scripts.script_runs(t)["latin_runs"].alias("latin"))


@query("""WITH p AS (SELECT source AS k, CAST(doc_id % 35 AS INTEGER) AS page, doc_id AS seq, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE doc_id % 35 BETWEEN 1 AND 30 AND lang <> 'de'), n AS (SELECT * FROM p WHERE t <> ''),
b AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY k ORDER BY page, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n), x AS (SELECT k, substr(string_agg(t, ' ' ORDER BY page, seq), 1, 8000) AS text FROM b WHERE before < 8000 GROUP BY 1),
g AS (SELECT k, page, sum(length(t) + 1) - 1 AS n FROM n GROUP BY 1, 2) SELECT k, md5(text) AS sample, (SELECT count(*) FROM g WHERE g.k = x.k AND n >= 200) AS pages FROM x""")
def language_samples(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select(F.col("source").alias("k"), (F.col("doc_id") % 35).cast("int").alias("page"), F.col("doc_id").alias("seq"), F.when(F.col("lang") == "de", "heading").alias("kind"), "text")
    return scripts.sample(x, "k").select("k", F.md5("text").alias("sample"), "pages")


@query("""SELECT c_custkey, 6 AS n, 'قال (' || c_name || ')' AS head, 'العاصمه' AS folded, 'the big ' || lower(c_mktsegment) AS candidate, 'see link for 5 percent or more greater than or equal to 3, blank of STAR*D' AS spoken FROM customer""")
def two_directions(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("قال ("), F.col("c_name"), F.lit(") ثم IL-6 و ABC"))
    runs = scripts.direction_runs(t)
    c = table(s, d, "customer")
    say = F.lit("see https://x.org/a?b for 5% or more ≥ 3†, ______ of STAR∗D")
    called = scripts.term_in_translation(F.lit("Acme"), F.concat(F.lit("So, the big "), F.lower("c_mktsegment"), F.lit(" (the ACME thing) grew")))
    return c.select("c_custkey", F.size(runs).alias("n"), F.concat(F.get(runs, F.lit(0))["text"], F.get(runs, F.lit(1))["text"]).alias("head"), scripts.fold_arabic(F.lit("العَاصمــة")).alias("folded"), called.alias("candidate"), scripts.speech(say).alias("spoken"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 1 THEN 'stop' WHEN 2 THEN 'next' END AS command, CASE c_custkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS rank FROM customer WHERE c_custkey % 3 <> 0""")
def heard_commands(s: SparkSession, d: str) -> DataFrame:
    words = s.createDataFrame([("Stop now", "stop"), ("next page", "next"), ("go on", "next"), ("back", "back"), ("back!", "undo")], "phrase string, command string")
    k = F.col("c_custkey") % 3
    alt = F.array(F.when(k == 0, "back").when(k == 1, "STOP, now!").otherwise("next cage"), F.when(k == 0, "what").otherwise("Next 2 page"), F.when(k == 0, "").otherwise("go on"))
    heard = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.posexplode(alt).alias("rank", "text")).withColumn("rank", F.col("rank") + 1)
    return scripts.commands(heard, F.broadcast(words), "k")  # five rows


@query("""SELECT o_orderkey, ['3-5', '1200.5', '≤-2.5%', '1.5×10^-6', '10^9', '~40'] AS chunks, CASE WHEN o_orderkey % 2 = 0 THEN ['mg/kg/일', '', 'l', NULL] ELSE ['mg/kg/일', '', 'µg', NULL] END AS units FROM orders""")
def number_expressions(s: SparkSession, d: str) -> DataFrame:
    t = F.lit("give 3 – 5, of 1,200.5 to ≤ −2.5 % or 1.5 x 10^-6 and 10⁹ at ≈40.")
    u = F.concat(F.lit("40 mg/kg/일; 30% of 7 "), F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("µg"), F.lit(", CD4."))
    units = checks.number_units(u)
    return table(s, d, "orders").select("o_orderkey", checks.number_chunks(t).alias("chunks"), units["u"].alias("units"))


@query("""WITH a AS (SELECT conv_id AS k, turn AS i, max(text) || ' 12' AS text FROM conversations GROUP BY 1, 2), r AS (SELECT *, CASE i % 5 WHEN 4 THEN 'missing' WHEN 1 THEN 'ratio' WHEN 2 THEN 'digits' END AS reason FROM a)
SELECT k, i, CASE WHEN reason IS NULL THEN 'ok' WHEN reason = 'missing' THEN 'missing' ELSE 'failed' END AS state, reason, 5 * count(*) FILTER (reason IN ('ratio', 'digits')) OVER (PARTITION BY k) > count(*) OVER (PARTITION BY k) AS failed FROM r""")
def checked_translations(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "conversations").groupBy(F.col("conv_id").alias("k"), F.col("turn").alias("i")).agg(F.concat(F.max("text"), F.lit(" 12")).alias("text"))
    good = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    t = F.when(F.col("i") % 5 == 1, "").when(F.col("i") % 5 == 2, F.translate("text", "0123456789", "xxxxxxxxxx")).otherwise(good)
    b = a.where("i % 5 <> 4").select("k", "i", F.lit(1).alias("seq"), t.alias("t"))
    return checks.translations(a, b.unionByName(b.select("k", "i", F.lit(2).alias("seq"), F.lit("later").alias("t"))), "k")


@query("""SELECT c_nationkey AS k, c_custkey AS i, CASE c_custkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'ok' END AS state, CASE c_custkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'long' WHEN 3 THEN 'lang' END AS reason,
CASE WHEN c_custkey % 6 > 3 THEN '심장 ' || c_custkey END AS translation, CASE c_custkey % 6 WHEN 4 THEN 'noun' WHEN 5 THEN 'other' END AS pos, CASE WHEN c_custkey % 6 > 3 THEN 'a b' END AS gloss FROM customer""")
def checked_terms(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"))
    m = F.col("i") % 6
    t = F.when(m == 1, " ").when(m == 2, F.repeat(F.lit("가"), F.lit(201))).when(m == 3, "heart").otherwise(F.concat(F.lit(" 심장  "), F.col("i").cast("string")))
    got = c.where("i % 6 <> 0").select("k", "i", F.lit(1).alias("seq"), t.alias("translation"), F.when(m == 4, " Noun").otherwise("thing").alias("pos"), F.lit(" a  b").alias("gloss"))
    return checks.terms(c, got, "k", "Hangul")


@query("""SELECT c_custkey, 'It is so. There are 12 of them!' AS kept, 5 AS sentences, c_custkey % 2 = 0 AS none, 'w' || (CASE WHEN c_custkey % 2 = 0 THEN 496 ELSE 497 END) AS first, 19 AS words FROM customer""")
def explained(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    text = F.lit("It is so. There are 12 of them! But 13 are not. 끝났다。그러나")
    odd = F.when(F.col("c_custkey") % 2 == 0, "Only 99.").otherwise("None.")
    para = F.lit(" ".join(f"w{i}" for i in range(100, 1000)))  # made once, not for each row
    cut = checks.context(F.when(F.col("c_custkey") % 2 == 0, "w505").otherwise("w506"), para, 100)
    of = let(cut, lambda x: F.struct(F.substring_index(x, " ", 1).alias("first"), F.size(F.split(x, " ")).alias("words")))
    x = c.select("c_custkey", checks.explanation(F.substring(text, 1, 47), F.lit("12 in all")).alias("kept"), F.size(checks.simple_sentences(text)).alias("sentences"), checks.explanation(odd, F.lit("")).isNull().alias("none"), F.array(of).alias("_of"))
    return x.select("c_custkey", "kept", "sentences", "none", F.inline("_of"))
