"""Text plans over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import hashing, text as T
from tessera.plans.catalog import FOLD_SQL, query
from tessera.session import table



@query(f"SELECT doc_id, md5({FOLD_SQL}) AS folded, length({FOLD_SQL}) AS n FROM documents")
def fold_text(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", T.fold(F.col("text")).alias("f"))
    return x.select("doc_id", F.md5("f").alias("folded"), F.length("f").alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Hangul}')) AS hangul, len(regexp_extract_all(text, '[\p{Hiragana}\p{Katakana}]')) AS kana,
len(regexp_extract_all(text, '\p{Han}')) AS han, len(regexp_extract_all(text, '\p{Arabic}')) AS arabic, len(regexp_extract_all(text, '[A-Za-zªºÀ-ÖØ-öø-ʸ]')) AS latin FROM documents""")
def script_counts(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", "text", T.beyond_latin(F.col("text")).alias("beyond"))
    return x.select("doc_id", *[c.alias(k) for k, c in T.script_counts(F.col("text"), F.col("beyond")).items()])


#: Documents of which some are written in letters of other scripts, by their id.
_FOREIGN = ("가나다라마바사아자차", "あいうえおカキクケコ", "中文字母表一二三四五", "ابتثجحخدذر")
_LATIN = "aeiounrtsl"
_MIXED = "CASE doc_id % 6 " + " ".join(f"WHEN {i + 1} THEN translate(text, '{_LATIN}', '{x}')" for i, x in enumerate(_FOREIGN)) + " ELSE text END"


def _mixed_scripts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.expr(_MIXED).alias("text"))


_WORDS = {k: "list_contains(['" + "','".join(v) + "'], x)" for k, v in T.FUNCTION_WORDS.items()}


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents)
SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: {_WORDS['en']})) AS en, len(list_filter(w, lambda x: {_WORDS['fr']})) AS fr FROM w""")
def function_word_counts(s: SparkSession, d: str) -> DataFrame:
    w = T.function_words(F.col("w"))
    return table(s, d, "documents").select("doc_id", T.letter_words(F.col("text")).alias("w")).select("doc_id", w["words"].alias("words"), w["en"].alias("en"), w["fr"].alias("fr"))


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace({_MIXED}, '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '\p{{L}}+') AS o FROM t), l AS (SELECT *, list_transform(o, lambda x: lower(x)) AS w FROM w),
c AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '\p{{L}}')) AS a, len(regexp_extract_all(t, '\p{{Hangul}}')) AS ko, len(regexp_extract_all(t, '[\p{{Hiragana}}\p{{Katakana}}]')) AS kana, len(regexp_extract_all(t, '\p{{Han}}')) AS han, len(regexp_extract_all(t, '\p{{Arabic}}')) AS ar, len(list_filter(w, lambda x: {_WORDS['en']})) AS en, len(list_filter(w, lambda x: {_WORDS['fr']})) AS fr, len(list_filter(w, lambda x: {_WORDS['fr']} AND x <> 'la')) AS f2,
  len(list_filter(generate_series(1, len(o)), lambda i: list_contains(['el','los','las','del','por','para','con','una','lo'], w[i])
    AND (NOT regexp_matches(o[i], '^\p{{Lu}}') OR o[i] = upper(o[i]) OR coalesce(regexp_matches(o[i + 1], '^\p{{Ll}}'), false)))) AS es FROM l)
SELECT doc_id, CASE WHEN n < 200 THEN 'en' WHEN ko * 10 >= a * 3 AND a > 0 THEN 'ko' WHEN kana > 0 AND (kana + han) * 10 >= a * 3 THEN 'ja' WHEN han * 10 >= a * 3 AND a > 0 THEN 'zh' WHEN ar * 10 >= a * 3 AND a > 0 THEN 'ar' WHEN es >= 2 AND es >= 2 * greatest(en, f2) THEN 'es' WHEN greatest(en, fr) >= 2 * least(en, fr) AND fr > en THEN 'fr' ELSE 'en' END AS guess,
CASE WHEN n < 200 THEN 0.0 WHEN ko * 10 >= a * 3 AND a > 0 THEN floor(ko / a * 1000 + 0.5) / 1000 WHEN kana > 0 AND (kana + han) * 10 >= a * 3 THEN floor((kana + han) / a * 1000 + 0.5) / 1000 WHEN han * 10 >= a * 3 AND a > 0 THEN floor(han / a * 1000 + 0.5) / 1000 WHEN ar * 10 >= a * 3 AND a > 0 THEN floor(ar / a * 1000 + 0.5) / 1000 WHEN es >= 2 AND es >= 2 * greatest(en, f2) THEN floor((1 - greatest(en, f2) / es) * 1000 + 0.5) / 1000 WHEN greatest(en, fr) = 0 THEN 0.0 ELSE floor((1 - least(en, fr) / greatest(en, fr)) * 1000 + 0.5) / 1000 END AS score FROM c""")
def guess_language(s: SparkSession, d: str) -> DataFrame:
    return T.with_language(_mixed_scripts(s, d), "text").drop("text")


@query(rf"""WITH t AS (SELECT doc_id, {_MIXED} AS t FROM documents), w AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '[가-힣؀-ۿ]')) AS wide FROM t)
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN wide * 10 >= n * 3 THEN ceil(n / 2) ELSE ceil(n / 4) END AS BIGINT) AS tokens FROM w""")
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return _mixed_scripts(s, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_REDACTED = "text"
for _p in T.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '[KEY]', 'g')"


@query(f"SELECT doc_id, md5({_REDACTED}) AS redacted FROM (SELECT doc_id, text || ' Bearer abc sk-0123456789abcdefXY' AS text FROM documents)")
def redact_secrets(s: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.lit(" Bearer abc sk-0123456789abcdefXY"))
    return table(s, d, "documents").select("doc_id", F.md5(T.redact(t)).alias("redacted"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(trim(text, ' '), '(?s)\n[ \t\r]*\n.*$', '') AS b FROM documents),
p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(b, '(?s)```.*?```|!\[[^\]]*\]\([^)]*\)|\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#>*_`~-]', '', 'g'), '\s+', ' ', 'g')) AS x FROM b)
SELECT doc_id, CASE WHEN length(x) > 160 THEN substr(x, 1, 160) || '…' ELSE x END AS excerpt FROM p""")
def excerpts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '\d+', '#', 'g')), '\s+', ' ', 'g')) AS k FROM documents")
def repeat_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.repeat_key(F.col("text")).alias("k"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(x, '[",\r\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END AS cell FROM (SELECT page_id, CASE WHEN regexp_matches(html, '^''*[=+\-@\t\r]') THEN '''' || html ELSE html END AS x FROM pages)""")
def csv_cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", T.csv_cell(F.col("html")).alias("cell"))


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^(?i)https://[^/?#]+') THEN 'scheme' WHEN regexp_matches(url, '^(?i)https://[^/?#]*@') THEN 'userinfo' WHEN length(url) > 2048 THEN 'long' ELSE 'ok' END AS verdict FROM pages""")
def safe_links(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", T.safe_link(F.col("url")).alias("verdict"))


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(\d),(\d{3})\b', '\1\2', 'g'), '\d+(?:\.\d+)?')) AS n FROM documents),
p AS (SELECT doc_id, CASE WHEN contains(n, '.') THEN regexp_replace(n, '\.?0+$', '') ELSE n END AS n FROM n)
SELECT doc_id, list_sort(list(DISTINCT regexp_replace(n, '^0+(\d)', '\1'))) AS numbers FROM p GROUP BY 1""")
def numbers(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", T.number_tokens(F.col("text")).alias("numbers"))
    return x.where(F.size("numbers") > 0)


@query("SELECT doc_id, 's256:' || sha256(text) AS content, sha256(lang || chr(1) || source || chr(1) || text) AS id, 'text|' || lang || '|' || doc_id || '|' || sha256(text) AS cache FROM documents")
def content_keys(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", hashing.content_hash(t).alias("content"), hashing.content_id(F.col("lang"), F.col("source"), t).alias("id"), hashing.cache_key(F.col("doc_id"), t, F.col("lang"), F.lit("text")).alias("cache"))


@query("""WITH h AS (SELECT c_custkey, hex(encode(c_name || '-ß中😀-' || c_mktsegment)) AS h FROM customer), b AS (SELECT c_custkey, list_transform(generate_series(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS HUGEINT)) AS b FROM h)
SELECT c_custkey, printf('%08x%08x', CAST(x // 4294967296 AS BIGINT), CAST(x % 4294967296 AS BIGINT)) AS fnv FROM (SELECT c_custkey, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), b), lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616) AS x FROM b)""")
def fnv_hashes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", hashing.fnv1a64(F.concat("c_name", F.lit("-ß中😀-"), "c_mktsegment")).alias("fnv"))


@query(r"SELECT count(DISTINCT trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS n FROM documents")
def normal_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").agg(F.countDistinct(F.sha2(hashing.hash_form(F.col("text")), 256)).alias("n"))


@query(f"""WITH h AS (SELECT doc_id, trim(regexp_replace({FOLD_SQL}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))
SELECT k, count(*) AS n, count(DISTINCT doc_id) AS docs FROM h WHERE k <> '' GROUP BY 1 HAVING count(*) >= 10""")
def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).select("doc_id", T.head_key(F.col("t")).alias("k")).where("k <> ''")
    once = h.groupBy("k", "doc_id").agg(F.count("*").alias("c"))
    return once.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).where("n >= 10")


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line, role || ': ' || text AS text FROM conversations)
SELECT * FROM t UNION ALL SELECT conv_id, 0, 'conversation ' || conv_id || ' (' || count(*) || ')' FROM t GROUP BY conv_id""")
def grouped_report(s: SparkSession, d: str) -> DataFrame:
    """Conversations as lines of a text file: a heading with the number of turns, then every turn in order. Lines stay rows,
    so a conversation of any length passes through one sorted window and is held nowhere."""
    c = table(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = c.select("conv_id", F.row_number().over(w).cast("long").alias("line"), F.concat_ws(": ", "role", "text").alias("text"))
    heads = c.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.lit(0).cast("long").alias("line"), F.format_string("conversation %d (%d)", "conv_id", "n").alias("text"))
    return lines.unionByName(heads)


@query("SELECT conv_id, turn, role, sum(CASE WHEN role IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) ")
def role_runs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", "turn", "role").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role").eqNullSafe(F.lag("role").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return c.withColumn("new", new).select("conv_id", "turn", "role", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
