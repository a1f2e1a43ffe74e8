"""Plans over pages of positioned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import columns, layout
from tessera.plans.catalog import query
from tessera.session import dealt, table

#: Rows of lineitem or orders that a task takes to pages.
ROWS = 250_000
#: Documents that a task sets in columns.
SET = 2_000

# a page of items for each order: three lines of up to three items in two sizes, one of them printed twice
_ITEMS = """SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber AS item, CASE WHEN l_linenumber = 6 THEN ' ' ELSE concat(l_returnflag, CAST(l_linenumber AS VARCHAR(9))) END AS text, CAST(CASE l_linenumber % 3 WHEN 0 THEN 300 WHEN 1 THEN 50 ELSE 60 + l_quantity % 5 * 4 END AS DOUBLE) AS x, CAST(100 + l_linenumber // 3 * 20 + l_linenumber % 2 AS DOUBLE) AS y,
CAST(CASE WHEN l_linenumber = 5 THEN -1 ELSE 8 END AS DOUBLE) AS w, CAST(10 + l_linenumber // 4 * 2 AS DOUBLE) AS size FROM lineitem"""
_CLEAN = f"""i AS (SELECT DISTINCT ON (doc, page, item) * FROM ({_ITEMS}) ORDER BY doc, page, item, x), c AS (SELECT * REPLACE (CASE WHEN w > 0 AND w <= 4 * length(text) * size * 0.5 THEN w ELSE length(text) * size * 0.5 END AS w) FROM i WHERE trim(text) <> ''),
s AS (SELECT *, CASE WHEN y - lag(y) OVER o > 0.3 * greatest(size, lag(size) OVER o) THEN 1 ELSE 0 END AS new FROM c WINDOW o AS (PARTITION BY doc, page ORDER BY y, x, item)), l AS (SELECT * EXCLUDE (new), CAST(sum(new) OVER (PARTITION BY doc, page ORDER BY y, x, item ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line FROM s)"""


def _items(s: SparkSession, d: str) -> DataFrame:
    i = dealt(s.sql(_ITEMS.replace("FROM lineitem", "FROM {l}").replace("//", "div"), l=table(s, d, "lineitem")), ROWS, *layout.PAGE)
    one = i.groupBy("doc", "page", "item").agg(F.min(F.struct("x", "text", "y", "w", "size")).alias("r")).select("doc", "page", "item", "r.text", "r.x", "r.y", "r.w", "r.size")
    return layout.lines_of(layout.clean_items(one))


_ITEMS_ONE = _CLEAN.replace("ORDER BY doc, page, item, x)", "ORDER BY doc, page, item, x, text, y, w, size)")


@query(f"WITH {_ITEMS_ONE} SELECT doc, page, item, line, w FROM l")
def page_items(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("doc", "page", "item", "line", "w")


@query(f"""WITH {_ITEMS_ONE}, g AS (SELECT *, x - lag(x + w) OVER o AS gap FROM l WINDOW o AS (PARTITION BY doc, page, line ORDER BY x, item))
SELECT doc, page, line, string_agg(CASE WHEN gap > 0.15 * size THEN ' ' ELSE '' END || trim(text), '' ORDER BY x, item) AS text, count(*) FILTER (gap > size) + 1 AS cells, min(x) AS x, max(x + w) - min(x) AS w, least(min(x), 310) AS "left", greatest(0, least(min(y) - max(size), 120)) AS top FROM g GROUP BY 1, 2, 3""")
def page_lines(s: SparkSession, d: str) -> DataFrame:
    twice = _items(s, d).withColumn("item", F.explode(F.when(F.col("item") == 1, F.array(F.col("item"), F.lit(0).cast("bigint"))).otherwise(F.array("item"))))  # some printed twice
    return layout.with_boxes(layout.line_texts(twice), F.lit(310.0), F.lit(120.0)).select("doc", "page", "line", "text", "cells", "x", "w", "left", "top")


@query("""SELECT o_orderkey, CASE WHEN abs(o_custkey % 9 - 4) <= 0.3 * greatest(10, o_orderkey % 13) THEN CASE WHEN o_orderkey % 13 < 8 THEN 'raised' ELSE 'same' END END AS kind FROM orders""")
def item_joins(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", layout.join_kind(F.col("o_custkey") % 9 - 4, F.col("o_orderkey") % 13, F.lit(10)).alias("kind"))


# lines of pages: a customer's orders, ten to a page, in two columns with some that span both; sizes and texts by their keys
_LINES = """SELECT o_custkey AS doc, o_orderkey % 3 + 1 AS page, o_orderkey AS line, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 40 WHEN o_orderkey % 2 = 0 THEN 50 ELSE 320 END AS DOUBLE) AS x, CAST(o_orderkey % 97 * 8 AS DOUBLE) AS y, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 500 WHEN o_orderkey % 5 = 0 THEN 180 ELSE 200 END AS DOUBLE) AS w,
CAST(CASE WHEN o_orderkey % 11 = 0 THEN 14 ELSE 10 + o_orderkey % 3 * 0.5 END AS DOUBLE) AS size, CASE WHEN o_orderkey % 97 < 6 THEN concat('Chapter ', CAST(o_orderkey % 3 + 101 AS VARCHAR(9))) WHEN o_orderkey % 97 > 92 THEN 'Of 5 hearts' ELSE o_orderpriority END AS text, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS col FROM orders"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_LINES.replace("FROM orders", "FROM {o}"), o=table(s, d, "orders"))


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, y - lag(y) OVER (PARTITION BY doc, page, col ORDER BY y, line) AS step FROM l), m AS (SELECT doc, page, median(size) AS size, median(step) FILTER (step > 0) AS leading FROM s GROUP BY 1, 2)
SELECT m.*, (SELECT count(*) FROM l WHERE l.doc = m.doc AND l.page = m.page AND l.y BETWEEN 0.08 * 800 AND 0.92 * 800 AND l.size BETWEEN 0.8 * m.size AND 1.3 * m.size) AS body FROM m""")
def page_metrics(s: SparkSession, d: str) -> DataFrame:
    m = layout.page_metrics(_lines(s, d))
    n = layout.body_lines(_lines(s, d), m, F.lit(800.0)).groupBy("doc", "page").agg(F.count("*").alias("body"))
    return m.join(n, ["doc", "page"], "left").select("doc", "page", "size", "leading", F.coalesce("body", F.lit(0)).alias("body"))


@query(f"""WITH n AS (SELECT doc, page, col, CAST(floor(x + 0.5) AS BIGINT) AS e, count(*) AS n, max(w) AS w FROM ({_LINES}) GROUP BY 1, 2, 3, 4) SELECT doc, page, col, arg_min(e, (-n, e)) AS "left", max(w) AS width FROM n GROUP BY 1, 2, 3""")
def column_metrics(s: SparkSession, d: str) -> DataFrame:
    return layout.column_metrics(_lines(s, d))


_TRACKS = f"""l AS (SELECT * FROM ({_LINES}) WHERE col > 0), b AS (SELECT doc, page, unnest(generate_series(CAST(floor(x / 6) AS BIGINT), least(99, CAST(floor((x + w) / 6) AS BIGINT)))) AS bin FROM l), n AS (SELECT doc, page, bin, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT * FROM n QUALIFY n >= 0.15 * max(n) OVER (PARTITION BY doc, page)),
r AS (SELECT *, bin - row_number() OVER (PARTITION BY doc, page ORDER BY bin) AS r FROM k), t AS (SELECT doc, page, min(bin) AS lo, max(bin) AS hi FROM r GROUP BY doc, page, r HAVING max(bin) - min(bin) + 1 >= 15)"""


@query(f"WITH {_TRACKS} SELECT DISTINCT l.doc, l.page, CAST(greatest(1, (SELECT count(*) FROM t WHERE t.doc = l.doc AND t.page = l.page)) AS INTEGER) AS columns FROM l")
def page_columns(s: SparkSession, d: str) -> DataFrame:
    return layout.columns(_lines(s, d).where("col > 0"), F.lit(600.0))


@query(f"WITH {_TRACKS}, v AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY lo) AS track FROM t) SELECT l.doc, l.page, l.line, CAST(coalesce(max(track), 0) AS INTEGER) AS col FROM l LEFT JOIN v ON l.doc = v.doc AND l.page = v.page AND l.x >= lo * 6 AND l.x + l.w <= (hi + 1) * 6 GROUP BY 1, 2, 3")
def lines_by_column(s: SparkSession, d: str) -> DataFrame:
    lines = dealt(_lines(s, d), ROWS, *layout.PAGE).where("col > 0").drop("col")
    return layout.with_columns(lines, F.lit(600.0)).groupBy("doc", "page", "line").agg(F.max("col").alias("col"))


@query(f"""WITH l AS ({_LINES}), b AS (SELECT *, sum(CASE WHEN col = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y, line ROWS UNBOUNDED PRECEDING) * 2 - CASE WHEN col = 0 THEN 1 ELSE 0 END AS band FROM l)
SELECT doc, page, line, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY band, col, y, x, line) AS INTEGER) AS place FROM b""")
def reading_order(s: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_lines(s, d)).select("doc", "page", "line", "place")


@query(f"""WITH l AS ({_LINES}), z AS (SELECT *, y < 64 OR y > 736 AS zone, lower(regexp_replace(text, '\\d+', '#', 'g')) AS k, TRY_CAST(regexp_extract(text, '(\\d{{1,4}})\\s*$', 1) AS INTEGER) - page AS off, lead(size) OVER (PARTITION BY doc, page ORDER BY y, line) AS nx, median(size) OVER (PARTITION BY doc, page) AS m FROM l)
SELECT doc, page, line, CASE WHEN zone AND off IS NOT NULL AND EXISTS (SELECT 1 FROM z b WHERE b.zone AND b.doc = a.doc AND b.off = a.off AND abs(b.page - a.page) = 1) THEN 'folio' WHEN zone AND EXISTS (SELECT 1 FROM z b WHERE b.zone AND b.doc = a.doc AND b.k = a.k AND abs(b.page - a.page) = 1) THEN 'runner'
WHEN size >= 1.15 * m AND coalesce(nx, 0) < size THEN 'heading' ELSE 'body' END AS role FROM z a""")
def line_roles(s: SparkSession, d: str) -> DataFrame:
    return layout.roles(_lines(s, d), F.lit(800.0)).select("doc", "page", "line", "role")


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, y - lag(y) OVER (PARTITION BY doc, page ORDER BY y, line) AS step, min(y) OVER (PARTITION BY doc, page) AS t FROM l), m AS (SELECT doc, page, median(step) FILTER (step > 0) AS lead FROM s GROUP BY 1, 2), h AS (SELECT *, y <= t + 0.3 * size AS head FROM s),
n AS (SELECT *, min(CASE WHEN NOT head THEN y END) OVER (PARTITION BY doc, page) AS nx FROM h) SELECT n.doc, n.page, line FROM n JOIN m ON n.doc = m.doc AND n.page = m.page WHERE head AND nx - y > 1.5 * lead""")
def top_bands(s: SparkSession, d: str) -> DataFrame:
    return layout.top_band(_lines(s, d)).select("doc", "page", "line")


@query(f"""WITH l AS (SELECT doc, page, line, CAST(1 + CASE WHEN line % 3 = 0 THEN 0 ELSE line % 4 END AS INTEGER) AS cells FROM ({_LINES})), r AS (SELECT *, sum(CASE WHEN cells = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY line) AS run FROM l),
f AS (SELECT *, first_value(cells) OVER (PARTITION BY doc, page, run ORDER BY line) AS fc FROM r WHERE cells > 1), g AS (SELECT doc, page, run, min(line) AS "first", max(line) AS "last", count(*) AS rows, count(*) FILTER (cells = fc) AS same FROM f GROUP BY 1, 2, 3)
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY "first") AS INTEGER) AS "table", "first", "last", rows, CASE WHEN rows < 2 THEN 'short' WHEN same * 2 <= rows THEN 'ragged' ELSE 'table' END AS verdict FROM g""")
def page_tables(s: SparkSession, d: str) -> DataFrame:
    x = _lines(s, d).select("doc", "page", "line", (F.when(F.col("line") % 3 == 0, 0).otherwise(F.col("line") % 4) + 1).alias("cells"))
    return layout.tables(x, 2)


@query(f"""WITH l AS ({_LINES}) SELECT doc, page, label, line FROM (SELECT *, last_value(CASE WHEN col = 1 THEN line END IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY y, col, line ROWS UNBOUNDED PRECEDING) AS label FROM l WHERE col > 0) WHERE col > 1 AND label IS NOT NULL""")
def label_rows(s: SparkSession, d: str) -> DataFrame:
    return layout.label_rows(_lines(s, d))


@query(f"""WITH l AS (SELECT * REPLACE (CASE WHEN line % 6 = 0 THEN 5.0 ELSE size END AS size) FROM ({_LINES})), n AS (SELECT *, lead(size) OVER w AS ns, lead(y) OVER w AS ny, lead(line) OVER w AS nl, lag(size) OVER w AS ps, lag(y) OVER w AS py, lag(line) OVER w AS pl FROM l WINDOW w AS (PARTITION BY doc, page, col ORDER BY y, line))
SELECT doc, page, line, CASE WHEN size < 0.8 * ns AND ny - y < 0.8 * ns THEN nl WHEN size < 0.8 * ps AND y - py < 0.8 * ps THEN pl END AS "into" FROM n""")
def absorbed_lines(s: SparkSession, d: str) -> DataFrame:
    x = _lines(s, d).withColumn("size", F.when(F.col("line") % 6 == 0, 5.0).otherwise(F.col("size")))
    return layout.absorbed(x).select("doc", "page", "line", "into")


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y, line) AS place, CASE line % 9 WHEN 0 THEN 'aside' WHEN 1 THEN 'heading' ELSE 'body' END AS kind FROM ({_LINES})), n AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND y - lag(y) OVER w BETWEEN 0 AND 15 * size THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY place)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY place) AS para FROM n) SELECT doc, page, CAST(para AS BIGINT) AS para, min(kind) AS kind, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY 1, 2, 3""")
def described_pages(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    m = F.col("line") % 9
    x = _lines(s, d).withColumn("place", F.row_number().over(Window.partitionBy("doc", "page").orderBy("y", "line"))).withColumn("role", F.when(m == 0, "folio").when(m == 1, "heading").otherwise("body"))
    return layout.described(x, 15.0)


_SET = """t AS (SELECT doc_id AS doc, doc_id % 3 + 1 AS k, regexp_extract_all(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), '(?s).{1,30}') AS pieces FROM documents),
q AS (SELECT doc, k, unnest(pieces) AS t, generate_subscripts(pieces, 1) - 1 AS i FROM t),
r AS (SELECT doc, i // k AS line, i % k AS run, length(t) AS chars, CAST((i % k) * (600.0 / k) + CASE WHEN doc % 4 = 0 AND i % k > 0 THEN (ascii(t) * 13 + i * 7) % 170 ELSE (i % 3) END AS DOUBLE) AS x0, (600.0 / k - 24) / 30 AS letter, k FROM q),
runs AS (SELECT doc, line, run, chars, x0, CASE WHEN line % 7 = 3 AND run = 0 THEN 590.0 ELSE least(x0 + chars * letter, (run + 1) * 600.0 / k - 12) END AS x1 FROM r WHERE line % 7 <> 3 OR run = 0)"""


@query(f"""WITH {_SET},
gap AS (SELECT doc, line, lag(x1) OVER (PARTITION BY doc, line ORDER BY run) AS g0, x0 AS g1 FROM runs),
h AS (SELECT doc, bin, count(DISTINCT line) AS parted FROM gap, (SELECT unnest(generate_series(30, 70)) AS bin) WHERE g1 > g0 AND (bin + 0.5) * 6.0 >= g0 AND (bin + 0.5) * 6.0 < g1 GROUP BY 1, 2),
ends AS (SELECT doc, line, arg_min(x0, run) AS a, arg_max(x1, run) AS z FROM runs GROUP BY 1, 2),
n AS (SELECT doc, bin, count(*) AS passing FROM ends, (SELECT unnest(generate_series(30, 70)) AS bin) WHERE (bin + 0.5) * 6.0 > a AND (bin + 0.5) * 6.0 < z GROUP BY 1, 2),
v AS (SELECT n.doc, n.bin, parted, n.bin - row_number() OVER (PARTITION BY n.doc ORDER BY n.bin) AS run FROM n JOIN h ON h.doc = n.doc AND h.bin = n.bin WHERE passing >= 4 AND parted >= 0.55 * passing),
b AS (SELECT doc, (min(bin) * 6.0 + (max(bin) + 1) * 6.0) / 2 AS x, sum(parted) AS depth, min(bin) AS a FROM v GROUP BY doc, run HAVING (max(bin) - min(bin) + 1) * 6.0 >= 12.0),
g AS (SELECT doc, x, row_number() OVER (PARTITION BY doc ORDER BY depth DESC, a) AS rank, count(*) OVER (PARTITION BY doc) AS many FROM b),
s AS (SELECT runs.doc, x0 > x AS side, count(*) AS starts, mad(x0) AS dev FROM runs JOIN g ON g.doc = runs.doc AND rank = 1 WHERE x0 <> x GROUP BY 1, 2),
two AS (SELECT doc, count(*) FILTER (starts >= 4 AND dev <= 30) = 2 AS two FROM s GROUP BY 1),
top AS (SELECT doc, min(x) AS l, max(x) AS r FROM g WHERE rank <= 2 AND many >= 2 GROUP BY 1),
sg AS (SELECT runs.*, l, top.r, CAST((x0 + x1) / 2 >= l AS INTEGER) + CAST((x0 + x1) / 2 >= top.r AS INTEGER) AS k, x1 - x0 AS w FROM runs JOIN top ON top.doc = runs.doc),
ok AS (SELECT * FROM sg WHERE NOT (k = 1 AND x0 < l) AND NOT (k = 2 AND x0 < r) AND NOT (k = 0 AND x1 > l) AND NOT (k = 1 AND x1 > r)),
rf AS (SELECT doc, k, list_sort(list(w)) AS ws FROM ok GROUP BY 1, 2),
st AS (SELECT ok.doc, ok.k, count(DISTINCT line) AS lines, avg(chars) AS prose, avg(CAST(w >= 0.85 * ws[least(len(ws) - 1, CAST(floor(len(ws) * 0.9) AS BIGINT)) + 1] AS INTEGER)) AS full_, count(*) AS starts, mad(x0) AS dev FROM ok JOIN rf ON rf.doc = ok.doc AND rf.k = ok.k GROUP BY 1, 2),
th AS (SELECT doc, count(*) AS sides, min(lines) AS least_, max(lines) AS most, min(prose) AS prose, min(full_) AS full_, bool_and(starts >= 4 AND dev <= 30) AS edges FROM st GROUP BY 1),
y AS (SELECT g.doc, g.x AS best, two, l, top.r, CASE WHEN many < 2 THEN 'one' WHEN top.r - l < 120 THEN 'apart' WHEN coalesce(sides, 0) < 3 OR least_ < 12 THEN 'lines' WHEN prose < 25 THEN 'prose' WHEN full_ < 0.5 THEN 'ragged' WHEN least_ < 0.4 * most THEN 'balance' WHEN NOT edges THEN 'edges' END AS why
  FROM g LEFT JOIN two ON two.doc = g.doc LEFT JOIN top ON top.doc = g.doc LEFT JOIN th ON th.doc = g.doc WHERE rank = 1)
SELECT t.doc, 1 AS page, CASE WHEN y.doc IS NULL THEN 1 WHEN why IS NULL THEN 3 WHEN two THEN 2 ELSE 1 END AS columns, CASE WHEN y.doc IS NULL THEN NULL WHEN why IS NULL THEN l WHEN two THEN best END AS "left", CASE WHEN why IS NULL THEN r END AS "right", why FROM t LEFT JOIN y ON y.doc = t.doc""")
def column_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Documents set in one to three columns of thirty letters, with spanning lines, some with starts out of line."""
    squeezed = F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))
    docs = dealt(table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"), SET, "doc")
    t = docs.select("doc", (F.col("doc") % 3 + 1).alias("k"), F.regexp_extract_all(squeezed, F.lit("(?s).{1,30}"), F.lit(0)).alias("pieces"))
    r = t.select("doc", "k", F.posexplode("pieces").alias("i", "t")).withColumn("line", F.floor(F.col("i") / F.col("k"))).withColumn("run", F.col("i") % F.col("k")).withColumn("chars", F.length("t"))
    off = F.when((F.col("doc") % 4 == 0) & (F.col("run") > 0), (F.ascii("t") * 13 + F.col("i") * 7) % 170).otherwise(F.col("i") % 3)
    r = r.withColumn("x0", (F.col("run") * (F.lit(600.0) / F.col("k")) + off).cast("double")).where("line % 7 <> 3 OR run = 0")
    end = F.least(F.col("x0") + F.col("chars") * ((F.lit(600.0) / F.col("k") - 24) / 30), (F.col("run") + 1) * 600.0 / F.col("k") - 12)
    runs = r.select("doc", F.lit(1).alias("page"), "line", "run", "chars", "x0", F.when((F.col("line") % 7 == 3) & (F.col("run") == 0), 590.0).otherwise(end).alias("x1"))
    pages = t.select("doc", F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.lit(10.0).alias("font"))
    return columns.verdicts(runs, pages)
