"""Backups: what goes into them, what of a file is believed, and whose ids it has."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessera.functions.text import SECRETS, let

#: Fields of a document that are the user's own (fixed values).
DOC_FIELDS = (
    "id", "title", "fileName", "size", "pageCount", "fileHash", "addedAt", "lastOpenedAt", "lastPage",
    "lastLineId", "lang", "langSource", "langGuess", "domain", "readStats", "outline", "outlineV", "pageLabels", "scan", "columnsHint",
)
#: A value's kinds that may stand where a setting has none yet.
_FREE = ("VOID", "STRING", "BIGINT", "DECIMAL", "DOUBLE", "ARRAY")
_LINK_ID = r"^[^\x00-\x1F\x7F'\"\\\\]{1,64}$"


def own_fields(docs: DataFrame) -> DataFrame:
    """Documents without what can be made again."""
    return docs.where("id IS NOT NULL").select(*[c for c in docs.columns if c in DOC_FIELDS])


def has_secret(v: Column) -> Column:
    """Does a text hold the shape of a secret?"""
    return reduce(lambda a, p: a | v.rlike(p), SECRETS, F.lit(False))


def scrub(v: Column) -> Column:
    return reduce(lambda a, p: F.regexp_replace(a, p, "[KEY]"), SECRETS, v)


def settings_for_backup(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """(key, value as JSON text) of the allowed settings whose value holds no secret."""
    return rows.where(F.col("key").isin(*allowed) & F.col("value").isNotNull() & ~has_secret(F.col("value")))


def hash_candidates(file_hash: Column, pages: Column) -> Column:
    """Hashes by which a file's document may be known here: its own, the one without a page count, the one with."""
    base = F.regexp_replace(file_hash, r":n\d+$", "")
    with_pages = F.when(pages > 0, F.concat(base, F.lit(":n"), pages.cast("string")))
    return F.when(F.coalesce(file_hash, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(file_hash, base, with_pages))))


def same_pdf(mine: Column, theirs: Column) -> Column:
    """As many pages, or one side does not know."""
    a, b = F.coalesce(mine, F.lit(0)), F.coalesce(theirs, F.lit(0))
    return (a == 0) | (b == 0) | (a == b)


def remap(v: Column, table: Column) -> Column:
    """An id, or the new one that a map names for it."""
    return F.coalesce(F.try_element_at(table, v), v)


def remap_prefixed(v: Column, table: Column, sep: str = "#") -> Column:
    """``doc#rest`` with the document's new id."""
    head = F.substring_index(v, sep, 1)
    return F.when(v.contains(sep), F.concat(remap(head, table), F.substring(v, F.length(head) + 1, F.length(v)))).otherwise(v)


def remap_cache_key(v: Column, table: Column) -> Column:
    """``kind|target|doc|hash`` with the document's new id."""
    parts = F.split(v, r"\|")
    return F.when(F.size(parts) >= 4, F.array_join(F.transform(parts, lambda x, i: F.when(i == 2, remap(x, table)).otherwise(x)), "|")).otherwise(v)


def remapped(records: DataFrame, ids: DataFrame, columns: dict[str, str]) -> DataFrame:
    """records with the new ids of (old, new); columns names each id column and how it holds the id: plain or prefixed.
    A join for each column, so the table of ids may be as large as it likes."""
    for c, how in columns.items():
        key = F.col(c) if how == "plain" else F.substring_index(c, "#", 1)
        j = records.withColumn("_k", key).join(ids.select(F.col("old").alias("_k"), F.col("new").alias("_n")), "_k", "left")
        rest = F.expr(f"substring(`{c}`, length(substring_index(`{c}`, '#', 1)) + 1)")
        records = j.withColumn(c, F.when(F.col("_n").isNull(), F.col(c)).otherwise(F.col("_n") if how == "plain" else F.concat("_n", rest))).drop("_k", "_n")
    return records


def setting_ok(value: Column, default: Column) -> Column:
    """Is a variant of the kind that the default has? Where that is nothing yet: any but an object or a truth value."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    number = lambda v: F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), "NUMBER").otherwise(kind(v))
    return F.coalesce(F.when(kind(default) == "VOID", kind(value).isin(*_FREE)).otherwise(number(value) == number(default)), F.lit(False))


def natural(v: Column, least: int) -> Column:
    """A whole number from ``least`` up; anything else: null."""
    n = v.try_cast("double")
    return F.when((n >= least) & (n == F.floor(n)), n.cast("long"))


def doc_times(opened: Column, now: Column, is_new: Column) -> tuple[Column, Column]:
    """(time a document was opened, is the file's place in it believed): a time that lies ahead is now for a new document,
    and for one that is here the file's time and place do not count."""
    ahead = opened > now
    return F.when(ahead & is_new, now).when(ahead, F.lit(None)).otherwise(opened), is_new | ~F.coalesce(ahead, F.lit(False))


def clean_links(links: Column) -> Column:
    """links (id, ...) with a new id, ``i`` and its place, for each whose id is missing, ill-formed or taken before."""
    fine = lambda ids, i: F.get(ids, i).rlike(_LINK_ID) & (F.array_position(ids, F.get(ids, i)) == i + 1)

    def fresh(ids: Column, i: Column) -> Column:
        name = F.concat(F.lit("i"), i.cast("string"))
        return F.when(F.array_contains(ids, name), F.concat(name, F.lit("_"))).otherwise(name)

    ids = F.transform(links, lambda x: F.coalesce(x["id"], F.lit("")))
    return let(ids, lambda known: F.transform(links, lambda x, i: F.when(fine(known, i), x).otherwise(x.withField("id", fresh(known, i)))))


_SECRET = re.compile("|".join(SECRETS))


def _walk(v, depth: int, deep: int, long: int):
    if depth > deep:
        return "[DEEP]"
    if isinstance(v, str):
        return _SECRET.sub("[KEY]", v)
    if isinstance(v, list):
        return [_walk(x, depth + 1, deep, long) for x in v[:long]]
    if isinstance(v, dict):
        return {k: _walk(x, depth + 1, deep, long) for k, x in list(v.items())[:long] if not _SECRET.search(k)}
    return v


@pandas_udf(StringType())
def redacted_json(value: pd.Series) -> pd.Series:
    """JSON of any shape without secrets: in texts they become [KEY], fields named like one go; what is nested deeper than
    8 is not told, lists and objects end after 200 items. Shapes differ from row to row, so no schema can say it."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(_walk(json.loads(x), 0, 8, 200), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return json.dumps(_SECRET.sub("[KEY]", x), ensure_ascii=False)

    return value.map(one, na_action=None)


def setting(values: DataFrame, key: str, default: str, retired: dict[str, str] | None = None) -> Column:
    """A setting out of a map column ``values``: the default where it is absent, today's word for a retired one."""
    v = F.coalesce(F.try_element_at(F.col("values"), F.lit(key)), F.lit(default))
    for old, new in (retired or {}).items():
        v = F.when(v == old, new).otherwise(v)
    return v
