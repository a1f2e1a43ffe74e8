"""Registered content: what a file may add, in which order files win, and texts that link to terms."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions.text import let

_NODE = "[a-z0-9]+(?:-[a-z0-9]+)*"


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def _missing(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def _judged(rows: DataFrame, nodes: DataFrame, reason: Column, letter: str) -> DataFrame:
    """rows with ``reason`` (null: taken): an id names its node, which exists; of one id the first that is otherwise right."""
    of = F.regexp_extract("id", f"^({_NODE})-{letter}[0-9]{{2}}$", 1)
    j = rows.join(nodes.select("node").distinct().withColumn("_there", F.lit(True)), "node", "left")
    bad = F.when(of == "", "id").when(of != F.col("node"), "node").when(F.col("_there").isNull(), "tree").otherwise(reason)
    j = j.withColumn("reason", bad)
    first = F.row_number().over(Window.partitionBy("id", F.col("reason").isNull()).orderBy("seq"))
    return j.withColumn("_n", first).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), "duplicate").otherwise(F.col("reason"))).drop("_n", "_there")


def questions(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (seq, id, node, type, kind, difficulty, prompt, explanation, terms, choices, answer) with ``reason`` why a question is
    not taken, and of those that are what is ``missing``. An answer must be a choice's number, a truth value or a text."""
    index = F.col("answer").try_cast("int")
    right = F.when(F.col("type") == "mcq", (F.size("choices") >= 2) & index.between(0, F.size("choices") - 1)).when(F.col("type") == "ox", F.col("answer").isin("true", "false")).otherwise(_text("answer"))
    reason = F.when(~F.col("type").isin("mcq", "ox", "short"), "type").when(~F.coalesce(right, F.lit(False)), "answer")
    checks = {"kind": F.col("kind").isin("concept", "code", "calc"), "difficulty": F.col("difficulty").between(1, 3), "prompt": _text("prompt"), "explanation": _text("explanation"), "terms": F.size("terms") > 0}
    return _judged(rows, nodes, reason, "q").withColumn("missing", _missing(checks))


def practices(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (seq, id, node, answer_type, answer, title, task) with ``reason`` and ``missing``: an answer is a number, a whole one,
    or a text."""
    n = F.col("answer").try_cast("double")
    right = F.when(F.col("answer_type") == "number", n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))).when(F.col("answer_type") == "int", n == F.floor(n)).when(F.col("answer_type") == "string", _text("answer"))
    return _judged(rows, nodes, F.when(~F.coalesce(right, F.lit(False)), "answer"), "p").withColumn("missing", _missing({"title": _text("title"), "task": _text("task")}))


def terms(rows: DataFrame) -> DataFrame:
    """id, def, nodes, related, conflict out of (seq, id, def, nodes, related): the first definition stays, links are put
    together, and another definition is a conflict."""
    r = rows.where(F.col("id").rlike(f"^{_NODE}$"))
    links = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  few files name a term
    return r.groupBy("id").agg(F.min_by("def", "seq").alias("def"), links("nodes"), links("related"), (F.countDistinct(F.trim("def")) > 1).alias("conflict"))


def in_scope(tree: DataFrame, scope: DataFrame) -> DataFrame:
    """node of all that lie under the scope's nodes (or are them) in a tree (node, parent), level by level."""
    now = scope.select("node").distinct()
    found = now
    while True:
        now = tree.join(now.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node").join(found, "node", "left_anti")
        if now.isEmpty():
            return found
        found = found.unionByName(now).distinct()


def linked(texts: DataFrame, terms_: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts with [[id|label]] and [[id]] as bold label and name of a known term (id, name), else as label or id alone."""
    link = r"\[\[([a-z0-9-]+)(?:\|([^\]]*))?\]\]"
    marks = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({link})"), F.lit(1)))).alias("m"))
    marks = marks.select(key, "m", F.regexp_extract("m", link, 1).alias("id"), F.regexp_extract("m", link, 2).alias("label")).join(terms_.select("id", "name"), "id", "left")
    label = F.nullif("label", F.lit(""))
    made = F.when(F.col("name").isNull(), F.coalesce(label, F.col("id"))).otherwise(F.concat(F.lit("**"), F.coalesce(label, F.col("id")), F.lit("("), F.col("name"), F.lit(")**")))
    by = marks.groupBy(key).agg(F.collect_list(F.struct("m", made.alias("x"))).alias("_x"))
    j = texts.join(by, key, "left")
    done = F.aggregate(F.coalesce("_x", F.array().cast("array<struct<m:string,x:string>>")), F.col(text), lambda acc, x: F.replace(acc, x["m"], x["x"]))
    return j.withColumn(text, done).drop("_x")


def plain(text: Column, most: int = 0) -> Column:
    """Marked-up text as plain text: code blocks as a word, code, bold and links without their marks, on one line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```[a-zA-Z]*\n.*?```", " [code] ")
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\*\*([^*]+)\*\*", "$1"), r"\[\[[a-z0-9-]+\|([^\]]*)\]\]", "$1"), r"\[\[([a-z0-9-]+)\]\]", "$1")
    # every second part is code, in which nothing is a mark
    bare = let(F.split(t, "`"), lambda parts: F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), x).otherwise(clean(x))))
    out = F.trim(F.regexp_replace(F.array_join(bare, ""), r"(?U)\s+", " "))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("…"))).otherwise(out) if most else out


_URL = re.compile(r"https?://[^\s\"'<>)]+", re.I)


def conformed(schema: dict):
    """A function of a column of JSON: (value, changed) with what the schema does not allow taken out, or null if the root
    goes. type, required, enum, minItems, maxLength, properties and items count; numbers as text are numbers; addresses in
    texts go."""
    gone = object()

    class Work:
        changed = False

        def text(self, v, s):
            if not isinstance(v, str):
                return gone
            clean = re.sub(r"\s{2,}", " ", _URL.sub("", v)).strip() if _URL.search(v) else v
            self.changed |= clean != v
            return gone if len(clean) > s.get("maxLength", math.inf) else clean

        def number(self, v, s):
            if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v.strip()):
                v, self.changed = json.loads(v.strip()), True
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
                return gone
            return gone if s["type"].lower() == "integer" and v != int(v) else v

        def many(self, v, s):
            if not isinstance(v, list):
                return gone
            kept = [y for y in (self.any(x, s.get("items")) for x in v) if y is not gone]
            self.changed |= len(kept) < len(v)
            return gone if len(kept) < s.get("minItems", 0) else kept

        def fields(self, v, s):
            if not isinstance(v, dict):
                return gone
            if "properties" not in s:
                return v
            kept = {k: y for k, p in s["properties"].items() if k in v and (y := self.any(v[k], p)) is not gone}
            self.changed |= len(kept) < len(v)
            return gone if set(s.get("required", ())) - set(kept) else kept

        def any(self, v, s):
            if not s:
                return v
            if "enum" in s and v not in s["enum"]:
                return gone
            kind = s.get("type", "").lower()
            if kind == "boolean":
                return v if isinstance(v, bool) else gone
            by = {"string": self.text, "integer": self.number, "number": self.number, "array": self.many, "object": self.fields}
            return by[kind](v, s) if kind in by else v

    def one(raw):
        work = Work()
        try:
            v = work.any(json.loads(raw), schema)
        except (TypeError, ValueError):
            v = gone
        return (None, False) if v is gone else (json.dumps(v, ensure_ascii=False, separators=(",", ":")), work.changed)

    @pandas_udf(StructType([StructField("value", StringType()), StructField("changed", BooleanType())]))
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in raw], columns=["value", "changed"])

    return run
