"""Sources and sinks: record dumps as lines of JSON, CSV, TSV, front matter, notebooks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import csv_cell

FORMAT, VERSION, LINE = "tessera-dump", 1, 8 << 20


def write_dump(tables: dict[str, DataFrame], path: str) -> None:
    """A head line, every record as {t, s, v}, and an end line with counts, as gzipped parts in the order of their names."""
    spark = next(iter(tables.values())).sparkSession
    head = spark.createDataFrame([(0, f'{{"t":"head","format":"{FORMAT}","version":{VERSION}}}')], "part int, value string")
    out, counts = head, None
    for i, (name, df) in enumerate(tables.items(), 1):
        rec = F.to_json(F.struct(F.lit("rec").alias("t"), F.lit(name).alias("s"), F.struct(*df.columns).alias("v")))
        out = out.unionByName(df.select(F.lit(i).alias("part"), rec.alias("value")))
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    end = counts.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts"))  # one row a table
    end = end.select(F.lit(len(tables) + 1).alias("part"), F.to_json(F.struct(F.lit("end").alias("t"), "counts")).alias("value"))
    out.unionByName(end).write.partitionBy("part").option("compression", "gzip").mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, longest: int = LINE) -> DataFrame:
    """kind (head, rec, end, bad, long), name, value: every line of a dump, classified."""
    return classified(spark.read.text(path).select("value"), longest)


def classified(lines: DataFrame, longest: int = LINE) -> DataFrame:
    """The same of lines (value) from anywhere."""
    p = F.try_parse_json("value")
    t = F.try_variant_get(p, "$.t", "string")
    kind = F.when(F.length("value") > longest, "long").when(t.isin("head", "rec", "end"), t).otherwise("bad")
    return lines.select(kind.alias("kind"), F.try_variant_get(p, "$.s", "string").alias("name"), "value").where("length(trim(value)) > 0")


def gates(heads: DataFrame) -> DataFrame:
    """heads (value, and what else) with ``gate``: ok for the first line of a dump that this version reads, newer for one of a
    later version, else not-dump."""
    p = F.try_parse_json("value")
    head = (F.try_variant_get(p, "$.t", "string") == "head") & (F.try_variant_get(p, "$.format", "string") == FORMAT)
    version = F.try_variant_get(p, "$.version", "int")
    return heads.withColumn("gate", F.when(F.coalesce(head & version.isNotNull(), F.lit(False)), F.when(version > VERSION, "newer").otherwise("ok")).otherwise("not-dump"))


def preview(lines: DataFrame, name: str, record_key: str, there: DataFrame) -> DataFrame:
    """One row of what a dump would bring, before any record is read in full: ``gate``, how many records of a table there are, how
    many of them are in ``there`` (key) by now, and whether the dump is cut short."""
    raw = lines.select("value")
    gate = gates(raw.where(F.col("value").startswith('{"t":"head"')).limit(1)).agg(F.coalesce(F.first("gate"), F.lit("not-dump")).alias("gate"))
    c = classified(raw)
    keys = c.where((F.col("kind") == "rec") & (F.col("name") == name)).select(F.get_json_object("value", f"$.v.{record_key}").alias("key"))
    known = there.select(F.col("key").cast("string").alias("key")).distinct().withColumn("_there", F.lit(1))
    counts = keys.join(known, "key", "left").agg(F.count("*").alias("n"), F.count("_there").alias("known"))
    cut = c.agg((F.count_if(F.col("kind") == "end") == 0).alias("truncated"))
    return gate.crossJoin(counts).crossJoin(cut)  # one row each


def read_dump(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    text = schema if isinstance(schema, str) else schema.simpleString()
    return records(read_lines(spark, path), name, text)


def records(lines: DataFrame, name: str, text: str) -> DataFrame:
    """A table's records out of classified lines."""
    rows = lines.where((F.col("kind") == "rec") & (F.col("name") == name))
    return rows.select(F.from_json("value", f"struct<v:{text}>" if text.startswith("struct") else f"v struct<{','.join(x.strip().replace(' ', ':', 1) for x in text.split(','))}>").alias("x")).select("x.v.*")


def dump_report(spark: SparkSession, path: str) -> DataFrame:
    """name, n, said: records read of each table against the end line; no end line means that the dump is cut short."""
    return report(read_lines(spark, path))


def report(lines: DataFrame) -> DataFrame:
    n = lines.where("kind = 'rec'").groupBy("name").agg(F.count("*").alias("n"))
    end = lines.where("kind = 'end'").select(F.explode(F.from_json(F.get_json_object("value", "$.counts"), "map<string,long>")).alias("name", "said"))
    bad = lines.groupBy().agg(F.count_if(F.expr("kind = 'bad'")).alias("bad"), F.count_if(F.expr("kind = 'long'")).alias("long"), (F.count_if(F.expr("kind = 'end'")) == 0).alias("truncated"))
    return n.join(end, "name", "full").crossJoin(bad)


def to_csv_lines(df: DataFrame) -> DataFrame:
    """Lines of a CSV file, the header first: cells guarded against formulas; ``at`` orders them."""
    head = df.sparkSession.createDataFrame([(-1, ",".join(df.columns))], "at long, value string")
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in df.columns]).alias("value"))
    return head.unionByName(rows)


def csv_text(df: DataFrame) -> DataFrame:
    """``at`` and ``value`` of the same lines as a file that spreadsheets open as UTF-8: a byte order mark before the header, a
    carriage return at the end of each line (the writer adds the line feed)."""
    mark = F.when(F.col("at") == -1, "\ufeff").otherwise("")
    return to_csv_lines(df).select("at", F.concat(mark, "value", F.lit("\r")).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Parts of a CSV file whose first one, in the order of their names, begins with the header."""
    csv_text(df).repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def manifest(files: DataFrame) -> DataFrame:
    """path, place, name of manifests (path, value): a JSON array of names, or an object that has one under ``posts``; names
    that are empty or no strings are left out, and what is no manifest has none."""
    p = F.try_parse_json("value")
    names = F.coalesce(F.try_variant_get(p, "$.posts", "array<string>"), F.try_variant_get(p, "$", "array<string>"))
    return files.select("path", F.posexplode(F.filter(names, lambda x: F.trim(x) != "")).alias("place", "name"))


def parse_csv(files: DataFrame, columns: list[str], rewinds: int = 20) -> DataFrame:
    """(path, line, cells..., note) out of whole files (path, value): a quote that never closes is taken as a plain
    character, so the rows after it are not lost; ``note`` says quote, short or wide."""

    def records(text: str) -> Iterator[tuple[list[str], str | None]]:
        lines = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        i = left = 0
        while i < len(lines):
            block, j = lines[i], i + 1
            while block.count('"') % 2 and j < len(lines):
                block, j = block + "\n" + lines[j], j + 1
            if block.count('"') % 2 and left < rewinds:
                left += 1
                yield lines[i].split(","), "quote"
                i += 1
                continue
            if block.strip():
                yield next(csv.reader(io.StringIO(block))), None
            i = j

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["value"]):
                rows = records(text or "")
                next(rows, None)  # the header
                for n, (cells, note) in enumerate(rows, 1):
                    note = note or ("short" if len(cells) < len(columns) else "wide" if len(cells) > len(columns) else None)
                    out.append((path, n, *(cells + [None] * len(columns))[: len(columns)], note))
            yield pd.DataFrame(out, columns=["path", "line", *columns, "note"])

    return files.select("path", "value").mapInPandas(run, ", ".join(["path string", "line long", *[f"`{c}` string" for c in columns], "note string"]))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """slug, title, date, tags, body of markdown files with a front-matter block."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("slug"), "value")
    return front_matter(raw)


def front_matter(raw: DataFrame) -> DataFrame:
    """(slug, value) to slug, title, date, tags, body."""
    block = F.regexp_extract("value", r"^﻿?---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    get = lambda k: F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^[ \t]*{k}[ \t]*:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    tags = F.regexp_replace(F.coalesce(get("tags"), F.lit("")), r"^\[(.*)\]$", "$1")
    body = F.regexp_replace("value", r"^﻿?---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|$)", "")
    return raw.select("slug", F.coalesce(get("title"), "slug").alias("title"), get("date").alias("date"), F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != "").alias("tags"), body.alias("body"))


def latest_posts(posts: DataFrame) -> DataFrame:
    """Newest first; posts without a readable date last."""
    return posts.orderBy(F.desc_nulls_last(F.try_to_timestamp("date")), "slug")


def notebooks(cells: DataFrame) -> DataFrame:
    """name, json out of cells (name, seq, kind, source): notebooks of a few cells each."""
    g = cells.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "source"))).alias("x"))
    none = F.create_map().cast("map<string,string>")
    made = F.transform("x", lambda c: F.struct(c["kind"].alias("cell_type"), none.alias("metadata"), F.array(c["source"]).alias("source")))
    return g.select("name", F.to_json(F.struct(F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"), none.alias("metadata"), made.alias("cells"))).alias("json"))
