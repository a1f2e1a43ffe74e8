"""A search table derived from texts: postings of three folded characters, from which candidates come before any text is read.

A gram's id is exact: its three code points in one whole number. Postings are stored in ranges of (gram, key), so a search
reads the row groups of its grams alone, and a frequent gram lies in many files. Of each spelling's grams the rarest are
looked up; texts that hold them all are candidates, and only these are folded and searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from tessera.functions.text import fold, fold_char
from tessera.operators import search

#: Characters of a gram, and grams of a spelling that are looked up.
SIZE, RARE = 3, 4
#: Postings of a file, about: a task sorts no more.
FILE_ROWS = 4_000_000


def _ids(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < SIZE:
        return np.zeros(0, np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


@pandas_udf(ArrayType(LongType()))
def gram_ids(text: pd.Series) -> pd.Series:
    return pd.Series([_ids(t) if t else [] for t in text])


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """gram, key: each gram of each folded text once. Null texts and those of fewer than three characters have none."""
    return docs.select(key, F.explode(gram_ids(fold(F.col(text)))).alias("gram")).select("gram", key)


def stored(rows: DataFrame, folder: str, files: int, key: str = "doc_id", most: int = 0) -> DataFrame:
    """Postings written so that a gram's rows stand together, and those of a frequent one in several files: so many, or more
    if ``most`` rows would make these too large."""
    rows.repartitionByRange(max(files, -(-most // FILE_ROWS)), "gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def frequencies(rows: DataFrame) -> DataFrame:
    """gram, n: in how many texts a gram is."""
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


def candidates(rows: DataFrame, query: str, key: str = "doc_id") -> DataFrame | None:
    """key: texts that may hold the query, by postings; None where a spelling is too short to say (all texts may)."""
    q = search.parse(query)
    spellings = [sorted(set(_ids("".join(map(fold_char, v))).tolist())) for v in q.variants]
    if q.error or not all(spellings):
        return None
    asked = sorted({g for s in spellings for g in s})  # some 60 for each of VARIANTS spellings at most
    seen = {r.gram: r.n for r in frequencies(rows.where(F.col("gram").isin(asked))).collect()}
    found = None
    for s in spellings:
        rare = sorted(s, key=lambda g: (seen.get(g, 0), g))[:RARE]
        own = rows.where(F.col("gram").isin(rare)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(key)
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def counted(docs: DataFrame, rows: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What search.counted() finds, by way of the postings: only candidates' texts are folded and searched."""
    c = candidates(rows, query, key)
    return search.counted(docs if c is None else docs.join(c, key, "left_semi"), query, key, text)
