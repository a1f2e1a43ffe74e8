"""Content keys and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

BASIS, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


@pandas_udf(StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a over UTF-8, 16 hex digits: texts of a batch advance together, a byte at a time."""
    raw = [x.encode() if x is not None else b"" for x in text]
    size = np.array([len(x) for x in raw])
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if len(raw) else size
    h = np.full(len(raw), BASIS, np.uint64)
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    with np.errstate(over="ignore"):
        for i, n in enumerate(live):
            h[:n] = (h[:n] ^ data[at[:n] + i]) * PRIME
    out = np.empty(len(raw), object)
    out[order] = [f"{int(x):016x}" for x in h]
    return pd.Series([o if x is not None else None for o, x in zip(out, text)])


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def hash_form(text: Column) -> Column:
    """NFKC, blanks collapsed, trimmed."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)  # plain ASCII is its own form and does not go to Python
    return F.trim(F.regexp_replace(F.coalesce(nfkc(odd), text), r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("s256:"), F.sha2(text, 256))


def cache_key(doc: Column, text: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws("|", kind, target, doc.cast("string"), F.sha2(text, 256))


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
