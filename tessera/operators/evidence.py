"""Quotes found in paragraphs: candidates by the words of both sides' forms, then places in the text as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.forms import forms, quote_place
from tessera.operators.search import meeting


def candidates(paras: DataFrame, quotes: DataFrame) -> DataFrame:
    """para, text, quote_id, quote: paragraphs (para, text) of which a form holds that of a quote (quote_id, quote). A form is
    made once. Loose words serve both: a quote's inner words are the same in its loose form and in that of any text that
    holds it in either form."""
    p = paras.select("para", "text", forms("text").alias("f")).select("para", "text", "f.*")
    q = quotes.select("quote_id", "quote", forms("quote").alias("f")).select("quote_id", "quote", F.col("f.normal").alias("q_normal"), F.col("f.loose").alias("q_loose"))
    near = meeting(p, q.where("q_normal <> ''"), "para", "quote_id", "loose", "q_loose")
    held = "contains(normal, q_normal) OR q_loose <> '' AND contains(loose, q_loose)"
    return near.where(held).select("para", "text", "quote_id", "quote")


def places(paras: DataFrame, quotes: DataFrame) -> DataFrame:
    """para, quote_id, how, start, end of every paragraph that holds a quote at whole words: text[start:end] is what it holds."""
    c = candidates(paras, quotes)
    return c.select("para", "quote_id", quote_place("text", "quote").alias("p")).where("p.how IN ('exact', 'loose')").select("para", "quote_id", "p.*")


def found(paras: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id, para, how, start, end: the paragraph (para, seq, text) of each quote (quote_id, quote, claimed): an exact one
    before a loose one, of these the claimed one, else the first. Quotes that stand nowhere have no row."""
    p = places(paras, quotes).join(paras.select("para", "seq"), "para").join(quotes.select("quote_id", "claimed"), "quote_id")
    order = F.struct(F.col("how") == "loose", ~F.col("para").eqNullSafe(F.col("claimed")), F.col("seq"))
    return p.groupBy("quote_id").agg(F.min_by(F.struct("para", "how", "start", "end"), order).alias("x")).select("quote_id", "x.*")
