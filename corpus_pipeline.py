"""A corpus pipeline of five stages: quality, near copies, repeated strings, the mix of sources, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's rows to the
shared folder and reads them again, as a driver would between jobs. Columns beside those of documents stay as they are, by
whatever names; an empty table goes through as an empty one; stages can be chained without writing between them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Saved, read, saved_here
from tessera.llm.mixing import mixed
from tessera.llm.neardup import drop_near_duplicates
from tessera.llm.packing import pack_online
from tessera.llm.quality import fit, scored
from tessera.llm.repeats import strip_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 1; it learns from the labelled ones among them and the labels of sf_dir. Null
    and empty texts are judged like any other; repeated rows are judged alike, and so kept or gone together."""
    model = fit(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).where("score >= 0.5").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. The least doc_id stays, a null one
    only if there is no other; null and empty texts are copies of each other."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes or more that stand anywhere else, n_chars with them; a text that is empty then goes, a
    null one stays."""
    out = strip_repeats(docs, min_bytes=200)
    return out.where((F.length("text") > 0) | F.col("text").isNull())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most. A null source is one of its own, the last;
    null and empty texts have no size and are taken by their source's rate."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4096 tokens; a null or empty text is the closing id alone."""
    return pack_online(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, last_id=2)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: Tokens and fitted rules are not SQL's; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each other stage is written and read again; then what it had saved and what it read go."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with saved_here() as used:
            out = stage(spark, docs, sf_dir)
        now = Saved(out)
        for x in [*used, before]:
            if x is not None:
                x.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
