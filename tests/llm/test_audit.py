import os
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tessera.llm import audit as module
from tessera.llm.audit import audit, masked
from tessera.llm.common import read
from tessera.llm.queries import SQL


def failed(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        out.append((i, lang or "", sum(x << k for k, x in enumerate(tests))))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    out = {}
    rows = failed(rows)
    for part in {p for _, p, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, m) for i, p, m in rows if p == part]
            gone = []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                here = [(i, m) for i, m in left if m & bit]
                redundant = sum(bool(m & bit) for _, m in gone)
                left = [(i, m) for i, m in left if not m & bit]
                gone += here
                out[part, order, step] = [len(left), len(here), redundant, sum(m == bit for _, p, m in rows if p == part), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return {k: (*x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def as_dict(df):
    got = [((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


WORDS = " ".join(f"w{i}" for i in range(250))
ROWS = [(5, WORDS, "en"), (3, WORDS, "de"), (3, WORDS, "de"), (None, WORDS, None), (9, WORDS, ""), (1, None, None), (2, "", "en"), (8, WORDS + "#", "en"), (7, WORDS.upper() + " #", "en"), (6, "a b " * 300, "en"), (4, "a b " * 300, "fr"), (10, "é" * 2000 + " ×", "fr"), (11, "é" * 2000 + " Z", "fr"), (12, "x " * 40000 + "y", "en"), (13, "x " * 40000 + "z", "en"), (14, "x " * 40000 + "y", "en")]
LABELS = [(5, 1, 0), (5, 0, 1), (3, 1, None), (9, 0, 0), (7, None, 1), (None, 1, 1), (14, 1, 1)]


@pytest.mark.parametrize("sent", [module.MOST_SENT, 0])
def test_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(module, "MOST_SENT", sent)
    docs = spark.createDataFrame([(*r, "m") for r in ROWS], "doc_id long, text string, lang string, mask string").repartition(3)
    assert sorted(((r.doc_id or -1, r.part, r.mask) for r in masked(docs).collect())) == sorted((i or -1, p, m) for i, p, m in failed(ROWS))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert as_dict(audit(docs, labels)) == brute(ROWS, LABELS)
    assert audit(docs.limit(0), labels).count() == 0


def test_names_that_meet_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(module, "_hash", lambda c: F.length(c).cast("long"))
    rows = [*ROWS, (20, "ab", "en"), (21, "cd", "en"), (22, "ab", "en"), (23, "cd", "en"), (20, "cd", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(((r.doc_id or -1, r.part, r.mask) for r in masked(docs).collect())) == sorted((i or -1, p, m) for i, p, m in failed(rows))


def test_given_tables_and_sql(spark, small):
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    got = as_dict(audit(docs, labels))
    assert got == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    r = c.execute(SQL["op12_filter_audit"])
    names = [x[0] for x in r.description]
    at = [names.index(x) for x in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert {tuple(x[i] for i in at[:3]): tuple(x[i] for i in at[3:]) for x in r.fetchall()} == got
