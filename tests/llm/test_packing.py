import random
import zlib

import numpy as np
import pytest

import public_tokenizers
from tessera.llm import packing
from tessera.llm.packing import Capacities, best_fit_decreasing, pack_matrix, pack_online, unpack_matrix
from tessera.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def texts(seed, n=120, top=900):
    r = random.Random(seed)
    odd = ["don't", "L'été", "it's", "!!'s", "naïve…", "x9y", "12345", "ÀB", "日本語", "é", " ", "\x1f", "A.B,c", "#$%", "İ", "ſ", "ΣΑΣ", " ", "'tis", "a'", "😀!", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "é<|EndOfText|>É", "<|endoftext", "é<|endoftext|>"]
    word = lambda: r.choice(odd) if r.random() < 0.2 else "".join(r.choice("abcDEfg.,!") for _ in range(r.randint(1, 9)))
    out = [None, "", "   ", "one", "<|endoftext|> x"]
    for _ in range(n):
        out.append(r.choice([" ", "\n", "\t"]).join(word() for _ in range(r.randint(0, top))))
    return out


def test_encoder_equals_the_tokenizer(reference):
    e = Encoder(PATH)
    t = texts(1, 60)
    for _ in range(2):  # learned and remembered
        raw = [(x or "").encode() for x in t]
        ids, at = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        for i, x in enumerate(t):
            assert ids[at[i] : at[i + 1]].tolist() == reference(x), repr(x)[:200]


def test_long_texts_are_encoded_in_parts(reference, monkeypatch):
    from tessera.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 50)
    for t in [" ".join(x for x in texts(7, 40) if x), "é" * 300 + " a" * 90, "x" * 5000, " " * 400, "ab " * 70 + "<|endoftext|>" * 12]:
        data = np.frombuffer(t.encode(), np.uint8)
        ids, at = Encoder(PATH).encode(data, np.array([0, len(data)]))
        assert ids.tolist() == reference(t) and at.tolist() == [0, len(ids)]


@pytest.mark.parametrize("size,parts", [(64, 3), (4096, 7)])
def test_online_pieces_are_whole(spark, reference, size, parts, monkeypatch):
    t = texts(2)
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(t)], "doc_id long, text string, part int").repartition(parts)
    monkeypatch.setattr(packing, "FAN", 2)
    rows = pack_online(df, PATH, size=size, windows=4).toPandas()
    for i, x in enumerate(t):
        ids = np.array([*reference(x), 2], "<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() == len(ids)
        assert (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= size
    used = rows.groupby("sequence_id").length.sum()
    assert used.sum() / (len(used) * size) > (0.95 if size == 64 else 0.9)


def test_ids_null_large_and_repeated(spark):
    big = 2**53 + 1
    rows = [(big, "a b c"), (None, "d e"), (None, None), (5, "x y"), (5, "x y"), (-big, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in pack_online(df, PATH).collect()]
    key = lambda x: (x is None, x or 0)
    assert sorted(got, key=key) == sorted([r[0] for r in rows], key=key)
    got = [d for r in pack_matrix(df, PATH).collect() for d in r.doc_ids]
    assert sorted(got, key=key) == sorted([r[0] for r in rows], key=key)


def test_a_text_above_a_slice(spark, reference):
    t = " ".join(f"w{i % 977} é{i % 13}" for i in range(150_000))
    assert len(t.encode()) > 1 << 20
    rows = pack_online(spark.createDataFrame([(1, t), (2, "a")], "doc_id long, text string"), PATH).toPandas()
    ids = np.array([*reference(t), 2], "<u4")
    own = rows[rows.doc_id == 1].sort_values("start")
    assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] and own.length.sum() == len(ids)


def test_online_empty(spark):
    assert pack_online(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_segment_tree_finds_the_best_fit():
    r = random.Random(5)
    tree, rooms = Capacities(100), []
    for k in range(2000):
        if rooms and r.random() < 0.5:
            need = r.randint(1, 100)
            fit = [x for x in rooms if x[0] >= need]
            got = tree.take(need)
            assert (got is None) == (not fit)
            if got:
                assert got[1] == min(fit)[0] and (got[1], got[0]) in rooms
                rooms.remove((got[1], got[0]))
        else:
            x = (r.randint(1, 100), k)
            rooms.append(x)
            tree.add(*x)


def test_best_fit_decreasing_is_full():
    n = np.random.default_rng(1).integers(1, 101, 5000)
    bins, offs = best_fit_decreasing(n, 100)
    total = np.bincount(bins, n)
    assert total.max() <= 100 and total.mean() > 98
    for b in range(50):
        own = bins == b
        o = np.argsort(offs[own])
        assert offs[own][o].tolist() == [0, *np.cumsum(n[own][o])[:-1].tolist()]


def test_matrix_round_trip(spark, reference):
    t = texts(3, 80)
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(2)
    rows = pack_matrix(df, PATH, size=128, chunk=2000).toPandas()
    assert unpack_matrix(rows) == {i: [*reference(x), 2] for i, x in enumerate(t)}
    for r in rows.itertuples():
        pos = np.frombuffer(r.position_ids, "<u4")
        assert len(pos) == len(r.input_ids) // 4 == 128 and r.cu_seqlens[-1] == r.n_tokens
        for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
    assert rows.sequence_id.is_unique
    assert pack_matrix(df.limit(0), PATH).count() == 0


def test_written_matrix_reads_again(spark, reference, tmp_path):
    from tessera.llm.packing import write_packed

    t = texts(5, 20)
    write_packed(pack_matrix(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), PATH, size=64), f"file://{tmp_path}/m")
    rows = spark.read.parquet(f"file://{tmp_path}/m").toPandas()
    assert unpack_matrix(rows) == {i: [*reference(x), 2] for i, x in enumerate(t)}
