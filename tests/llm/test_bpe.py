import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.bpe import Codec, decode, encode
from tessera.llm.common import read
from tessera.llm.lexicon import Lexicon, automaton, compiled

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\r\n", "Hello, World's don't 'RE 12 a1b2", "<|endoftext|>x<|ENDOFTEXT|> a<|startoftext|>B <| |>", "J̌ KK İ İ ẛ̣  x y　z", "naïve café 한국어 กำ \U0001f600‍♂ ٣²Ⅷ", "x\x00y\x1c\x1dz\x7f \x85 \x0b", "a" * 3000 + "é" * 300 + "!" * 999, "it's it’s 'tis rock'n'roll ''' 's's", "ΣΙΣ ßẞ ﬁ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_lexicon_is_minimal_and_exact(tmp_path):
    r = random.Random(3)
    words = sorted({bytes(r.choice(b"ab\xc3") for _ in range(r.randrange(0, 7))) for _ in range(300)})
    states, first = automaton(words)

    def ends(s):
        return (states[s][0], tuple((x, ends(t)) for x, t in states[s][1]))

    assert len({ends(s) for s in range(len(states))}) == len(states)  # no two states have the same continuations
    tails = {w[:i]: frozenset(v[i:] for v in words if v.startswith(w[:i])) for w in words for i in range(len(w) + 1)}
    assert len(states) == len(set(tails.values()))
    f = tmp_path / "x"
    f.write_bytes(compiled({w: [i, i + 1] for i, w in enumerate(words)}))
    lex = Lexicon(str(f))
    asked = [*words, *(bytes(r.choice(b"abc\xc3") for _ in range(r.randrange(0, 9))) for _ in range(500))]
    at = np.cumsum([0, *map(len, asked)])
    got = lex.find(np.frombuffer(b"".join(asked), np.uint8), at[:-1], at[1:]).tolist()
    assert got == [words.index(w) if w in words and w else -1 for w in asked]
    assert lex.ids[lex.start[5] : lex.start[6]].tolist() == [5, 6]


def same(tokenizer, texts, codec):
    data = [t.encode() for t in texts]
    ids, at = codec.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        assert codec.decode(own).decode() == tokenizer.decode(own.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("known", [[], ["hello", ",", "don't", "naïve", "1", "a", "the", "J̌"]])
def test_odd_texts_one_by_one_and_together(tokenizer, tmp_path, known):
    rules = bpe.Merges(PATH)
    (tmp_path / "x").write_bytes(compiled({w.encode(): rules.ids(w.encode()) for w in known}))
    codec = Codec(PATH, str(tmp_path / "x"))
    for t in ODD:
        same(tokenizer, [t], codec)
    same(tokenizer, ODD, codec)
    r = random.Random(8)
    letters = "aZ'1 <|>é̌éÉKK.,\n\t İ\U0001f600sdtm"
    same(tokenizer, ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)], codec)


def test_long_text_in_parts(tokenizer, tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(compiled({}))
    codec = Codec(PATH, str(tmp_path / "x"))
    monkeypatch.setattr(bpe, "SLICE", 50)
    same(tokenizer, ["It's a long <|endoftext|> text, with naïve words 123\n" * 40 + "x" * 500], codec)


def test_table_against_the_tokenizer(spark, small, tokenizer):
    docs = read(spark, small, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(i, t) for i, t in enumerate([None, *ODD, ODD[2]])] + [(None, "a"), (7, "a")], "doc_id long, text string")
    rows = docs.unionByName(more).repartition(3)
    full = rows.selectExpr("*", "1 AS ids", "2 AS n_tokens", "text AS decoded")
    got = sorted(((x.doc_id or -1, x.n_tokens, bytes(x.ids), x.decoded) for x in encode(full, PATH, most=700).collect()))
    want = []
    for x in rows.collect():
        ids = tokenizer.encode(x.text or "", add_special_tokens=False).ids
        want.append((x.doc_id or -1, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    back = decode(encode(rows, PATH, most=700), PATH)
    assert sorted((x.doc_id or -1, x.text) for x in back.collect()) == sorted((i, t) for i, _, _, t in want)
    assert encode(docs.limit(0), PATH).count() == 0


def test_frequent_words_of_all_texts(spark):
    docs = spark.createDataFrame([(1, "a b. a A it's"), (2, "a " * 9 + "<|x|> " + "y" * 50), (3, None)], "doc_id long, text string")
    assert {(r.piece, r.n) for r in bpe.frequent(docs).collect()} == {("a", 12), ("b", 1), (".", 1), ("it's", 1)}
    assert [(r.piece, r.n) for r in bpe.frequent(docs, 3).collect()] == [("a", 12)]
    assert bpe.frequent(docs.limit(0)).count() == 0


def test_query_digests(spark, small, tokenizer):
    from tessera.llm.queries import op13_bpe_lexicon

    got = {x.doc_id: x for x in op13_bpe_lexicon(spark, small).collect()}
    docs = read(spark, small, "documents").collect()
    assert len(got) == len(docs)
    for x in docs:
        ids = tokenizer.encode(x.text or "", add_special_tokens=False).ids
        g = got[x.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
