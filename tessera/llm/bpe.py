"""Whole texts to token ids and back, exactly as a public tokenizer file says, with a lexicon of frequent words.

The most frequent words of the corpus, counted over all documents, are compiled with their ids into a minimal acyclic
transducer (lexicon.py); the file goes to the shared folder and from there to every executor, where workers map it. A word
that is not in it is merged by the file's ranks. What the lexicon holds decides speed alone.

A word is what stands between ASCII blanks. ASCII words without apostrophes are folded and parted into letters, single
digits and signs, which the tokenizer treats alone; other words stay whole and raw, as normal forms and contractions may
depend on all of them. For files whose pre-tokenizer splits at every blank and drops it, and folds case
(word_bpe_49k.json), with NFC, byte-level symbols and no decoder: decoded text is the tokens with a space between.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Saved, buffers, lean, shared_dir, slices
from tessera.llm.lexicon import Lexicon, compiled

#: Words of the lexicon at most, and bytes of a word at most: they bound what the driver and a file hold (some 10 MB).
MOST, LONGEST = 1 << 16, 40
#: Words that a worker remembers beside the lexicon; beyond, it starts anew.
REMEMBER = 200_000
#: Bytes of text that are encoded together; a longer text goes in parts, cut at blanks.
SLICE = 1 << 20

_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = _KIND[39] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Merges:
    """The tokenizer file's own rules: any word to ids by merging, ids to tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.token = [b""] * (max(self.tokenizer.get_vocab(True).values()) + 1)
        for t, i in self.tokenizer.get_vocab(True).items():
            self.token[i] = t.encode()
        self.complete = all(self.token)

    def merged(self, symbols: str) -> list[int]:
        """Of a word's byte symbols the pair of least rank is merged, the leftmost first, until no pair has a rank."""
        return [x.id for x in self.tokenizer.model.tokenize(symbols)]

    def ids(self, word: bytes) -> list[int]:
        """Of a piece as cut() makes them, or of any text without an added token."""
        if b"<|" in word:  # perhaps an added token, which is found before all else
            return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        if word.isascii() and word.isalnum() and not word[0:1].isdigit() and word.islower():
            return self.merged(word.decode())
        normal = self.tokenizer.normalizer.normalize_str(word.decode())
        return [y for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for y in self.merged(x)]


    def text(self, ids: np.ndarray) -> bytes:
        """The tokens with a space between; ids without a token say nothing."""
        if not self.complete or len(ids) and ids.max() >= len(self.token):
            ids = np.array([i for i in ids.tolist() if i < len(self.token) and self.token[i]], np.int64)
        token = self.token
        return b" ".join([token[i] for i in ids.tolist()])


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some texts' bytes into pieces whose ids do not depend on each other: (folded bytes, starts, ends)."""
    n = len(data)
    kind = _KIND[data]
    word = kind > 0
    kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = 4
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return data, at, at
    whole = np.zeros(n, bool)
    whole[at[0] :] = np.repeat(np.bitwise_or.reduceat(kind == 4, at), np.diff(np.append(at, n)))
    begin = first
    begin[1:] |= word[1:] & ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    end = word.copy()
    end[:-1] &= ~word[1:] | begin[1:]
    return np.where(whole, data, _LOWER[data]), np.flatnonzero(begin), np.flatnonzero(end) + 1


class Codec:
    def __init__(self, path: str, lexicon: str):
        self.rules, self.lexicon = Merges(path), Lexicon(lexicon)
        self.other: dict[bytes, list[int]] = {}

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts' UTF-8 bytes, and n + 1 places of the texts in them."""
        n = len(data)
        if len(offs) > 2 or n <= 2 * SLICE:
            return self._encode(data, offs)
        got, a = [], 0
        while a < n:
            b = min(n, a + SLICE)
            while b < n and _KIND[data[b]]:
                b += 1
            got.append(self._encode(data[a:b], np.array([0, b - a]))[0])
            a = b
        return np.concatenate(got), np.array([0, sum(map(len, got))])

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        data, a, b = cut(data, offs)
        number = self.lexicon.find(data, a, b)
        start = self.lexicon.start[number]
        count = self.lexicon.start[1:][number] - start if len(self.lexicon.start) > 1 else np.zeros_like(start)
        table, more = self.lexicon.ids, []
        unseen = np.flatnonzero(number < 0)
        if len(unseen):
            raw, size = data.tobytes(), len(table)
            for i, x, y in zip(unseen.tolist(), a[unseen].tolist(), b[unseen].tolist(), strict=True):
                w = raw[x:y]
                ids = self.other.get(w)
                if ids is None:
                    if len(self.other) >= REMEMBER:
                        self.other.clear()
                    ids = self.rules.ids(w)
                    if len(w) <= 100:
                        self.other[w] = ids
                start[i], count[i] = size + len(more), len(ids)
                more.extend(ids)
            table = np.concatenate([table, np.array(more, np.int32)])
        out = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = table[np.repeat(start - out[:-1], count) + np.arange(out[-1])]
        return ids, out[np.searchsorted(a, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.rules.text(ids)


_open: dict[tuple[str, str], Codec] = {}


def _codec(path: str, name: str) -> Codec:
    """One for each worker: later tasks find what earlier ones remembered."""
    if (path, name) not in _open:
        _open.clear()
        _open[path, name] = Codec(path, SparkFiles.get(name))
    return _open[path, name]


def frequent(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(piece, n): the pieces of words, as cut() makes them, that occur most often in all texts, ``most`` at most. Words are
    counted first, so pieces are only cut from distinct words. How many pieces have which count (in steps of a sixteenth of
    a doubling) gives the count from which on pieces are taken, so no task sends more than it has of these."""
    word = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    words = docs.select(word.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    parted = F.col("w").rlike(r"\A[\x00-\x26\x28-\x7f]+\z") & ~F.col("w").contains("<|")
    piece = F.when(parted, F.regexp_extract_all(F.lower("w"), F.lit("[a-z]+|[0-9]|[^a-z0-9]+"), F.lit(0))).otherwise(F.array("w"))
    pieces = words.select(F.explode(piece).alias("piece"), "n").where((F.octet_length("piece") <= LONGEST) & ~F.col("piece").contains("<|"))
    pieces = Saved(pieces.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    least, taken = 1 << 30, 0
    for step, k in pieces.df.groupBy("step").count().orderBy(F.desc("step")).collect():  # some 16 x 64 rows at most
        taken += k
        if taken > most:
            break
        least = step
    return pieces.df.where(F.col("step") >= least).select("piece", "n")


def send_lexicon(spark: SparkSession, words: Iterable[str], path: str) -> str:
    """Compiles words with their ids, writes the file to the shared folder and gives it to all executors, later ones too."""
    rules = Merges(path)
    name = f"lexicon-{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/tessera/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(compiled({w.encode(): rules.ids(w.encode()) for w in words})))
    finally:
        out.close()
    spark.sparkContext.addFile(at)
    return name


CODED = "doc_id long, n_tokens long, ids binary, decoded string"
_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode(docs: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit whole numbers, in bytes) and the text decoded from them, one row for each
    of ``docs`` (doc_id, text).

    A null text is an empty one: no ids and an empty decoded text. Rows that share an id, or have none, each have a row; a
    very long text is encoded in parts; other columns take no part, whatever they are called; no rows give no rows.
    """
    name = send_lexicon(docs.sparkSession, [x.piece for x in frequent(docs, most).collect()], path)

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, name)
        for t in slices(batches, 1, SLICE):
            ids, at = codec.encode(*buffers(t.column(1)))
            own = [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            columns = [t.column(0).combine_chunks(), pa.array(np.diff(at)), pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()), pa.array([codec.decode(x).decode() for x in own], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_CODED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ``rows`` (doc_id, ids as encode() gives them). Null ids are none; ids without a token say nothing."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Merges(path)
        for t in batches:
            texts = [rules.text(np.frombuffer(x.as_py() or b"", "<u4")).decode() for x in t.column(1)]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
