"""Packing documents into training sequences by lexical retrieval."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.session import materialize

#: Tokens of a sequence; the id that ends a document; the size of the vocabulary, which fits 16 bits.
CONTEXT, END, VOCABULARY = 2048, 1, 50_257
#: Document rests of one shard of the inverted index; candidates of a seed are the unused of its shard.
SHARD = 512
K1, B = 1.2, 0.75
#: Characters beyond those for which both tokenizer libraries agree on letters, digits and white space.
RARE = re.compile("[^\x00-ɏ‐-‧₠-₿]")
SPECIAL = "<|endoftext|>"

PIECE = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def _from_file(json_path: str) -> Tokenizer:
    """The tokenizer file, read by the first text of a worker that needs it: it holds 31 MB."""
    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=1)
def tokenizer(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as the tokenizer file gives them, without special tokens added.

    The rank file holds the same vocabulary and merges; its library is several times as fast, and
    texts with rarer characters or the special string itself go to the tokenizer file.
    """
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if SPECIAL in text or not (text.isascii() or RARE.search(text) is None):
            return _from_file(json_path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def tokenize(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ids): the ids of each whole text and the end id, as 16-bit little-endian numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(json_path, ranks_path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                packed = [np.array([*of(t.as_py() or ""), END], "<u2").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(packed, pa.binary())], ["doc", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "doc long, ids binary")


def _numbers(ids: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(ids.as_py(), "<u2")


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Of every id in how many documents it occurs; the number of documents; their mean length.

    Tasks count their documents into one row per id, so what is shuffled and collected is bounded by the
    vocabulary, whatever the size of the corpus.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, total = np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in batches:
            for x in batch.column(0):
                ids = _numbers(x)
                seen[np.unique(ids)] += 1
                n, total = n + 1, total + len(ids)
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2]), pa.int64()), pa.array(np.append(seen[terms], [n, total]), pa.int64())], ["term", "n"])

    rows = tokens.select("ids").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(VOCABULARY, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    n = found.get(-1, 0)
    return df, n, found.get(-2, 0) / max(1, n)


class Shard:
    """A BM25 inverted index of some document rests: postings by term, in arrays."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.terms = []
        docs, tfs = [], []
        for i, ids in enumerate(rests):
            t, tf = np.unique(ids, return_counts=True)
            self.terms.append(t)
            docs.append(np.full(len(t), i))
            tfs.append(tf)
        terms, docs, tf = np.concatenate(self.terms), np.concatenate(docs), np.concatenate(tfs).astype(np.float64)
        lengths = np.array([len(r) for r in rests], np.float64)
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / mean_length))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights, self.size = docs[order], weight[order], len(rests)
        self.first = np.searchsorted(terms[order], np.arange(VOCABULARY + 1))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every rest in the shard for a query of these distinct terms."""
        begin, end = self.first[terms], self.first[terms + 1]
        n = end - begin
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.docs[at], self.weights[at], minlength=self.size)


class Packer:
    """Fills windows of one partition, shard by shard; a window left open goes on with the next shard."""

    def __init__(self, idf: np.ndarray, mean_length: float, base: int) -> None:
        self.idf, self.mean_length, self.sequence = idf, mean_length, base
        self.open: list[tuple[int, int, np.ndarray, int]] = []
        self.room, self.query = CONTEXT, None
        self.rests: list[list] = []
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple[int, int, np.ndarray, int]]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // CONTEXT * CONTEXT
        for at in range(0, whole, CONTEXT):
            self._emit([(doc, at, ids[at : at + CONTEXT], len(ids))])
        if whole < len(ids):
            self.rests.append([doc, whole, ids[whole:], len(ids)])
            if len(self.rests) == SHARD:
                self.pack()

    def _place(self, rest: list, n: int) -> None:
        doc, start, ids, total = rest
        self.open.append((doc, start, ids[:n], total))
        rest[1], rest[2] = start + n, ids[n:]
        self.room -= n
        if not self.room:
            self._emit(self.open)
            self.open, self.room, self.query = [], CONTEXT, None

    def pack(self) -> None:
        """Pack all rests of the shard. Each seed's window takes all unused neighbours that fit, best first,
        then the best of those left is cut to fill it; its remainder stays unused."""
        rests, self.rests = self.rests, []
        if not rests:
            return
        index = Shard([r[2] for r in rests], self.idf, self.mean_length)
        unused, lengths = np.ones(len(rests), bool), np.array([len(r[2]) for r in rests])
        seed = 0
        while unused.any():
            if self.query is None:
                while not unused[seed]:
                    seed += 1
                self.query = index.terms[seed]
                self._place(rests[seed], len(rests[seed][2]))
                unused[seed] = False
                continue
            scores = np.where(unused, index.scores(self.query), -1.0)
            order = np.argsort(-scores, kind="stable")
            order = order[: int(unused.sum())]
            while self.query is not None:
                whole = order[unused[order] & (lengths[order] <= self.room)]
                if not len(whole):
                    break
                self._place(rests[whole[0]], lengths[whole[0]])
                unused[whole[0]] = False
            for i in order[unused[order]]:
                if self.query is None:
                    break
                self._place(rests[i], min(lengths[i], self.room))
                lengths[i] = len(rests[i][2])
                unused[i] = lengths[i] > 0

    def finish(self) -> None:
        """Pack what is left. The last window is dealt into sequences of powers of two, which need no padding."""
        self.pack()
        pieces, self.open = self.open, []
        while pieces:
            n = sum(len(p[2]) for p in pieces)
            size, taken = 1 << (n.bit_length() - 1), []
            while size:
                doc, start, ids, total = pieces[0]
                k = min(size, len(ids))
                taken.append((doc, start, ids[:k], total))
                size -= k
                if k == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + k, ids[k:], total)
            self._emit(taken)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, its end id included, lies in exactly one piece; sequences hold 2048 ids,
    or a power of two at the end of a partition. Documents are put in the order of their two rarest ids
    (by BM25 weight, from counts over all documents), so that the bounded shards of the index hold
    related ones; a run of copies of any length is cut into shards like any other.

    A null text is empty: its piece is the end id. Null ids and repeated rows are packed as they are;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tokens, _ = materialize(tokenize(docs, json_path, ranks_path, pattern, id_col, text_col), "pack-tokens")
    df, n, mean_length = document_frequencies(tokens)
    # One number for each id of the vocabulary.
    idf = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
    # The rarer of two ids in more than one document has the smaller number; ids of one document alone come last.
    rarity = np.where(df > 1, df, 1 << 40) << 16 | np.arange(VOCABULARY)
    shared = spark.sparkContext.broadcast(rarity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            keys = []
            for x in batch.column(1):
                own = rarity[_numbers(x)]
                first = own.min()
                second = own[own != first].min(initial=1 << 62)
                keys.append((int(first & 0xFFFF), int(second & 0xFFFF)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())], ["doc", "ids", "first", "second"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(idf.value, mean_length, TaskContext.get().partitionId() << 33)
        kinds = pa.schema([(name, pa.int64()) for name in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, _numbers(ids))
                if len(packer.out) > 4096:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    order = ["first", "second", "doc", F.octet_length("ids"), F.crc32("ids")]
    dealt = tokens.mapInArrow(place, "doc long, ids binary, first int, second int").repartitionByRange("first", "second", "doc", F.crc32("ids")).sortWithinPartitions(*order)
    return dealt.select("doc", "ids").mapInArrow(work, PIECE).withColumnRenamed("doc", id_col)
