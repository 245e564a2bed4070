"""Byte-level BPE over a rank file, with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers as recent, and as many older ones. Results do not depend on it.
REMEMBERED = 500_000
#: Longer pre-tokens (in characters) are merged anew each time, which bounds the bytes of what is remembered.
KEPT = 128
#: Bits of a bitmap word: two levels cover a million ranks.
SHIFT = 10
LOW = (1 << SHIFT) - 1
BIT = [1 << i for i in range(LOW + 1)]


class Codec:
    """Encoder and decoder of one rank file; pre-tokens are matches of a pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Ranks of two-byte parts, by both bytes; -1 where they do not merge.
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.words = [0] * ((max(self.ranks.values()) >> SHIFT) + 1)
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the least rank merges first, of equal ranks the leftmost.

        The queue has a bucket of positions per merge rank and a bitmap of the occupied buckets in two
        levels: a word of 2**SHIFT bits for each run of ranks, and one of the words that are not zero. The
        least rank is one find-first-set a level. An entry is stale if its position has another rank by now.
        A pre-token of n bytes makes fewer than 3 n entries.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        get, words, top, buckets, pairs = ranks.get, self.words, 0, {}, self.pairs
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))  # where the part before begins
        rank_at = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # of the part here and the next; -1 if none
        rank_at.append(-1)
        # A bucket is one position or a list of several. (rank, position) pairs wait in `fresh` to enter theirs.
        fresh = [(rank, i) for i, rank in enumerate(rank_at) if rank >= 0]
        while True:
            for rank, i in fresh:
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = i
                    w = rank >> SHIFT
                    words[w] |= BIT[rank & LOW]
                    top |= BIT[w]
                elif held.__class__ is int:
                    buckets[rank] = [held, i]
                else:
                    held.append(i)
            if not top:
                break
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w << SHIFT | (word & -word).bit_length() - 1
            word &= word - 1
            words[w] = word
            if not word:
                top &= top - 1
            held = buckets.pop(rank)
            if held.__class__ is int:
                waiting = (held,)
            else:
                held.sort()
                waiting = held
            fresh = []
            for at, i in enumerate(waiting):
                if rank_at[i] != rank:
                    continue
                middle = end[i]
                stop = end[i] = end[middle]
                rank_at[middle] = -1
                early = False
                if stop < n:
                    before[stop] = i
                    wider = rank_at[i] = get(piece[i : end[stop]], -1)
                    if wider >= 0:
                        fresh.append((wider, i))
                        early = wider <= rank
                else:
                    rank_at[i] = -1
                if i:
                    left = before[i]
                    wider = rank_at[left] = get(piece[left:stop], -1)
                    if wider >= 0:
                        fresh.append((wider, left))
                        early = early or wider <= rank
                if early:
                    # A pair that comes first has formed: the rest of this bucket waits again.
                    fresh += [(rank, j) for j in waiting[at + 1 :]]
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def __call__(self, text: str) -> list[int]:
        """The ids of a text, without special tokens."""
        recent, older = self.recent, self.older
        pieces = self.pattern.findall(text)
        long = []
        for new in set(pieces).difference(recent):
            recent[new] = older.get(new) or self.merge(new.encode())
            if len(new) > KEPT:
                long.append(new)
        ids = list(chain.from_iterable(map(recent.__getitem__, pieces)))
        for piece in long:
            del recent[piece]
        if len(recent) > REMEMBERED:
            self.recent, self.older = {}, recent
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, shared by its tasks."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text. A null text is empty and has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [of(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, f"{id_col} long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256 of the decoded ids.

    Null texts are empty: no tokens, and the digests of nothing. Repeated rows and null ids are
    returned as they are; an empty table gives no rows; other columns are ignored. The ids of a text stay
    in the task that made them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        decimal = [str(i) for i in range(max(of.tokens) + 1)]
        sha = hashlib.sha256
        gc.disable()  # nothing here is cyclic, and the remembered tuples are many
        try:
            for batch in batches:
                n, left, right = [], [], []
                for t in batch.column(1):
                    ids = of(t.as_py() or "")
                    n.append(len(ids))
                    left.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    right.append(sha(of.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
