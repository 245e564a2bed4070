"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trie nodes that a worker holds, beyond which the trie starts anew; and terminal counts that it remembers
#: as recent, and as many older ones. Results do not depend on either.
NODES, TERMINALS = 800_000, 400_000
#: Pre-tokens of more characters do not enter the trie.
LONGEST = 1_024


class PieceTrie:
    """Best forward score and token count of every prefix seen, each computed once.

    A piece of rank r has the log-probability -ln(r + 1) up to a constant (Zipf's law over the public
    ranks; nothing is trained). A prefix's score is the best over its last pieces; of equal scores the
    one with fewer tokens counts. Every byte is a piece, so every prefix has a segmentation.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        total = math.log(sum(1 / (r + 1) for r in ranks.values()))
        # Every ending of a piece, with the log-probability where it is a piece itself, else minus infinity: the
        # search for last pieces stops at the first string that ends none.
        self.ends = {token[k:]: -math.inf for token in ranks for k in range(len(token))}
        self.ends.update((token, -math.log(rank + 1) - total) for token, rank in ranks.items())
        self.longest = max(map(len, ranks))
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """Insert a pre-token and return the tokens of its best segmentation."""
        data, node, path = word.encode(), 0, [0]
        child, score, count, ends = self.child, self.score, self.count, self.ends
        for i, byte in enumerate(data, 1):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                best, tokens = -math.inf, 0
                for j in range(i - 1, -1, -1):
                    p = ends.get(data[j:i])
                    if p is None:
                        break
                    at = path[j]
                    s = score[at] + p
                    if s >= best:
                        n = count[at] + 1
                        if s > best or n < tokens:
                            best, tokens = s, n
                node = child[key] = len(score)
                score.append(best)
                count.append(tokens)
            path.append(node)
        return count[node]

    def alone(self, data: bytes) -> int:
        """insert() for a pre-token too long for the trie: only the scores that a piece can reach back to are held."""
        score, count, ends = [0.0], [0], self.ends
        for i in range(1, len(data) + 1):
            best, tokens, n = -math.inf, 0, len(score)
            for back in range(1, min(n, i) + 1):
                p = ends.get(data[i - back : i])
                if p is None:
                    break
                s = score[n - back] + p
                if s >= best and (s > best or count[n - back] + 1 < tokens):
                    best, tokens = s, count[n - back] + 1
            score.append(best)
            count.append(tokens)
            if n > 2 * self.longest:
                del score[: n - self.longest], count[: n - self.longest]
        return count[-1]

    def count_all(self, pieces: Counter) -> int:
        """Tokens of a multiset of pre-tokens."""
        recent, older, total = self.recent, self.older, 0
        for piece, times in pieces.items():
            n = recent.get(piece)
            if n is None:
                n = older.get(piece)
                if n is None and len(piece) > LONGEST:
                    total += times * self.alone(piece.encode())
                    continue
                n = recent[piece] = self.insert(piece) if n is None else n
                if len(self.score) > NODES:
                    self.clear()
            total += times * n
        if len(recent) > TERMINALS:
            self.recent, self.older = {}, recent
        return total


@lru_cache(maxsize=2)
def trie(path: str) -> PieceTrie:
    return PieceTrie(path)


@lru_cache(maxsize=2)
def compiled(pattern: str):
    return regex.compile(pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pretokens, n_distinct, n_tokens, from the whole text.

    Pre-tokens are the matches of pattern; those of more than LONGEST characters are counted outside the trie, so
    texts of any length leave it bounded. A null or empty text has none and no tokens. Repeated rows
    and null ids are returned as they are; an empty table gives no rows; other columns are ignored. A
    document is counted where it is read: there is no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = trie(path), compiled(pattern)
        for batch in batches:
            out = []
            for t in batch.column(1):
                pieces = Counter(split.findall(t.as_py() or ""))
                out.append((pieces.total(), len(pieces), words.count_all(pieces)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], [id_col, "n_pretokens", "n_distinct", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, f"{id_col} long, n_pretokens long, n_distinct long, n_tokens long")
