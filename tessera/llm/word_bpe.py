"""BPE over a tokenizer file with word ends, by concatenating the encodings of halves.

Of two encoded neighbours only tokens near their join can change. A window around the join is encoded
anew and grows until its first and last token are those that the two sides have there; all pairs of
neighbouring tokens are then pairs of some exact encoding, which makes the whole exact. This holds
where every token has one merge, later than those of its parts; Vocabulary checks it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.session import materialize

#: Symbols that are merged in one go; longer text is encoded by halves.
LEAF = 16
#: Symbols of a word that stay in its document's task; of longer words the halves go to tasks of their own.
SPLIT = 8_192
#: Words that a worker remembers as recent, and as many older ones; results do not depend on it. Longer
#: words (in characters) than KEPT are not remembered.
REMEMBERED = 300_000
KEPT = 64
#: Ids of a row of parts.
ROW = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file's tokens: itself if it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Vocabulary:
    """Words, merges and tokens of one file of the BPE kind with a suffix for word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, suffix = whole["model"], whole["model"]["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + suffix] for c in letters]
        parts: dict[int, tuple[int, ...]] = {i: (i,) for i in [*self.inner, *self.last]}
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the id that each rank makes
        born: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, new = ids[a], ids[b], ids[a + b]
            if new in parts or a not in parts or b not in parts:
                raise ValueError("encodings can only be joined if each token has one merge, after those of its parts")
            parts[new], born[new] = parts[a] + parts[b], rank
            self.merges[a, b] = rank
            self.made.append(new)
        #: The symbols (byte letters, and those with the suffix) that a token is made of.
        self.parts = parts
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        splits = [s["pattern"]["Regex"] for s in whole["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.word = regex.compile(splits[0])
        #: Letters seen so far that Python's tables know: texts with others are split by the tokenizer file's own rules.
        self.known: set[str] = set()
        self.own = Tokenizer.from_file(path)
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        self.recent: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: canonical composition, lower case, matches of the pattern."""
        if not text.isascii():
            new = set(text).difference(self.known)
            unknown = {c for c in new if unicodedata.category(c) == "Cn"}
            self.known |= new - unknown
            if unknown:
                found = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text))
                return [bytes(self.letter_bytes[c] for c in w).decode() for w, _ in found]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter, without final sigmas
        return self.word.findall(text.lower())

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def merge(self, now: list[int]) -> list[int]:
        """The exact encoding of symbols: the least rank merges first, of equal ranks the leftmost."""
        if len(now) > 4 * LEAF:
            return self._merge_many(now)
        get, made, now = self.merges.get, self.made, list(now)
        none = len(made)
        ranks = [get(pair, none) for pair in zip(now, now[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            now[i : i + 2] = [made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((now[i], now[i + 1]), none)
            if i:
                ranks[i - 1] = get((now[i - 1], now[i]), none)
        return now

    def _merge_many(self, now: list[int]) -> list[int]:
        """As merge, with a heap of (rank, position) over a linked list."""
        get, made, now, n = self.merges.get, self.made, list(now), len(now)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(now, now[1:])) if (r := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or now[i] < 0 or get((now[i], now[j])) != rank:
                continue
            now[i], now[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((now[i], now[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((now[h], now[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in now if x >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The exact encoding of the text of two exact encodings."""
        if not left or not right:
            return left or right
        back, ahead = 1, 1
        while True:
            i, j = max(0, len(left) - back), min(len(right), ahead)
            window = self.merge([s for t in (*left[i:], *right[:j]) for s in self.parts[t]])
            begins, ends = i == 0 or window[0] == left[i], j == len(right) or window[-1] == right[j - 1]
            if begins and ends:
                return [*left[:i], *window, *right[j:]]
            back, ahead = back if begins else 2 * back, ahead if ends else 2 * ahead

    def encode(self, symbols: list[int], leaf: int = LEAF) -> list[int]:
        """The exact encoding of symbols, by halves down to `leaf` of them."""
        if len(symbols) <= leaf:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.encode(symbols[:half], leaf), self.encode(symbols[half:], leaf))

    def shown(self, ids: list[int]) -> tuple[str, str]:
        """Decimal ids and tokens, each joined by a space."""
        return " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))

    def shown_words(self, words: list[str]) -> list[tuple[str, str]]:
        recent, older, long = self.recent, self.older, []
        for new in set(words).difference(recent):
            recent[new] = older.get(new) or self.shown(self.encode(self.symbols(new)))
            if len(new) > KEPT:
                long.append(new)
        out = list(map(recent.__getitem__, words))
        for word in long:
            del recent[word]
        if len(recent) > REMEMBERED:
            self.recent, self.older = {}, recent
        return out

    def pieces(self, text: str) -> Iterator[int | list[str]]:
        """The text in order: ids of special tokens, and lists of words between them."""
        if any(map(text.__contains__, self.special)):
            for i, part in enumerate(self.apart.split(text)):
                if i % 2:
                    yield self.special[part]
                elif part:
                    yield self.words(part)
        else:
            yield self.words(text)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, which is what a file without a decoder means."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process, shared by its tasks."""
    return Vocabulary(path)


#: What the first pass makes of a document: its whole encoding (`part` null), or rows of parts. A part is a run of ids
#: (`node` null), or a node of a long word's tree: symbols first, ids once it is encoded.
PASSED = "doc long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, whole string, part long, node long"
_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in PASSED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _digests(decimal: str, tokens: str) -> tuple[int, str, str]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return decimal.count(" ") + 1 if decimal else 0, sha(decimal), sha(tokens)


def _passed(docs: DataFrame, path: str, id_col: str, text_col: str, split: int, keep_ids: bool) -> DataFrame:
    def parts_of(of: Vocabulary, doc, pieces: list) -> Iterator[list[tuple]]:
        """Rows of a document with long words; their symbols are dealt into nodes of at most `split`."""
        whole, at, run = uuid.uuid4().hex, 0, []
        blank = (None, None, None, whole)
        for piece in pieces:
            for word in [piece] if isinstance(piece, int) else piece:
                if isinstance(word, int):
                    run.append(word)
                elif len(word.encode()) <= split:
                    run += map(int, of.shown_words([word])[0][0].split())
                else:
                    symbols = of.symbols(word)
                    yield [(doc, run, *blank, at, None)]
                    for node, k in enumerate(range(0, len(symbols), split)):
                        yield [(doc, symbols[k : k + split], *blank, at + 1, node)]
                    run, at = [], at + 2
                if len(run) >= ROW:
                    yield [(doc, run, *blank, at, None)]
                    run, at = [], at + 1
        yield [(doc, run, *blank, at, None)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py() or ""
                    pieces = list(of.pieces(text))
                    if len(text) * 4 > split and any(len(w) * 4 > split and len(w.encode()) > split for p in pieces if not isinstance(p, int) for w in p):
                        for some in parts_of(of, doc, pieces):
                            yield _batch(some)
                        continue
                    shown = [s for p in pieces for s in ([(str(p), of.tokens[p])] if isinstance(p, int) else of.shown_words(p))]
                    decimal, tokens = (" ".join(x) for x in zip(*shown, strict=True)) if shown else ("", "")
                    ids = list(map(int, decimal.split())) if keep_ids else None
                    rows.append((doc, ids, *((None,) * 3 if keep_ids else _digests(decimal, tokens)), None, None, None))
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(work, PASSED)


def _joined(parts: DataFrame, path: str) -> DataFrame:
    """(whole, doc, part, ids) of the parts, whose words' nodes are encoded in parallel and joined in pairs, level by level."""
    nodes = parts.where("node IS NOT NULL").select("whole", "doc", "part", "node", "ids")
    schema = "whole string, doc long, part long, node long, ids array<int>"
    names = [c.split()[0] for c in schema.split(", ")]
    width = (nodes.agg(F.max("node")).first()[0] or 0) + 1

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([of.encode(row.column(4)[0].as_py())], pa.list_(pa.int32()))], names)

    def pair(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["node"])
        ids = rows[0]["ids"] if len(rows) == 1 else vocabulary(path).join(rows[0]["ids"], rows[1]["ids"])
        first = rows[0]
        return pa.Table.from_arrays([pa.array([first["whole"]]), pa.array([first["doc"]], pa.int64()), pa.array([first["part"]], pa.int64()), pa.array([first["node"] // 2], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names)

    nodes = nodes.repartition("whole", "part", "node").mapInArrow(leaves, schema)
    while width > 1:
        nodes = nodes.groupBy("whole", "part", F.floor(F.col("node") / 2).alias("above")).applyInArrow(pair, schema)
        width = -(-width // 2)
    return parts.where("node IS NULL").select("whole", "doc", "part", "ids").union(nodes.select("whole", "doc", "part", "ids"))


def _in_order(t: pa.Table) -> list[int]:
    return [i for row in sorted(t.select(["part", "ids"]).to_pylist(), key=lambda r: r["part"]) for i in row["ids"]]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(id, ids): the token ids of every whole text, special tokens in it included, as the tokenizer file's own library
    gives them without added ones. A null or empty text has none; a row is returned for every row, in no order.

    Words of more than `split` bytes are cut into nodes, which tasks encode in parallel; neighbours are joined in
    rounds. The first pass is written once, as rows of such a document are named at random.
    """
    passed, _ = materialize(_passed(docs, path, id_col, text_col, split, True), "word-ids")
    parts = passed.where("whole IS NOT NULL")
    done = passed.where("whole IS NULL").select(F.col("doc").alias(id_col), "ids")
    if parts.isEmpty():
        return done

    def whole(t: pa.Table) -> pa.Table:
        return pa.table({id_col: pa.array([t.column("doc")[0].as_py()], pa.int64()), "ids": pa.array([_in_order(t)], pa.list_(pa.int32()))})

    return done.union(_joined(parts, path).groupBy("whole").applyInArrow(whole, f"{id_col} long, ids array<int>"))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every array of ids, special tokens included: tokens joined by spaces. Null is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([of.decode(ids.as_py() or []) for ids in batch.column(1)], pa.string())], [id_col, "text"])

    return rows.select(F.col(id_col).cast("long"), ids_col).mapInArrow(work, f"{id_col} long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows and null ids are returned as they
    are; an empty table gives no rows; other columns are ignored. Ids leave their task only for documents with
    words of more than `split` bytes; the rest of the first pass is four short columns, written once.
    """
    passed, _ = materialize(_passed(docs, path, id_col, text_col, split, False), "word-digests")
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"]
    done = passed.where("whole IS NULL").select(F.col("doc").alias(id_col), *columns)
    parts = passed.where("whole IS NOT NULL")
    if parts.isEmpty():
        return done

    def whole(t: pa.Table) -> pa.Table:
        digests = _digests(*vocabulary(path).shown(_in_order(t)))
        return pa.table({id_col: pa.array([t.column("doc")[0].as_py()], pa.int64()), **{c: pa.array([v]) for c, v in zip(columns, digests, strict=True)}})

    return done.union(_joined(parts, path).groupBy("whole").applyInArrow(whole, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
