"""Repeated passages across documents: shared k-mer seeds, collinear chains, alignment.

Seeds are the winnowed k-mers of words. Each occurrence is joined with the first document that has the
seed, so a passage in thousands of documents gives as many matches, not their square. A run, all seeds
from one to the first at least SPAN words behind it, is joined with its own first holder as well, and with
the holder before: two copies of MIN_WORDS words always have a run in common, and an earlier document that has
some phrases of a passage by chance does not have the run, so it cannot hide the passage's source. The matches of a
document with one source are chained in order with gap costs (a Fenwick tree holds the best score by
source position), and chains are aligned word by word between their seeds, which admits fuzzy copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.wordhash import Spans, mixed, runs
from tessera.operators.filters import MANY, join_few, possibly_in
from tessera.operators.ranking import running_sum
from tessera.session import materialize, remove, scratch_scope

#: Words of a seed, and the window of which the least seed is kept: a run of K + WINDOW - 1 shared words
#: always has a common seed.
K, WINDOW = 5, 12
#: A passage has at least this many words, and this share of its words is aligned.
MIN_WORDS, IDENTITY = 50, 0.8
#: Words from the first to the last seed of a run, at least. MIN_WORDS shared words have a common seed among
#: their first WINDOW places and one among the WINDOW places where the last k-mers begin, and alike seeds between.
SPAN = MIN_WORDS - K + 1 - WINDOW - (WINDOW - 1)
#: Cost of a word of gap in either document; chains are cut at gaps of more than this many words, so an
#: alignment between two seeds is of LONGEST_GAP + K words at most.
GAP_COST, LONGEST_GAP = 0.05, 48
#: Bytes on both sides of a chain into which the alignment may grow: the first of these that holds enough words, else
#: all that the text has. The seeds of a passage may lie up to WINDOW + K - 2 words inside it; three more words are
#: asked for, as the first and the last may be cut and white space may come first.
MARGINS = (640, 10_240, 163_840)
ENOUGH = r"^(?:[^\x09-\x0D ]*+[\x09-\x0D ]++){%d}" % (WINDOW + K + 1)
#: Passages that touch are one, also over up to this many words.
BRIDGE = 5

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_odd = np.uint64(0x9E3779B97F4A7C15)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of the `width` values from each place on, the first of equal ones. Windows grow by doubling."""
    at, wide = np.arange(len(values)), 1
    while wide < width:
        step = min(wide, width - wide)
        left, right = values[:-step], values[step:]
        at = np.where(right < left, at[step:], at[:-step])
        values = np.minimum(left, right)
        wide += step
    return at


def seeds_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(number of the text, hash, word position, first byte, byte behind) of the seeds of texts in UTF-8, in order.

    Words are runs of bytes other than white space, A-Z in lower case. Texts of fewer than K words
    have no seed, and those of fewer than K + WINDOW - 1 words have their least one. The texts are gone
    through as one array, with a space between them.
    """
    data = _lower[np.frombuffer(b" ".join(texts), np.uint8)]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[:-1]
    begin, end = runs(~_space[data])
    words = Spans(data).hashes(begin, end)
    text = np.searchsorted(offsets, begin, side="right") - 1
    per_text = np.bincount(text, minlength=len(texts))
    first_word = np.cumsum(per_text) - per_text
    # K-mers of words of one text, numbered from the word that begins them.
    n = max(0, len(words) - K + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(K):
        grams = mixed(grams * _odd + words[i : i + n])
    whole = np.flatnonzero(text[:n] == text[K - 1 : K - 1 + n])
    grams, of = grams[whole], text[whole]
    found = []
    if len(grams) >= WINDOW:
        starts = np.flatnonzero(of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :])
        least = least_places(grams, WINDOW)[starts]
        # Places do not fall from window to window, so equal ones are next to each other.
        found.append(least[np.append(True, least[1:] != least[:-1])[: len(least)]])
    counts = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(counts)
    found += [ends[t] - counts[t] + grams[ends[t] - counts[t] : ends[t]].argmin(keepdims=True) for t in np.flatnonzero((counts > 0) & (counts < WINDOW))]
    at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    word, of = whole[at], of[at]
    return of, grams[at].view(np.int64), word - first_word[of], begin[word] - offsets[of], end[word + K - 1] - offsets[of]


def runs_of(of: np.ndarray, h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each seed whether no run begins with it, else the number of the seed that ends its run, and the run's
    hash: of its first and last seed, of all seeds between, and of its length."""
    seeds = h.view(np.uint64)
    place = of * (int(pos.max(initial=0)) + SPAN + 1) + pos
    to = np.minimum(np.searchsorted(place, place + SPAN), max(0, len(h) - 1))
    none = (of[to] != of) | (pos[to] - pos < SPAN)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(seeds), dtype=np.uint64)))
    between = (sums[to] - sums[: len(h)]) * _odd
    return none, to, mixed(mixed(seeds * _odd + seeds[to]) + between + (pos[to] - pos).astype(np.uint64)).view(np.int64)


SEED = "h long, doc long, own long, pos int, begin int, stop int, run long, pos2 int, begin2 int, stop2 int"


def seed_table(texts: DataFrame) -> DataFrame:
    """SEED columns: one row per seed of texts (doc, own, txt), with its run and the last seed of that; null where
    there is none."""
    names = [c.split()[0] for c in SEED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                of, h, pos, begin, stop = seeds_of(part.column(2).to_pylist())
                none, to, run = runs_of(of, h, pos)
                columns = [pa.array(x, pa.int64()) for x in (h, part.column(0).to_numpy()[of], part.column(1).to_numpy()[of])] + [pa.array(x, pa.int32()) for x in (pos, begin, stop)]
                columns += [pa.array(run, pa.int64(), mask=none)] + [pa.array(x[to], pa.int32(), mask=none) for x in (pos, begin, stop)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("doc", "own", "txt").mapInArrow(work, SEED)


def _hashes(texts: DataFrame) -> DataFrame:
    """h: the seeds of texts (doc, own, txt), each once a row of texts. Nothing else of a seed leaves the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                of, h, *_ = seeds_of(batch.column(0).slice(k, 64).to_pylist())
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                again = (of[1:] == of[:-1]) & (h[1:] == h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[np.append(True, ~again)[: len(h)]], pa.int64())], ["h"])

    return texts.select("txt").mapInArrow(work, "h long")


def chain(pos: np.ndarray, src: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of the matches (pos, src), as index arrays in order.

    The score of a match is K plus the best score of a match before it in both documents less
    GAP_COST for each word between, or plus nothing if that is negative. With the gap's cost linear in
    both positions, the best predecessor is a prefix maximum over source positions.
    """
    n = len(pos)
    order = np.lexsort((src, pos))
    rank = np.unique(src, return_inverse=True)[1] + 1
    size = int(rank.max(initial=0))
    tree_score, tree_item = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    p, s, r = pos.tolist(), src.tolist(), rank.tolist()
    order = order.tolist()
    at = 0
    while at < n:
        # Matches at one position do not precede each other: all are asked before any is entered.
        stop = at
        while stop < n and p[order[stop]] == p[order[at]]:
            i, best, item = order[stop], 0.0, -1
            q, cost = r[i] - 1, GAP_COST * (p[i] + s[i])
            while q > 0:
                if tree_score[q] - cost > best:
                    best, item = tree_score[q] - cost, tree_item[q]
                q &= q - 1
            score[i], before[i] = K + best, item
            stop += 1
        for i in order[at:stop]:
            q, value = r[i], score[i] + GAP_COST * (p[i] + s[i])
            while q <= size:
                if value > tree_score[q]:
                    tree_score[q], tree_item[q] = value, i
                q += q & -q
        at = stop
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            if links and max(p[links[-1]] - p[i], s[links[-1]] - s[i]) > LONGEST_GAP + K:
                chains.append(np.array(links[::-1]))
                links = []
            links.append(i)
            i = before[i]
        chains.append(np.array(links[::-1]))
    return chains


MATCH = ["own", "src", "doc", "source", "pos", "src_pos", "begin", "stop", "src_begin", "src_stop"]
CHAIN = [*MATCH, "at", "src_at"]
CHAIN_KINDS = ", ".join(f"{c} long" for c in MATCH) + ", at array<int>, src_at array<int>"
#: Matches as they are sorted: two numbers below 2**31 make one long, of the same order.
PAIRED = [("pos", "src_pos"), ("begin", "stop"), ("src_begin", "src_stop")]


def _chained(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chains of two matches or more of the rows of m (as MATCH, sorted by text, source and places, each row once):
    the numbers of their rows, one chain after the other, and the lengths.

    Where the matches of a text and a source rise in both documents, the best predecessor of a match is the one
    before it, and it is linked if the words between cost less than K; then chains are what lies between gaps of more than
    LONGEST_GAP words. Only other matches go through the tree of chain().
    """
    step = np.diff(m[:, [0, 1, 4, 5]], axis=0)
    inner = (step[:, 0] == 0) & (step[:, 1] == 0)
    far = np.maximum(step[:, 2], step[:, 3]) > LONGEST_GAP + K
    plain = (step[:, 2] > 0) & (step[:, 3] > 0) & (far | (GAP_COST * (step[:, 2] + step[:, 3] + 1) <= K))
    group = np.cumsum(np.append(0, ~inner))
    crossed = np.zeros(group[-1] + 1, bool)
    crossed[group[1:][inner & ~plain]] = True
    begins = np.flatnonzero(np.append(True, ~inner | far))
    lengths = np.diff(np.append(begins, len(m)))
    # Pieces of crossed groups are taken from the tree, all others are chains as they are.
    whole = (lengths > 1) & ~crossed[group[begins]]
    rows, counts = [np.flatnonzero(np.repeat(whole, lengths))], [lengths[whole]]
    starts = np.flatnonzero(np.append(True, ~inner))
    ends = np.append(starts[1:], len(m))
    for g in np.flatnonzero(crossed):
        for c in chain(m[starts[g] : ends[g], 4], m[starts[g] : ends[g], 5]):
            if len(c) > 1:
                rows.append(c + starts[g])
                counts.append(np.array([len(c)]))
    return np.concatenate(rows), np.concatenate(counts)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of two seeds or more from matches (four ids and PAIRED) sorted by text and source: their first match, with the
    ends of the last, and the places of all matches in words behind the first."""

    def table(m: np.ndarray) -> pa.RecordBatch:
        # A seed may come by itself and in two runs.
        m = m[np.append(True, (np.diff(m[:, [0, 1, 4, 5]], axis=0) != 0).any(axis=1))]
        rows, counts = _chained(m)
        to = np.cumsum(counts)
        first, last = m[rows[to - counts]], m[rows[to - 1]]
        first[:, [7, 9]] = last[:, [7, 9]]
        behind = [pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(m[rows, c] - np.repeat(first[:, c], counts), pa.int32())) for c in (4, 5)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in first.T), *behind], CHAIN)

    # The matches of a text are held until its last one has come; they are as many as its seeds and runs at most.
    held: list[np.ndarray] = []
    for batch in batches:
        ids, pairs = [c.to_numpy() for c in batch.columns[:4]], [c.to_numpy() for c in batch.columns[4:]]
        now = np.stack([*ids, *(x for p in pairs for x in (p >> 32, p & 0xFFFFFFFF))], axis=1)
        if not len(now):
            continue
        whole = np.flatnonzero(now[:, 0] != now[-1, 0])
        cut = whole[-1] + 1 if len(whole) else 0
        if held and (cut or held[0][0, 0] != now[0, 0]):
            yield table(np.concatenate([*held, now[:cut]]))
            held = []
        elif cut:
            yield table(now[:cut])
        held.append(now[cut:])
    if held:
        yield table(np.concatenate(held))


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """The length of the longest common subsequence, by bit-parallel rows of its table."""
    if a == b:
        return len(a)
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def align(target: list[bytes], source: list[bytes], at: list[int], src_at: list[int]) -> int:
    """Words of the two sequences that an alignment through the matches at these places pairs, in order."""
    ends = [*at[1:], len(target)], [*src_at[1:], len(source)]
    return sum(common_words(target[i:j], source[k:n]) for i, j, k, n in zip(at, ends[0], src_at, ends[1], strict=True))


#: Words changed, missing or added between two runs of AGAIN equal words, over which a passage goes on.
_SKIPS = ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0))
AGAIN = 3


def _grow(a: list[bytes], b: list[bytes]) -> tuple[int, int, int]:
    """Words taken from a, from b, and words equal, as grow() takes them."""
    i, j, equal = 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, equal = i + 1, j + 1, equal + 1
            continue
        for x, y in _SKIPS:
            ahead = a[i + x : i + x + AGAIN]
            if len(ahead) == AGAIN and ahead == b[j + y : j + y + AGAIN]:
                i, j, equal = i + x + AGAIN, j + y + AGAIN, equal + AGAIN
                break
        else:
            break
    return i, j, equal


def grow(a: list[bytes], b: list[bytes]) -> tuple[int, int]:
    """How far two word runs go on alike: words taken from a, and words equal. One or two words may be changed,
    missing or added where the AGAIN words behind are equal."""
    i, _, equal = _grow(a, b)
    return i, equal


#: Words of a margin that are looked at first, and how many of these decide at a place: what is skipped and AGAIN words.
NEAR, AHEAD = 16, 2 + AGAIN


def _grown(a: bytes, b: bytes, back: bool, cut_a: bool, cut_b: bool) -> tuple[int, int]:
    """grow() over the words of two margins, backwards if `back`. A cut margin's outermost word is left out unless white
    space ends it. The nearest words are split off first, all only if these do not decide."""
    a, b = a.lower(), b.lower()

    def words(margin: bytes, cut: bool, most: int) -> tuple[list[bytes], bool]:
        found = margin.rsplit(None, most) if back else margin.split(None, most)
        if back:
            found.reverse()
        if most >= 0 and len(found) > most:
            return found[:most], False
        if cut and found and not (margin[:1] if back else margin[-1:]).isspace():
            found.pop()
        return found, True

    (near, all_a), (src_near, all_b) = words(a, cut_a, NEAR), words(b, cut_b, NEAR)
    i, j, equal = _grow(near, src_near)
    if (all_a or i + AHEAD <= len(near)) and (all_b or j + AHEAD <= len(src_near)):
        return i, equal
    return grow(words(a, cut_a, -1)[0], words(b, cut_b, -1)[0])


def _bytes_of(piece: bytes, offset: int, begin: int, stop: int, before: int, behind: int) -> tuple[int, int]:
    """The byte range in the text of a chain together with so many words before and behind it."""
    starts, ends = runs(~_space[np.frombuffer(piece, np.uint8)])
    left, right = np.searchsorted(starts, begin - offset), np.searchsorted(starts, stop - offset)
    return int(starts[left - before]) + offset, int(ends[right + behind - 1]) + offset


ALIGNED = ["own", "doc", "source", "word", "words", "begin", "stop", "equal"]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with the texts around their two sides, as parts of passages: those of which enough words align."""
    asked = ["own", "doc", "source", "pos", "begin", "stop", "src_begin", "src_stop", "piece", "offset", "more", "src_piece", "src_offset", "src_more"]
    for batch in batches:
        out = []
        at, src_at, counts = batch.column("at").flatten().to_numpy(), batch.column("src_at").flatten().to_numpy(), batch.column("at").value_lengths().to_numpy()
        to = np.cumsum(counts)
        # From the first word of the first seed to the last of the last.
        cores = (at[to - 1] + K).tolist()
        for n, (own, doc, source, pos, begin, stop, src_begin, src_stop, piece, offset, more, src_piece, src_offset, src_more) in enumerate(zip(*(batch.column(c).to_pylist() for c in asked), strict=True)):
            before, equal_before = _grown(piece[: begin - offset], src_piece[: src_begin - src_offset], True, offset > 0, src_offset > 0)
            behind, equal_behind = _grown(piece[stop - offset :], src_piece[src_stop - src_offset :], False, more, src_more)
            words = before + cores[n] + behind
            if words < MIN_WORDS:
                continue
            own_words, src_words = piece[begin - offset : stop - offset].lower().split(), src_piece[src_begin - src_offset : src_stop - src_offset].lower().split()
            places = slice(to[n] - counts[n], to[n])
            equal = align(own_words, src_words, at[places].tolist(), src_at[places].tolist())
            if 2 * equal >= IDENTITY * (len(own_words) + len(src_words)):
                first, last = _bytes_of(piece, offset, begin, stop, before, behind)
                out.append((own, doc, source, pos - before, words, first, last, equal_before + equal + equal_behind))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(ALIGNED))], ALIGNED)


def _own(id_col: str, text_col: str) -> Column:
    """Tells rows apart: a hash of id and text, so that rows that repeat an id stay different texts."""
    return F.xxhash64(F.col(id_col).cast("long"), F.encode(text_col, "UTF-8"))


PLACE = ["pos", "begin", "stop"]


def _as_matches(met: DataFrame) -> DataFrame:
    """MATCH columns from (own, doc, m, a): both ends of the run m are matched with those of the run a."""
    end = lambda n: F.struct(F.struct(*[F.col(f"m.{c}{n}").alias(c) for c in PLACE]).alias("m"), F.struct(*[F.col(f"a.{c}{n}").alias(c) for c in PLACE]).alias("f"))
    ends = met.select("own", F.col("a.own").alias("src"), "doc", F.col("a.doc").alias("source"), F.explode(F.array(end(""), end("2"))).alias("e"))
    return ends.select("own", "src", "doc", "source", "e.m.pos", F.col("e.f.pos").alias("src_pos"), "e.m.begin", "e.m.stop", F.col("e.f.begin").alias("src_begin"), F.col("e.f.stop").alias("src_stop"))


OPEN = "key long, own long, doc long, fresh boolean, " + ", ".join(f"{c} int" for c in [*PLACE, "pos2", "begin2", "stop2"])
#: Words from the beginning of a window to its second place; chain() links two matches that are so far apart.
APART = SPAN + WINDOW - 1


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OPEN columns of the windows asked for in texts (own, doc, txt, places and masks of runs, known parts), each once: a key
    of its words, whether it is in no known part, and where K words at its beginning and K words behind are."""
    names = [c.split()[0] for c in OPEN.split(", ")]
    powers = np.cumprod(np.full(MIN_WORDS, _odd))
    for batch in batches:
        for own, doc, txt, asked, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = _lower[np.frombuffer(txt, np.uint8)]
            begin, end = runs(~_space[data])
            words = Spans(data).hashes(begin, end)
            pos, mask = (np.array([r[c] for r in asked], np.int64) for c in ("pos", "mask"))
            at, back = np.nonzero((mask[:, None] >> np.arange(MIN_WORDS)) & 1)
            start = np.unique(pos[at] - back)
            start = start[(start >= 0) & (start + MIN_WORDS <= len(words))]
            sums = np.zeros(len(start), np.uint64)
            for i in range(MIN_WORDS):
                sums += words[start + i] * powers[i]
            # Of the parts that begin before or at a window's start the furthest end decides.
            parts = np.array(sorted((k["word"], k["end"]) for k in known or []), np.int64).reshape(-1, 2)
            reach = np.append(-1, np.maximum.accumulate(parts[:, 1]))[np.searchsorted(parts[:, 0], start, side="right")]
            made = [pa.array(mixed(sums).view(np.int64)), pa.array(np.full(len(start), own)), pa.array(np.full(len(start), doc)), pa.array(reach < start + MIN_WORDS)]
            made += [pa.array(x, pa.int32()) for first in (start, start + APART) for x in (first, begin[first], end[first + K - 1])]
            yield pa.RecordBatch.from_arrays(made, names)


def _covering(met: pa.Table) -> pa.Table:
    """Of the windows of a text that one source has those that together hold all words of all of them."""
    start = np.array([m["pos"] for m in met.column("m").to_pylist()], np.int64)
    order = np.argsort(start, kind="stable")
    start, kept, at = start[order], [], 0
    while at < len(start):
        kept.append(order[at])
        # The last window that begins within the one kept or right behind it, else the next.
        at = max(at + 1, int(np.searchsorted(start, start[at] + MIN_WORDS, side="right")) - 1)
    return met.take(np.array(kept))


def _left_over(texts: DataFrame, coupled: DataFrame, known: DataFrame) -> DataFrame:
    """(own, doc, m, a): windows of MIN_WORDS words around runs that no known part (of, known) holds, each with its place in the first
    text that has it. Every window has a run that both texts have, so none is missed, however many texts have the run, unless
    parts hold all of its runs; then words at the edge of a part may be left."""
    spark = texts.sparkSession
    # Bit b of a mask is the window that begins b words before the run.
    starts = F.sequence(F.greatest(F.lit(0), F.col("m.pos2") + (K - MIN_WORDS)), F.col("m.pos"))
    inside = F.exists("known", lambda x: (x["word"] <= F.col("m.pos")) & (F.col("m.pos2") + K <= x["end"]))
    mask = F.aggregate(starts, F.lit(0).cast("long"), lambda x, s: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m.pos") - s)))
    # Of two occurrences of a run one is the first, which the other has met.
    late = coupled.where(f"own <> a.own AND n > 2 AND m.pos2 + {K} <= m.pos + {MIN_WORDS}").join(known, F.col("own") == F.col("of"), "left").where(F.col("known").isNull() | ~inside)
    asked, asked_at = materialize(late.select("run", mask.alias("mask")).groupBy("run").agg(F.bit_or("mask").alias("mask")), "windows-asked")
    held = coupled.join(asked, "run").groupBy("own", "doc").agg(F.collect_list(F.struct("m.pos", "mask")).alias("runs"))
    held, held_at = materialize(held.join(known, F.col("own") == F.col("of"), "left").select("own", "doc", "runs", "known"), "windows-held")
    some = possibly_in(texts.select(F.col("own").alias("of"), "txt"), [F.col("of")], held.select("own")).where("__maybe").select("of", "txt").dropDuplicates(["of"])
    windows, path = materialize(held.join(some, F.col("own") == F.col("of")).select("own", "doc", "txt", "runs", "known").mapInArrow(_windows, OPEN), "windows")
    whole = F.struct(*[c.split()[0] for c in OPEN.split(", ")[4:]]).alias("m")
    first = windows.groupBy("key").agg(F.min(F.struct("doc", "own", *[c.split()[0] for c in OPEN.split(", ")[4:]])).alias("a"), F.bool_or("fresh").alias("fresh"), F.min("own").alias("lo"), F.max("own").alias("hi"))
    first, first_at = materialize(first.where("fresh AND lo <> hi").select("key", "a"), "windows-first")
    met = windows.where("fresh").join(first, "key").where("own <> a.own").select("own", "doc", whole, "a", F.col("a.own").alias("src"))
    met, _ = materialize(met.groupBy("own", "src").applyInArrow(_covering, met.schema).drop("src"), "windows-met")
    for done in (asked_at, held_at, path, first_at):
        remove(spark, done)
    return met


def _parts(texts: DataFrame) -> DataFrame:
    """ALIGNED columns: runs of MIN_WORDS words or more that align with a text before.

    First each seed and each run meets the first text that has it. The first holder of a run may have less of the
    passage than a later one, so runs that are in no part then meet the text before that has them. Both may have less
    than a text between: windows around runs that are still in no part meet the first text that has all of their words.
    """
    # Rows that repeat a text with its id count as two here, which lets their seeds go on and meet themselves.
    shared = _hashes(texts).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared, _ = materialize(shared, "seeds-shared")
    # Seeds are made again rather than written: most are in one text only, and these go here.
    seeds = possibly_in(seed_table(texts), [F.col("h")], shared, MANY).where("__maybe").drop("__maybe")
    seeds, seeds_at = materialize(seeds, "seeds")
    # A seed that only its own text has, which the bitmap lets through, meets nothing but itself.
    first, first_at = materialize(seeds.groupBy("h").agg(F.min(F.struct("doc", "own", *PLACE)).alias("a")), "seeds-first")
    single = seeds.select("h", "own", "doc", *PLACE).join(first, "h").where("own <> a.own")
    single = single.select("own", F.col("a.own").alias("src"), "doc", F.col("a.doc").alias("source"), "pos", F.col("a.pos").alias("src_pos"), "begin", "stop", F.col("a.begin").alias("src_begin"), F.col("a.stop").alias("src_stop"))
    whole = [*PLACE, "pos2", "begin2", "stop2"]
    coupled = seeds.where("run IS NOT NULL").drop("h")
    heads = coupled.groupBy("run").agg(F.min(F.struct("doc", "own", *whole)).alias("a"), F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    # Written: the join with it is then of two plain shuffles, and a run of a third of the texts can be split.
    heads, heads_at = materialize(heads.select("run", "a", "n"), "runs-first")
    coupled, coupled_at = materialize(coupled.join(heads, "run").select("run", "doc", "own", F.struct(*whole).alias("m"), "a", "n"), "seeds-runs")
    found = _aligned_chains(texts, single.union(_as_matches(coupled.where("own <> a.own"))))
    for path in (seeds_at, first_at, heads_at):
        remove(texts.sparkSession, path)

    # A run's holders in the order of their ids, each with the one before it. Numbers are unique, so no run is a hot key.
    with scratch_scope(texts.sparkSession) as keep:
        holders = running_sum(coupled.groupBy("run", "doc", "own").agg(F.min("m").alias("m"), F.first("a.own").alias("first")), ["run", "doc", "own"], F.lit(1), "nth")
        holders, path = materialize(holders, "seeds-holders")
        keep.append(path)
    before = holders.select((F.col("nth") + 1).alias("nth"), F.col("run").alias("of"), F.struct("doc", "own", "m.*").alias("a"))
    second = holders.join(before, "nth").where("run = of AND a.own <> first").select("own", "doc", "m", "a")
    # A text has one row of its parts, which are as many as its passages.
    known = found.groupBy(F.col("own").alias("of")).agg(F.collect_list(F.struct("word", (F.col("word") + F.col("words")).alias("end"))).alias("known"))
    inside = F.exists("known", lambda x: (x["word"] <= F.col("m.pos")) & (F.col("m.pos2") + K <= x["end"]))
    fresh = second.join(known, F.col("own") == F.col("of"), "left").where(F.col("known").isNull() | ~inside).select("own", "doc", "m", "a")
    found = found.union(_aligned_chains(texts, _as_matches(fresh)))
    known, _ = materialize(found.groupBy(F.col("own").alias("of")).agg(F.collect_list(F.struct("word", (F.col("word") + F.col("words")).alias("end"))).alias("known")), "parts-known")
    left = _left_over(texts, coupled, known)
    remove(texts.sparkSession, coupled_at)
    return found.union(_aligned_chains(texts, _as_matches(left)))


def _margin(there: Column, piece) -> Column:
    """Bytes of the first of MARGINS that holds enough words, given the bytes there are and piece(bytes)."""
    chosen = there
    for n in reversed(MARGINS):
        chosen = F.when((there <= n) | piece(F.lit(n)).cast("string").rlike(ENOUGH), F.least(there, F.lit(n))).otherwise(chosen)
    return chosen.cast("int")


def _around(sides: DataFrame, key: list[str]) -> DataFrame:
    """key, side, piece, offset, more: the range `from` to `to` of txt with its margins, where that begins, and whether the
    text goes on behind it."""
    begin, stop = F.col("from").cast("int"), F.col("to").cast("int")
    before = _margin(begin, lambda n: F.substring("txt", F.greatest(begin - n, F.lit(0)) + 1, F.least(n, begin)))
    behind = _margin(F.octet_length("txt") - stop, lambda n: F.substring("txt", stop + 1, n))
    wide = sides.select(*key, "side", "txt", (begin - before).alias("offset"), (stop + behind).alias("end"))
    return wide.select(*key, "side", F.substring("txt", F.col("offset") + 1, F.col("end") - F.col("offset")).alias("piece"), "offset", (F.col("end") < F.octet_length("txt")).alias("more"))


def _aligned_chains(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """ALIGNED columns of the chains of these matches, as a written table."""
    with scratch_scope(texts.sparkSession) as keep:
        pairs = [F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long")).alias(a) for a, b in PAIRED]
        dealt = matches.select(*MATCH[:4], *pairs).repartition("own").sortWithinPartitions("own", "src", "pos")
        chains, _ = materialize(dealt.mapInArrow(_chains, CHAIN_KINDS), "chains")
        # Both sides of a chain are cut out of their texts in one join; texts without a chain are not moved.
        key = ["own", "src", "pos", "src_pos"]
        sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(own).alias("at"), F.col(b).alias("from"), F.col(s).alias("to")) for n, own, b, s in ((0, "own", "begin", "stop"), (1, "src", "src_begin", "src_stop"))])
        wanted, _ = materialize(chains.select(*key, F.explode(sides).alias("w")).select(*key, "w.*"), "chain-sides")
        held = possibly_in(texts.select(F.col("own").alias("held"), "txt"), [F.col("held")], wanted.select("at")).where("__maybe").select("held", "txt").dropDuplicates(["held"])
        cut, _ = materialize(_around(wanted.join(held, F.col("at") == F.col("held")), key), "chain-texts")
        source = cut.where("side = 1").select(*key, *[F.col(c).alias(f"src_{c}") for c in ("piece", "offset", "more")])
        one = chains.join(cut.where("side = 0").drop("side"), key).join(source, key)
        parts, path = materialize(one.mapInArrow(_aligned, ", ".join(f"{c} long" for c in ALIGNED)).distinct(), "parts")
        keep.append(path)
    return parts


def _passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The passages of repeated_passages with their row's hash (own), as a written table."""
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts = usable.select(F.col(id_col).cast("long").alias("doc"), _own(id_col, text_col).alias("own"), F.encode(text_col, "UTF-8").alias("txt"))
    with scratch_scope(docs.sparkSession) as keep:
        parts = _parts(texts)
        # Parts that touch, also with different sources, are one passage of the text.
        order = Window.partitionBy("own").orderBy("word", "words", "source", "begin", "stop", "equal")
        seen = F.max(F.col("word") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = parts.withColumn("new", F.when(seen.isNull() | (F.col("word") > seen + BRIDGE), 1).otherwise(0))
        island = fresh.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        joined = island.groupBy("own", "doc", "island").agg(F.min("source").alias("source_id"), F.min("begin").alias("begin"), F.max("stop").alias("stop"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("n_words"), F.max("equal").alias("n_equal"), F.count("*").alias("n_chains"))
        found, path = materialize(joined.drop("island"), "passages")
        keep.append(path)
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: id, source_id, begin, stop (bytes of the UTF-8 text), n_words, n_equal, n_chains.

    A passage is a run of at least MIN_WORDS words that a document with a smaller id has too, exact or
    with at least IDENTITY of the words aligned; the smallest such id is source_id. The first document
    to have a passage is not listed for it. Repeats within one document are not passages.

    A document is an id with a text: rows that repeat an id with another text are documents of their
    own, in the order of a hash (source_id may then be the id itself), and rows that repeat both are one.
    Words may have any length. Chains are cut where LONGEST_GAP words in a row hold no common seed, so a fuzzy copy is
    lost if every stretch between such gaps has fewer than MIN_WORDS words.
    Where several places of a source fit, the first is taken. Null and short texts have no passages,
    and rows without an id take no part. A text may be as long as Arrow's batches hold; its seeds and
    matches are held in one task. An empty table gives no rows. Other columns are ignored.
    """
    return _passages(docs, id_col, text_col).select(F.col("doc").alias(id_col), "source_id", "begin", "stop", "n_words", "n_equal", "n_chains")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text; columns and rows stay, also rows left empty.

    The document that has a passage first keeps it. Documents without one keep their text as it is, and
    rows that repeat an id are cut each by its own text.
    """
    with scratch_scope(docs.sparkSession) as keep:
        cuts = F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("__cuts")
        found, path = materialize(_passages(docs, id_col, text_col).groupBy(F.col("own").alias("__own")).agg(cuts), "passages")
        keep.append(path)
    data = F.encode(text_col, "UTF-8")
    # The text between the end of one cut and the beginning of the next.
    between = F.transform(
        F.sequence(F.lit(0), F.size("__cuts")),
        lambda i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("__cuts"), i - 1)["stop"]).alias("from"), F.coalesce(F.get(F.col("__cuts"), i)["begin"], F.octet_length(data).cast("long")).alias("to")),
    )
    kept = F.array_join(F.transform(between, lambda x: F.decode(F.substring(data, (x["from"] + 1).cast("int"), F.greatest(F.lit(0), x["to"] - x["from"]).cast("int")), "UTF-8")), "")
    own = F.when(F.col(id_col).isNotNull() & F.col(text_col).isNotNull(), _own(id_col, text_col))

    def cut(few: DataFrame) -> DataFrame:
        joined = few.join(found, own == F.col("__own"), "left")
        return joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(kept)).drop("__own", "__cuts")

    return join_few(docs, [own], found.select("__own"), cut)
