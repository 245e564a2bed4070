"""The operators of joined encodings, manifests and threshold search, against their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import lexical_search, merkle, warc, word_bpe

WORD_FILE = P.path("word_bpe_49k.json")


def hexdigest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_FILE)


def test_halves_joined_equal_the_library(library):
    of, r = word_bpe.vocabulary(WORD_FILE), random.Random(5)
    for k in range(300):
        letters = ("ab", "the", "aeinthgou", "éñçinß")[k % 4]
        word = "".join(r.choice(letters) for _ in range(r.randint(1, 500)))
        want = library.encode(word, add_special_tokens=False).ids
        for leaf in (1, 2, 7, 16, 600):
            assert of.encode(of.symbols(word), leaf) == want


def test_windows_grow_until_both_sides_agree():
    of, r, seen = word_bpe.vocabulary(WORD_FILE), random.Random(6), []
    merge = of.merge
    of.merge = lambda now: seen.append(len(now)) or merge(now)
    try:
        for _ in range(200):
            of.encode(of.symbols("".join(r.choice("aab") for _ in range(300))), 4)
        assert 2 * max(map(len, of.parts.values())) < 300 and len(set(seen)) > 8
    finally:
        del of.merge


def test_every_code_point_is_split_as_the_library_does(library):
    of = word_bpe.vocabulary(WORD_FILE)
    letters = word_bpe.byte_letters()
    for c in (c for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        text = f"A{chr(c)}1{chr(c) * 2}!"
        if of.own.normalizer.normalize_str(chr(c)) != chr(c) or c % 101 == 0 or c in range(0x11DE0, 0x12600):
            want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
            assert ["".join(letters[b] for b in w.encode()) for w in of.words(text)] == want, hex(c)


TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "One two, don't 12!"), (4, "One two, don't 12!"), (None, "<|startoftext|>Hi ΑΣ.<|endoftext|> İx Ᲊ \x00\x1c\x85 ñé ñ 漢字 😀"), (6, "x" * 5000 + " short <|endoftext|>" + "thein" * 900 + " end"), (7, "ab" * 3000), (8, "<|StartOfText|>")]


@pytest.mark.parametrize("split", [64, word_bpe.SPLIT])
def test_word_bpe_round_trip(spark, library, split):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "ids", "whole", "part", "node", "n_tokens")})
    want = []
    for doc, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hexdigest(" ".join(map(str, ids))), hexdigest(library.decode(ids, skip_special_tokens=False))))
    got = word_bpe.round_trip(docs, WORD_FILE, split=split)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    encoded = word_bpe.encode(docs, WORD_FILE, split=split)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in encoded.collect()) == sorted((doc or 0, library.encode(text or "", add_special_tokens=False).ids) for doc, text in TEXTS)
    decoded = word_bpe.decode(encoded, WORD_FILE)
    assert sorted((r["doc_id"] or 0, hexdigest(r["text"])) for r in decoded.collect()) == sorted((w[0] or 0, w[3]) for w in want)
    assert word_bpe.round_trip(docs.limit(0), WORD_FILE).count() == 0


# 12 ---------------------------------------------------------------------------------------------------

VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(row):
    return hexdigest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes, fanout):
    """The root and each node's proof as a list of (before, after)."""
    proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, merged = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k : k + fanout]
            for j in range(len(run)):
                for leaf in groups[k + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            parents.append(hexdigest("".join(run)))
            merged.append([leaf for g in groups[k : k + fanout] for leaf in g])
        nodes, groups = parents, merged
    return nodes[0], proofs


def manifest_of(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *tree_of([leaf_of(r) for r in own], fanout)))
    root, above = tree_of([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, proofs), top in zip(trees, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            fold = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            for before, after in proof + top:
                fold = hexdigest(before + fold + after)
            out.append((r[0], leaf_of(r), subroot, root, hexdigest("".join(b + a for b, a in proof + top)), fold, fold == root))
    return sorted(out, key=str)


def changed_chars():
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize(("fanout", "small"), [(2, 4096), (2, 8), (3, 0), (16, 4096)])
def test_merkle_manifest(spark, monkeypatch, fanout, small):
    monkeypatch.setattr(merkle, "SMALL", small)
    r = random.Random(fanout)
    rows = [(i, r.choice(["a", "bé", None]), r.choice(["en", "en", "en", "de", None]), r.choice([1, 22, None]), r.choice(["", None, "x" * 300, "ß漢"])) for i in range(75)]
    rows += [(5, "a", "en", 1, "same")] * 9 + [(None, None, None, None, None)] * 2 + [(900, "z", "zz", 3, "alone"), (14, "a", "", 5, "empty lang")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("q") for c in ("tree", "at", "hash", "id", "n", "kids", "proof")})
    got = merkle.manifest(df.repartition(5), VALUES, "lang", "doc_id", fanout, changed_chars())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == manifest_of(rows, fanout)


def test_merkle_of_one_and_of_no_row(spark):
    row = (7, "s", "en", 3, "abc")
    df = spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in merkle.manifest(df, VALUES, "lang", "doc_id").collect()] == [(7, leaf_of(row), leaf_of(row), leaf_of(row), hexdigest(""), leaf_of(row), True)]
    assert merkle.manifest(df.limit(0), VALUES, "lang", "doc_id").count() == 0


# 13 ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(items, docs, k):
    words = [terms_of(t) for _, t in docs]
    rows, total = sum(map(bool, words)), sum(map(len, words))
    counts = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), w, c in zip(docs, words, counts, strict=True):
            m = 50 + 50 * len(w) * rows // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if known else None, -score) for rank, (score, known, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, items, docs, k, report=None):
    clash = {c: F.lit("x") for c in ("row", "doc", "term", "tf", "n", "q", "t", "part", "score", "rank")}
    of = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumns(clash)
    got = lexical_search.search(of(items, "item_id"), of(docs, "doc_id").repartition(3), k, report=report)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_lexical_search_equals_all_scores(spark, k):
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "漢字", "İx", "it's", "a_b", "1\x7f2", "THE", "The", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i // 2 if i % 9 == 0 else i, " ".join(["the", *r.choices(words, weights, k=r.randint(0, 80))])) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " \n-_"), (None, "w1 w2 w3 the"), (503, "w50 w51 w52"), (503, "w50 w51 w52"), (504, "w50 " * 3000 + "w51")] + [(600 + i, "w1 w40 same") for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(6)] + [(6, None), (7, ""), (8, "nowhere"), (9, "same"), (9, "w40 W40 the"), (None, "w50 w51")]
    assert searched(spark, items, docs, k) == ranked(items, docs, k)


def test_lexical_search_of_nothing(spark):
    assert searched(spark, [(1, "a")], [], 5) == [] and searched(spark, [], [(1, "a")], 5) == []


def test_lists_are_read_to_a_threshold_only(spark):
    r = random.Random(9)
    docs = [(i, " ".join(r.choices([f"c{j}" for j in range(30)], k=60))) for i in range(600)]
    docs += [(1000 + i, " ".join([f"rare{j}" for j in range(8)] + r.choices([f"c{j}" for j in range(30)], k=20))) for i in range(12)]
    items = [(1, " ".join([f"rare{j}" for j in range(8)] + [f"c{j}" for j in range(10)]))]
    report = {}
    assert searched(spark, items, docs, 5, report) == ranked(items, docs, 5)
    assert report["fetched"] < report["postings"] / 10 and report["candidates"] <= 12


def test_thresholds_are_the_greatest_that_hold(spark):
    r = random.Random(3)
    queries = [([r.randint(1, 40) for _ in range(r.randint(1, 6))], r.randint(1, 90)) for _ in range(40)]
    queries = [(tops, min(least, sum(tops))) for tops, least in queries]
    wanted = spark.createDataFrame([(q, t, top) for q, (tops, _) in enumerate(queries) for t, top in enumerate(tops)], "q long, t long, top long")
    least = spark.createDataFrame([(q, least) for q, (_, least) in enumerate(queries) if q % 5], "q long, least long")
    got = {row["q"]: (row["cut"], row["rest"]) for row in lexical_search.thresholds(wanted, least).collect()}
    for q, (tops, score) in enumerate(queries):
        rest = lambda cut: sum(min(cut - 1, t) for t in tops)  # noqa: B023, E731
        cut = max([c for c in range(1, 100) if rest(c) < score] or [1]) if q % 5 else 1
        assert got[q] == (cut, rest(cut))


# 3, once more -----------------------------------------------------------------------------------------


def test_salvage_survives_damage_at_every_byte(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 3 if i < 3 else "page 1 " * 3) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    for compression, read in (("none", warc.salvage), ("gzip", warc.salvage_zipped)):
        warc.write_archives(pages, f"{tmp_path}/{compression}", compression=compression)
        data = next((tmp_path / compression).glob("part-*")).read_bytes()
        key = lambda r: (r["record_id"], r["payload"], r["refers_to_id"])
        whole = list(read(data))
        assert len(whole) == 4 and not any(r["problem"] for r in whole)
        if compression == "none":
            spans = [(r["start"], r["end"]) for r in whole]
        else:
            starts = [m[0] for m in warc.unzip(data)]
            spans = list(zip(starts, [*starts[1:], len(data)], strict=True))
        for at in range(len(data)):
            for damaged in (data[:at] + bytes([data[at] ^ 0x45]) + data[at + 1 :], data[:at] + data[at + 1 :], data[:at] + "²9\r\n".encode() + data[at:]):
                got = {key(r) for r in read(damaged) if not r["problem"]}
                assert {key(r) for r, (begin, end) in zip(whole, spans, strict=True) if not begin <= at < end} <= got, (compression, at)


def test_lengths_that_are_no_numbers_are_damage():
    for length in ("²", "9" * 5000, "-1", "", "٣"):
        record = f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {length}\r\n\r\nabc\r\n\r\n".encode()
        good = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
        assert [r["problem"] for r in warc.salvage(record + good)] == ["no content length", None]
