"""Each operator against a brute-force version, and its edge cases: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, exact_dedup, packing, queries, shard_tree, simhash, substring_dedup, token_counts, topk, toxicity, warc

WORDS = [f"w{i}" for i in range(4000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Columns that clash with names used inside the operators.
    return df.withColumns({c: F.lit("x") for c in ("grp", "keep_id", "id", "ids", "fp", "h", "n", "rid", "slot", "shard", "score", "lang", "source", "n_chars")}) if extra else df


EDGE = [(1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "one two three"), (5, "one two three"), (None, "one two three"), (7, prose(1, 6000)), (8, "ünïcödé 漢字 😀 <|endoftext|>\x00\x1c"), (9, "x" * 20000)]


# 1 ----------------------------------------------------------------------------------------------------


def test_passages_found_and_clean_documents_left(spark):
    shared, fuzzy = prose(100, 60).split(), prose(101, 120).split()
    changed = [w if i % 11 else f"z{i}" for i, w in enumerate(fuzzy)]
    rows = [(i, prose(i, 150)) for i in range(20)]
    rows += [(30 + i, " ".join([prose(200 + i, 40), *shared, prose(300 + i, 40)])) for i in range(6)]
    rows += [(40, " ".join([prose(400, 30), *fuzzy])), (41, " ".join([*changed, prose(401, 30)]))]
    rows += [(50, prose(3, 150)), (60, None), (61, ""), (None, " ".join(shared)), (62, " ".join(shared[:30]))]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
    assert set(got) == {31, 32, 33, 34, 35, 41, 50}
    assert {got[i]["source_id"] for i in range(31, 36)} == {30} and got[50]["source_id"] == 3
    text = dict(rows)[33]
    assert text.encode()[got[33]["begin"] : got[33]["stop"]].decode().split() == shared
    assert got[41]["n_words"] >= 100


def test_words_of_any_length_are_found_whole(spark):
    """Exact copies of 55 words of 1 to 2,000 bytes, in texts of such words, are found and reported whole."""
    r = random.Random(12)
    for size in (1, 8, 80, 200, 2_000):
        word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzäöü", k=max(3, size)) if size > 1 else r.choices("abcdefghijklmnopqrstuvwxyz0123456789äöüßéèàç", k=1))  # noqa: B023, E731
        around = lambda n: [word() for _ in range(n)]  # noqa: B023, E731
        passages = [around(55) for _ in range(20)]
        rows = [(i, " ".join(around(30) + p + around(30))) for i, p in enumerate(passages)] + [(100 + i, " \n".join([*around(20), " ".join(p), *around(40)])) for i, p in enumerate(passages)]
        got = {g["doc_id"]: g for g in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
        assert set(got) == {100 + i for i in range(20)}, size
        assert all(g["source_id"] == g["doc_id"] - 100 and g["n_words"] >= 55 for g in got.values()), size


def test_chance_holders_of_phrases_do_not_hide_a_passage(spark):
    shared = prose(110, 50).split()
    rows = [(i, " ".join([prose(500 + i, 40), *shared[i : i + 5], prose(600 + i, 40)])) for i in range(46)]
    rows += [(100 + i, " ".join([prose(700 + i, 60), *shared, prose(800 + i, 60)])) for i in range(3)]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
    assert set(got) == {101, 102} and {r["source_id"] for r in got.values()} == {100}
    text = dict(rows)[102].encode()
    assert text[got[102]["begin"] : got[102]["stop"]].decode().split() == shared


def test_cutting_keeps_the_first_passage(spark):
    shared = prose(100, 60)
    rows = [(1, f"{prose(1, 20)} {shared} {prose(2, 20)}"), (2, f"{prose(3, 20)} {shared} {prose(4, 20)}"), (3, None), (4, "short"), (None, "no id")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs_of(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[3] is None and got[4] == "short" and got[None] == "no id"
    assert got[2].split() == prose(3, 20).split() + prose(4, 20).split()


def plain_repeats(rows):
    """Documents with a run of 50 words that a document before them has, and for each all places of such runs."""
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        words = text.lower().split()
        grams = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        if places := [k for k, g in enumerate(grams) if first.get(g, i) != i]:
            out[i] = {w for k in places for w in range(k, k + 50)}
        for g in grams:
            first.setdefault(g, i)
    return out


def test_repeated_passages_equal_brute_force(spark):
    """Exact runs of 50 words and more are all found, also where documents before hold overlapping pieces of them."""
    rows, r = [], random.Random(3)
    for k in range(20):
        shared = prose(3000 + k, 60).split()
        rows += [(1000 * k + i, " ".join([prose(r.random(), 30), *shared[at : at + 14], prose(r.random(), 30)])) for i, at in enumerate(range(0, 47, 7))]
        rows += [(100_000 + 2 * k + i, " ".join([prose(r.random(), r.randrange(80)), *shared[: r.choice((50, 55, 60))], prose(r.random(), r.randrange(80))])) for i in range(2)]
    rows += [(200_000 + i, prose(4000 + i % 7, 49 + i % 3)) for i in range(20)]
    # One passage twice in its first document, one long text, and one passage in many documents.
    common = prose(5000, 90)
    rows += [(300_000 + i, f"{prose(5100 + i, 40)} {common} {prose(5200 + i, 10)} {common if i % 5 == 0 else ''}") for i in range(40)]
    rows += [(400_000, prose(5300, 30_000)), (400_001, prose(5400, 20_000) + " " + prose(5300, 30_000) + " tail")]
    want = plain_repeats(rows)
    got, texts = collections.defaultdict(set), dict(rows)
    for p in substring_dedup.repeated_passages(docs_of(spark, rows)).collect():
        word = len(texts[p["doc_id"]].encode()[: p["begin"]].split())
        got[p["doc_id"]] |= set(range(word, word + p["n_words"]))
        assert p["n_words"] >= 50 and p["source_id"] < p["doc_id"]
    assert set(got) == set(want) and len(want) > 60
    assert all(want[i] <= got[i] for i in want)


def test_fuzzy_passages_are_found(spark):
    rows = []
    for k in range(30):
        words = prose(6000 + k, 80).split()
        changed = [w for i, w in enumerate(words) for w in ({9: ["new"], 23: [], 37: [w, "added"], 51: ["x", "y"], 65: ["z"]}.get(i, [w]))]
        rows += [(k, " ".join([prose(6100 + k, 30), *words, prose(6200 + k, 30)])), (100 + k, " ".join([prose(6300 + k, 30), *changed, prose(6400 + k, 30)]))]
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(docs_of(spark, rows)).collect()}
    assert len([i for i in found if i >= 100]) >= 27 and not [i for i in found if i < 100]
    assert all(found[i]["source_id"] == i - 100 for i in found)


def test_common_words_equal_a_plain_table():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([b"abcd"[k : k + 1] for k in r.choices(range(4), k=r.randrange(20))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert substring_dedup.common_words(a, b) == best[-1][-1]


def test_rows_that_repeat_an_id_are_cut_by_their_own_text(spark):
    shared, other = prose(100, 60), prose(7000, 200)
    rows = [(1, f"{prose(1, 20)} {shared}"), (2, other), (2, f"{prose(3, 20)} {shared} {prose(4, 20)}"), (2, f"{prose(3, 20)} {shared} {prose(4, 20)}"), (None, shared), (3, None), (4, ""), (5, shared[:40])]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in substring_dedup.remove_passages(docs_of(spark, rows)).collect())
    cut = f"{prose(3, 20)}  {prose(4, 20)}"
    assert got == sorted([(1, rows[0][1]), (2, other), (2, cut), (2, cut), (0, shared), (3, ""), (4, ""), (5, shared[:40])])
    assert substring_dedup.repeated_passages(docs_of(spark, EDGE)).count() == 0
    assert substring_dedup.repeated_passages(docs_of(spark, rows).limit(0)).count() == 0


def test_chains_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 25))
        pos, src = rng.integers(0, 60, n), rng.integers(0, 60, n)
        best = {}
        for i in sorted(range(n), key=lambda i: (pos[i], src[i])):
            before = [best[j] - substring_dedup.GAP_COST * (pos[i] - pos[j] + src[i] - src[j]) for j in best if pos[j] < pos[i] and src[j] < src[i]]
            best[i] = substring_dedup.K + max([0, *before])
        chains = substring_dedup.chain(pos, src)
        first = chains[0]
        for c in chains:
            assert all(pos[a] < pos[b] and src[a] < src[b] for a, b in zip(c, c[1:], strict=False))
        score = substring_dedup.K * len(first) - substring_dedup.GAP_COST * (pos[first[-1]] - pos[first[0]] + src[first[-1]] - src[first[0]])
        if max(pos) - min(pos) <= substring_dedup.LONGEST_GAP:
            assert score == pytest.approx(max(best.values())) or max(src) - min(src) > substring_dedup.LONGEST_GAP
        assert sorted(np.concatenate(chains).tolist()) == list(range(n))


def test_least_places_are_those_of_windows():
    rng = np.random.default_rng(4)
    for n, width in ((12, 12), (500, 12), (500, 7), (30, 1)):
        values = rng.integers(0, 9, n).astype(np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1) + np.arange(n - width + 1)
        assert (substring_dedup.least_places(values, width) == windows).all()


def test_shared_run_has_a_shared_seed():
    run = prose(5, substring_dedup.K + substring_dedup.WINDOW - 1)
    a = set(substring_dedup.seeds_of([f"{prose(6, 50)} {run} {prose(7, 50)}".encode()])[1].tolist())
    b = set(substring_dedup.seeds_of([f"{prose(8, 9)}\n{run.upper()} {prose(9, 3)}".encode()])[1].tolist())
    assert a & b and not len(substring_dedup.seeds_of([b"a b c d"])[1]) and len(substring_dedup.seeds_of([b"a b c d e"])[1]) == 1


# 2 ----------------------------------------------------------------------------------------------------


def test_trie_counts_equal_plain_viterbi(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    words = token_counts.PieceTrie(path)
    pieces = {k: v for k, v in words.ends.items() if v > -np.inf}

    def plain(word):
        data, best = word.encode(), [(0.0, 0)]
        for i in range(1, len(data) + 1):
            s, n = max((best[j][0] + pieces[data[j:i]], -best[j][1] - 1) for j in range(i) if data[j:i] in pieces)
            best.append((s, -n))
        return best[-1][1]

    sample = [w for w in dict.fromkeys(words_in(" ".join([prose(1, 300), EDGE[8][1], "internationalization of words wordsmith"])))]
    for w in sample:
        assert words.insert(w) == plain(w)
    got = token_counts.count_tokens(docs_of(spark, EDGE), path, P.PATTERN).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 0 and by[2]["n_pretokens"] == 0
    assert by[5]["n_tokens"] == sum(plain(w) for w in words_in("one two three"))


def words_in(text):
    return bpe.regex.findall(P.PATTERN, text)


def test_long_pretokens_leave_the_trie_bounded(monkeypatch):
    trie, r = token_counts.PieceTrie(P.path("byte_bpe_50k.tiktoken")), random.Random(8)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 90))) for _ in range(60)] + ["ab" * 700, "the" * 500]
    assert [trie.alone(w.encode()) for w in words] == [trie.insert(w) for w in words]
    want = trie.count_all(collections.Counter(words))
    fresh = token_counts.PieceTrie(P.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(token_counts, "LONGEST", 20)
    monkeypatch.setattr(token_counts, "NODES", 50)
    assert fresh.count_all(collections.Counter(words)) == want and len(fresh.score) < 200


def test_only_short_pretokens_are_remembered():
    of = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = "word " + "x" * 5000 + " " + "y" * 5000 + " word"
    assert of.decode(of(text)).decode() == text and of(text) == of(text)
    assert max(map(len, of.recent)) <= bpe.KEPT


# 3 ----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://a/\r\nx", "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "crlf\r\n\r\nWARC/1.1\r\ninside"), (6, "u", "é漢😀"), (6, "u", "é漢😀"), (None, "u", "lonely")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "kind": F.lit(2), "bytes": F.lit(3)})
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for page, _, html in rows:
        data = (html or "").encode()
        assert by[page]["payload_bytes"] == len(data) and by[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [by[i]["record_type"] for i in (1, 2, 9, 3, 4, 5, 6)] == ["revisit", "revisit", "response", "revisit", "response", "response", "response"]
    assert (by[1]["refers_to"], by[9]["refers_to"], by[3]["refers_to"]) == (9, None, 4)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    whole = list(warc.salvage(data))
    assert len(whole) == 12 and not any(r["problem"] for r in whole)
    third, seventh = whole[3], whole[7]
    broken = bytearray(data)
    broken[third["end"] - 60] ^= 1  # a flipped bit in a payload
    broken[seventh["start"] : seventh["start"] + 4] = b"XXXX"
    broken = bytes(broken[: whole[-1]["end"] - 9])  # a cut file
    rows = list(warc.salvage(broken))
    gaps = [r for r in rows if r["problem"]]
    assert len(rows) - len(gaps) == 9 and len(gaps) == 3
    assert (gaps[0]["start"], gaps[0]["end"]) == (third["start"], third["end"]) and (gaps[1]["start"], gaps[1]["end"]) == (seventh["start"], seventh["end"])
    import gzip

    members = [gzip.compress(data[r["start"] : r["end"]]) for r in whole]
    members[5] = members[5][:-20]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(b"".join(members))
    got = warc.read_archives(spark, f"{tmp_path}/z").collect()
    assert sum(r["problem"] is None for r in got) == 11 and sum(r["problem"] is not None for r in got) == 1
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk"))[0]["end"] == 4


def test_warc_salvage_of_gzip_members(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, "u", prose(i, 200)) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", compression="gzip")
    file = next((tmp_path / "w").glob("part-*"))
    data = file.read_bytes()
    assert len(list(warc.unzip(data))) == 12 and gzip.decompress(data).count(b"WARC/1.1\r\n") == 12
    assert [r["problem"] for r in warc.read_archives(spark, str(file)).collect()] == [None] * 12
    one = gzip.compress(gzip.decompress(data))  # one member of 12 records
    for name, content, records in (("a.warc.gz", b"X" + data[1:], 11), ("b", b"X" + data[1:], 11), ("c.warc.gz", one[: len(one) // 2], 5)):
        (tmp_path / name).write_bytes(content)
        got = warc.read_archives(spark, f"{tmp_path}/{name}").collect()
        assert sum(r["problem"] is None for r in got) >= records and sum(r["problem"] is not None for r in got) == 1


def test_archive_files_are_bounded(spark, tmp_path):
    rows = [(i, "u", "x" * n + str(i)) for i, n in enumerate([10] * 60 + [3000] * 30 + [40_000] * 12 + [300_000] * 3)] + [(999, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for compression in ("none", "gzip"):
        warc.write_archives(pages, f"{tmp_path}/{compression}", records_per_file=16, file_bytes=64_000, compression=compression)
        files = list((tmp_path / compression).glob("part-*"))
        assert len(files) > 10 and max(f.stat().st_size for f in files) < 310_000
        assert all(f.stat().st_size < 90_000 for f in files if f.read_bytes().count(b"WARC/1.1") > 1)
        got = warc.read_archives(spark, f"{tmp_path}/{compression}").collect()
        assert not any(r["problem"] for r in got)
        assert sorted((r["record_id"], bytes(r["payload"]).decode()) for r in got) == sorted((f"<urn:page:{i}>", h or "") for i, _, h in rows)


# 4 ----------------------------------------------------------------------------------------------------


def reference_bpe(name):
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark):
    want, path = reference_bpe("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")
    of, r = bpe.Codec(path, P.PATTERN), random.Random(4)
    letters = [" ", "\n", "\t", "a", "b", "é", "漢", "😀", "́", "٠", "\x1c", "\x85", "'", "'s", "1", ".", "the", "ing"]
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randrange(120)))
        assert of(text) == want.encode_ordinary(text) and of.decode(of(text)) == text.encode()
    for text in ("ab" * 4000, "a" * 9000, prose(2, 500).replace(" ", "")):
        assert of(text) == want.encode_ordinary(text)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs_of(spark, EDGE), path, P.PATTERN).collect()}
    for i, text in EDGE:
        ids = want.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(docs_of(spark, EDGE), path, P.PATTERN).count() == len(EDGE)


# 5 ----------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.1, (400, 32)).astype(np.float32)
    x[300:350] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 32), (1002, [float("nan")] * 32), (1003, [float("inf")] * 32), (None, x[1].tolist()), (2000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(1), "cb": F.lit(0)})
    v = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 100, 200, 300):
        s = v @ v[q]
        assert got[q] == [(int(i), int(s[i])) for i in sorted((j for j in range(400) if j != q), key=lambda j: (-s[j], j))[:10]]
    # One component alone: (2000, [1.0]) is a query without a candidate.
    assert set(got) == {0, 100, 200, 300}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_tells_rows_apart_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (120, 8)) / 1024
    ids = [*range(110), 100, 100, 7, 7, 0, *[1] * 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(100, x[100].tolist())], "vec_id long, embedding array<double>")
    v = np.floor(1024 * np.concatenate([x, x[100:101]])).astype(np.int64)
    ids.append(100)
    want = []
    for q in (n for n, i in enumerate(ids) if i % 100 == 0):
        best = sorted((-int(v[n] @ v[q]), i) for n, i in enumerate(ids) if n != q)[:10]
        want += [(ids[q], rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()) == sorted(want)



def test_segment_bounds_hold():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-300, 300, (20, 24)), rng.integers(-300, 300, (30, 24))
    for s in (1, 4, 5, 16):
        assert (topk.segment_features(q, s) @ topk.segment_features(c, s).T + 1e-6 >= q @ c.T).all()


def best_of(q, rows, c, k):
    s = q @ c.T
    return [[(int(i), int(s[a, i])) for i in sorted((i for i in range(len(c)) if i != rows[a]), key=lambda i: (-s[a, i], i))[:k]] for a in range(len(q))]


@pytest.mark.parametrize(("kind", "at_most"), [("clusters", 0.1), ("random", 1.0)])
def test_bounds_discard_pairs_and_lose_none(monkeypatch, kind, at_most, capsys):
    """Vectors around 60 centres that are flat over sixteenths: most pairs go by their bounds. Random ones: as reported."""
    rng = np.random.default_rng(8)
    flat = np.repeat(rng.integers(-200, 200, (60, 16)), 4, axis=1)
    c = flat[rng.integers(0, 60, 3000)] + rng.integers(-9, 10, (3000, 64)) if kind == "clusters" else rng.integers(-200, 200, (3000, 64))
    c[2000:2040] = c[0]
    asks = np.arange(0, 3000, 50)
    for pairs in (1 << 20, 1 << 14):
        monkeypatch.setattr(topk, "PAIRS", pairs)
        left = np.zeros(len(topk.LEVELS) + 1, np.int64)
        rows, ids, score = topk.search_block(asks, c[asks], np.arange(3000), np.arange(3000), c, 10, left)
        got = [[(int(i), int(s)) for r, i, s in zip(rows, ids, score, strict=True) if r == a] for a in asks]
        assert got == best_of(c[asks], asks, c, 10)
        assert left[0] == 60 * 2999 and (np.diff(left) <= 0).all() and left[-1] <= at_most * left[0]
    with capsys.disabled():
        print(f"{kind}: pairs left by level {left.tolist()}")


@pytest.mark.parametrize("width", [0, 1, 2, 5])
def test_blocks_of_few_rows_and_narrow_vectors(width):
    c = np.random.default_rng(width).integers(-3, 4, (7, width))
    for n in (0, 1, 7):
        rows, ids, score = topk.search_block(np.arange(7), c, np.arange(n), np.arange(n), c[:n], 10)
        want = best_of(c, range(7), c[:n], 10)
        assert [[(int(i), int(s)) for r, i, s in zip(rows, ids, score, strict=True) if r == a] for a in range(7)] == want
    assert all(len(x) == 0 for x in topk.search_block(np.arange(0), c[:0], np.arange(7), np.arange(7), c, 10))


# 6 ----------------------------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    words = [w for w in bpe.regex.split(rb"[\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())) if w]
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    base = prose(1, 400).split()
    rows = [(i, prose(i, 30)) for i in range(40)]
    for i in range(40):
        near = list(base)
        near[i * 7] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "One TWO three"), (204, "one two\nthree"), (205, "one"), (300, rows[0][1])]
    got = {r["doc_id"]: r for r in simhash.near_duplicate_groups(docs_of(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_groups(prints)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows)
    assert simhash.near_duplicate_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_links_and_tallies_are_exact(spark):
    r = random.Random(6)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints]
    prints += [prints[0] ^ (1 << b) for b in range(64)] + [prints[1] ^ m for m in (7, 1 | 1 << 9 | 1 << 20, 255 << 40, 0xFFFF)]
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, low long")
    both = [(min(a, b), max(a, b), (a ^ b) & (1 << 64) - 1) for i, a in enumerate(signed) for b in signed[:i]]
    shared = {(a, b): sum((x >> 8 * k) & 255 == 0 for k in range(8)) for a, b, x in both}
    assert {(a, b): n for a, b, n in simhash.tallied_pairs(classes).collect()} == {p: n for p, n in shared.items() if n >= 6}
    assert {tuple(p) for p in simhash.linked_fingerprints(classes).collect()} == {(a, b) for a, b, x in both if x.bit_count() <= 2}


def test_similar_texts_are_grouped(spark):
    rows = [(i, prose(i, 200)) for i in range(30)]
    for i in range(10):
        near = rows[i][1].split()
        near[50] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(200, None), (201, ""), (None, rows[0][1])]
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(docs_of(spark, rows)).collect()}
    assert kept == {*range(30), 200, 201, None}


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_only_similar_texts_are_dropped(spark):
    line = prose(70, 8) + " "
    rows = [(1, line * 300 + prose(71, 60)), (2, line * 300 + prose(72, 60))]
    # Twenty pairs that differ in one run of 30 words of 250: 0.757, which fingerprints take for 0.8.
    for i in range(20):
        words = prose(1000 + i, 250).split()
        rows += [(100 + 2 * i, " ".join(words)), (101 + 2 * i, " ".join([*words[:100], *prose(2000 + i, 30).split(), *words[130:]]))]
    rows += [(900, prose(1000, 250) + " more")]
    assert jaccard(rows[0][1], rows[1][1]) < 0.2 and jaccard(rows[2][1], rows[3][1]) < 0.8
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(docs_of(spark, rows)).collect()}
    assert kept == {i for i, _ in rows} - {900}


def plain_similar(rows):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def test_similar_texts_equal_brute_force(spark):
    rows, r = [], random.Random(5)
    # Big groups over a template; each member differs in runs of its own and of its subgroup, about the threshold.
    for group in range(3):
        template = prose(600 + group, 120).split()
        for k in range(90):
            words = list(template)
            for seed in (r.randrange(30), 1000 * k + 77):
                at, n = random.Random(seed).randrange(100), r.choice((0, 3, 6, 9, 12))
                words[at : at + n] = prose(seed + group, n).split()
            rows.append((1000 * group + k, " ".join(words)))
    want = plain_similar(rows)
    assert 20 < len(want) < len(rows) - 20
    assert {r["doc_id"] for r in simhash.keep_one_of_similar(docs_of(spark, rows)).collect()} == want


# 7 ----------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = [(i, "x" * (i % 50)) for i in range(5000)] + [(None, None), (None, "a"), (7, "x" * 7), (8, None)]
    got = shard_tree.shard_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = np.array([len(s) for s in by.values()])
    assert len(by) == 24 and counts.max() < 1.5 * counts.mean()
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert 0.5 * len(rows) / 25 < moved < 1.6 * len(rows) / 25
    r = next(r for r in got if r["doc_id"] == 9)
    assert (r["size"], r["text_crc32"], r["law"]) == (17, zlib.crc32(b"x" * 9), "key")
    assert shard_tree.shard_documents(docs_of(spark, rows).limit(0)).count() == 0


def plain_shard(key, nodes):
    """The weighted draws of a key, recomputed level by level."""
    seed = xxhash.xxh64_intdigest(b"" if key is None else int(key).to_bytes(8, "little", signed=True), 42) if key is not None else 42

    def draw(n):
        return -math.log(((xxhash.xxh64_intdigest(n.name.encode(), seed) >> 12) + 1) / 2**52) / n.weight

    while True:
        best = min(nodes, key=draw)
        if best.shard is not None:
            return best.shard
        nodes = best.children


def test_shards_equal_plain_draws(spark):
    rows = [(i * 7919 - 300, "x") for i in range(400)] + [(None, "y"), (5, "long " * 50_000), (5, "x")]
    got = {(r["doc_id"], r["shard"], r["grown_shard"]) for r in shard_tree.shard_documents(docs_of(spark, rows)).collect()}
    assert got == {(i, plain_shard(i, shard_tree.tree_for(24)), plain_shard(i, shard_tree.tree_for(25))) for i, _ in rows}


def test_movement_is_confined(spark):
    tree = shard_tree.tree_for(24)
    heavier = shard_tree.Node(tree[1].name, tree[1].weight * 2, tree[1].children)
    df = spark.range(4000).withColumnRenamed("id", "k")
    out = shard_tree.assign(shard_tree.assign(df, "k", tree, "a"), "k", (tree[0], heavier, tree[2]), "b").collect()
    assert all(r["a"] == r["b"] or 8 <= r["b"] < 16 for r in out) and any(r["a"] != r["b"] for r in out)
    assert all(shard_tree.tree_for(n) for n in (1, 7, 23, 24, 25, 40))


# 8 ----------------------------------------------------------------------------------------------------


def test_packing_covers_every_id(spark):
    files = [P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")]
    tok = Tokenizer.from_file(files[0])
    rows = [*EDGE, *((20 + i, prose(i, 20 + 37 * i)) for i in range(40))]
    got = packing.pack_documents(docs_of(spark, rows), *files, P.PATTERN).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    # A repeated row: every piece twice.
    twice = collections.Counter((r["start"], r["length"], r["ids_crc32"]) for r in pieces[5])
    assert sum(n * k[1] for k, n in twice.items()) == 2 * (len(tok.encode("one two three", add_special_tokens=False).ids) + 1)
    for i, text in rows:
        if i == 5:
            continue
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048
    assert packing.pack_documents(docs_of(spark, rows).limit(0), *files, P.PATTERN).count() == 0


def test_windows_take_the_best_neighbours():
    """A packer against a plain one: each seed, the best unused neighbours that fit, and the best of the rest cut."""
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 60, int(n)) for n in rng.integers(40, 900, 60)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=packing.VOCABULARY)
    idf, mean = np.log(1 + (60 - df + 0.5) / (df + 0.5)), float(np.mean([len(r) for r in rests]))
    packer = packing.Packer(idf, mean, 0)
    for i, r in enumerate(rests):
        packer.add(i, r)
    packer.finish()
    got = collections.defaultdict(list)
    for doc, start, length, _, _, sequence, _ in packer.out:
        got[sequence].append((doc, start, length))

    def score(query, r):
        tf = np.bincount(r, minlength=packing.VOCABULARY)
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(r) / mean)) for t in np.unique(query))

    table = [[score(q, r) for r in rests] for q in rests]
    left, windows, now, room, seed = {i: len(r) for i, r in enumerate(rests)}, [], [], 2048, None
    place = lambda i, n: (now.append((i, len(rests[i]) - left[i], n)), left.update({i: left[i] - n}))
    while any(left.values()):
        if not now:
            seed = min(i for i in left if left[i])
            room -= left[seed]
            place(seed, left[seed])
        order = sorted((i for i in left if left[i]), key=lambda i: (-round(table[seed][i], 9), i))
        whole = next((i for i in order if left[i] <= room), None)
        pick = order[0] if whole is None and order else whole
        if pick is not None:
            n = min(left[pick], room)
            room -= n
            place(pick, n)
        if not room:
            windows.append(now)
            now, room = [], 2048
    assert [got[k] for k in range(len(windows))] == windows


def test_bm25_equals_formula():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 40, n) for n in (30, 50, 20, 70)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=packing.VOCABULARY)
    idf = np.log(1 + (4 - df + 0.5) / (df + 0.5))
    mean = np.mean([len(r) for r in rests])
    got = packing.Shard(rests, idf, mean).scores(np.unique(rests[0]))
    for d, r in enumerate(rests):
        tf = np.bincount(r, minlength=packing.VOCABULARY)
        want = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(r) / mean)) for t in np.unique(rests[0]))
        assert got[d] == pytest.approx(want)


def test_tokenizer_libraries_agree():
    files = [P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")]
    of, tok, r = packing.tokenizer(*files, P.PATTERN), Tokenizer.from_file(files[0]), random.Random(5)
    common = [chr(c) for c in range(1, 0x250)] + [" ", " ", "\n", "'s", "the", "‑", "–", "€"]
    for _ in range(400):
        text = "".join(r.choice(common) for _ in range(80))
        assert of(text) == tok.encode(text, add_special_tokens=False).ids


# 9 ----------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_grouping(spark):
    long = prose(3, 60000)
    rows = [*EDGE, (10, "x" * 20000), (11, "x" * 19999 + "y"), (12, long), (13, long), (14, long[:-1] + "!"), (15, "é"), (16, "é"), (17, None), (None, "z"), (None, "z")]
    got = exact_dedup.duplicate_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    names = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = collections.Counter()
    for r in got:
        ids = groups[names[r["text_sha256"]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    stay = exact_dedup.drop_duplicates(docs_of(spark, rows))
    assert stay.count() == len(groups) and "keep_id" in stay.columns
    assert exact_dedup.duplicate_groups(docs_of(spark, rows).limit(0)).count() == 0


# 10 ---------------------------------------------------------------------------------------------------


def toxic_rows(n):
    r, out = random.Random(9), []
    for i in range(n):
        words = prose(i, 40).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vile", "rotten", "nasty"]) + r.choice(["", "est"]))
        out.append((i, " ".join(words), "en" if i % 2 else "de", int(toxic)))
    return out


def test_classifier_on_held_out_rows(spark, monkeypatch):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(5000, None, None), (5001, "", "fr"), (None, "vile", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == 903 and got[5000]["score"] == got[5001]["score"]
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 100 and sum(got[r[0]]["predicted"] == r[3] for r in held) / len(held) > 0.95
    model = toxicity.calibrate(toxicity.fit_classifier(docs, labels), docs, labels)
    assert set(model.thresholds) >= {None, "en", "de"}
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, model).collect()}
    assert sum(r[0] in kept for r in rows if r[3]) < 20 and sum(r[0] in kept for r in rows if not r[3]) > 580 and 5000 in kept
    none = toxicity.toxicity_report(docs, labels.limit(0)).collect()
    assert len(none) == 903 and all(r["predicted"] == 0 for r in none)


def test_windows_score_like_one(monkeypatch):
    model = toxicity.TextCNN.fresh()
    rows = toxicity.word_rows(prose(1, 500))
    whole = model.score(rows)
    monkeypatch.setattr(toxicity, "WINDOW", 37)
    assert model.score(rows) == pytest.approx(whole, rel=1e-5)


def plain_score(model, rows):
    """Embedding sums, every filter at every place, the greatest response, one output: written out."""
    x = [model.table[r].sum(axis=0) for r in rows]
    x += [np.zeros(toxicity.DIM, np.float32)] * (max(toxicity.WIDTHS) - len(x))
    total = float(model.out_bias)
    for j, kernel in enumerate(model.kernels):
        w = kernel.shape[1]
        for f in range(toxicity.FILTERS):
            best = max(sum(float(x[p + k] @ kernel[:, k, f]) for k in range(w)) for p in range(len(x) - w + 1))
            total += max(0.0, best + float(model.bias[j * toxicity.FILTERS + f])) * float(model.out[j * toxicity.FILTERS + f])
    return 1 / (1 + math.exp(-total))


def test_scores_equal_a_plain_convolution():
    model = toxicity.TextCNN.fresh()
    for text in ("", "one", "one two", prose(1, 60), "a" * 5000):
        rows = toxicity.word_rows(text)
        assert model.score(rows) == pytest.approx(plain_score(model, rows), abs=1e-5)


def test_fit_lowers_the_loss():
    rows = toxic_rows(120)
    texts, y = [toxicity.word_rows(r[1]) for r in rows], np.array([r[3] for r in rows], np.float32)
    model = toxicity.TextCNN.fresh()
    loss = lambda: -np.mean([math.log(abs(1 - t - model.score(x)) + 1e-9) for x, t in zip(texts, y, strict=True)])
    before = loss()
    model.fit(texts, y)
    assert loss() < before / 3


def test_thresholds_and_scores_do_not_change_with_the_sample(spark, monkeypatch):
    """A balanced sample of an unbalanced table: the mean score stays near the share of label 1."""
    rows = [r for r in toxic_rows(1500) if not r[3] or r[0] % 5 == 0]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(rows[0][0], "another text of the same id"), (99_999, "x " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(99_999, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FIT_ROWS", 60)
    model = toxicity.calibrate(toxicity.fit_classifier(docs, labels), docs, labels)
    assert set(model.thresholds) == {None} and 0 < model.thresholds[None] < 1
    scores = [r["score"] for r in toxicity.score_documents(docs, model).collect()]
    assert len(scores) == len(rows) + 2 and abs(np.mean(scores) - np.mean([r[3] for r in rows])) < 0.15
    assert toxicity.best_cut({900: (0, 5), 100: (9, 0), 400: (1, 4)}) == pytest.approx(0.25)


# Pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    labelled = toxic_rows(300)
    rows = [(i, t, g, "s", len(t)) for i, t, g, _ in labelled]
    clean = [(1000 + i, prose(5000 + i, 90), "en", "s", 1) for i in range(20)]
    near = clean[0][1].split()
    near[45] = "changed"
    shared = prose(9000, 70)
    plan = [(2000, clean[1][1], "en", "s", 1), (2001, " ".join(near), "en", "s", 1), (2002, f"{prose(9001, 60)} {shared}", "en", "s", 1), (2003, f"{shared} {prose(9002, 60)}", "de", "s", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows + clean + plan, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y, 1) for i, _, _, y in labelled], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    toxic = {i for i, _, _, y in labelled if y}
    assert len(toxic & set(seen[0])) < 10 and len(set(range(300)) - toxic - set(seen[0])) < 10
    assert 1001 not in seen[1] and 2000 in seen[1]
    assert 2001 not in seen[2] and 1000 in seen[2] and {1000 + i for i in range(2, 20)} <= set(seen[2])
    assert seen[3][2003]["text"].split() == prose(9002, 60).split() and seen[3][2002]["text"] == plan[2][1]
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, d).count() > 0


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, own long, key string"
    odd = [(i, t, None if k % 2 else "en", "s", 1, 2, 3, "x") for k, (i, t) in enumerate([*EDGE, (11, prose(3, 80)), (12, prose(3, 80)), (13, prose(3, 79) + " other"), (None, prose(3, 80))])]
    for name, rows, labels in (("odd", odd, [(1, 0), (7, 1), (None, 1), (9, None)]), ("empty", [], [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, d)
            assert k == 4 or out.columns == docs.columns, stage
            out.write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
            got = collections.Counter(r["doc_id"] for r in docs.collect())
            if name == "empty":
                assert not got
            elif stage == "exact dedup":
                # Of the empty texts the larger id stays, of the equal ones the largest, a null id never before another.
                assert got[1] == 0 and got[2] == got[3] == got[4] == got[5] == got[12] == got[13] == 1 and got[11] == got[None] == 0
            elif stage == "near dedup":
                assert got[12] == 1 and got[13] == 0 and got[2] == got[3] == 1


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
