"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, lexical_search, merkle, packing, shard_tree, simhash, substring_dedup, token_counts, topk, toxicity, warc, word_bpe
from tessera.session import expose_package, load, spread


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(spread(load(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(spread(load(spark, sf_dir, "documents")), ranks, public_tokenizers.PATTERN)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(spread(load(spark, sf_dir, "documents")), ranks, public_tokenizers.PATTERN)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(spread(load(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard_documents(load(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return packing.pack_documents(spread(load(spark, sf_dir, "documents")), *files, public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(spread(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(spread(load(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(chosen, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(load(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered={"n_chars": more.cast("decimal(20,0)")})


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "benchmark"), spread(load(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            expose_package(spark)
            return query(spark, sf_dir)

        run.__name__ = query.__name__
        return run

    return {f.__name__: ready(f) for f in (op1_substring_dedup, op2_token_counts, op3_warc, op4_bpe, op5_topk, op6_simhash, op7_sharding, op8_packing, op9_exact_dedup, op10_toxicity, op11_word_bpe, op12_merkle, op13_lexical_search)}


#: Equal texts are joined by value; DuckDB compares strings byte by byte.
OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


#: Equal payloads are those equal by value. Base-32 digits are five bits of the SHA-1 each.
OP3_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), x AS (SELECT *, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
 regexp_replace(url, '[\r\n]', ' ', 'g') AS target_uri FROM x
"""

#: Rows are numbered, as ids may repeat: a query's own row is left out, not every row of its id.
OP5_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


#: Trees as lists of digests, level by level; proofs and folds go up one level at a time. The CRC-32 of an id is taken bit
#: by bit, as SQL has none.
OP12_SQL = """
WITH RECURSIVE f AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  n_chars, coalesce(strlen(text) || ':' || text, '-') AS z, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
   lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::bigint) ELSE v >> 1 END)) AS crc FROM documents),
h AS MATERIALIZED (SELECT *, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) AS leaf,
  sha256(a || coalesce(strlen((n_chars + (xor(crc, 4294967295::bigint) % 7 = 0)::int)::varchar) || ':' || (n_chars + (xor(crc, 4294967295::bigint) % 7 = 0)::int), '-') || z) AS forged FROM f),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
s(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM l GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1 : i + 2], ''))) FROM s WHERE len(nodes) > 1),
b AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM s WHERE len(nodes) = 1),
t(level, nodes) AS (SELECT 0, list(subroot ORDER BY pos) FROM b
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1 : i + 2], ''))) FROM t WHERE len(nodes) > 1),
u AS MATERIALIZED (SELECT s.lang, s.level, s.nodes, 0 AS base FROM s WHERE len(nodes) > 1 UNION ALL SELECT b.lang, b.height + t.level, t.nodes, b.height FROM b, t WHERE len(t.nodes) > 1),
p(r, lang, level, pos, height, crown, proof, fold) AS (SELECT l.r, l.lang, 0, l.pos, b.height, b.pos, '', l.forged FROM l JOIN b ON l.lang IS NOT DISTINCT FROM b.lang
  UNION ALL SELECT q.r, q.lang, q.level + 1, q.k // 2, q.height, q.crown, q.proof || coalesce(q.nodes[q.k + (CASE WHEN q.k % 2 = 0 THEN 2 ELSE 0 END)], ''),
   sha256(CASE WHEN q.k % 2 = 0 THEN q.fold || coalesce(q.nodes[q.k + 2], '') ELSE q.nodes[q.k] || q.fold END)
   FROM (SELECT p.*, u.nodes, CASE WHEN p.level = p.height THEN p.crown ELSE p.pos END AS k FROM p JOIN u ON p.lang IS NOT DISTINCT FROM u.lang AND p.level = u.level) q),
e AS (SELECT r, arg_max(proof, level) AS proof, arg_max(fold, level) AS fold FROM p GROUP BY r),
x AS (SELECT arg_max(nodes[1], level) AS root FROM t)
SELECT l.doc_id, l.leaf, b.subroot, x.root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = x.root AS verified
FROM l JOIN e USING (r) JOIN b ON l.lang IS NOT DISTINCT FROM b.lang, x
"""

#: Every score of every item; rows are numbered, as ids may repeat.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
s AS MATERIALIZED (SELECT count(*)::bigint AS big_n, sum(len(w))::bigint AS big_l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT r, doc_id, t, len(w) AS n, count(*)::bigint AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, t, n),
f AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, s GROUP BY t, big_n),
x AS (SELECT q.q, q.item_id, p.r, p.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * s.big_n) // s.big_l))))::bigint AS score FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::int AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_topk": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op12_merkle": OP12_SQL, "op13_lexical_search": OP13_SQL}
