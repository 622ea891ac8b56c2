"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collision_ann, compression_quality, count_rtree, hmm_lm, hyperminhash, merkle_manifest, packing, ppm_langid, spelling_variants, suffix_dedup, threshold_topk, token_files, trie_bpe

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Chunks that encoders remember where workers have nothing else to hold; the pipeline's, which run beside its other stages, have half of it.
CHUNKS = 600_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), TOKENIZER, memory=CHUNKS)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), TOKENIZER, memory=CHUNKS)


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.scored(_documents(spark, sf_dir))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(_documents(spark, sf_dir), TOKENIZER)


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.components(_documents(spark, sf_dir), words=4)


def op8_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.classified(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_langid.identified(_documents(spark, sf_dir))


def op11_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.components(_documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_LINKED = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id{more} FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id"""

#: crc32 of a list of bytes, bit by bit: a byte goes in, eight shifts (-1) follow
_CRC = "xor(list_reduce(flatten(list_transform({bytes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"

_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n_chars}", "text"))

_MANIFEST = f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS k, sha256({_LEAF.format(n_chars="n_chars")}) AS h,
CASE WHEN coalesce({_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda s: unicode(s)::BIGINT)")} % 7 = 0, false) THEN sha256({_LEAF.format(n_chars="(n_chars + 1)")}) END AS t FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
lv(l, k, i, h, n) AS (SELECT 0, k, i, h, n FROM p UNION ALL SELECT min(l) + 1, k, i // 2, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 1) // 2 FROM lv WHERE n > 1 GROUP BY k, i // 2),
s AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(l, i, h, n) AS (SELECT 0, i, h, n FROM s UNION ALL SELECT min(l) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 1) // 2 FROM tv WHERE n > 1 GROUP BY i // 2),
root AS (SELECT h FROM tv WHERE n = 1),
a AS (SELECT row_number() OVER () AS r, p.*, s.h AS sub, s.i AS si, s.n AS sn FROM p JOIN s USING (k)),
w(r, k, l, i, n, si, sn, path, fold) AS (SELECT r, k, 0, i, n, si, sn, '', coalesce(t, h) FROM a
UNION ALL SELECT w.r, w.k, w.l + 1, w.i // 2, (w.n + 1) // 2, w.si, w.sn, w.path || coalesce(o.h, ''), sha256(CASE WHEN w.i % 2 = 1 THEN o.h || w.fold ELSE w.fold || coalesce(o.h, '') END) FROM w LEFT JOIN lv o ON o.k = w.k AND o.l = w.l AND o.i = xor(w.i, 1) WHERE w.n > 1),
x(r, l, i, n, path, fold) AS (SELECT r, 0, si, sn, path, fold FROM w WHERE n = 1
UNION ALL SELECT x.r, x.l + 1, x.i // 2, (x.n + 1) // 2, x.path || coalesce(o.h, ''), sha256(CASE WHEN x.i % 2 = 1 THEN o.h || x.fold ELSE x.fold || coalesce(o.h, '') END) FROM x LEFT JOIN tv o ON o.l = x.l AND o.i = xor(x.i, 1) WHERE x.n > 1)
SELECT a.doc_id, a.h AS leaf, a.sub AS subroot, root.h AS root, sha256(x.path) AS proof_sha256, x.fold AS folded_root, x.fold = root.h AS verified FROM a JOIN x ON x.r = a.r AND x.n = 1 CROSS JOIN root"""

_VARIANTS = f"""WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT w, n, {_CRC.format(bytes="flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END))")} AS h FROM g),
v AS (SELECT CASE WHEN h % 97 = 0 THEN w[:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:] ELSE w END AS word, n FROM c),
u AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM u),
x AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM k),
e AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word UNION SELECT x.word, u.word, u.n FROM x JOIN u ON u.word = x.rest UNION SELECT u.word, x.word, x.n FROM x JOIN u ON u.word = x.rest),
m AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM e GROUP BY word),
f AS (SELECT u.word, u.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN -m.best.less >= 2 * u.n THEN m.best.near END AS form, CASE WHEN -m.best.less >= 2 * u.n THEN -m.best.less END AS form_n FROM u LEFT JOIN m USING (word)),
r(word, up) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.up WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.up AS root FROM r JOIN f ON f.word = r.up WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, z.root FROM f JOIN z USING (word)"""


def oracle_sql() -> dict[str, str]:
    """The others hold tokens, models or approximate results, which SQL cannot express; tests compare them with brute force."""
    return {"op4_threshold_topk": _TOP_K, "op7_hyperminhash": _LINKED.format(words=4, more=", coalesce(m.y >= w.doc_id, true) AS kept"), "op11_count_rtree": _LINKED.format(words=5, more=""), "op12_merkle_manifest": _MANIFEST, "op13_spelling_variants": _VARIANTS}
