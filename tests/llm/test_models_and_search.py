import math
import re
import zlib
from collections import Counter

import numpy as np

from seisloom.llm import collision_ann, compression_quality, hmm_lm, ppm_langid, threshold_topk
from seisloom.llm import vectors as V

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_model(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9001, None), (9002, ""), (9003, "NEVER seen"), (9001, "the the")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")
    most, hmm_lm.HEAD = hmm_lm.HEAD, 2000  # so that many words lie beyond the head
    try:
        got = hmm_lm.scored(docs).toPandas()
    finally:
        hmm_lm.HEAD = most
    tokens = lambda t: [*WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), ""]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, norm = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    expected = sorted((i, len(w := tokens(t)), sum(x in counts for x in w), round(sum(math.log10(counts.get(x, 0) + 0.5) for x in w) - len(w) * norm, 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()) == expected
    assert (got["train_tokens"] == n).all()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    assert hmm_lm.scored(docs.limit(0)).count() == 0


def test_forward_is_the_likelihood():
    rng = np.random.default_rng(1)
    chain = hmm_lm.Chain.first(rng.integers(1, 50, 12).astype(float))
    seqs = [rng.integers(0, 12, n) for n in (1, 3, 5)]
    for seq, got in zip(seqs, chain.log10_likelihood(seqs), strict=True):
        a = chain.start * chain.emit[seq[0]]
        for s in seq[1:]:
            a = (a @ chain.move) * chain.emit[s]
        assert math.isclose(got, math.log10(a.sum()))
    start, move, emit = chain.expected(seqs)
    assert math.isclose(start.sum(), 3, rel_tol=1e-4) and math.isclose(move.sum(), 6, rel_tol=1e-4) and math.isclose(emit.sum(), 9, rel_tol=1e-4)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ppm_langid.identified(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "x" * 100_000, None), (5, "the cat", "en"), (5, "the cat", "en")], "doc_id long, text string, lang string")
    rows = {(r["doc_id"], r["lang_pred"]) for r in ppm_langid.identified(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows and ppm_langid.identified(odd).count() == 6
    assert ppm_langid.identified(odd.limit(0)).count() == 0


def brute_chance(seen: dict[bytes, Counter], context: bytes) -> list[float]:
    """The probabilities of all 256 bytes after a context, straight from the definition; `seen` holds one language's counts."""
    lower = brute_chance(seen, context[1:]) if context else [1 / 256] * 256
    own = seen.get(context)
    if not own:
        return lower
    n, d = sum(own.values()), len(own)
    rest = sum(p for b, p in enumerate(lower) if b not in own)
    return [own[b] / (n + d) if b in own else d / (n + d) * lower[b] / rest for b in range(256)]


def trained(texts: dict[str, list[str]], order: int) -> ppm_langid.ContextTree:
    languages = sorted(texts)
    found = [ppm_langid.grams(texts[x], order) for x in languages]
    which = np.concatenate([np.full(len(code), k) for k, (code, _) in enumerate(found)])
    return ppm_langid.ContextTree.build(languages, which, np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found]).astype(float), order)


TEXTS = {"x": ["Abracadabra, banana"] * 3 + ["abba"], "y": ["na \u00fcber na"], "z": ["q"]}


def test_code_lengths_are_a_distribution():
    tree = trained(TEXTS, 3)
    for k, level in enumerate(tree.levels):
        upto = ppm_langid.ContextTree(tree.languages, tree.levels[: k + 1])
        for context in level.contexts.tolist():
            mass = (2.0 ** -upto.bits((context << 8) | np.arange(256)).astype(float)).sum(0)
            assert np.abs(mass - 1).max() < 1e-6


def test_code_lengths_equal_brute_force():
    order, plain = 2, lambda t: re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", t.lower().encode())
    tree = trained(TEXTS, order)
    asked = ["abracadabra", "Bananas & \u00fcber", "", "q", "zebra  9\tbra"]
    window, ppm_langid.WINDOW = ppm_langid.WINDOW, 5  # windows end within texts
    try:
        got = tree.lengths(asked)
    finally:
        ppm_langid.WINDOW = window
    for column, language in enumerate(tree.languages):
        seen: dict[bytes, Counter] = {}
        for text in TEXTS[language]:
            data = bytes(order) + plain(text)
            for at in range(order, len(data)):
                for k in range(order + 1):
                    seen.setdefault(data[at - k : at], Counter())[data[at]] += 1
        for row, text in enumerate(asked):
            data = bytes(order) + plain(text)
            bits = -sum(math.log2(brute_chance(seen, data[at - order : at])[data[at]]) for at in range(order, len(data)))
            assert math.isclose(got[row, column], bits, rel_tol=1e-5, abs_tol=1e-5)


def test_language_of_a_very_long_text(spark):
    rows = [(1, "the cat sat on the mat " * 200_000, "en"), (2, "der hund und die katze " * 50, "de"), (3, "the mat sat on the cat " * 50, "en"), (3, None, None), *[(i, "die maus und der hund " * 20, "de") for i in range(7, 12)]]
    docs = spark.createDataFrame([(i, t, x, 0.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    got = {(r["doc_id"], r["lang_pred"]) for r in ppm_langid.predict(docs, ppm_langid.train(docs)).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "en"), (3, "und"), *[(i, "de") for i in range(7, 12)]}


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = compression_quality.classified(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "y" * 50_000), (3, "y" * 50_000)], "doc_id long, text string")
    rows = compression_quality.classified(odd, labels.limit(0)).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 for r in rows)
    assert compression_quality.classified(odd.limit(0), labels).count() == 0


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).round(2).tolist(), k % 3) for k in range(400)]
    rows += [(400, None, 0), (450, [0.0] * 16, 0), (500, [1.0, None] * 8, 0), (550, [float("nan")] * 16, 0), (600, [float("inf")] * 16, 0), (650, rows[7][1], 0), (651, rows[7][1], 0), (None, rows[3][1], 1), (700, rows[50][1], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_exact_top_k(spark):
    rows, df = vectors(spark)
    good = [(i, np.floor(256 * np.array(v, "float32").astype(float))) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in threshold_topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == expected
    assert threshold_topk.top_k(df.limit(0)).count() == 0
    assert threshold_topk.top_k(df.where("vec_id < 3")).count() == 2


def test_approximate_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    unit = np.stack(rows["embedding"]).astype(float)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    ids = rows["vec_id"].to_numpy()
    found = collision_ann.nearest(df).toPandas()
    hits = 0
    for q, g in found.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        cosines = unit @ unit[at]
        cosines[at] = -9
        hits += len(set(g["vec_id"]) & set(ids[np.lexsort((ids, -cosines))[:5]]))
    assert len(found) == 5 * (ids % 50 == 0).sum() and hits / len(found) >= 0.9
    _, odd = vectors(spark)
    got = collision_ann.nearest(odd)
    assert not {400, 450, 500, 550, 600} & {r["vec_id"] for r in got.collect()}
    assert collision_ann.nearest(odd.limit(0)).count() == 0


def test_recall_over_full_blocks():
    rng = np.random.default_rng(1)
    ids = np.arange(32_768)
    centres = rng.standard_normal((300, 64))
    clustered = centres[rng.integers(0, 300, len(ids))] + 0.4 * rng.standard_normal((len(ids), 64))
    for matrix in (rng.standard_normal((len(ids), 64)), rng.standard_normal((len(ids), 128)), clustered):
        made, unit, hits = collision_ann.index(ids, matrix), matrix / np.sqrt((matrix * matrix).sum(1))[:, None], 0
        for q in range(0, len(ids), 1024):
            found, _ = collision_ann.collision_search(made, ids, matrix, q, matrix[q], 5)
            cosines = unit @ unit[q]
            cosines[q] = -9
            hits += len(set(found.tolist()) & set(np.lexsort((ids, -cosines))[:5].tolist()))
        assert hits >= 0.93 * 5 * 32


def test_fewer_candidates_than_asked(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (50, [1.0, 1.0]), (51, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in collision_ann.nearest(few).collect()}
    half = round(0.5**0.5, 6)
    assert got == {(0, 1, 50, half), (0, 2, 3, 0.0), (0, 3, 51, -half), (50, 1, 0, half), (50, 2, 3, half), (50, 3, 51, -1.0)}


def test_rare_language_keeps_its_grams(spark):
    random = np.random.default_rng(5)
    letters = lambda n, of: "".join(random.choice(list(of), n))
    often = [(k, letters(20_000, "abcdefghijklmnopqrstuvwxyz") * 2, "often") for k in range(40)]
    rare = [(100 + k, letters(150, "aeiou"), "rare") for k in range(3)]
    tree = ppm_langid.train(spark.createDataFrame(often + rare, "doc_id long, text string, lang string"))
    assert tree.languages == ["often", "rare"]
    assert tree.lengths([letters(200, "aeiou"), letters(200, "bcdfgxyz")]).argmin(1).tolist() == [1, 0]


def test_searches_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(int(k), [float(x) for x in centres[k % 20] + 0.3 * rng.standard_normal(16)]) for k in range(700)]
    rows += [(5000 + k, [float(2**20 * x) for x in rng.standard_normal(16)]) for k in range(4)] + [(6000, [1e300] * 16), (6050, [-1e12] * 16), (6001, [1.0]), (6100, [2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    block, group = V.BLOCK, V.GROUP
    V.BLOCK, V.GROUP = 100, 3
    try:
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in threshold_topk.top_k(docs).collect()}
        near = {(r["query_id"], r["rank"]): r["vec_id"] for r in collision_ann.nearest(docs).collect()}
    finally:
        V.BLOCK, V.GROUP = block, group
    top = 2**63 - 1
    whole = {i: [max(-top - 1, min(top, math.floor(256 * x))) for x in v] for i, v in rows}
    hits = total = 0
    for i, v in rows:
        if i % 50:
            continue
        others = [j for j, w in rows if j != i and len(w) == len(v)]
        scores = {j: max(-top - 1, min(top, sum(a * b for a, b in zip(whole[i], whole[j], strict=True)))) for j in others}
        best = sorted(others, key=lambda j: (-scores[j], j))[:5]
        assert [got.get((i, r)) for r in range(1, 6)] == [(j, scores[j]) for j in best] + [None] * (5 - len(best))
        if i < 1000:
            unit = lambda x: np.array(x) / np.linalg.norm(x)
            cosine = {j: float(unit(v) @ unit(w)) for j, w in rows if j != i and len(w) == len(v) and j != 6000}
            hits += len({near[i, r] for r in range(1, 6)} & set(sorted(cosine, key=lambda j: (-cosine[j], j))[:5]))
            total += 5
    assert hits >= 0.9 * total
