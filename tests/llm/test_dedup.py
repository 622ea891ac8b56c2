import hashlib
import random
import re
from collections import Counter

import numpy as np

from seisloom.llm import common, hyperminhash, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_spans(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def corpus():
    random.seed(9)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(1, 8)))
    passage = " ".join(word() for _ in range(80))
    rows = [(k, " ".join(word() for _ in range(random.randint(1, 150)))) for k in range(40)]
    rows += [(100 + k, f"{word()} {passage} {word()}") for k in range(12)] + [(200 + k, passage[k * 7 :]) for k in range(12)]
    rows += [(300, "x" * 3000), (301, None), (302, ""), (303, "é" * 150), (304, "é" * 150), (305, rows[0][1]), (306, (word() + " ") * 200)]
    return rows


def test_removed_bytes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_removed int")
    expected = dict(zip([i for i, _ in rows], brute_spans([(t or "").encode() for _, t in rows], 200), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed(docs).collect()}
    assert got == expected
    assert suffix_dedup.removed(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    rows = suffix_dedup.removed(docs).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(text), len(text), len(text)]


def test_anchors_split_over_shards(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = dict(zip([i for i, _ in rows], brute_spans([(t or "").encode() for _, t in rows], 200), strict=True))
    for most in (1, 3):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed(docs, group_segments=most).collect()}
        assert got == expected


def test_keys_that_hold_most_rows(spark):
    shares, common.SHARE_ROWS = common.SHARE_ROWS, 2
    try:
        test_removed_bytes(spark)
        test_components(spark)
    finally:
        common.SHARE_ROWS = shares


def test_text_longer_than_a_slice(spark):
    random.seed(4)
    words = [f"{random.getrandbits(40):x}" for _ in range(130_000)]
    long = " ".join(words)
    assert len(long) > suffix_dedup.SLICE * 1.1
    over = long[suffix_dedup.SLICE - 150 : suffix_dedup.SLICE + 250]  # lies across the place where the text is cut
    rows = [(1, long), (2, f"start {over} end"), (3, long[-300:] + "!"), (4, "other " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = dict(zip([1, 2, 3, 4], brute_spans([t.encode() for _, t in rows], 200), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed(docs).collect()}
    assert got == expected


def test_rows_stay_whole_where_names_clash(spark):
    passage = " ".join(f"w{k}" for k in range(90))
    rows = [(1, f"a {passage}", 7, "x", None), (1, f"b {passage}", 8, None, "q"), (None, "c", 9, "z", "r"), (None, None, 10, "t", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, spans string, `row` string")
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "a", 7, "x", None), (1, "b", 8, None, "q"), (None, "c", 9, "z", "r"), (None, None, 10, "t", "s")], key=repr)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_shards_merge_by_binary_search():
    random.seed(2)
    parts = [bytes(random.choice(b"ab") for _ in range(random.randint(200, 420))) for _ in range(6)]
    parts += [parts[0][10:230], parts[1][:100] + parts[2][:210], b"ab" * 150, parts[3]]
    seen = Counter(p[i : i + 200] for p in parts for i in range(len(p) - 199))
    for size in (1 << 20, 500, 1):
        masks = suffix_dedup.shared_windows(parts, [len(p) - 199 for p in parts], 200, size)
        for p, m in zip(parts, masks, strict=True):
            assert np.unpackbits(np.frombuffer(m, np.uint8))[: len(p) - 199].astype(bool).tolist() == [seen[p[i : i + 200]] > 1 for i in range(len(p) - 199)]


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def near_copies():
    random.seed(6)
    rows = [(k, " ".join(random.choice("abcdefgh") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 8, 12] * 4)]
    base = [str(random.randint(0, 9999)) for _ in range(90)]
    for k in range(120):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(90)] = f"x{random.randint(0, 10**6)}"
        rows.append((1000 + k, " ".join(w)))
    return rows + [(5000, None), (5001, " \n"), (5002, "A b"), (5003, "a B")]


def test_components(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.components(docs, 4).collect()}
    assert got == brute_components(rows, 4)
    assert hyperminhash.components(docs.limit(0), 4).count() == 0
    kept = hyperminhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in brute_components(rows, 5).items() if x[2]}


def test_one_of_each_with_repeated_and_null_ids(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    near = [text("a") + f" end{k}" for k in range(6)]
    rows = [(9, near[0]), (None, near[1]), (None, near[2]), (7, near[3]), (3, near[4]), (7, text("only")), (3, near[4])]
    rows += [(None, text("b")), (None, text("b")), (20, text("c")), (20, text("c")), (21, None), (21, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in hyperminhash.one_of_each(docs).collect()]
    assert sorted(got, key=repr) == sorted([(3, near[4]), (7, text("only")), (None, text("b")), (20, text("c")), (21, None), (21, None), (None, None)], key=repr)


def test_links_and_components_of_all_sizes(spark):
    random.seed(3)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    small = {r["node"]: r["root"] for r in hyperminhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    most, hyperminhash.SMALL = hyperminhash.SMALL, 0
    try:
        large = {r["node"]: r["root"] for r in hyperminhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        hyperminhash.SMALL = most
    assert small == large and small[1060] == 1000


def test_registers_estimate_similarity():
    random.seed(8)
    a = np.unique(np.array([random.getrandbits(64) for _ in range(1000)], np.uint64))
    b = np.concatenate([a[:800], np.array([random.getrandbits(64) for _ in range(200)], np.uint64)])
    b.sort()
    guess = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None])[0]
    assert abs(guess - 800 / 1200) < 0.2


def test_words_that_a_polynomial_confuses(spark):
    """Two words of 1024 bytes that collide under every polynomial hash modulo 2^64 share no shingle and are two words."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x y {word} z"), (2, f"x y {other} z")], "doc_id long, text string")
    assert {r["component_id"] for r in hyperminhash.components(docs, words=4).collect()} == {1, 2}
    hashes, counts, _, _ = common.word_hashes([f"{word} {other} {word}".encode(), b"", b" \x0b"])
    assert len(set(hashes.tolist())) == 2 and counts.tolist() == [3, 0, 0]
