import hashlib
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import pytest

from seisloom.llm import merkle_manifest, queries, spelling_variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, node string, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """All levels, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, i):
    """(siblings, is it left) from the leaf up."""
    for level in levels[:-1]:
        other = i ^ 1
        yield (level[other] if other < len(level) else ""), i % 2 == 1
        i //= 2


def brute_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[2] for x in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for i, (_, _, own, row) in enumerate(groups[name]):
            path = [*steps(trees[name], i), *steps(top, place)]
            fold = leaf(row, 1) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else own
            for sibling, left in path:
                fold = sha(sibling + fold if left else fold + sibling)
            out.append((row[0], own, trees[name][-1][0], top[-1][0], sha("".join(s for s, _ in path)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def documents():
    random.seed(4)
    lang = lambda k: None if k % 11 == 0 else random.choice(["en", "en", "en", "fr", "é", ""])
    rows = [(k, random.choice(["", "a", "çé" * 40, None, f"text {k}"]), lang(k), random.choice(["s", None]), random.choice([None, k, 2**63 - 1]), 1, "n", "k") for k in range(-30, 180)]
    rows += [(None, f"t{k}", "en", "s", 3, 1, "n", "k") for k in range(3)] + [(5, "again", "en", "s", 3, 1, "n", "k")] * 2 + [(1000, "lone", "xx", "s", 7, None, None, None), (1001, "long " * 60_000, "en", "s", 7, None, None, None)]
    return rows


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest(spark, levels):
    rows = documents()
    got = sorted((tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(rows, DOCS), levels).collect()), key=repr)
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_small_manifests(spark):
    rows = documents()
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
    for some in (rows[:1], rows[-2:], [rows[0], rows[0]]):
        assert sorted((tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(some, DOCS), 1).collect()), key=repr) == brute_manifest(some)


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_variants(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], form[w] and words[form[w]], root))
    return sorted(out, key=repr)


def test_variants(spark):
    random.seed(8)
    bases = ["".join(random.choice("abé") for _ in range(random.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "bananana", "×÷×÷×", "ÀÈÌÒÙ", "x" * 300, "ab" * 200]
    words = []
    for base in bases:
        for _ in range(3):
            at = random.randrange(len(base))
            words += [base[:at] + base[at + 1 :], base[:at] + random.choice("abcé") + base[at:], base[:at] + random.choice("abcÿ") + base[at + 1 :]]
    words += bases * 4
    text = lambda: random.choice([" ", "-", "1", "€", "\n"]).join(random.choice([str.upper, str, str.title])(random.choice(words)) if random.random() < 0.5 else random.choice(words) for _ in range(60))
    rows = [(k, text()) for k in range(120)] + [(None, text()), (7, text()), (7, text()), (200, None), (201, ""), (202, "many words of plain text " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, `a.b` int")
    got = sorted((tuple(r) for r in spelling_variants.variants(docs).collect()), key=repr)
    assert got == brute_variants(rows)
    assert any(r[3] and r[3] != r[5] for r in got)
    assert spelling_variants.variants(docs.limit(0)).count() == 0


def test_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 2)
    rows = [(k, f"alpha{k % 3} Omega omega gammaé") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in spelling_variants.variants(docs).collect()), key=repr) == brute_variants(rows)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_spelling_variants"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
