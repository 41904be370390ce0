import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from treeline.llm import ngram_join as nj

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingles(t, k=5):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs):
    """id -> (size, component) by comparing all documents that share a shingle."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for a, (_, s) in enumerate(sets):
        common = Counter(b for g in s for b in seen[g])
        for g in s:
            seen[g].append(a)
        for b, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[b][1]) - k):
                up[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for a, (i, _) in enumerate(sets):
        r = find(a)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return sorted(((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


def run(spark, docs, extra=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 AS n", "'x' AS sig", "2 AS rid", "3 AS id", "4 AS label")
    return sorted(((r.id, r.n, r.component_id) for r in nj.jaccard_components(df).collect()), key=str)


def test_sets_are_those_of_plain_words():
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "A b C d", "a B c D e", "a b c d e a b c d e a b c d e", "é É x\u00a0y \u2003 z w", "x" * 5000 + " y z w v u", "  lead and trail  here now  "]
    for t, s in zip(texts, nj.shingle_sets(texts), strict=True):
        assert len(s) == len(shingles(t)), t
    assert np.array_equal(nj.shingle_sets(["A B c d E f"])[0], nj.shingle_sets(["q", "a b C  d\te f"])[1])
    assert nj.shingle_sets(["a b"])[0] != nj.shingle_sets(["b a"])[0]
    assert nj.shingle_sets(["a b c d e"])[0] != nj.shingle_sets(["a b c d"])[0]
    many = [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4}" for i in range(2000)]
    assert len({nj.signature(s) for s in nj.shingle_sets(many)}) == 2000


def test_odd_documents(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (9, "A  B"), (5, "b a"), (6, base), (6, base), (None, base), (7, base.upper()), (8, base + " tail"), (10, "z " * 50), (11, "z " * 70), (None, "lone words are here too")]
    assert run(spark, docs, extra=True) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed, monkeypatch):
    """Groups with many links around the threshold, a passage that all share, chains."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for g in range(6):
        base = [f"g{g}x{rng.randrange(400)}" for _ in range(rng.randrange(30, 160))]
        texts += variants(rng, base, 25, max(2, len(base) // 22))
        texts += [" ".join(passage + base[: rng.randrange(10, 30)]) for _ in range(6)]
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[k * 3 : k * 3 + 60]))
    texts += [" ".join(passage + [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 200))]) for _ in range(60)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    # small blocks, so that groups are split over several tries and tasks
    monkeypatch.setattr(nj, "PIVOTS", 2)
    monkeypatch.setattr(nj, "BLOCK", 3)
    monkeypatch.setattr(nj, "PROBES", 10)
    assert run(spark, docs) == brute(docs)


def test_trie_finds_what_comparison_does():
    rng = random.Random(5)
    sets = []
    for _ in range(150):
        s = set(range(rng.randrange(3, 40)))
        for _ in range(rng.randrange(6)):
            s ^= {rng.randrange(60)}
        if s:
            sets.append(np.array(sorted(s)))
    trie, labelled = nj.Trie(80), nj.Trie(80)
    for k, s in enumerate(sets):
        trie.insert(s, len(s), k)
        labelled.insert(s, len(s), k, k % 3)
    mark = np.zeros(100, bool)
    for s in sets:
        mark[s] = True
        want = {k for k, t in enumerate(sets) if len(np.intersect1d(s, t)) * 100 >= 80 * len(np.union1d(s, t))}
        assert {k for k, _ in trie.search(s, len(s), mark)} == want
        joined = {k % 3 for k in range(2)}
        assert {k for k, _ in labelled.search(s, len(s), mark, joined)} == {k for k in want if k % 3 not in joined}
        mark[s] = False


def test_table_against_brute_force(spark):
    from tests.conftest import DATA

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.op5(spark, DATA).collect()), key=str)
    assert got == brute(docs)


def test_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (2, ""), (3, base), (3, base), (4, base), (5, base + " x"), (6, "other words stand here alone"), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = nj.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, None), (2, ""), (2, ""), (3, base), (6, "other words stand here alone")], key=str)
