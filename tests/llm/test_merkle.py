import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.conftest import DATA, duck_rows, rows
from treeline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(leaves):
    """Root, and of each leaf the (left, right) of every level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def brute(table):
    """The query's result as sorted tuples, from rows of doc_id, source, lang, n_chars, text."""
    by = {}
    for r in table:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, inner[s] = plain_tree([leaf(r) for r in by[s]])
        subs.append(root)
    if not names:
        return []
    root, outer = plain_tree(subs)
    out = []
    for s, sub, above in zip(names, subs, outer, strict=True):
        for r, own in zip(by[s], inner[s], strict=True):
            path = own + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            x = leaf((*r[:4], r[4].replace("\n", ""))) if hit else leaf(r)
            for a, b in path:
                x = h(a, x, b)
            out.append((r[0], leaf(r), sub, root, h(*(a + b for a, b in path)), x, x == root))
    return sorted(out, key=str)


def run(spark, tmp_path, table, extra=()):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(table, schema).selectExpr("*", *extra).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11(spark, str(tmp_path)).collect()), key=str)


ODD = [(3, None, None, None, None), (1, None, "en", 3, "a\nb"), (None, "s", "en", 0, ""), (2, "", "en", 3, "é😀\n"), (7, "s", "de", 9, "\n" * 5000), (7, "s", "de", 9, "x"), (7, "s", "de", 9, "x"), (7, "s", "de", 9, "x")]


@pytest.mark.parametrize("blocks,ranges", [(8, 100_000), (1, 20), (2, 3)])
def test_like_brute_force(spark, tmp_path, monkeypatch, blocks, ranges):
    rng = random.Random(blocks)
    table = ODD + [(rng.randrange(500), rng.choice(["hot", "hot", "a", "b", "é", None, f"s{rng.randrange(30)}"]), "en", 5, rng.choice(["x\ny", "z", None])) for _ in range(300)]
    monkeypatch.setattr(merkle, "HEIGHT", blocks)
    monkeypatch.setattr(merkle, "RANGE_ROWS", ranges)
    extra = ["1 AS tree", "2 AS key", "'d' AS digest", "'n' AS now", "3 AS place", "4 AS pid", "5 AS block", "6 AS slot", "7 AS rank"]
    assert run(spark, tmp_path, table, extra) == brute(table)


@pytest.mark.parametrize("table", [[], [(5, "s", "en", 1, "a\nb")], [(5, None, None, None, None)] * 4])
def test_small_tables(spark, tmp_path, table):
    assert run(spark, tmp_path, table) == brute(table)


def test_proofs_fold_to_the_root(spark):
    d = spark.createDataFrame([(f"t{i % 3}", i, h(str(i))) for i in range(200)], "tree string, key int, digest string")
    p = merkle.build(d).prove()
    got = p.select("key", "root", merkle.fold(p.digest, p.path).alias("same"), merkle.fold(merkle.leaf(p.digest), p.path).alias("other")).collect()
    assert len(got) == 200 and all(r.same == r.root != r.other for r in got)


def test_addresses():
    for levels in range(1, 10):
        every = np.concatenate([merkle.address(levels, d, np.arange(3**d)) for d in range(levels)])
        assert sorted(every) == list(range(merkle.n_nodes(levels)))
    # 4 levels: a top of two, then nine bottoms of two
    assert merkle.address(4, 1, [0, 1, 2]).tolist() == [1, 2, 3]
    assert merkle.address(4, 2, [0, 1, 8]).tolist() == [4, 8, 36] and merkle.address(4, 3, [0, 1, 2, 3]).tolist() == [5, 6, 7, 9]


def test_matches_sql(spark):
    got = rows(merkle.op11(spark, DATA))
    assert got == duck_rows(merkle.op11_sql()) and {r[-1] for r in got[1]} == {True, False}
