import random
import re

import pandas as pd

from plumbline.llm import jaccard_join
from plumbline.llm.jaccard_join import similarity_join


def brute(rows, n=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(s | sets[j]):
                seen.add((j, i))
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                up[b] = a
    for i, (a, _) in enumerate(rows):  # rows that share an id are one node
        for j in range(i):
            if a is not None and rows[j][0] == a:
                x, y = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                up[y] = x
    return [(i, len(s), None if i is None else rows[root(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = [(r.id, r.n_shingles, r.component_id) for r in similarity_join(docs).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def make(rng, groups, sizes, most):
    rows, i = [], 100
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"x{rng.randrange(1000)}"]
            rows.append((i, " ".join(w)))
            i += rng.randrange(1, 3)
    return rows


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = make(rng, 60, [3, 5, 8, 9, 12, 20, 45, 100, 400], 7)
    rows += [(1, None), (2, ""), (3, "  "), (4, "A b"), (5, "a B"), (None, "a b"), (None, None), (6, "one two three four five"), (7, "One two three four five"), (7, "One two three four five"), (8, "z " * 30_000), (9, "z z z z z z")]
    check(spark, rows)


def test_large_groups(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "GROWTH", 3)
    check(spark, make(rng, 5, [30, 60, 200], 40))


def test_hot_signatures_are_split(spark, monkeypatch):
    rng = random.Random(10)
    for name, value in (("SMALL", 2), ("GROWTH", 2), ("SPLIT", 8), ("HUBS", 2), ("BUCKET_ENTRIES", 200)):
        monkeypatch.setattr(jaccard_join, name, value)
    check(spark, make(rng, 4, [30, 60, 120], 60))


def test_texts_of_one_id(spark):
    words = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    check(spark, [(3, words), (5, words + " x"), (5, other), (9, other + " y"), (7, None), (7, words + " z"), (11, "")])


def test_deduplicate(spark):
    words, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, words, 1), (5, words + " x", 2), (5, other, 3), (9, other + " y", 4), (None, words, 5), (11, "", 6), (12, None, 7), (3, words, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = sorted(tuple(r) for r in jaccard_join.deduplicate(docs).select("doc_id", "text").na.fill(-1).na.fill("").collect())
    assert got == sorted([(3, words), (5, other), (-1, words), (11, ""), (12, "")])
    unique = docs.where("id NOT IN (3, 8)")
    got = {r.id for r in jaccard_join.deduplicate(unique).collect()}
    assert got == {1, 4, 5, 6, 7}
    assert jaccard_join.deduplicate(docs.limit(0)).collect() == []


def test_empty(spark):
    assert similarity_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op3_jaccard_join(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(brute(rows))


def test_tallies_never_rule_out_similar_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 9, 60, 127, 128, 129, 2000):
        for _ in range(30):
            x = rng.integers(1, 2**63, n).astype(np.uint64)
            y = np.concatenate([x[: n - rng.integers(0, 1 + n // 9)], rng.integers(1, 2**63, rng.integers(0, 1 + n // 9)).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert jaccard_join.can_be_similar(jaccard_join.tally(x), jaccard_join.tally(y), len(x) + len(y))
    a, b = (rng.integers(1, 2**63, 500).astype(np.uint64) for _ in range(2))
    assert not jaccard_join.can_be_similar(jaccard_join.tally(a), jaccard_join.tally(b), 1000)


def test_listed_members_are_named_once(spark, monkeypatch):
    put, names = jaccard_join.Tables.put, []
    monkeypatch.setattr(jaccard_join.Tables, "put", lambda self, frame, name: (names.append(name), put(self, frame, name))[1])
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    check(spark, make(random.Random(11), 2, [30], 12))
    assert "listed" in names and "arrays" not in names


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeated_pairs_are_not_all_held():
    import numpy as np

    sets, sigs = 60, 1500  # each pair of the sets shares each signature
    sig = np.repeat(np.arange(1, sigs + 1, dtype=np.uint64) << np.uint64(4), sets) | np.uint64(jaccard_join.INDEX | jaccard_join.PROBE)
    nodes = np.tile(np.arange(sets), sigs)
    (pairs, large), mb = peak_mb(lambda: jaccard_join.pair_up(sig, nodes, nodes, 64, np.zeros(len(sig), bool)))
    assert pairs.tolist() == [[a, b] for a in range(sets) for b in range(a + 1, sets)] and not len(large)
    assert mb < 60, mb  # all repeats at 16 bytes are 42 MB, and twice that as one array


def test_parts_of_a_bucket(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(4), 5000
    pool = (rng.integers(1, 2**20, n, dtype=np.uint64) << np.uint64(8)) | np.uint64(jaccard_join.INDEX | jaccard_join.PROBE)
    nodes = rng.integers(-(2**62), 2**62, 1500)
    sig = np.concatenate([pool[rng.integers(0, n, 4 * n)], np.repeat(pool[:3], 300)])
    owner = np.concatenate([rng.integers(0, 1500, 4 * n), np.tile(np.arange(300), 3)])
    sketch = np.zeros(jaccard_join.SKETCH, np.int64)
    for later in (False, True):
        tallies = [rng.integers(0, 3, 64).astype(np.uint8) for _ in nodes] if later else None
        table = pa.Table.from_batches([jaccard_join._rows(sig[i::4], owner[i::4], nodes, nodes // 2**60, np.full(1500, 200, np.int32), tallies, sketch, 1, 1 << 16) for i in range(4)])
        got = []
        for entries in (1 << 30, 1 << 10):
            monkeypatch.setattr(jaccard_join, "PART_ENTRIES", entries)
            out, mb = peak_mb(lambda: jaccard_join.pair_bucket(table, later, 16, sketch, 1 << 16))  # noqa: B023
            rows = sorted(map(tuple, out.to_pandas().fillna(0).astype("int64").to_numpy().tolist()))
            assert len(rows) > 500
            got.append((rows, mb))
        assert got[0][0] == got[1][0]
        assert later or got[1][1] < 0.7 * got[0][1], [mb for _, mb in got]
