import random

import pytest

from plumbline.llm import topk


def brute(rows, k, every):
    codes = {(i, c) for i, c in rows if i is not None and c is not None}
    out = []
    for q, a in codes:
        if q % every == 0:
            best = sorted((bin((a ^ b) & (2**64 - 1)).count("1"), i) for i, b in codes if i != q)[:k]
            out += [(q, n, i, d) for n, (d, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "several", "sample"), [(1 << 17, 1 << 16, 1 << 13), (40, 3, 20)])
def test_against_brute_force(spark, monkeypatch, block, several, sample):
    for name, value in (("BLOCK", block), ("PASS", several), ("SAMPLE", sample)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(6)
    base = [rng.getrandbits(64) - 2**63 for _ in range(6)]
    rows = [(i, rng.choice(base) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(120)] + [(i, 77) for i in range(200, 260)] + [(None, 5), (300, None), (301, -1), (200, 77)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, code long, distance int")
    got = sorted(tuple(r) for r in topk.search(frame, k=5, every=20).collect())
    assert got == brute(rows, 5, 20)
    assert topk.search(frame.limit(0)).collect() == []
    assert sorted(tuple(r) for r in topk.search(frame.where("vec_id in (0, 1, 2)"), k=5).collect()) == brute(rows[:3], 5, 100)


def test_random_codes(spark):
    rng = random.Random(7)
    rows = [(i, rng.getrandbits(64) - 2**63) for i in range(3000)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, code long"), k=7).collect())
    assert got == brute(rows, 7, 100)
