import random
import re

from plumbline.llm import decontamination
from plumbline.llm.decontamination import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n):
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            k = min(n, len(x))
            for j in range(len(x) - k + 1) if k else ():
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == x[j : j + k]:
                        hit.update(range(i, i + k))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids - {"None"}), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(spark, texts, items, n):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, hits string, row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.row.doc_id: r for r in decontaminate(docs, bench, window=n).collect()}
    for i, want in enumerate(brute(texts, items, n)):
        r = rows[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == want, (i, texts[i])
        assert r.row.hits == "x" and r.row.text == texts[i]


def data():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["a", "bc", "Def", "é1", "THE", "quick"]) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(rng.randrange(0, 14))) for i in range(12)] + [(50, "unique phrase here"), (None, "lonely item of nothing"), (51, None), (52, ""), (53, "x"), (50, "unique phrase here")]
    texts = [say(rng.randrange(0, 60)) for _ in range(80)] + [None, "", "...", "x", "y x-z", "UNIQUE phrase, here", "the lonely item of nothing is", "uniquephrase here unique phrase", "zz " * 50_000 + "unique phrase here"]
    return texts, items


def test_against_brute_force(spark):
    texts, items = data()
    check(spark, texts, items, 5)
    check(spark, texts, items[10:], 13)


def test_passes_over_parts_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    check(spark, *data(), 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    (r,) = decontaminate(docs, none).collect()
    assert (r.n_words, r.n_hit, r.items, r.contaminated) == (2, 0, [], False)
    assert decontaminate(docs.limit(0), none).collect() == []
