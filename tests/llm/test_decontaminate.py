import random
import re

import numpy as np

from sparloom.llm import decontaminate as d


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 30)), rng.integers(0, 5, rng.integers(0, 30))
        assert d.lcs(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_answers():
    assert d.answer_of("What? Because. It is so.") == "It is so."
    assert d.answer_of("Q: x\nAnswer: forty two") == "forty two"
    assert d.answer_of("") == ""


def corpus():
    rng = random.Random(8)
    words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(4))}" for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words[: 40 if rng.random() < 0.5 else 500]) for _ in range(n))
    items = [(i, text(rng.randint(15, 50)) + ". " + text(5) + ".") for i in range(12)]
    docs, planted = [], set()
    for i in range(150):
        t = text(rng.randint(1, 300))
        if i % 6 == 0:
            item, body = items[i // 6 % 12][0], items[i // 6 % 12][1].split(" ")
            if i % 12 == 0:  # a paraphrase: every ninth word replaced, the answer kept
                body = [w if j % 9 or j > len(body) - 6 else "other" for j, w in enumerate(body)]
            t = t + " " + " ".join(body) + " " + text(rng.randint(1, 100))
            planted.add((i, item))
        docs.append((i, t))
    return docs, items, planted


def brute(docs, items, rules):
    """All places of all documents, by words as they are, without any retrieval."""
    split = lambda t: re.findall(r"\w+", t.lower())
    out = set()
    for k, t in docs:
        h = split(t or "")
        for i, x in items:
            a, answer = split(x), split(re.split(r"(?<=[.?!])\s+", x)[-1])
            for begin in range(-rules.slack, len(h)):
                there = h[max(0, begin - rules.slack) : max(0, begin + len(a) + rules.slack)]
                if len(set(a) & set(there)) < rules.paraphrase * len(set(a)) * 0.8:
                    continue
                share = brute_lcs(a, there) / len(a)
                if share >= rules.verbatim or (share >= rules.paraphrase and brute_lcs(answer, there) / len(answer) >= rules.answer):
                    out.add((k, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    docs, items, planted = corpus()
    more = [(900, None), (901, ""), (902, "..."), (0, docs[0][1]), (None, docs[0][1])]
    frame = spark.createDataFrame([(*r, "x") for r in [*docs, *more]], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in [*items, (50, None), (51, "")]], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(frame, bench).collect()}
    want = brute(docs, items, d.Rules()) | {(None, 0)}
    assert planted <= want
    assert got == want
    kept = {r.doc_id for r in d.without_leaks(frame, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in planted} | {900, 901, 902}
    # rows of one id, and without one, go each by its own text
    twice = spark.createDataFrame([(1, docs[0][1]), (1, "clean text"), (None, docs[0][1]), (None, "more clean text")], "doc_id long, text string")
    assert sorted(r.text for r in d.without_leaks(twice.unionByName(frame.select("doc_id", "text")), bench).filter("doc_id = 1 OR doc_id IS NULL").collect()) == sorted(["clean text", "more clean text", *[t for k, t in docs if k == 1]])


def test_items_in_batches(spark, monkeypatch):
    docs, items, planted = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {tuple(r) for r in d.find_leaks(frame, bench).collect()}
    monkeypatch.setattr(d, "BATCH_BYTES", 8000)
    assert len(list(d._batches(bench, "item_id", "text"))) > 2
    assert {tuple(r) for r in d.find_leaks(frame, bench).collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.find_leaks(docs.limit(0), bench).count() == 0 and d.find_leaks(docs, bench.limit(0)).count() == 0
    assert d.find_leaks(docs, bench).count() in (0, 1)


def test_short_items_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(4))}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(4 + i % 14)) for i in range(42)]
    docs = []
    for i, (_, body) in enumerate(items):
        body = body.split(" ")
        if i % 3 == 1:
            body[rng.randrange(len(body) - 1)] = "other"
        if i % 3 == 2:  # verbatim with a word put between
            body.insert(len(body) // 2, "between")
        docs.append((i, " ".join([text(rng.randint(0, 200)), *body, text(rng.randint(0, 100))])))
    docs += [(100 + i, text(rng.randint(1, 250))) for i in range(40)]
    want = brute(docs, items, d.Rules())
    assert {(i, i) for i in range(42) if i % 3 == 0} <= want
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(frame, bench).collect()} == want


def test_recall_of_paraphrases(spark, sf):
    """Given items planted in given texts, a share of their words (the answer's left out) replaced by others."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(3)
    vocabulary = [w for _, t in docs for w in t.split()]
    clean = [t.split() for _, t in docs if 200 < len(t) < 4000]
    planted = {}
    for rate in (0.0, 0.2, 0.3, 0.4):
        for _ in range(60):
            item, text = rng.choice(items)
            words, answer = text.split(), len(d.answer_of(text).split())
            body = [w if j >= len(words) - answer or rng.random() >= rate else rng.choice(vocabulary) for j, w in enumerate(words)]
            base = rng.choice(clean)
            at = rng.randrange(len(base) + 1)
            planted[10**6 + len(planted)] = (item, rate, " ".join(base[:at] + body + base[at:]))
    df = spark.createDataFrame(docs + [(k, t) for k, (_, _, t) in planted.items()], "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()}
    recall = {rate: np.mean([(k, i) in found for k, (i, r, _) in planted.items() if r == rate]) for rate in (0.0, 0.2, 0.3, 0.4)}
    assert recall[0.0] == 1.0 and recall[0.2] >= 0.98 and recall[0.3] >= 0.9 and recall[0.4] >= 0.7, recall
