import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from sparloom.llm import disclosure as d

RAW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and s % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    found = []
    for rank, kind in enumerate(d.KINDS):
        found += [(m.start(), rank, m.end(), kind) for m in RAW[kind].finditer(text) if valid(kind, m[0])]
    return sorted(found)


def joined(spans):
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)


TEXTS = [
    None, "", "a@b.c", "a@b.c_d@e.f x@y", "é😀 me.x+1@host-1.co.uk, and 10.0.0.1!", "1.2.3.4.5.6.7.8", "1.2.3.999.5.6.7", "000255.1.1.01 256.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "41111111 1111 1111 2", "+49 (30) 123-45.67 8", "+1234567890123456 +12345678", "++4912345678- 5", "4111111111111111 4111111111111111",
    "a" * 5000 + "@" + "b.c" * 3000, "9" * 5000, "1." * 4000, "+" + "1 (" * 3000, "@@@ a@ @b.c a@b..c", "x@y.z" * 50, "1-2-3-4-5-6-7-8-9-0-1-2 ", "+1 2 3 4 5 6 7 8 9",
]


def corpus():
    rng = random.Random(4)
    texts = list(TEXTS)
    for _ in range(200):
        texts.append("".join(rng.choice(["a@b.co", "1.2.3.4", ".", "4111111111111111", " ", "-", "+49301234567", "5", "@", "x", "é", "(", ")", "\n", "😀"]) for _ in range(rng.randint(1, 30))))
    return texts


def test_base_spans_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a@b.c", "x", 1)], "doc_id long, text string, base string, entity int").repartition(3)
    got = {r.doc_id: r for r in d.report(d.find_personal_data(docs)).collect()}
    for i, t in [*enumerate(texts), (None, "a@b.c")]:
        want, r = brute(t or ""), got[i]
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == [x for x in joined(want).split(",") if x], t
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in d.KINDS]


def test_empty_table(spark):
    assert d.report(d.find_personal_data(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def levels(kind, value):
    """The entity, its group and its kind."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
    part = plain.rsplit("@", 1)[-1] if kind == "email" else ".".join(plain.split(".")[:2]) if kind == "ip" else plain[:6] if kind == "card" else plain[:4]
    return f"{kind}:{plain}", f"{kind}*:{part}", f"{kind}**"


def brute_terms(rows, p=d.Policy()):
    letters = re.compile(r"[^\W\d_]+")
    near, n_entity, n_term, contexts, n_pair = [], {}, {}, {}, {}
    for i, t in rows:
        for w in {w.lower() for w in letters.findall(t) if len(w) >= p.min_term}:
            n_term[w] = n_term.get(w, 0) + 1
        pairs, entities = set(), set()
        for a, _, z, kind in brute(t):
            lo = max(0, a - p.window)
            value = levels(kind, t[a:z])[0]
            for entity in levels(kind, t[a:z]):
                entities.add(entity)
                for m in letters.finditer(t):
                    inside = (lo <= m.start() and m.end() <= a) or (z <= m.start() and (m.end() < z + p.window or m.end() <= z + p.window and len(t) <= z + p.window))
                    if inside and len(m[0]) >= p.min_term:
                        pairs.add((entity, m[0].lower()))
                        near.append((i, entity, m[0].lower(), m.start(), m.end()))
                        contexts.setdefault((entity, m[0].lower()), set()).add(t[lo : lo + 2 * p.window] if entity == value else value)
        for e in entities:
            n_entity[e] = n_entity.get(e, 0) + 1
        for x in pairs:
            n_pair[x] = n_pair.get(x, 0) + 1
    telling, n = {}, len(rows)
    for (e, w), c in contexts.items():
        usual = n_entity[e] / n
        there = (n_pair[e, w] + p.smoothing * usual) / (n_term[w] + p.smoothing)
        share = math.log2(there / usual) / -math.log2(usual) if usual < 1 else 0
        if len(c) >= p.min_contexts and share >= p.generalise:
            telling[e, w] = share
    spans = {}
    for i, e, w, a, z in near:
        if (e, w) in telling:
            spans.setdefault((i, a, z), []).append("remove" if telling[e, w] >= p.remove else "generalise")
    return telling, {k: max(v) for k, v in spans.items()}


def plain_sanitised(text, spans):
    """Spans (start, end, new) in order; one that begins inside an earlier one only extends it."""
    out, at = "", 0
    for a, z, new in sorted(spans):
        out += text[at:a] + new if a >= at else ""
        at = max(at, z)
    return out + text[at:]


def test_added_terms_equal_brute_force(spark):
    rng = random.Random(9)
    common = [f"common{c}" for c in "abcdefghij"]
    rows = []
    for i in range(120):
        words = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        if i % 10 == 0:
            words[3] = f"zebrafish boss@secret.org nearby{chr(97 + i % 7)}"
        if i % 12 == 7:  # each address once: only the domain and the kind tell
            words[2] = f"lonely me{i}@once{i % 2}.org"
        if i % 9 == 4:
            words[1] = f"hotline +49 30 {rng.randint(1000000, 9999999)} or 10.{i}.0.1"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, near string").repartition(2)
    telling, spans = brute_terms(rows)
    assert {("email:boss@secret.org", "zebrafish"), ("email*:once1.org", "lonely"), ("phone**", "hotline")} <= set(telling)
    found = d.find_personal_data(docs)
    got = {(r.doc_id, r.s["start"], r.s["end"]): r.s["action"] for r in found.select("doc_id", F.explode("added").alias("s")).collect()}
    assert got == spans
    report = {r.doc_id: r for r in d.report(found).collect()}
    assert report[0].n_term == sum(k[0] == 0 for k in spans) and report[0].n_spans == report[0].n_term + 1
    assert report[0].actions == ",".join(f"{spans[k]}:{k[1]}:{k[2]}" for k in sorted(spans) if k[0] == 0)
    clean = {r.doc_id: r.text for r in d.sanitise(docs).collect()}
    for i, t in rows:
        new = [(a, z, f"[{kind.upper()}]") for a, _, z, kind in brute(t)] + [(a, z, "" if act == "remove" else "[TERM]") for (k, a, z), act in spans.items() if k == i]
        assert clean[i] == plain_sanitised(t, new)


def test_sanitised_rows_stay_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "a@b.c", 7), (None, "a@b.c", 8), (3, "a@b.c", 7), (4, "x" * 1000 + "é😀 10.0.0.1" + "y" * 600, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int").repartition(2)
    got = sorted(map(tuple, d.sanitise(docs).collect()), key=str)
    assert got == sorted([(1, None, 5), (2, "", 6), *[(i, "[EMAIL]", n) for i, n in ((3, 7), (None, 8), (3, 7))], (4, "x" * 1000 + "é😀 [IP]" + "y" * 600, 9)], key=str)
    assert d.sanitise(docs.limit(0)).count() == 0


def test_time_follows_the_matches(spark):
    """Many addresses in one text: four times as many take no more than some four times as long."""
    took = []
    for n in (20_000, 80_000):
        docs = spark.createDataFrame([(1, "".join(f"a{i}@b.co " for i in range(n)))], "doc_id long, text string")
        began = time.time()
        r = d.report(d.find_personal_data(docs)).first()
        took.append(time.time() - began)
        assert r.n_email == n and r.spans.endswith(f"email:{len(''.join(f'a{i}@b.co ' for i in range(n - 1)))}:{len(''.join(f'a{i}@b.co ' for i in range(n))) - 1}")
    assert took[1] < 8 * took[0] + 10


def test_planted_names_are_found(spark):
    """Sixty people, an address each in eight documents, the name beside it at one of three rates; rare words stand
    everywhere."""
    rng = random.Random(75)
    common = [a + b + "word" for a in "abcdefghij" for b in "klmnop"]
    rare = ["rare" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(600)]
    names = [f"person{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(60)]
    rates = (1.0, 0.75, 0.5)
    rows = []
    for i in range(1600):
        words = [rng.choice(rare) if rng.random() < 0.05 else rng.choice(common) for _ in range(30)]
        if i < 480:
            k = i % 60
            words[10:12] = [names[k] if rng.random() < rates[k % 3] else rng.choice(common), f"me{k}@box{k % 7}.org"]
        rows.append((i, " ".join(words)))
    found = d.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    texts = dict(rows)
    hits = {texts[r.doc_id][r.s["start"] : r.s["end"]] for r in found.select("doc_id", F.explode("added").alias("s")).collect()}
    for of, least in enumerate((1.0, 0.9, 0.4)):
        mine = set(names[of::3])
        assert len(hits & mine) >= least * len(mine), (rates[of], len(hits & mine))
    assert len(hits & set(rare)) <= 0.03 * len(rare) and not hits & set(common)
