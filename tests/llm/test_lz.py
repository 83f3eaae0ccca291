import hashlib

import xxhash

from sparloom.llm import lz_fingerprint as lz


def brute_phrases(text):
    seen, i = {}, 0
    while i < len(text):
        j = i + 1
        while text[i:j] in seen and j <= len(text):
            j += 1
        if j > len(text):
            break
        seen[text[i:j]] = None
        i = j
    return list(seen)


def test_parse_equals_brute_force():
    for t in ["", "a", "aaaaaaaaaa", "abababab", "the cat the cat the hat", "é日é日é"]:
        assert lz.parse(t, set(), "")[0] == brute_phrases(t)


def plain_signature(phrases):
    """Minima of 128 hash functions over a phrase set, in whole numbers, low 16 bits of each."""
    out = []
    hashes = [xxhash.xxh3_64_intdigest(p.encode()) for p in phrases]
    for i in range(128):
        raw = hashlib.sha256(f"phrase family {i}".encode()).digest()
        a, b = int.from_bytes(raw[:8], "little") | 1, int.from_bytes(raw[8:16], "little")
        out.append(min([((h * a + b) % 2**64) >> 32 for h in hashes] or [2**32 - 1]) % 65536)
    return b"".join(x.to_bytes(2, "little") for x in out)


def plain_likeness(a, b):
    return sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (plain_signature(brute_phrases(x)) for x in (t, edited, nxt))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), plain_likeness(a, b), plain_likeness(a, c)))
    return out


ROWS = [(i * 13 % 47, f"word{i % 7} and é more text {i}" * (i % 9)) for i in range(47)] + [(900, "long one " * 3000), (901, None), (902, ""), (5, "tie a"), (5, "tie b"), (None, "no id"), (None, None)]


def test_query_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in ROWS], "doc_id long, text string, fingerprint string, at double").repartition(3)
    got = [tuple(r) for r in lz.edit_likeness(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id int, text string")
    assert [tuple(r) for r in lz.edit_likeness(one).collect()] == brute([(1, "abcd")])
    assert lz.edit_likeness(one.limit(0)).count() == 0


def test_likeness_orders_texts():
    base = " ".join(f"w{i * i % 97}" for i in range(400))
    near = base[:1500] + " something else at the end"
    far = " ".join(f"q{i * 7 % 89}z" for i in range(400))
    a, b, c = map(lz.fingerprint, (base, near, far))
    assert lz.likeness(a, a) == 1.0 and lz.likeness(a, b) > lz.likeness(a, c)
