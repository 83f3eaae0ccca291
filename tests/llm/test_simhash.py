import os
import random
import re

import numpy as np
import xxhash

from sparloom.llm import graph, simhash
from sparloom.llm.common import Scratch


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    import re

    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


TEXTS = ["", None, " \t\n", "one", "one two", "One two THREE", "one two three four", "É é x y z", "a b c d a b c d a b c", "ÀÉ K k q", "x " * 9000]


def test_fingerprint_equals_brute_force():
    for t in TEXTS:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t or "")


def test_codes_cover_and_no_link_is_lost():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    homes, _ = simhash.anchors(a, 0)
    for flips in (0, 1, 2):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        replicas = [set() for _ in b]
        for rows, values in simhash.anchors(b, 2)[1]:
            for r, v in zip(rows.tolist(), values.tolist(), strict=True):
                assert v not in replicas[r]
                replicas[r].add(v)
        assert all(int(h) in s for h, s in zip(homes, replicas, strict=True))
        assert max(map(len, replicas)) < 300


def brute(rows):
    fps = [brute_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d if d is not None else -1), f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            edit = list(base)
            edit[rng.randrange(len(edit))] = "edited"
            rows.append((len(rows), " ".join(edit)))
    return [*rows, (None, "one two"), (3, "one"), (3, "one"), (None, "nothing like it at all")]


def test_query_equals_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, root string").repartition(3)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex("fp").alias("fp"), "component_id").collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fp, r.component_id) for r in got) == brute(rows)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(3):
            y = x
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= -(1 << 63) if bit == 63 else 1 << int(bit)
            fps.add(y)
    fps = sorted(fps)
    want = {(a, b) for i, b in enumerate(fps) for a in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (300, 299), (299, 300)]
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
        assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
        folder = scratch.folder.removeprefix("file://")
        assert len(os.listdir(folder)) == 2  # of the rounds only the last one's table is left
    assert not os.path.exists(folder)
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 140)}, 300: 299}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bit_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 10, 1000):
        w = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert simhash.bit_counts(w).tolist() == [int(((w >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def shingles(t):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_groups_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "two words")]
    for _ in range(60):
        base = [words[int(3000 * rng.random() ** 3)] for _ in range(rng.randint(30, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            rate = rng.choice([0.0, 0.003, 0.006, 0.012, 0.03, 0.2])
            edit = [rng.choice(words) if rng.random() < rate else w for w in base]
            rows.append((len(rows), " ".join(edit).upper() if rng.random() < 0.1 else " ".join(edit)))
    docs = spark.createDataFrame([*rows, (None, "one"), (4, "two words")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    want, _ = exact_groups(rows)
    assert got == want | {None: 2}
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_one_row_of_each_group_stays(spark):
    """Null ids, repeated ids with different texts, rows repeated whole, and columns that clash."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c", 1), (None, "d e f", 2), (None, "d e f", 2), (7, long, 3), (7, "other text", 4), (7, "other text", 5), (9, long + " end", 6), (None, long, 7), (8, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int").repartition(3)
    kept = sorted([tuple(r) for r in simhash.keep_one(docs).collect()], key=str)
    assert kept == sorted([rows[0], rows[1], rows[3], rows[4], rows[8]], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_bins_that_are_dealt_out_lose_no_pair(spark, monkeypatch):
    """Sub-bins and blocks of a few entries, over texts that share most of their shingles."""
    rng = random.Random(3)
    atoms = [" ".join(f"a{i}{j}" for j in range(6)) for i in range(14)]
    rows = [(i, " ".join(atoms[c] for c in sorted(rng.sample(range(14), rng.choice((10, 11, 12)))))) for i in range(120)]
    want, _ = exact_groups(rows)
    assert 1 < len(set(want.values())) < 119
    monkeypatch.setattr(simhash, "_SUB_BIN", 5)
    monkeypatch.setattr(simhash, "_BLOCK", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want


def exact_groups(rows):
    """The components of all pairs at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = []
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            j_ij = shared / (len(sets[i]) + len(sets[j]) - shared)
            close += [j_ij] if 0.7 < j_ij < 0.9 else []
            if j_ij >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}, close


def words_of(rng, n, vocabulary=3000):
    return ["w" + str(int(vocabulary * rng.random())) for _ in range(n)]


def test_groups_are_exact_for_blocks_appended_text_and_cuts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        base = words_of(rng, rng.randint(60, 300))
        share = rng.uniform(0.08, 0.26)
        k, at = int(len(base) * share), rng.randrange(int(len(base) * (1 - share)))
        other = [base + words_of(rng, k), base[: len(base) - k], base[:at] + words_of(rng, k // 2) + base[at + k // 2 :]][i % 3]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want, close = exact_groups(rows)
    assert sum(j >= 0.8 for j in close) > 30 and sum(j < 0.8 for j in close) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want


def test_no_pair_of_a_crowded_bin_stays_untried(spark):
    """Every shingle stands in most documents, so copies meet only in bins full of others."""
    rng = random.Random(6)
    atoms = [" ".join(f"a{i}{j}" for j in range(5)) for i in range(20)]
    text = lambda chosen: " x x x x ".join(["", *[atoms[c] for c in sorted(chosen)], ""])
    rows = []
    for i in range(40):
        some = rng.sample(range(20), 12)
        swapped = [*some[1:], rng.choice([c for c in range(20) if c not in some])]
        rows += [(2 * i, text(some)), (2 * i + 1, text(swapped))]
    want, _ = exact_groups(rows)
    assert 5 < len(set(want.values())) < 41
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want


def test_the_threshold_is_decided_on_whole_sets(spark):
    """Pairs just above and just below 0.8: none is refused, and none is merged."""
    rng = random.Random(9)
    rows, above = [], []
    for i in range(60):
        base = words_of(rng, 404, 10**6)
        k = 100 + (-1, 1)[i % 2]  # of 400 shingles and k more, 400 are shared
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + words_of(rng, k, 10**6)))]
        above.append(k <= 100)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(60)] == above


def _licence_rows(n, rng):
    """Short texts that share a line of twenty words and have two to nine of their own."""
    line = " ".join(f"licence{i}" for i in range(20))
    return [(i, line + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.randint(2, 9)))) for i in range(n)]


def test_short_texts_with_one_frequent_line(spark, monkeypatch):
    """Those with few words of their own are similar, the others aren't, in bins that are dealt out."""
    rows = _licence_rows(150, random.Random(8))
    want, close = exact_groups(rows)
    assert 1 < len(set(want.values())) < 149 and any(j < 0.8 for j in close)
    monkeypatch.setattr(simhash, "_SUB_BIN", 30)
    monkeypatch.setattr(simhash, "_BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want


def test_entries_without_a_partner_go_before_pairs_are_made():
    """Of texts that share a line of twenty words and have 5 to 9 of their own none reaches another, however many there
    are, so nothing of the line's bins is tried; with 2 to 4 some do."""
    for own, reached in (((5, 9), False), ((2, 4), True)):
        sets = [(16 + k, k) for k in range(own[0], own[1] + 1)]  # members, and where the line's first shingle stands
        sets = [(n, i) for n, i in sets if i < simhash.prefix_length(np.array(n), 0.8)]
        least = min((n for n, _ in sets), default=0)
        assert any(simhash.largest_partner(n, i, 0.8) >= least for n, i in sets) == reached


def test_first_shared_places_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n, m, both = int(rng.integers(1, 40)), int(rng.integers(1, 40)), 0
        a, b = set(rng.choice(60, n, replace=False).tolist()), set(rng.choice(60, m, replace=False).tolist())
        if rng.random() < 0.7:
            b = set(rng.permutation(sorted(a))[: max(1, n - int(rng.integers(0, 4)))].tolist()) | set(rng.choice(60, int(rng.integers(0, 4))).tolist())
        both = len(a & b)
        if both / len(a | b) < 0.8:
            continue
        x, y = sorted(a), sorted(b)
        first = min(a & b)
        i, j = x.index(first), y.index(first)
        assert i < simhash.prefix_length(np.array(len(x)), 0.8) and j < simhash.prefix_length(np.array(len(y)), 0.8)
        assert simhash.may_meet_first(len(x), i, len(y), j, 0.8) and simhash.largest_partner(len(x), i, 0.8) >= len(y)
