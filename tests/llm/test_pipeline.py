"""The pipeline's decisions against plain versions that call none of the operators."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from sparloom.llm.common import table

STAGE = dict(P.STAGES)


def shingles(t):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(texts):
    """Components by all pairs of documents that share a shingle."""
    sets, root, by = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}, {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in sorted(sets):
        shared = Counter(o for s in sets[k] for o in by.get(s, ()))
        for o, n in shared.items():
            if n >= 0.8 * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((find(k), find(o)))
                root[b] = a
        for s in sets[k]:
            by.setdefault(s, []).append(k)
    return {k: find(k) for k in texts}


def test_filters_on_given_tables(spark, sf):
    docs = table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf, "labels").collect()}
    good = STAGE["quality"](spark, docs, sf)
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    clean, poor = [k for k, (q, t) in labels.items() if q == 1 and t == 0], [k for k, (q, _) in labels.items() if q == 0]
    assert sum(k in ids for k in clean) >= 0.98 * len(clean) and sum(k not in ids for k in poor) >= 0.9 * len(poor)

    single = STAGE["near_duplicates"](spark, docs, sf)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups(text).values()))

    left = STAGE["decontamination"](spark, docs, sf)
    items = [r.text for r in table(spark, sf, "benchmark").collect() if r.text]
    planted = {k for k, t in text.items() if any(i in (t or "") for i in items)}
    kept = {r.doc_id for r in left.collect()}
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    # whatever goes has most of an item's words; whatever has an item whole goes
    assert left.columns == docs.columns and planted and not planted & kept
    assert all(any(len(words(i) & words(text[k])) >= 0.6 * len(words(i)) for i in items) for k in set(text) - kept)


def test_run_writes_what_its_stages_leave(spark, sf, tmp_path):
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    folder = "file://" + str(tmp_path / "run")
    final = P.run(spark, sf, folder).orderBy("start").collect()
    again = P.run(spark, sf, folder).orderBy("start").collect()  # nothing is left to do
    assert final == again
    from tokenizers import Tokenizer

    lib, start = Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json")), 0
    for r in final:
        ids = np.array([*lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # mixed, not sorted; and the files are where the index says
    assert [r.doc_id for r in final] != sorted(r.doc_id for r in final)
    files = {(r.path, r.file) for r in final}
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(final[0].path)
    assert {p.rsplit("/", 1)[-1] for p in (r.path for r in stored.select("path").collect())} == {f for _, f in files}


def test_run_goes_on_after_the_last_stage(spark, sf, tmp_path):
    folder = "file://" + str(tmp_path / "lost")
    docs = table(spark, sf, "documents").filter("doc_id < 40")
    docs.write.parquet(f"{folder}/3-mixing")
    assert {r.doc_id for r in P.run(spark, sf, folder).collect()} == {r.doc_id for r in docs.collect()}


def test_null_and_repeated_ids_lose_no_row(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r.doc_id for r in table(spark, sf, "labels").filter("quality = 1 AND toxic = 0").collect()}
    some = [r for r in docs.collect() if r.doc_id in labels and len(r.text or "") > 300][:6]
    rows = [(None, *some[0][1:]), (None, *some[1][1:]), (10**6, *some[2][1:]), (10**6, *some[3][1:])]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    mine = lambda df: sorted(r.text for r in df.filter("doc_id IS NULL OR doc_id = 1000000").collect())
    assert mine(STAGE["quality"](spark, odd, sf)) == sorted(r[1] for r in rows)
    left = {r.text for r in STAGE["decontamination"](spark, docs, sf).collect()}
    assert mine(STAGE["decontamination"](spark, odd, sf)) == sorted(r[1] for r in rows if r[1] in left)


def test_empty_and_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0)], docs.schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, odd, sf)
        assert out.count() == (1 if name == "near_duplicates" else 3) or name == "mixing"
        if name != "token_files":
            assert out.columns == docs.columns
