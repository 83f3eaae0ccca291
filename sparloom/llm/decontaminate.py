"""Benchmark decontamination by latent semantic retrieval (operator 1).

1. Every document becomes the hashes of its words, kept zstd-compressed in the shared folder.
2. TF-IDF passages over hashed features: passage frequencies are counted over all documents.
3. A randomised singular value decomposition of the passage matrix: each task multiplies its passages with a
   random matrix and back, the products are summed block by block, the driver orthonormalises the sum (its
   size is fixed: features x sketch), and a second pass gives the small matrix whose eigenvectors turn that
   basis into the leading right singular vectors.  A third pass evens out the latent space.
4. Every window of every document is compared, by cosine in the latent space, with the windows of the
   benchmark items, which are the stated query set and are broadcast; nothing is capped.  Items shorter than a
   window would drown in foreign text there, so they are looked up by words: of a leaked item's rarest words,
   as many as may be missing and one more, a place has one at least.
5. Candidates are checked exactly: the longest common subsequence of the item's words and the words around
   the window, as a share of the item, and the same for the item's answer (its last sentence).  An item
   leaks where nearly all of its words follow one another, or most do and its answer is there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, arrow_rows, cut, keeping_nothing, row_key, ship, small_batches, text_chunks, text_of, without_rows
from sparloom.llm.words import hashed_words

FEATURES = 1 << 13
#: Query items are broadcast with their words and vectors, as many at a time as stay below this.
BATCH_BYTES = 48 << 20
_CHUNK = 1 << 16


@dataclass(frozen=True)
class Rules:
    """``cell`` and ``cells``: a window is ``cells`` steps of ``cell`` words; ``passage``: words of a passage
    of the decomposition; ``rank``, ``sketch``: latent dimensions kept and sampled; ``cosine``: for
    candidates; ``verbatim``, ``paraphrase``, ``answer``: shares of an item's words (and answer's words) that
    must be found in order; ``slack``: words around the item's place that are looked at too."""

    cell: int = 6
    cells: int = 3
    passage: int = 64
    rank: int = 48
    sketch: int = 56
    cosine: float = 0.55
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.7
    slack: int = 6
    seed: int = 1


def feature(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint32(1)) & np.uint32(FEATURES - 1)).astype(np.uint16)


def hashed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, row_key, z): id, row key and the zstd-compressed word hashes of the whole text."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for part in text_chunks(batches):
            z = [squeeze.compress(h.astype("<u4").tobytes()) for h in hashed_words(part.column(2).to_pylist(), "words")]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], names=["k", "row_key", "z"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), row_key(id_col, text_col), text_of(text_col)).mapInArrow(keeping_nothing(each), f"k {kind}, row_key binary, z binary")


def _loaded(rows: Iterable[tuple]) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Documents in lists of about _CHUNK words; a longer document is a list of its own."""
    import zstandard

    loosen = zstandard.ZstdDecompressor()
    held, n = [], 0
    for *key, z in rows:
        h = np.frombuffer(loosen.decompress(z), "<u4")
        if not len(h):
            continue
        held.append((key, h))
        n += len(h)
        if n >= _CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def _steps(held: list[tuple[object, np.ndarray]], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Features in pieces of ``step`` words, a row each, and pieces by document.  A document's last piece is
    filled up with the feature FEATURES, which stands for nothing."""
    lengths = np.array([len(h) for _, h in held])
    pieces = -(-lengths // step)
    out = np.full(pieces.sum() * step, FEATURES, np.uint16)
    to = np.repeat((np.cumsum(pieces) - pieces) * step - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    out[to] = feature(np.concatenate([h for _, h in held]))
    return out.reshape(-1, step), pieces


def _piece_sums(pieces: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of the table's rows over each piece, some thousand words at a time."""
    n, step = pieces.shape
    out = np.empty((n, table.shape[1]), np.float32)
    rows = max(1, 16384 // step)
    for at in range(0, n, rows):
        part = pieces[at : at + rows]
        out[at : at + rows] = table.take(part.ravel(), axis=0).reshape(len(part), step, -1).sum(axis=1)
    return out


def _with_nothing(table: np.ndarray) -> np.ndarray:
    return np.concatenate((table, np.zeros((1, table.shape[1])))).astype(np.float32)


def _sum_blocks(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Sums equal-sized arrays by block, in two steps so that no task adds up what all others send; the driver
    gets one row a block."""

    def add(rows: Iterable[tuple]) -> Iterator[tuple]:
        sums: dict[int, np.ndarray] = {}  # a number of blocks of fixed size
        for block, data in rows:
            v = np.frombuffer(data, dtype)
            sums[block] = sums[block] + v if block in sums else v.astype(np.float64)
        for block, total in sums.items():
            yield block, total.astype(dtype).tobytes()

    salted = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("block", "salt").select("block", "data")
    some = arrow_rows(salted, add, "block int, data binary", chunk=16)
    summed = arrow_rows(some.repartition("block"), add, "block int, data binary", chunk=16)
    with small_batches(parts.sparkSession):
        return {r["block"]: np.frombuffer(r["data"], dtype).astype(np.float64) for r in summed.collect()}


def passage_counts(hashed: DataFrame, passage: int) -> tuple[np.ndarray, int]:
    """Passages with each feature, and passages, over all documents."""

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for held in _loaded(rows):
            pieces, _ = _steps(held, passage)
            for at in range(0, len(pieces), 1024):
                part = pieces[at : at + 1024]
                there = np.zeros((len(part), FEATURES + 1), bool)
                there[np.arange(len(part))[:, None], part] = True
                df[:FEATURES] += np.count_nonzero(there[:, :FEATURES], axis=0)
            n += len(pieces)
        df[FEATURES] = n
        yield 0, df.tobytes()

    got = _sum_blocks(arrow_rows(hashed.select("z"), count, "block int, data binary"), "<i8").get(0)
    return (got[:FEATURES], int(got[FEATURES])) if got is not None else (np.zeros(FEATURES), 0)


def latent_basis(hashed: DataFrame, idf: np.ndarray, rules: Rules) -> np.ndarray:
    """(features + 1) x rank: the latent vector of each word, by the leading right singular vectors and idf; the
    last row, for no word, is zero."""
    spark = hashed.sparkSession
    wide = 64  # features to a block of the sum
    omega = np.random.default_rng(rules.seed).standard_normal((FEATURES, rules.sketch)).astype(np.float32)
    start = spark.sparkContext.broadcast(_with_nothing(idf[:, None] * omega))  # 2 MB, whatever the input

    def there_and_back(rows: Iterable[tuple]) -> Iterator[tuple]:
        table, z = start.value, np.zeros((FEATURES, rules.sketch), np.float64)
        for held in _loaded(rows):
            pieces, _ = _steps(held, rules.passage)
            y = _piece_sums(pieces, table)
            f = pieces.ravel().astype(np.int64)
            for c in range(rules.sketch):
                z[:, c] += np.bincount(f, weights=np.repeat(y[:, c], rules.passage), minlength=FEATURES + 1)[:FEATURES]
        for block in range(FEATURES // wide):
            part = z[block * wide : (block + 1) * wide]
            if part.any():
                yield block, part.tobytes()

    summed = _sum_blocks(arrow_rows(hashed.select("z"), there_and_back, "block int, data binary", chunk=16), "<f8")
    z = np.zeros((FEATURES, rules.sketch))
    for block, data in summed.items():
        z[block * wide : (block + 1) * wide] = data.reshape(wide, rules.sketch)
    q, _ = np.linalg.qr(idf[:, None] * z)
    values, vectors = np.linalg.eigh(_second_moment(hashed, _with_nothing(idf[:, None] * q), rules.passage, False))
    top = np.argsort(values)[::-1][: rules.rank]
    top = top[values[top] > max(values.max(), 0) * 1e-9]
    # words as directions in the latent space, so that rare ones tell as much as their weight says ...
    words = _with_nothing(idf[:, None] * _unit(q @ (vectors[:, top] / np.sqrt(values[top]))))
    # ... turned and scaled so that passages spread evenly over all directions: else those of one language
    # all point the same way
    spread, turn = np.linalg.eigh(_second_moment(hashed, words, rules.passage, True))
    some = spread > max(spread.max(), 0) * 1e-6
    return (words @ (turn[:, some] / np.sqrt(spread[some]))).astype(np.float32)


def _second_moment(hashed: DataFrame, table: np.ndarray, passage: int, unit: bool) -> np.ndarray:
    """The sum of b'b over all passages b (scaled to length one, if so asked): a matrix of fixed size."""
    shared = hashed.sparkSession.sparkContext.broadcast(table)  # at most 2 MB
    width = table.shape[1]

    def gram(rows: Iterable[tuple]) -> Iterator[tuple]:
        g = np.zeros((width, width))
        for held in _loaded(rows):
            b = _piece_sums(_steps(held, passage)[0], shared.value)
            b = _unit(b) if unit else b
            g += (b.T @ b).astype(np.float64)
        yield 0, g.tobytes()

    return _sum_blocks(arrow_rows(hashed.select("z"), gram, "block int, data binary"), "<f8")[0].reshape(width, width)


# ---- items and checks ----------------------------------------------------------------------------------


def answer_of(text: str) -> str:
    """What follows the last "answer:" of an item, or else its last sentence or line."""
    if m := re.search(r".*\banswers?\s*:\s*(.+)", text, re.S | re.I):
        return m[1]
    pieces = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if re.search(r"\w", p)]
    return pieces[-1] if pieces else ""


def item_windows(n: int, width: int) -> list[tuple[int, int]]:
    """Starts and ends of an item's query windows: every two thirds of a window, the last at its end."""
    if n <= width:
        return [(0, n)] if n else []
    starts = list(range(0, n - width, max(1, 2 * width // 3)))
    return [(s, s + width) for s in [*starts, n - width]]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit a word of ``a``."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        if m := where.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def telling_words(h: np.ndarray, rarity: np.ndarray, share: float) -> set[int]:
    """Of an item's words the rarest, as many that any text with ``share`` of the item's words has one."""
    missing = len(h) - int(np.ceil(share * len(h) - 1e-9))
    return set(h[np.argsort(-rarity[feature(h)], kind="stable")[: missing + 1]].tolist())


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(size, 1e-20)


def _batches(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(item id, word hashes, hashes of the answer's words) of items that have words, in lists that stay below
    BATCH_BYTES with their vectors (an item above it is a list of its own).  The driver holds one list."""
    held: list[tuple] = []
    size = 0
    for name, text in benchmark.select(item_col, text_of(text_col)).toLocalIterator():
        h, answer = (x.astype(np.uint32) for x in hashed_words([text, answer_of(text)], "words"))
        if not len(h):
            continue
        cost = 300 + 60 * len(h)  # words as numbers and as objects, a vector every twelve words
        if held and size + cost > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append((name, h, answer))
        size += cost
    if held:
        yield held


def _best_place(asked: tuple, h: np.ndarray, starts: Iterable[int], rules: Rules) -> tuple | None:
    """(share, answer share, start, end) of the best of the places in a text of word hashes ``h`` where an item
    may start: largest shares, then first.  None if it leaks at none."""
    _, words, answer = asked
    best, seen = None, None
    for begin in starts:
        lo, hi = max(0, begin - rules.slack), min(len(h), begin + len(words) + rules.slack)
        if (lo, hi) == seen or lo >= hi:
            continue
        seen, there = (lo, hi), h[lo:hi]
        share = lcs(words, there) / len(words)
        if share < rules.paraphrase:
            continue
        told = lcs(answer, there) / len(answer) if len(answer) else 1.0
        if (share >= rules.verbatim or told >= rules.answer) and (best is None or (share, told) > best[:2]):
            best = share, told, lo, hi
            if share == told == 1:
                break
    return best


def _search(hashed: DataFrame, items: list[tuple], basis: np.ndarray, idf: np.ndarray, rules: Rules, schema: str) -> DataFrame:
    """Every place of every text of ``hashed`` where one of ``items`` leaks."""
    width = rules.cell * rules.cells
    long = [(i, s, e) for i, (_, h, _) in enumerate(items) if len(h) >= width for s, e in item_windows(len(h), width)]
    places = [(i, s) for i, s, _ in long]
    queries = np.array([basis[feature(items[i][1][s:e])].sum(axis=0) for i, s, e in long]).reshape(len(long), basis.shape[1])
    short: dict[int, list[int]] = {}
    for i, (_, h, _) in enumerate(items):
        for w in telling_words(h, idf, rules.paraphrase) if len(h) < width else ():
            short.setdefault(w, []).append(i)
    # at most some BATCH_BYTES
    shared = hashed.sparkSession.sparkContext.broadcast((basis, _unit(queries).astype(np.float32), places, items, short))

    def short_places(h: np.ndarray, keys: np.ndarray, plain: list[list[int]]) -> Iterator[tuple[int, list[int]]]:
        """Short items of which a telling word is in the text, and the starts of all places around it where
        enough of the item's words are."""
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)
        hits: dict[int, list[int]] = {}
        for p in at.tolist():
            for item in shared.value[4][int(h[p])]:
                hits.setdefault(item, []).append(p)
        for item, where in hits.items():
            words, starts = plain[item], set()
            reach = len(words) + 2 * rules.slack
            for p in where:
                near = set(h[max(0, p - reach) : p + reach].tolist())
                if sum([x in near for x in words]) >= rules.paraphrase * len(words):
                    starts.update(range(p - len(words) - rules.slack + 1, p + rules.slack + 1))
            if starts:
                yield item, sorted(starts)

    def search(rows: Iterable[tuple]) -> Iterator[tuple]:
        table, wanted, where, asked, telling = shared.value
        plain = [h.tolist() for _, h, _ in asked]
        keys = np.array(sorted(telling), np.uint32)
        for held in _loaded(rows):
            for key, h in held if len(keys) else ():
                for item, starts in short_places(h, keys, plain):
                    if best := _best_place(asked[item], h, starts, rules):
                        share, told, lo, hi = best
                        text, query = (table[feature(x)].sum(axis=0, keepdims=True) for x in (h[lo:hi], asked[item][1]))
                        yield *key, asked[item][0], round(float((_unit(text) * _unit(query)).sum()), 6), share, told, lo, hi
            if not len(wanted):
                continue
            filled, pieces = _steps(held, rules.cell)
            cells = _piece_sums(filled, table)
            cells = np.concatenate((cells, np.zeros((rules.cells, cells.shape[1]), np.float32)))
            per_doc = np.maximum(1, pieces - rules.cells + 1)
            doc = np.repeat(np.arange(len(held)), per_doc)
            inside = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            first = (np.cumsum(pieces) - pieces)[doc] + inside
            window = np.zeros((len(doc), cells.shape[1]), np.float32)
            for c in range(rules.cells):
                window += np.where((inside + c < pieces[doc])[:, None], cells[first + c], 0)
            window = _unit(window)
            for at in range(0, len(window), 1024):
                tried: dict[tuple[int, int, int], float] = {}
                for to in range(0, len(wanted), 1 << 14):
                    near = window[at : at + 1024] @ wanted[to : to + (1 << 14)].T
                    rows_hit = np.flatnonzero(near.max(axis=1) >= rules.cosine)
                    hit, query = np.nonzero(near[rows_hit] >= rules.cosine)
                    for w, q in zip(rows_hit[hit].tolist(), query.tolist(), strict=True):
                        item, offset = where[to + q]
                        place = (int(doc[at + w]), item, int(inside[at + w]) * rules.cell - offset)
                        tried[place] = max(tried.get(place, -1.0), float(near[w, q]))
                for (d, item, begin), cosine in tried.items():
                    key, h = held[d]
                    found = set(h[max(0, begin - rules.slack) : begin + len(plain[item]) + rules.slack].tolist())
                    # words that aren't there at all bound the common subsequence from above
                    if sum([x in found for x in plain[item]]) < rules.paraphrase * len(plain[item]):
                        continue
                    if best := _best_place(asked[item], h, [begin], rules):
                        yield *key, asked[item][0], round(cosine, 6), *best

    return arrow_rows(hashed, search, schema)


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, rules: Rules, by: str) -> DataFrame:
    """One row a document, told apart by ``by`` (id or row_key), and item that leaks into it."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, row_key binary, item {item_kind}, cosine double, lcs_share double, answer_share double, first_word long, end_word long"
    found = spark.createDataFrame([], schema)
    with Scratch(spark) as scratch:
        basis = None
        for items in _batches(benchmark, item_col, item_text_col):
            if basis is None:
                hashed = scratch.write(hashed_documents(docs, id_col, text_col))
                counts, n = passage_counts(hashed, rules.passage)
                if not n:
                    break
                idf = np.log((n + 1) / (counts + 0.5)).clip(0.0)
                basis = latent_basis(hashed, idf, rules)
            found = found.unionByName(scratch.write(_search(hashed, items, basis, idf, rules, schema)))
        best = F.max_by(F.struct("cosine", "lcs_share", "answer_share", "first_word", "end_word"), F.struct("lcs_share", "answer_share", -F.col("first_word")))
        return cut(found.groupBy(by, "item").agg(best.alias("b")).select(by, "item", "b.*"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """One row a document and item that leaks into it: id, item id, ``cosine``, ``lcs_share``,
    ``answer_share``, ``first_word`` and ``end_word`` (the place looked at, in words of the document), of the
    best place (largest shares, then first).

    Items without words, null documents and empty ones have no rows.  Equal items and repeated documents each
    give their rows (rows of one id are merged); null ids are kept as ids.  Whole texts are searched, for any
    number of items, a batch of bounded size at a time.  An empty corpus or benchmark gives no rows.
    """
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, rules, "id")
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents into which no item leaks, all their columns and rows.  Rows without an id or with a
    repeated one stay or go each by its own text."""
    found = _leaks(docs, benchmark, id_col, text_col, "item_id", "text", rules, "row_key")
    return without_rows(docs, found.select("row_key").distinct(), id_col, text_col)
