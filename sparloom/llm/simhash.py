"""SimHash near-duplicates through anchor-point covering (operator 3).

The 64 fingerprint bits are cut into blocks and a covering code is chosen for each; a product of codewords
is an anchor.  A code with covering radius R has a codeword within R of every point.  A fingerprint's home
is its nearest anchor, block by block.  If two fingerprints differ by at most t bits, the second lies within
R_i + d_i of the first one's home in block i, where the d_i add up to at most t; so every fingerprint is
replicated to all anchors within covering radius plus threshold in that sense, and compared, per anchor,
with the fingerprints at home there.  No link is lost, and none needs a bucket cap.

Blocks: two perfect binary codes of length 23 (12 information bits, radius 3), one perfect code of length
15 (11 information bits, radius 1) and 3 bits taken as they are (radius 0): 2^38 anchors, and about 230
replicas of a fingerprint at t = 2, each 16 bytes.  Equal fingerprints are one entry, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, arrow_rows, cut, few, free_name, keeping_nothing, row_key, ship, small_batches, text_chunks, text_of, without_rows
from sparloom.llm.graph import components
from sparloom.llm.words import hashed_words, mixed

#: Fixed values: (length, parity bits, generator polynomial) of two perfect cyclic codes; the plain bits.
BLOCKS = ((23, 11, 0b101011100011), (23, 11, 0b101011100011), (15, 4, 0b10011), (3, 0, 1))
RADIUS = (3, 3, 1, 0)


# ---- fingerprints --------------------------------------------------------------------------------------

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Lower-cases A-Z, takes words between ASCII white space and shingles of ``shingle`` words, repeats
    included (the whole sequence if there are fewer words); bit i is set if over half of the shingles' XXH64
    have it.  No words: 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: the six ASCII spaces
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([hashed(joined[a:z], seed) for a, z in spans], np.uint64)
    return majority(hashes)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 64-bit words have each bit, by carry-save adders: three words of a weight become one
    of that weight and one of the next, until at most two of each weight are left."""
    total, weight = np.zeros(64, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            k = len(words) // 3
            x, y, z = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            either = x ^ y
            carries.append((x & y) | (z & either))
            words = np.concatenate((either ^ z, words[3 * k :]))
        total += weight * np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return total


def majority(hashes: np.ndarray) -> int:
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, one row per input row, null texts as empty."""

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, _signed(fingerprint(text, shingle, seed))

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs.select(F.col(id_col), text_of(text_col).alias("t")), each, f"`{id_col}` {kind}, fp long")


# ---- anchors -------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _block_table(length: int, parity: int, generator: int, radius: int, extra: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of single bits, and for each syndrome the error patterns by level: level 0 the lightest
    pattern (smallest on ties), level d those of weight radius + d (level 0 holds the home alone)."""
    single = np.zeros(length, np.int64)
    for i in range(length):
        r = 1 << i
        for j in range(length, parity - 1, -1):
            if r >> j & 1:
                r ^= generator << (j - parity)
        single[i] = r if parity else 0
    found: list[list[list[int]]] = [[[] for _ in range(extra + 1)] for _ in range(1 << parity)]
    for weight in range(min(length, radius + extra) + 1):
        for bits in combinations(range(length), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            found[s][max(0, weight - radius)].append(sum(1 << b for b in bits))
    table = []
    for levels in found:
        home = levels[0][0]
        # perfect codes have just one pattern within the radius; a plain block's is the empty one
        table.append([np.array([home], np.uint64), *[np.array(x, np.uint64) for x in levels[1:]]])
    return single, table


def _syndromes(part: np.ndarray, single: np.ndarray) -> np.ndarray:
    s = np.zeros(len(part), np.int64)
    for i, v in enumerate(single):
        s ^= ((part >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * int(v)
    return s


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The home of each fingerprint, and (row, anchor) pairs of all its replicas, in pieces."""
    homes = np.zeros(len(fps), np.uint64)
    shift, per_block = 0, []
    for (length, parity, generator), radius in zip(BLOCKS, RADIUS, strict=True):
        part = (fps >> np.uint64(shift)) & np.uint64((1 << length) - 1)
        single, table = _block_table(length, parity, generator, radius, threshold)
        s = _syndromes(part, single)
        homes |= (part ^ np.array([t[0][0] for t in table], np.uint64)[s]) << np.uint64(shift)
        # the change from the home to each anchor of a level, as one flat list a level
        levels = []
        for d in range(threshold + 1):
            sizes = np.array([len(t[d]) for t in table])
            flat = np.concatenate([t[d] ^ t[0][0] for t in table]) << np.uint64(shift)
            levels.append((np.concatenate(([0], np.cumsum(sizes)[:-1]))[s], sizes[s], flat))
        per_block.append(levels)
        shift += length
    out = []

    def spread(rows: np.ndarray, values: np.ndarray, block: int, left: int) -> None:
        if block == len(BLOCKS):
            out.append((rows, values))
            return
        for d in range(left + 1):
            if d == 0:  # the home block: one pattern, no change
                spread(rows, values, block + 1, left)
                continue
            first, size, flat = (x[rows] if i < 2 else x for i, x in enumerate(per_block[block][d]))
            if not size.any():
                continue
            again = np.repeat(np.arange(len(rows)), size)
            within = np.arange(len(again)) - np.repeat(np.cumsum(size) - size, size)
            spread(rows[again], values[again] ^ flat[first[again] + within], block + 1, left - d)

    spread(np.arange(len(fps)), homes, 0, threshold)
    return homes, out


def fingerprint_links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): all pairs of different fingerprints, a < b as signed numbers, at ``threshold`` or fewer
    differing bits.  ``distinct`` has one row a fingerprint, in a column ``fp``."""
    if not 0 <= threshold <= 4:
        raise ValueError("the replicas of a threshold above 4 are too many")

    def replicas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for rows, anchor in anchors(fps, threshold)[1]:
                    for i in range(0, len(rows), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[i : i + (1 << 16)].view(np.int64)), pa.array(fps[rows[i : i + (1 << 16)]].view(np.int64))], names=["anchor", "b"])

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchors(values.view(np.uint64), 0)[0].view(np.int64)), pa.array(values)], names=["anchor", "a"])

    ship(distinct.sparkSession)
    at_home = distinct.select("fp").mapInArrow(keeping_nothing(home), "anchor long, a long")
    # the replicas are many times the rows: whatever few partitions the fingerprints are in, they are dealt out
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = dealt.mapInArrow(keeping_nothing(replicas), "anchor long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    # each link is met at both ends' homes; one direction is enough
    return placed.join(at_home, "anchor").filter((F.col("a") < F.col("b")) & near).select("a", "b")


# ---- operator ------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, ``fp`` (signed 64-bit fingerprint), ``component_id`` (the smallest id
    reachable over links of ``threshold`` or fewer differing bits) and ``n_links`` (other fingerprints that
    the row's own links to).

    Null and empty texts have fingerprint 0 and link like any other; equal texts share a fingerprint and so
    a component.  Null ids stay null and take the smallest id of their component that isn't null (null if
    there is none).  Repeated rows each give a row.  Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        fps = scratch.write(fingerprints(docs, id_col, text_col, shingle, seed))
        # one row a fingerprint: groups of copies of any size shrink before anything else
        distinct = scratch.write(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
        links = scratch.write(fingerprint_links(distinct, threshold))
        roots = components(links, scratch)
        known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
        degree = links.select(F.col("a").alias("fp")).union(links.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
        classes = known.join(smallest, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return cut(fps.join(classes, "fp").select(id_col, "fp", "component_id", "n_links"))


# ---- similar documents ---------------------------------------------------------------------------------

#: Counters that shingles are counted in by hash: 4 MB a task and on the driver.  They only order the shingles
#: from rare to frequent; any order gives the same pairs.  Bits of a set's parity map.
COUNTERS, PIECES, PARITY = 1 << 20, 64, 1024
#: Entries of a shingle's bin to a sub-bin in the first round, and to a block in the second.
_SUB_BIN, _BLOCK = 20_000, 1024
#: How often groups are joined with their nearest ones, at most, before all pairs that are left are tried.
_NEAREST = 5


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order; a text of fewer words is one shingle."""
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    h = np.sort(mixed(h, 5, len(words) if len(words) < shingle else 0))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """The set of each text, over words between ASCII white space, A-Z lower-cased."""
    return [shingle_hashes(w, shingle) for w in hashed_words(texts, "plain")]


def parity_map(hashes: np.ndarray) -> bytes:
    """Bits, each set if an odd number of hashes fall on it: PARITY of them, or a higher power of two for a large
    set.  Two sets' maps of one length differ in at most as many bits as the sets differ in members."""
    bits = max(PARITY, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(parity: bytes, size: int) -> np.ndarray:
    """The map of the same set in ``size`` bytes: its halves laid over one another."""
    x = np.frombuffer(parity, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def prefix_length(n, similarity: float):
    """Of this many shingles of a set of ``n``, in an order common to all sets, any similar set has one among
    as many of its own."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def shared_needed(both, similarity: float):
    """The members two similar sets of ``both`` members together have in common at least."""
    return np.ceil(similarity / (1 + similarity) * both - 1e-9)


def may_be_similar(n, i, m, j, similarity: float):
    """Whether sets of ``n`` and ``m`` members that share the one at place ``i`` and ``j`` can be similar: at
    most the members before it and those from it on are shared."""
    return np.minimum(i, j) + np.minimum(n - i, m - j) >= shared_needed(n + m, similarity)


def may_meet_first(n, i, m, j, similarity: float):
    """Whether sets of ``n`` and ``m`` members whose first shared one is at place ``i`` and ``j`` can be similar: at
    most the members from it on are shared.  Every similar pair has a first shared member, and it is among the first
    ``prefix_length`` of both, so a pair need only be tried where this holds."""
    return np.minimum(n - i, m - j) >= shared_needed(n + m, similarity)


def largest_partner(n, i, similarity: float):
    """The most members that a set can have which is similar to one of ``n`` and shares nothing before its place
    ``i``; works on columns as on arrays."""
    return (n - i) * ((1 + similarity) / similarity) + 1e-6 - n


def _numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True at the first row and wherever one of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _whole_bins(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """The columns of sorted batches, cut so that no bin, by the first ``keys`` columns, is in two pieces.  Bins
    have a bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_numpy(batch.column(i)) for i in range(keys)]
        at = int(np.flatnonzero(_changes(*columns))[-1])  # the last bin may go on
        if at or (held and any(held[-1].column(i)[0].as_py() != c[0] for i, c in enumerate(columns))):
            held.append(batch.slice(0, at))
            yield [c.combine_chunks() for c in pa.Table.from_batches(held).columns]
            held = []
        held.append(batch.slice(at))
    if held:
        yield [c.combine_chunks() for c in pa.Table.from_batches(held).columns]


def _pairs(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]


def shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many documents have shingles of each of COUNTERS hash values."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for some in text_chunks(batches):
            sets = shingle_sets(some.column(0).to_pylist(), shingle)
            total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        for i, part in enumerate(np.split(total.astype("<u4"), PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], names=["piece", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, "<u4").astype("<i8")
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], names=["piece", "counts"])

    counted = texts.mapInArrow(keeping_nothing(count), "piece int, counts binary").repartition("piece").mapInArrow(keeping_nothing(add), "piece int, counts binary")
    out = np.zeros((PIECES, COUNTERS // PIECES), np.int64)
    with small_batches(texts.sparkSession):
        for r in counted.collect():  # PIECES rows
            out[r["piece"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel().clip(0, (1 << 32) - 1).astype(np.uint32)


def _set_digest(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha256(members.tobytes()).digest()[:8], "little", signed=True)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, threshold: int = 1) -> DataFrame:
    """One row per input row: id, ``row_key`` (its identity, see ``common.row_key``), ``component_id`` (the
    smallest id of its group of similar documents) and ``kept_key`` (the row of that id; of several, the one with
    the smallest row key).

    Two documents are similar if their sets of word shingles agree in ``similarity`` or more (members shared,
    of all members); groups are the components of this relation, which is decided on the whole sets.

    Pairs are tried in two rounds.  The first takes those whose SimHash fingerprints, over the same shingles,
    differ in ``threshold`` bits or fewer, by the anchors that cover them, and tries each entry of a shingle's bin
    with the bin's first and with the one before; that joins copies, however many, in a number of pairs in
    proportion to the entries.  The second makes the whole exact, which no fingerprint is: in any order common
    to all sets similar sets meet in the first ``prefix_length`` shingles of each, the order goes from rare
    shingles to frequent ones so that few others meet there, and all pairs that meet are tried unless they are
    in one group already or their sizes, places or parity maps rule them out.  A pair is tried where its first
    shared shingle is, so what stands before a place counts as not shared: entries that reach no other of their
    bin this way go before any pair is made, as do short texts that share a frequent line and little else.  So that few are left to try, each
    group in a bin is joined with the one nearest to it before, a few times over.  Bins of frequent shingles are
    dealt out: in sub-bins whose first entries meet again, then in pairs of blocks.

    Texts with equal sets are one entry throughout.  Null and empty texts are similar to each other; null ids
    stay null and take the smallest id of their group; repeated rows each give a row; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), text_of(text_col).alias("t"))
    counts = spark.sparkContext.broadcast(shingle_counts(texts.select("t"), shingle))  # COUNTERS numbers

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = counts.value
        for some in text_chunks(batches):
            same, fps, sizes, first, parity, brief = [], [], [], [], [], []
            for members in shingle_sets(some.column(2).to_pylist(), shingle):
                order = np.argsort(frequent[members & np.uint64(COUNTERS - 1)], kind="stable")
                same.append(_set_digest(members))
                fps.append(_signed(majority(members)))
                sizes.append(len(members))
                first.append(members[order[: int(prefix_length(np.array(len(members)), similarity))]].tobytes())
                parity.append(parity_map(members))
                brief.append(folded(parity[-1], PARITY // 8).tobytes())
            made = [pa.array(same, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, pa.binary()), pa.array(parity, pa.binary()), pa.array(brief, pa.binary())]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], names=["id", "row_key", "same", "fp", "n", "first", "parity", "brief"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column(2).to_pylist()
                sizes = np.array([len(x) // 8 for x in raw])
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                h, node = np.frombuffer(b"".join(raw), "<i8"), np.repeat(_numpy(part.column(0)), sizes)
                subs = frequent[h.view(np.uint64) & np.uint64(COUNTERS - 1)] // _SUB_BIN + 1
                sub = np.where(subs > 1, (mixed(node.view(np.uint64), 7) % subs).astype(np.int32), -1)
                cols = [h, sub.astype(np.int32), node, np.repeat(_numpy(part.column(1)), sizes), pos.astype(np.int32)]
                for i in range(0, len(pos), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=["h", "sub", "node", "n", "pos"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs as (0, 0, a, b, 0, 0); entries of bins with pairs left, as (h, what, node, null, n, pos), where
        ``what`` is 2 for the first entries of sub-bins."""
        for h, sub, node, n, pos in (map(_numpy, piece) for piece in _whole_bins(batches, 2)):
            k = np.arange(len(h))
            new = _changes(h, sub)
            first = np.maximum.accumulate(np.where(new, k, 0))
            x = np.concatenate((k[~new] - 1, first[k - first >= 2]))
            y = np.concatenate((k[~new], k[k - first >= 2]))
            ok = may_be_similar(n[x], pos[x], n[y], pos[y], similarity)
            a, b = node[x[ok]], node[y[ok]]
            none = pa.array(np.zeros(len(a), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), none, *_pairs(a, b), none, none], names=["h", "what", "a", "b", "n", "pos"])
            # entries go for which no other of the bin is small enough; a sub-bin doesn't know all of its bin
            least = np.minimum.reduceat(n, k[new])[np.cumsum(new) - 1]
            left = (np.bincount(first, minlength=len(h))[first] > 3) & (largest_partner(n, pos, similarity) >= least) | (sub >= 0)
            what = np.where(new & (sub >= 0), 2, 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[left]), pa.array(what[left]), pa.array(node[left]), pa.nulls(int(left.sum()), pa.int64()), pa.array(n[left]), pa.array(pos[left])], names=["h", "what", "a", "b", "n", "pos"])

    def candidates(piece: list[pa.Array]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of different groups within a bin, or across the two blocks ``u`` and ``v`` of one, that sizes,
        places and parity maps leave: whether a new bin begins, then nodes, their roots and the bits in which
        their maps differ, as a share of their sizes."""
        h, u, v, block, node, n, pos, root = map(_numpy, piece[:8])
        maps = np.frombuffer(b"".join(piece[8].to_pylist()), np.uint64).reshape(len(h), -1)
        starts = np.flatnonzero(_changes(h, u, v))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True):
            fresh = True
            for at in range(lo, hi, 256):
                x, y = np.arange(at, min(at + 256, hi)), np.arange(at, hi)
                ok = (y[None, :] > x[:, None]) & (root[x][:, None] != root[y][None, :])
                if u[lo] != v[lo]:
                    ok &= block[x][:, None] != block[y][None, :]
                i, j = np.nonzero(ok & may_meet_first(n[x][:, None], pos[x][:, None], n[y][None, :], pos[y][None, :], similarity))
                i, j = x[i], y[j]
                for s in range(0, len(i), 1 << 14):
                    p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                    differ, both = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1), n[p] + n[q]
                    ok_too = differ <= both - 2 * shared_needed(both, similarity)
                    p, q = p[ok_too], q[ok_too]
                    yield fresh, np.stack((node[p], node[q])), np.stack((root[p], root[q])), differ[ok_too] / both[ok_too]
                    fresh = False

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _whole_bins(batches, 3):
            for _, nodes, _, _ in candidates(piece):
                yield pa.RecordBatch.from_arrays(_pairs(nodes[0], nodes[1]), names=["a", "b"])

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group in a bin the pair with another one that differs least."""

        def least(nodes: np.ndarray, roots: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            twice, number = np.concatenate((roots[0], roots[1])), np.tile(np.arange(len(differ)), 2)
            order = np.lexsort((number, differ[number], twice))
            chosen = np.unique(number[order[_changes(twice[order])]]) if len(order) else order
            return nodes[:, chosen], roots[:, chosen], differ[chosen]

        for piece in _whole_bins(batches, 3):
            held = None
            for fresh, *found in candidates(piece):
                if fresh and held is not None:
                    yield pa.RecordBatch.from_arrays(_pairs(held[0][0], held[0][1]), names=["a", "b"])
                    held = None
                held = least(*(found if held is None else (np.concatenate(x, axis=-1) for x in zip(held, found, strict=True))))
            if held is not None:
                yield pa.RecordBatch.from_arrays(_pairs(held[0][0], held[0][1]), names=["a", "b"])

    def loosely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = _numpy(batch.column(2)) + _numpy(batch.column(3))
            differ = np.array([differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)])
            ok = pa.array(differ <= both - 2 * shared_needed(both, similarity))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], names=["a", "b"])

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_chunks(batches):
            sets = shingle_sets(some.column(0).to_pylist(), shingle)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_set_digest(s) for s in sets], pa.int64()), lists], names=["same", "members"])

    def ends(pairs: DataFrame) -> DataFrame:
        return few(scratch.write(pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()))

    tried: list[DataFrame] = []

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that weren't tried before whose whole sets are similar, out of those that their
        parity maps leave.  Only one text an entry is read again."""
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        tried.append(pairs)
        maps = distinct.join(ends(pairs), "same", "left_semi").select("same", "n", "parity")
        mapped = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
        close = scratch.write(mapped.mapInArrow(keeping_nothing(loosely), "a long, b long"))
        keys = scratch.write(distinct.join(ends(close), "same", "left_semi").select(F.col("first_key").alias("row_key")))
        every = texts.join(few(keys), "row_key", "left_semi").select("t").mapInArrow(keeping_nothing(members), "same long, members array<long>")
        sets = every.dropDuplicates(["same"])
        both = close.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        links = scratch.write(both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))
        scratch.drop(close, keys)
        return links

    with Scratch(spark) as scratch:
        rows = scratch.write(texts.mapInArrow(keeping_nothing(describe), f"id {kind}, row_key binary, same long, fp long, n int, first binary, parity binary, brief binary"))
        named = rows.groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row_key")).alias("r"), F.min("row_key").alias("first_key"), *[F.first(c).alias(c) for c in ("fp", "n", "first", "parity", "brief")])
        distinct = scratch.write(named)
        ids = scratch.write(rows.select("id", "row_key", "same"))
        scratch.drop(rows)
        by_fp = distinct.groupBy("fp").agg(F.min("same").alias("node"))
        one_fp = distinct.join(by_fp, "fp").filter("node < same").select(F.col("node").alias("a"), F.col("same").alias("b"))
        linked = fingerprint_links(by_fp.select("fp"), threshold)
        near_fp = linked.join(by_fp.toDF("a", "x"), "a").join(by_fp.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        placed = distinct.select("same", "n", "first").mapInArrow(keeping_nothing(place), "h long, sub int, node long, n int, pos int")
        # bins in order of size, then of the nodes' numbers, which are digests: the same on every run
        met_schema = "h long, what int, a long, b long, n int, pos int"
        met = scratch.write(placed.repartition("h", "sub").sortWithinPartitions("h", "sub", "n", "node").mapInArrow(keeping_nothing(meet), met_schema))
        leading = met.filter("what = 2").select("h", F.lit(-1).alias("sub"), F.col("a").alias("node"), "n", "pos")
        led = leading.repartition("h").sortWithinPartitions("h", "n", "node").mapInArrow(keeping_nothing(meet), met_schema).filter("b is not null")
        links = similar(met.filter("b is not null").select("a", "b").union(led.select("a", "b")).union(one_fp).union(near_fp).distinct())
        roots = components(links, scratch)
        # bins with entries of more than one group
        left = met.filter("b is null").select("h", "a", "n", "pos")
        rooted = left.join(few(roots), F.col("a") == F.col("node"), "left").select("h", "a", "n", "pos", F.coalesce("root", "a").alias("root"))
        several = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size")).filter("lo != hi").select("h", "least", F.ceil(F.col("size") / _BLOCK).cast("int").alias("blocks"))
        reach = largest_partner(F.col("n"), F.col("pos"), similarity)
        in_several = left.join(scratch.write(several), "h").filter(reach >= F.col("least")).join(distinct.select(F.col("same").alias("a"), "brief"), "a")
        mine = F.pmod(F.xxhash64("a", "h"), F.col("blocks")).cast("int").alias("block")
        open_ = scratch.write(in_several.select("h", "a", "n", "pos", "brief", "blocks", mine))
        scratch.drop(met)
        new, rounds = links, 0
        while True:
            now = open_.join(few(roots), F.col("a") == F.col("node"), "left").withColumn("root", F.coalesce("root", "a")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            units = now.select("h", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "a", "n", "pos", "root", "brief")
            last = new.isEmpty() or rounds == _NEAREST
            pairs = units.repartition("h", "u", "v").sortWithinPartitions("h", "u", "v", "n", "a").mapInArrow(keeping_nothing(every if last else nearest), "a long, b long")
            new = similar(pairs.distinct())
            if not new.isEmpty():
                # the groups so far, and what joins them
                roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new), scratch)
            if last:
                break
            rounds += 1
        known = distinct.join(roots, distinct["same"] == roots["node"], "left").select("same", "r", F.coalesce("root", "same").alias("root"))
        smallest = known.groupBy("root").agg(F.min("r").alias("r"))
        classes = known.select("same", "root").join(smallest, "root").select("same", F.col("r.id").alias("component_id"), F.col("r.row_key").alias("kept_key"))
        return cut(ids.join(classes, "same").select(F.col("id").alias(id_col), "row_key", "component_id", "kept_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without near duplicates: of each group of similar documents one row stays, the one with the
    smallest id (rows without an id only where no row of the group has one; then the smallest row key).  Of rows
    equal in id and text one stays, the smallest as JSON.  Columns are those of ``docs``."""
    marks = similar_groups(docs, id_col, text_col, similarity, shingle)
    kept = without_rows(docs, marks.filter("row_key != kept_key").select("row_key").distinct(), id_col, text_col)
    twice = cut(marks.filter("row_key = kept_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("row_key").alias("_twice")))
    if twice.isEmpty():
        return kept
    single = without_rows(kept, twice, id_col, text_col)
    key, other = free_name(docs, "_key"), free_name(docs, "_twice")
    repeated = kept.withColumn(key, row_key(id_col, text_col)).join(few(twice.toDF(other)), F.col(key) == F.col(other), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = repeated.groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return single.unionByName(once)


def as_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
