"""Token-identifier files in patched frame-of-reference blocks (operator 10).

A segment file is a run of segments, each followed by one newline byte.  A segment holds whole documents:

    magic "PFR1" | u32 documents | u32 identifiers | u32 blocks | u32 payload bytes | u8 id width
    documents x (i64 id, u8 id is null, u32 identifiers)       the document index
    blocks x u32                                               the block starts in the payload
    payload                                                    the blocks

A block holds up to 1024 identifiers: u32 minimum, u8 width, u8 zero, u16 exceptions, u16 count, then the identifiers
less the minimum, each packed into ``width`` bits (higher bits of exceptions are cut), then the exceptions'
positions (u16 each) and the cut higher bits (u32 each).  The width is the bit length of the value at a
percentile of the block's offsets, so few outliers don't widen the whole block.

Files are written by Spark's own file writer and commit protocol, so they can go to any store that Spark
reaches, a lost executor's attempt leaves nothing behind, and a retry writes the same bytes.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, arrow_rows, cut, kept_by_worker, range_bounds, range_count, small_batches, text_of

MAGIC = b"PFR1"
BLOCK = 1024
HEAD = 10
PERCENTILE = 95
#: A segment is closed at the document that reaches this many identifiers; a document is never split.
SEGMENT_IDS = 1 << 18
#: Segments to a file: some 32 MB, far below the 2 GB that a binary value may have.
SEGMENTS_PER_FILE = 64


# ---- codec ---------------------------------------------------------------------------------------------


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The block starts and the payload of one run of unsigned 32-bit identifiers."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u4"), b""
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    offset = grid - low[:, None]
    counts = np.full(blocks, BLOCK)
    counts[-1] = n - (blocks - 1) * BLOCK
    at = min(BLOCK - 1, (BLOCK * PERCENTILE) // 100)
    chosen = np.partition(offset, at, axis=1)[:, at]
    width = np.zeros(blocks, np.int64)
    width[chosen > 0] = np.floor(np.log2(chosen[chosen > 0].astype(np.float64))).astype(np.int64) + 1
    parts, starts, size = [], np.zeros(blocks, "<u4"), 0
    packed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width):  # all blocks of a width at once
        rows = np.flatnonzero(width == w)
        packed[int(w)] = (rows, _pack(offset[rows], int(w)))
    where = {int(r): (w, i) for w, (rows, _) in packed.items() for i, r in enumerate(rows)}
    for b in range(blocks):
        w, i = where[b]
        starts[b] = size
        over = np.flatnonzero((offset[b, : counts[b]].astype(np.uint64) >> np.uint64(w)) > 0)
        body = packed[w][1][i].tobytes()
        part = struct.pack("<IBBHH", int(low[b]), w, 0, len(over), int(counts[b])) + body
        if len(over):
            part += over.astype("<u2").tobytes() + (offset[b, over].astype(np.uint64) >> np.uint64(w)).astype("<u4").tobytes()
        parts.append(part)
        size += len(part)
    return starts, b"".join(parts)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values, each in its lowest ``width`` bits, low bit first: eight values fill ``width`` bytes,
    and each byte is put together from the values that reach into it."""
    eights = (values.astype(np.uint64) & np.uint64((1 << width) - 1)).reshape(len(values), BLOCK // 8, 8)
    out = np.empty((len(values), BLOCK // 8, width), np.uint8)
    for j in range(width):
        byte = np.zeros(eights.shape[:2], np.uint64)
        for k in range(8 * j // width, (8 * j + 7) // width + 1):
            shift = 8 * j - k * width
            byte |= eights[:, :, k] >> np.uint64(shift) if shift >= 0 else eights[:, :, k] << np.uint64(-shift)
        out[:, :, j] = byte.astype(np.uint8)
    return out.reshape(len(values), BLOCK * width // 8)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    eights = raw.reshape(len(raw), BLOCK // 8, width)
    out = np.empty((len(raw), BLOCK // 8, 8), np.uint64)
    for k in range(8):
        first = k * width >> 3
        value = eights[:, :, first].astype(np.uint64)
        for j in range(first + 1, ((k + 1) * width - 1 >> 3) + 1):
            value |= eights[:, :, j].astype(np.uint64) << np.uint64(8 * (j - first))
        out[:, :, k] = value >> np.uint64(k * width & 7) & np.uint64((1 << width) - 1)
    return out.reshape(len(raw), BLOCK)


def unpack_blocks(starts: np.ndarray, payload: bytes) -> np.ndarray:
    """The identifiers again; every block is found by its start, so any of them could be read alone."""
    heads = [struct.unpack_from("<IBBHH", payload, int(s)) for s in starts]
    out = np.zeros((len(heads), BLOCK), np.uint64)
    by_width: dict[int, list[int]] = {}
    for b, (_, w, _, _, _) in enumerate(heads):
        by_width.setdefault(w, []).append(b)
    data = np.frombuffer(payload, np.uint8)
    for w, rows in by_width.items():
        if w:
            raw = np.stack([data[int(starts[b]) + HEAD : int(starts[b]) + HEAD + BLOCK * w // 8] for b in rows])
            out[rows] = _unpack(raw, w)
    for b, (_, w, _, over, _) in enumerate(heads):
        if over:
            at = int(starts[b]) + HEAD + BLOCK * w // 8
            spots = np.frombuffer(payload, "<u2", over, at)
            out[b, spots] += np.frombuffer(payload, "<u4", over, at + 2 * over).astype(np.uint64) << np.uint64(w)
    out += np.array([h[0] for h in heads], np.uint64).reshape(-1, 1)
    counts = np.array([h[4] for h in heads], int)
    return out[np.arange(BLOCK)[None, :] < counts[:, None]].astype(np.uint32) if len(heads) else np.zeros(0, np.uint32)


def pack_segment(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ids = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, np.uint32)
    starts, payload = pack_blocks(ids)
    index = b"".join(struct.pack("<qBI", d or 0, d is None, len(v)) for d, v in docs)
    return MAGIC + struct.pack("<IIIIB", len(docs), len(ids), len(starts), len(payload), 32) + index + starts.tobytes() + payload


def unpack_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, identifiers) of a file's segments in order."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        n_docs, n_ids, n_blocks, size, _ = struct.unpack_from("<IIIIB", content, at + 4)
        at += 21
        index = [struct.unpack_from("<qBI", content, at + 13 * i) for i in range(n_docs)]
        at += 13 * n_docs
        starts = np.frombuffer(content, "<u4", n_blocks, at)
        at += 4 * n_blocks
        ids = unpack_blocks(starts, content[at : at + size])
        if len(ids) != n_ids:
            raise ValueError("a segment's identifiers don't match its header")
        at += size + 1
        done = 0
        for doc, null, n in index:
            yield None if null else doc, ids[done : done + n]
            done += n


# ---- encoding ------------------------------------------------------------------------------------------


class WordEncoder:
    """A tokenizers file, with the identifiers of words kept.

    A byte-level tokenizer splits a text before any single space between two characters that aren't white
    space, and around a single newline between two such, wherever it is; so most texts are words.  The words of many
    texts are numbered together by Arrow, each different one is looked up once, and the texts are put together from
    the numbers.  Any other text (runs of white space, special strings) is encoded whole.

    A word that isn't kept is, if it holds nothing but Latin letters, ASCII digits and ASCII punctuation, the runs
    of these three that the tokenizer's own pattern makes of it.  The library's model gets such runs as they are,
    without that pattern, which takes most of the library's time.  Other words go through the whole tokenizer.
    Every identifier comes from the library.
    """

    ODD = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    ENTRIES = 700_000  # some 140 MB
    LENGTH = 48
    #: Letters in every version of Unicode from 5.0 on, and punctuation without the apostrophe, which may take letters along.
    LETTERS, PUNCTUATION = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", string.punctuation.replace("'", "")
    RUN = re.compile(f"[\n\r]?(?:[{LETTERS}]+|[0-9]+|[{re.escape(PUNCTUATION)}]+)")
    #: A run of punctuation that ends a word, after a letter or digit, is looked up as a word of its own.
    TAIL = f"([0-9{LETTERS}])([{re.escape(PUNCTUATION)}]+) "

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and said.get("normalizer") is None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        newline = self.library.encode("\n", add_special_tokens=False).ids
        self.by_word = plain and len(newline) == 1 and self.library.encode("a\nb\n c", add_special_tokens=False).ids.count(newline[0]) == 2
        self.newline = newline[0] if newline else -1
        self.shown = _shown_bytes()
        self.kept: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def is_plain(self, text: str) -> bool:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return False
        if any(c in text for c in self.ODD[:10]) or any(s in text for s in self.special):
            return False
        return text.isascii() or not any(c in text for c in self.ODD[10:])

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit identifiers of each text."""
        plain = [bool(t) and self.by_word and self.is_plain(t) for t in texts]
        by_words = self._encode_plain([t for t, p in zip(texts, plain, strict=True) if p])
        for t, p in zip(texts, plain, strict=True):
            yield next(by_words) if p else self.whole(t) if t else b""

    def _encode_plain(self, texts: list[str], at_once: int = 1 << 20) -> Iterator[bytes]:
        if not texts:
            return
        # a return marks what has no space before it: the first word, and punctuation that ends a word
        marked = pa.array(["\r" + t.replace("\n", " \n") for t in texts], pa.large_string())
        words = pc.split_pattern(pc.replace_substring_regex(marked, self.TAIL, "\\1 \r\\2 "), " ")
        coded = words.values.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.kept.get, different))
        gaps = [i for i, b in enumerate(found) if b is None]
        fresh = self._encode_words([different[i] for i in gaps])
        for i in gaps:
            found[i] = fresh[different[i]]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        numbers = coded.indices.to_numpy()
        parts = []
        for i in range(0, len(numbers), at_once):
            some = numbers[i : i + at_once]
            n = sizes[some]
            ends = np.cumsum(n)
            parts.append(ids[np.arange(ends[-1]) + np.repeat(starts[some] - ends + n, n)])
        data = np.concatenate(parts)
        ends = np.concatenate(([0], np.cumsum(sizes[numbers])))[words.offsets.to_numpy()].tolist()
        for a, z in zip(ends, ends[1:], strict=False):
            yield data[a:z].tobytes()

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Different words that aren't kept, a mark before each that starts a line (newline) or has no space before it (return)."""
        runs: dict[str, None] = {}
        mixed: list[tuple[str, list[str]]] = []
        odd: list[str] = []
        kept, split = self.kept, self.RUN.findall
        for w in words:
            if w.isascii() and w.isalpha():  # most words, without the pattern
                runs[w] = None
                continue
            parts = split(w)
            if sum(map(len, parts)) < len(w):
                odd.append(w)
            elif len(parts) == 1:
                runs[w] = None
            else:
                parts[1:] = ["\r" + p for p in parts[1:]]  # no space before these either
                mixed.append((w, parts))
                for p in parts:
                    if p not in kept:
                        runs[p] = None
        fresh = self._encode_runs(list(runs)) | self._encode_odd(odd)
        for w, parts in mixed:
            fresh[w] = b"".join([fresh[p] if p in fresh else kept[p] for p in parts])
        kept.update(islice(((w, b) for w, b in fresh.items() if len(w) <= self.LENGTH), max(0, self.ENTRIES - len(kept))))
        return fresh

    def _encode_runs(self, runs: list[str], at_once: int = 2000) -> dict[str, bytes]:
        """Runs of letters, digits or punctuation, by the library's model."""
        fresh: dict[str, bytes] = {}
        tokenize, pack = self.library.model.tokenize, struct.pack
        for i in range(0, len(runs), at_once):
            some = runs[i : i + at_once]
            shown = "\n".join([w[1:] if w[0] in "\n\r" else " " + w for w in some]).encode().decode("latin-1").translate(self.shown)
            for w, s in zip(some, shown.split(self.shown[10]), strict=True):
                ids = [t.id for t in tokenize(s)]
                if w[0] == "\n":
                    ids.insert(0, self.newline)
                fresh[w] = pack(f"<{len(ids)}I", *ids)
        return fresh

    def _encode_odd(self, words: list[str], at_once: int = 2000) -> dict[str, bytes]:
        """Words joined by newlines, encoded together and cut at the newlines' identifiers."""
        fresh: dict[str, bytes] = {}
        mark = np.array([self.newline], "<u4").tobytes()
        for i in range(0, len(words), at_once):
            some = words[i : i + at_once]
            ids = np.array(self.library.encode_batch_fast(["\n".join([w[1:] if w[0] in "\n\r" else " " + w for w in some])], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.newline)).tolist()
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer doesn't keep newlines apart")
            for w, a, z in zip(some, [0, *[e + 4 for e in ends]], [*ends, len(data)], strict=True):
                fresh[w] = mark + data[a:z] if w[0] == "\n" else data[a:z]
        return fresh


def _shown_bytes() -> dict[int, str]:
    """The character by which a byte-level vocabulary shows each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def encoder(path: str) -> WordEncoder:
    """The encoder of a worker process."""
    return kept_by_worker(f"encoder {path}", lambda: WordEncoder(path))


def _chunks(rows: Iterable[tuple], size: int = 4096, chars: int = 8 << 20) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += len(row[-1])
        if len(held) >= size or total >= chars:
            yield held
            held, total = [], 0
    if held:
        yield held


# ---- operator ------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", by_id: bool = True) -> None:
    """Encode every text, end each with ``end_id`` and write the identifiers to ``path``, in id order or
    (``by_id=False``) in the order in which the rows come, without a shuffle.

    Texts are encoded where they are read; only 16-bit identifiers (32-bit where they don't fit) are shuffled, to
    ranges of ids, and sorted by (id, text digest), so repeated ids have a defined order too (null ids come
    first, equal rows in any order, which no reader can tell apart).  Null and empty texts give the end id alone.
    An empty table gives an empty folder.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be a whole number")
    end = struct.pack("<I", end_id)

    def encoded(rows: Iterable[tuple]) -> Iterator[tuple]:
        coder = encoder(tokenizer_path)
        for some in _chunks(rows):
            for row, ids in zip(some, coder.encode_many([r[-1] for r in some]), strict=True):
                yield *row[:-1], ids + end

    def encode(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, tie, ids in encoded(rows):
            yield (0 if key is None else bisect.bisect_left(bounds, key)), key, tie, _narrow(ids)

    def segments(docs: Iterable[tuple[int | None, np.ndarray]]) -> Iterator[tuple]:
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0
        for key, ids in docs:
            held.append((key, ids))
            n += len(ids)
            if n >= SEGMENT_IDS:
                yield (pack_segment(held),)
                held, n = [], 0
        if held:
            yield (pack_segment(held),)

    key, text = F.col(id_col).cast("long").alias("k"), text_of(text_col)
    if by_id:
        bounds = range_bounds(docs, id_col, range_count(docs))
        coded = arrow_rows(docs.select(key, F.xxhash64(text).alias("tie"), text.alias("t")), encode, "at int, k long, tie long, z binary", keeps=True)
        ordered = coded.repartitionById(len(bounds) + 1, F.col("at")).sortWithinPartitions(F.col("k").asc_nulls_first(), "tie").select("k", "z")
        packed = arrow_rows(ordered, lambda rows: segments((k, _widen(z)) for k, z in rows), "s binary", keeps=True)
    else:
        packed = arrow_rows(docs.select(key, text.alias("t")), lambda rows: segments((k, np.frombuffer(ids, "<u4")) for k, ids in encoded(rows)), "s binary", keeps=True)
    # the text writer puts a string's bytes out as they are and a newline after each
    files = packed.select(F.col("s").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        files.write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).option("compression", "none").mode("overwrite").text(path)


def _narrow(ids: bytes) -> bytes:
    """One byte that says the width, then 16-bit identifiers if they fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def read_token_files(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """What the files hold, a row a document: id, ``start`` (identifiers of all documents before it),
    ``n_tokens``, ``ids_crc32`` (over the identifiers as little-endian 32-bit integers), ``file`` (path of its
    file below ``path``) and ``first`` (its first identifier's place among the file's)."""

    def decode(rows: Iterable[tuple]) -> Iterator[tuple]:
        for name, content in rows:
            part, piece = _file_order(name)
            done = 0
            for key, ids in unpack_file(content):
                yield part, piece, key, done, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name.rsplit("/", 1)[-1]
                done += len(ids)

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    with Scratch(spark) as scratch:
        docs = scratch.write(arrow_rows(stored, decode, f"part long, piece long, `{id_name}` long, first long, n_tokens long, ids_crc32 long, file string", chunk=4096, keeps=True))
        # one row a file: a running sum within a part's files, then one over the parts' totals
        per_file = docs.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
        per_part = per_file.groupBy("part").agg(F.sum("n").alias("n"))
        before_part = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
        before_file = per_file.select("part", "piece", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_file"))
        starts = before_file.join(before_part, "part")
        return cut(docs.join(starts, ["part", "piece"]).select(id_name, (F.col("before_part") + F.col("before_file") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file", "first"))


def _file_order(path: str) -> tuple[int, int]:
    """Spark names files part-<partition>-<job>-c<file of the partition>."""
    m = re.search(r"part-(\d+)-.*?-c(\d+)", path.rsplit("/", 1)[-1])
    if not m:
        raise ValueError(f"no segment file: {path}")
    return int(m[1]), int(m[2])


def read_token_ids(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """(id, ids array) of every document, for readers that want the identifiers themselves."""

    def decode(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (content,) in rows:
            for key, ids in unpack_file(content):
                yield key, ids.astype(np.int64).tolist()

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_rows(stored, decode, f"`{id_name}` long, ids array<long>", chunk=4, keeps=True)
