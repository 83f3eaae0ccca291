"""Lempel-Ziv phrase fingerprints (operator 8).

A text is parsed into dictionary phrases: the next phrase is the shortest string not in the dictionary yet,
which it then joins.  The set of phrases is hashed, and the signature holds, for each of a fixed family of
hash functions, the low bits of the smallest hash.  Two signatures agree in about the share of phrases that
two texts have in common, which is high for texts that would compress well together.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import arrow_rows, range_bounds, range_count, text_of

FUNCTIONS = 128
_MASK = (1 << 64) - 1


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets from a rule: digests of the numbers 0 to n - 1."""
    raw = [hashlib.sha256(f"phrase family {i}".encode()).digest() for i in range(n)]
    a = np.array([int.from_bytes(r[:8], "little") | 1 for r in raw], np.uint64)
    b = np.array([int.from_bytes(r[8:16], "little") for r in raw], np.uint64)
    return a, b


_A, _B = _family(FUNCTIONS)
_NONE = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)


def parse(text: str, known: set[str], pending: str) -> tuple[list[str], str]:
    """The phrases that ``text`` adds to the dictionary ``known``, and the unfinished rest."""
    added: list[str] = []
    for c in text:
        pending += c
        if pending not in known:
            known.add(pending)
            added.append(pending)
            pending = ""
    return added, pending


def minima(phrases: list[str], base: np.ndarray) -> np.ndarray:
    """The smallest hash a function, over ``phrases`` and what ``base`` stands for."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = base
    for at in range(0, len(phrases), 2048):
        h = np.array([digest(p.encode("utf-8", "surrogatepass")) for p in phrases[at : at + 2048]], np.uint64)
        out = np.minimum(out, ((h[:, None] * _A + _B) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def signature(low: np.ndarray) -> bytes:
    return low.astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of hash functions whose minima agree: 1.0 for equal phrase sets."""
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


class Parsed:
    """A text's signature, and the state of the parse before its last half, from which an edit goes on."""

    __slots__ = ("key", "known", "low", "n", "pending", "sign", "text")

    def __init__(self, key, text: str):
        self.key, self.text, self.n = key, text, len(text)
        keep = self.n - self.n // 2
        known: set[str] = set()
        added, self.pending = parse(text[:keep], known, "")
        self.low = minima(added, _NONE)
        self.known = set(known)
        rest, _ = parse(text[keep:], known, self.pending)
        self.sign = signature(minima(rest, self.low))

    def edited(self, following: str) -> tuple[str, bytes]:
        """The text with its last half replaced by as much of ``following``, and that text's signature."""
        half = self.n // 2
        other = following[:half]
        rest, _ = parse(other, self.known, self.pending)  # each text is edited once: the state may be used up
        return self.text[: self.n - half] + other, signature(minima(rest, self.low))


def fingerprint(text: str) -> bytes:
    return Parsed(None, text).sign


def phrase_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_chars``, ``fingerprint`` hex): one row per input row, without any shuffle."""

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, len(text), fingerprint(text).hex()

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs.select(F.col(id_col), text_of(text_col).alias("t")), each, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edit: the last floor(n/2) code points replaced by as many of the next document.

    The next document is the one after it in descending id order, and the first one after the last.  Rows of
    equal id follow one another in the order of their texts' SHA-256; null ids come last.  Null texts are
    empty; a lone document is its own next one; an empty table gives none.  Gives id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hex), ``near_edited``, ``near_next``.

    One shuffle moves the texts, zstd-compressed, into ranges of ids.  The ranges' bounds are quantiles of
    the ids, as many as the bytes ask for; the first document of each range goes to the range before as well,
    so every range can be streamed by itself and the bounds only decide how even the ranges are.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be a whole number")
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    bounds = range_bounds(ids, "k", 2 * range_count(docs))

    def range_of(k: int | None) -> int:
        return len(bounds) + 1 if k is None else len(bounds) - bisect.bisect_left(bounds, k)

    def place(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (k,) in rows:
            yield range_of(k), k

    # a row a range
    heads = {r["at"]: r["head"] for r in arrow_rows(ids, place, "at int, k long").groupBy("at").agg(F.max("k").alias("head")).collect()}
    order = sorted(heads)
    before = {at: order[i - 1] for i, at in enumerate(order)}

    def send(rows: Iterable[tuple]) -> Iterator[tuple]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for k, text in rows:
            raw = text.encode()
            tie, at, packed = hashlib.sha256(raw).hexdigest()[:16], range_of(k), squeeze.compress(raw)
            yield at, 0, k, tie, packed
            if heads[at] == k:
                yield before[at], 1, k, tie, packed

    def stream(rows: Iterable[tuple]) -> Iterator[tuple]:
        import zstandard

        loosen = zstandard.ZstdDecompressor()
        current, last = None, None
        for at, is_head, k, _, packed in rows:
            if at != current:
                current, last = at, None
            if is_head and last is None:
                continue  # the range's last document has its next one already
            now = Parsed(k, loosen.decompress(packed).decode())
            if last is not None:
                yield compare(last, now)
            last = None if is_head else now

    def compare(doc: Parsed, following: Parsed) -> tuple:
        # a document that follows itself is parsed twice, so its state is whole in both
        edited, sign = doc.edited(following.text)
        return doc.key, doc.n, hashlib.sha256(edited.encode()).hexdigest(), doc.sign.hex(), sign.hex(), likeness(doc.sign, sign), likeness(doc.sign, following.sign)

    sent = arrow_rows(docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("t")), send, "at int, is_head int, k long, tie string, packed binary")
    ordered = sent.repartitionById(len(bounds) + 2, F.col("at")).sortWithinPartitions("at", "is_head", F.col("k").desc_nulls_last(), "tie")
    out = arrow_rows(ordered, stream, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", chunk=64)
    return out.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
