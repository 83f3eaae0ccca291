"""SentencePiece encoding and decoding by vectorised merge rounds (operator 11).

The symbols of many words lie in flat numpy arrays.  A round looks up the rank of every adjacent pair, takes the
smallest rank of each word (a segmented minimum), merges the leftmost places of that rank at once and compacts
the arrays; words without a pair that merges leave, until none is left.

All places of a rank merge at once only where that equals merging them one by one from the left: if a merge makes
a pair whose rank is as good as its own, the places right of it wait for the next round (a long word in which that
happens is finished through a heap, so time doesn't grow with the square of its length).  Words are cut where no
piece spans two characters, so long runs without white space are many short words.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import kept_by_worker, ship, text_chunks, text_of

SPACE = "▁"
#: Words kept by a worker; further ones are merged anew.
ENTRIES = 700_000
#: Longer words are not worth an entry.
LENGTH = 48
#: Characters that are merged at a time.
AT_ONCE = 1 << 20
#: Words of more symbols whose places would have to wait for one another are finished through a heap instead.
LONG = 128
_NONE = np.int64(1) << 40

codecs.register_error("sparloom-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _seat(keys: np.ndarray, bits: int, which: int) -> np.ndarray:
    """The first or second place of keys in a table of twice 2**bits places."""
    return ((keys.astype(np.uint64) * np.uint64(_ODD[which])) >> np.uint64(64 - bits)).astype(np.int64) + (which << bits)


def _seated(pairs: dict[int, tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A table in which each key has one of its two places, so that a lookup reads two."""
    bits = max(4, (2 * len(pairs)).bit_length())
    while True:
        keys = list(pairs)
        both = [_seat(np.array(keys, np.int64), bits, which).tolist() for which in (0, 1)]
        who = [-1] * (2 << bits)
        for k in range(len(keys)):
            side = 0
            for _ in range(500):
                at = both[side][k]
                who[at], k = k, who[at]
                if k < 0:
                    break
                side = 1 if both[0][k] == at else 0
            if k >= 0:
                break
        else:
            break
        bits += 1
    table = np.full((3, 2 << bits), -1, np.int64)
    taken = np.flatnonzero(np.array(who) >= 0)
    order = [keys[who[i]] for i in taken.tolist()]
    table[0, taken] = order
    table[1, taken], table[2, taken] = zip(*(pairs[k] for k in order), strict=True) if order else ((), ())
    return bits, *table


class PieceModel:
    """Pieces, pair ranks and word boundaries of a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.end = library.eos_id()
        normal = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        ids = {library.id_to_piece(i): i for i in normal}
        scores = sorted({library.get_score(i) for i in normal}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = [((ids[p[:at]] << 32) | ids[p[at:]], rank[library.get_score(i)], i) for p, i in ids.items() for at in range(1, len(p)) if p[:at] in ids and p[at:] in ids]
        self.pairs = {k: (r, i) for k, r, i in pairs}
        self.seats, self.keys, self.ranks, self.joined = _seated(self.pairs)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        # two characters may be in one word only if some piece has them side by side
        inside = {a + b for p in ids for a, b in zip(p, p[1:], strict=False)}
        chars = {c: i + 1 for i, c in enumerate(sorted(set("".join(inside))))}
        self.char_class = np.zeros(0x110000, np.int32)
        for c, i in chars.items():
            self.char_class[ord(c)] = i
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in inside:
            self.beside[chars[a], chars[b]] = True
        self.byte_id = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.splits_words = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.splits_lines = not any("\n" in p for p in ids)
        self.bytes_of = [self._surface(library, i) for i in range(n)]
        self.byte_set = set(self.byte_id.tolist())
        self.needs_care = np.array([library.is_control(i) or library.is_unknown(i) for i in range(n)])
        self.needs_care[self.byte_id[0x96]] = True
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _surface(library, i: int) -> bytes:
        if library.is_control(i):
            return b""
        if library.is_unknown(i):
            return library.decode([i]).encode()
        piece = library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.encode()

    # ---- encoding --------------------------------------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of pairs; ``_NONE`` where there is none."""
        key = (left << 32) | right
        at = _seat(key, self.seats, 0)
        other = np.flatnonzero(self.keys[at] != key)
        at[other] = _seat(key[other], self.seats, 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.joined[at]

    def _rounds(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Merge all words; ``starts`` marks their first symbols.  The merged symbols in their first symbols'
        places, -2 where a symbol went into the one before."""
        out = np.full(len(symbols), -2, np.int64)
        sym, place, first = symbols.astype(np.int64), np.arange(len(symbols)), np.flatnonzero(starts)
        sizes = np.diff(np.append(first, len(sym)))
        rank, joined = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        rank[:-1], joined[:-1] = self._look_up(sym[:-1], sym[1:])
        rank[first + sizes - 1] = _NONE
        while len(sym):
            best = np.minimum.reduceat(rank, first)
            over = best == _NONE
            if over.any():  # these words are done
                gone = np.repeat(over, sizes)
                out[place[gone]] = sym[gone]
                stay = ~gone
                sym, place, rank, joined, best, sizes = sym[stay], place[stay], rank[stay], joined[stay], best[~over], sizes[~over]
                first = np.cumsum(sizes) - sizes
                if not len(sym):
                    break
            spots = np.flatnonzero(rank == np.repeat(best, sizes))
            # every second one of a run of overlapping places, from the left
            new_run = np.append(True, np.diff(spots) > 1)
            run_start = spots[np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))]
            spots = spots[(spots - run_start) % 2 == 0]
            word = np.repeat(np.arange(len(first)), np.add.reduceat(np.bincount(spots, minlength=len(sym)), first))
            if len(spots) > len(first):
                all_words = word
                spots, word = self._safe(sym, joined, rank, spots, word, first, sizes)
                if len(word) < len(all_words):
                    waits = np.bincount(all_words, minlength=len(first)) > np.bincount(word, minlength=len(first))
                    if (waits & (sizes > LONG)).any():
                        gone = waits & (sizes > LONG)
                        for w in np.flatnonzero(gone):
                            at, merged = self._one_by_one(sym[first[w] : first[w] + sizes[w]])
                            out[place[first[w] + at]] = merged
                        stay = ~np.repeat(gone, sizes)
                        sym, place, rank, joined, sizes = sym[stay], place[stay], rank[stay], joined[stay], sizes[~gone]
                        first = np.cumsum(sizes) - sizes
                        continue
            sym[spots] = joined[spots]
            stay = np.ones(len(sym), bool)
            stay[spots + 1] = False
            sym, place, rank, joined = sym[stay], place[stay], rank[stay], joined[stay]
            spots = spots - np.arange(len(spots))  # where the merged symbols are now
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            first = np.cumsum(sizes) - sizes
            # only pairs with a merged symbol are new
            begin = first[word]
            end = begin + sizes[word]
            new = np.concatenate((spots[spots + 1 < end], spots[spots > begin] - 1))
            rank[spots] = _NONE
            rank[new], joined[new] = self._look_up(sym[new], sym[new + 1])
        return out

    def _safe(self, sym: np.ndarray, joined: np.ndarray, rank: np.ndarray, spots: np.ndarray, word: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places (and their words) of each word up to the first one that makes a pair as good as its own rank."""
        new, own = joined[spots], rank[spots]
        begin, end = first[word], first[word] + sizes[word]
        beyond = np.minimum(spots + 2, len(sym) - 1)
        right = np.where(spots + 2 < end, self._look_up(new, sym[beyond])[0], _NONE)
        before = np.maximum(spots - 1, 0)
        touches = np.append(False, np.diff(spots) == 2) & np.append(False, word[1:] == word[:-1])
        neighbour = np.where(touches, np.append(0, new[:-1]), sym[before])
        left = np.where(spots > begin, self._look_up(neighbour, new)[0], _NONE)
        bad = (right <= own) | (left <= own)
        if not bad.any():
            return spots, word
        # bad places before each one in its word
        count = np.cumsum(bad) - bad
        opens = np.append(True, word[1:] != word[:-1])
        base = count[np.maximum.accumulate(np.where(opens, np.arange(len(spots)), 0))]
        return spots[count == base], word[count == base]

    def _one_by_one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word merged through a heap: where its symbols begin, and the symbols."""
        sym: list[int] = symbols.tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (found := self.pairs.get(sym[i] << 32 | sym[after[i]])) is not None:
                heapq.heappush(heap, (found[0], i, sym[i], sym[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = self.pairs[left << 32 | right][1], -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        merged = np.array(sym, np.int64)
        at = np.flatnonzero(merged != -2)
        return at, merged[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit identifiers of each word (white space marked already)."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word_first = np.cumsum(lengths) - lengths
        symbols = self.char_id[points]
        kind = self.char_class[points]
        starts = np.ones(len(points), bool)
        starts[1:] = ~self.beside[kind[:-1], kind[1:]]
        starts[word_first[lengths > 0]] = True
        merged = self._rounds(symbols, starts) if len(points) else np.zeros(0, np.int64)
        some = merged != -2
        merged, kept_points = merged[some], points[some]
        odd = merged == -1  # characters that are no piece: their bytes
        sizes = np.ones(len(merged), np.int64)
        sizes[odd] = 1 + (kept_points[odd] > 0x7F) + (kept_points[odd] > 0x7FF) + (kept_points[odd] > 0xFFFF)
        ids = np.repeat(merged, sizes)
        raw = kept_points[odd].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ids[ids == -1] = self.byte_id[np.frombuffer(raw, np.uint8)]
        per_point = np.zeros(len(points) + 1, np.int64)
        per_point[1:][some] = sizes
        ends = 4 * np.cumsum(per_point)
        data = ids.astype("<i4").tobytes()
        return [data[a:z] for a, z in zip(ends[word_first].tolist(), ends[word_first + lengths].tolist(), strict=True)]

    def words(self, text: str) -> list[str]:
        """The words of a text: runs of spaces with what follows them, and lines.  A word ``\\n..`` starts a line, any
        other has its space mark left out where that is one."""
        if self.splits_lines and text[0] != " " and "  " not in text and SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits_words:
            return [marked]
        found = re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n[^{SPACE}\n]*" if self.splits_lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)
        # "a" stands for "▁a"; what has no mark and starts no line is named by two line ends, which no word has
        return [w[1:] if w[0] == SPACE and w[1:2] != SPACE else w if w[0] in (SPACE, "\n") else "\n\n" + w for w in found]

    @staticmethod
    def _symbols(word: str) -> str:
        if word[:2] == "\n\n":
            return word[2:]
        return word if word[:1] == "\n" or word[:2] == SPACE * 2 else SPACE + word

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit identifiers of each text, without any at its ends."""
        if not self.splits_words:
            return self.merge([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
        kept, of_word = self.kept, self.kept.__getitem__
        found = [self.words(t) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(found)).difference(kept))
        at, size = 0, 0
        for i, w in enumerate(fresh):
            size += len(w) + 1
            if size >= AT_ONCE or i == len(fresh) - 1:
                some = fresh[at : i + 1]
                kept.update(zip(some, self.merge(list(map(self._symbols, some))), strict=True))
                at, size = i + 1, 0
        out = [b"".join(map(of_word, ws)) for ws in found]
        room = len(kept) <= ENTRIES
        for w in fresh:
            if not room or len(w) > LENGTH:
                del kept[w]
        return out

    # ---- decoding --------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), [0, len(ids)])[0]

    def decode_many(self, ids: np.ndarray, offsets: list[int]) -> list[str]:
        """Texts of runs of identifiers: the first space mark is the library's own and goes, bytes that are no UTF-8
        show as U+FFFD each, control pieces as nothing."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            raise ValueError("an identifier is not in the model")
        # bytes that spell a space mark stay, and control pieces part bytes: such runs go piece by piece
        odd = np.append(0, np.cumsum(self.needs_care[ids]))
        surfaces = list(map(self.bytes_of.__getitem__, ids.tolist()))
        out = []
        for a, z in zip(offsets, offsets[1:], strict=False):
            last = z - 1 if z > a and ids[z - 1] == self.end else z
            if odd[last] > odd[a] or z > a and ids[a] in self.byte_set:
                out.append(self._decode_slowly(ids[a:z].tolist()))
            else:
                text = b"".join(surfaces[a:z]).decode("utf-8", "sparloom-each-byte")
                out.append(text[text.startswith(SPACE) :].replace(SPACE, " "))
        return out

    def _decode_slowly(self, ids: list[int]) -> str:
        out, held = [], b""
        seen = False
        for i in ids:
            if i in self.byte_set:
                held += self.bytes_of[i]
                continue
            if held:
                out.append(held.decode("utf-8", "sparloom-each-byte"))
                held, seen = b"", True
            text = self.bytes_of[i].decode()
            if not seen and text:
                text, seen = (text[1:] if text[0] == SPACE else text), True
            out.append(text.replace(SPACE, " "))
        return "".join(out) + held.decode("utf-8", "sparloom-each-byte")


def model(path: str) -> PieceModel:
    """The model of a worker process."""
    return kept_by_worker(f"piece model {path}", lambda: PieceModel(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per input row: id and ``ids`` (array of int), the identifiers that the library gives for the whole
    text, then the end id if ``end``.

    Null texts count as empty (the end id alone); null ids stay null; repeated rows each give a row; an empty table
    gives none; further columns are ignored, whatever their names.  No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            m = model(model_path)
            tail = np.array([m.end] * end, "<i4").tobytes()
            coded = [b + tail for b in m.encode_many(batch.column(1).to_pylist())]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(b) // 4 for b in coded], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ``ids`` and ``decoded``, the library's text of the identifiers.  Null arrays
    count as empty and null identifiers as nothing; one that isn't in the model is an error, as in the library."""
    kind = tokens.schema[id_col].dataType.simpleString()
    ship(tokens.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(1)
                offsets = lists.offsets.to_numpy()
                ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                texts = model(model_path).decode_many(ids, (offsets - offsets[0]).tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    ids = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("ids")
    return tokens.select(F.col(id_col), ids).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
