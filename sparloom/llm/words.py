"""Words of texts as hashes, worked out for many texts at once by array operations on their bytes.

A run of bytes hashes to a polynomial of its bytes, as a difference of two prefix sums, so that there is no loop
over words and nothing to keep of them.  Texts are taken in chunks of a bounded size, long ones in pieces that
end at white space; a run of more than ``PIECE`` bytes counts as several words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Marks beside the hashes of ``parts``: a word in capitals follows; the word before once more; any word.  Hashes
#: of words are odd there, those of punctuation and the marks even, and none is smaller than 16 but the marks.
CAPITALS, AGAIN, WORD = 2, 4, 1
#: Bytes that are worked on at a time.
PIECE = 1 << 18
SPACE, RUN, OTHER = 0, 1, 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULTIPLIER = 0x9E3779B97F4A7C15


def _classes(spaces: Iterable[int], runs: Iterable[int]) -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[list(runs)] = RUN
    table[list(spaces)] = SPACE
    return table


#: ``plain``: anything between ASCII white space is a word.  Else letters, digits, the underscore and whatever
#: isn't ASCII make words, and other characters punctuation.
_PLAIN = _classes([*range(9, 14), 32], range(256))
_PARTED = _classes([*range(9, 14), *range(28, 33)], [*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)])


def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        steps = np.full(PIECE + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray, a: int = 3, b: int = 0) -> np.ndarray:
    """A 64-bit mix of whole numbers, one of a family."""
    x = (x + np.uint64(b)) * np.uint64(a | 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _runs(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the runs of one class, white space left out."""
    at = np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(data)]))
    kind = classes[at[:-1]]
    some = kind != SPACE
    return at[:-1][some], at[1:][some], kind[some]


def _punctuation(data: np.ndarray, classes: np.ndarray) -> None:
    """Marks the characters of three blocks beyond ASCII: U+0080-00BF, U+2000-207F and U+3000-303F."""
    first, second = data[:-1], data[1:]
    two = np.flatnonzero(first == 0xC2)
    classes[two] = classes[two + 1] = OTHER
    three = np.flatnonzero(((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80)))
    for i in range(3):
        classes[np.minimum(three + i, len(data) - 1)] = OTHER


def _of_piece(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of at most PIECE bytes, and where each starts."""
    if not _POWERS:
        _POWERS.extend(_powers())
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    classes = (_PLAIN if kind == "plain" else _PARTED)[data]
    if kind != "plain" and len(data) > 1 and data.max() > 127:
        _punctuation(data, classes)
    starts, ends, what = _runs(data, classes)
    if kind == "words":
        starts, ends = starts[what == RUN], ends[what == RUN]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _POWERS[0][: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _POWERS[1][starts])
    if kind == "plain":
        return hashes, starts
    short = np.maximum(hashes >> np.uint64(32), np.uint64(16)) & ~np.uint64(1)
    if kind == "words":
        return short | np.uint64(1), starts
    short |= (what == RUN).astype(np.uint64)
    case = np.frombuffer(raw, np.uint8)
    upper = np.concatenate(([0], np.cumsum((case >= 65) & (case <= 90))))
    lower = np.concatenate(([0], np.cumsum((case >= 97) & (case <= 122))))
    capitals = np.flatnonzero((upper[ends] > upper[starts]) & (lower[ends] == lower[starts]) & (ends - starts > 1))
    return np.insert(short, capitals, CAPITALS), np.insert(starts, capitals, starts[capitals])


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of at most PIECE bytes, cut at white space where there is some."""
    at = 0
    while len(raw) - at > PIECE:
        part = np.frombuffer(raw, np.uint8, PIECE, at)
        spaces = np.flatnonzero(_PLAIN[part] == SPACE)
        end = at + (int(spaces[-1]) + 1 if len(spaces) else PIECE)
        yield raw[at:end]
        at = end
    yield raw[at:]


def hashed_words(texts: list[str], kind: str) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order.

    ``plain``: what lies between ASCII white space, A-Z lower-cased.  ``words``: runs of word characters,
    lower-cased; ``parts``: these and the runs of punctuation between them, a mark before words in capitals.  The
    last two have 32-bit values.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        if not held:
            return
        hashes, starts = _of_piece(b"\n".join(held), kind)
        firsts = np.cumsum([0] + [len(h) + 1 for h in held[:-1]])
        out.extend(np.split(hashes, np.searchsorted(starts, firsts)[1:]))
        held.clear()

    size = 0
    for text in texts:
        raw = (text.lower() if kind == "words" and not text.isascii() else text).encode("utf-8", "surrogatepass")
        if size + len(raw) + 1 > PIECE:
            flush()
            size = 0
        if len(raw) > PIECE:
            out.append(np.concatenate([_of_piece(p, kind)[0] for p in _pieces(raw)]))
            continue
        held.append(raw)
        size += len(raw) + 1
    flush()
    return out
