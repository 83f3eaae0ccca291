"""Token counts by heap-and-linked-list byte-pair merging (operator 5).

A text's count is its initial symbols minus the merges made; no identifier is ever looked up or emitted.
The rules are those of a byte-fallback piece model: white space shows as U+2581, a symbol that is no piece
costs its UTF-8 bytes, and the adjacent pair with the best score merges first, the leftmost on ties.

Merges never cross a place that no piece spans.  ``CountingModel`` derives two such places from the
vocabulary (between a character and a following space mark, and around a character that no piece holds), so
a text splits into short segments whose counts are kept in a bounded cache.  When the vocabulary does have
pieces across such a place, the model merges the whole text instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import arrow_rows, kept_by_worker, text_of

SPACE = "▁"
#: Segments kept by a worker; further ones are counted anew, so memory stays bounded and counts stay whole.
CACHE_ENTRIES = 700_000
#: Longer segments are not worth a cache entry.
CACHE_LENGTH = 48


def merge_count(symbols: list[str], rank: dict[str, int]) -> int:
    """Merges that the pair heap makes over a linked list of symbols: best rank first, leftmost on ties."""
    n = len(symbols)
    if n < 2:
        return 0
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    piece: list[str | None] = list(symbols)
    heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, left, joined = heapq.heappop(heap)
        if piece[left] is None or (right := after[left]) >= n or piece[left] + piece[right] != joined:
            continue  # one of the two has merged with something else meanwhile
        merges += 1
        piece[left], piece[right] = joined, None
        after[left] = beyond = after[right]
        if beyond < n:
            before[beyond] = left
            if (p := joined + piece[beyond]) in rank:
                heapq.heappush(heap, (rank[p], left, p))
        if (prior := before[left]) >= 0 and (p := piece[prior] + joined) in rank:
            heapq.heappush(heap, (rank[p], prior, p))
    return merges


class CountingModel:
    """Ranks and segment rules of a sentencepiece byte-pair model file."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        order = sorted(ids, key=lambda i: (-library.get_score(i), i))
        self.rank = {library.id_to_piece(i): r for r, i in enumerate(order)}
        self.single = {p for p in self.rank if len(p) == 1}
        multi = [p for p in self.rank if len(p) > 1]
        self.splits_words = not any(SPACE in p.lstrip(SPACE) for p in multi)
        self.splits_lines = not any("\n" in p for p in self.rank)
        self.kept: dict[str, int] = {}

    def whole(self, marked: str) -> int:
        """Tokens of a run of symbols in which white space is marked already."""
        single = self.single
        symbols = list(marked)
        initial = sum(1 if s in single else len(s.encode("utf-8", "surrogatepass")) for s in symbols)
        return initial - merge_count(symbols, self.rank)

    def _word(self, key: str) -> int:
        """A cached word; a leading newline says that it starts a line, so no space mark precedes it."""
        if (n := self.kept.get(key)) is not None:
            return n
        n = (1 + self.whole(key[1:])) if key[:1] == "\n" else self.whole(SPACE + key)
        if len(self.kept) < CACHE_ENTRIES and len(key) <= CACHE_LENGTH:
            self.kept[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not (self.splits_words and self.splits_lines) or text[0] == " " or "  " in text or SPACE in text:
            return self._count_runs(text)
        words = text.replace("\n", " \n").split(" ")
        found = list(map(self.kept.get, words))
        if None in found:
            found = [self._word(w) if n is None else n for w, n in zip(words, found, strict=True)]
        return sum(found)

    def _count_runs(self, text: str) -> int:
        """Texts with runs of spaces: segments end where a character precedes a space mark, or whole."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits_words:
            return self.whole(marked)
        total, start = 0, 0
        for i in range(1, len(marked)):
            if marked[i] == SPACE and marked[i - 1] != SPACE:
                total += self.whole(marked[start:i])
                start = i
        return total + self.whole(marked[start:])


def model(path: str) -> CountingModel:
    """The model of a worker process."""
    return kept_by_worker(f"counting model {path}", lambda: CountingModel(path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more tokens than ``limit``).

    Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows each give a row; an
    empty table gives none; further columns are ignored, whatever their names.
    """

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        m = model(model_path)
        for key, size, text in rows:
            yield key, size, m.count(text)

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    out = arrow_rows(read, count, f"`{id_col}` {kind}, n_bytes long, n_tokens long", keeps=True)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
