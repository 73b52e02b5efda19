"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all items go into one suffix automaton. Documents are streamed through it word by word; the
automaton keeps the length of the longest suffix of the words read so far that occurs in some item. Where that length
reaches the window length, the window occurs; items shorter than a window must occur whole.

Items are a stated query set. They are cut into blocks of at most ``block_words`` words; each block's automaton is
broadcast, and all documents pass the blocks one after the other without any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import add_columns, as_bytes, column, named, numbered

BLOCK_WORDS = 500_000  # bound of one broadcast automaton
# Letters and digits of ASCII and all other characters stay; A-Z is lowered; the rest separates words.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that contain a window at the window's state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.windows: dict[int, set[str]] = {}  # state of a whole window
        self.shorts: dict[int, dict[int, set[str]]] = {}  # state of a short item, its length
        self.above: list[tuple[int, ...]] = []
        for name, words in items:
            self._mark(name, words)
        self._find_shorts()

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        there = nxt[last].get(word)
        if there is not None:  # read before, in another item
            return there if length[there] == length[last] + 1 else self._clone(last, word, there)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def _mark(self, name: str, words: list[bytes]) -> None:
        state = 0
        for n, word in enumerate(words, 1):
            state = self.next[state][word]
            if n >= self.window:
                self.windows.setdefault(self._top(state), set()).add(name)
        if words and len(words) < self.window:
            self.shorts.setdefault(state, {}).setdefault(len(words), set()).add(name)

    def _top(self, state: int) -> int:
        """The state of the last ``window`` words, going up the suffix links."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _find_shorts(self) -> None:
        """For each state, the states on its link path that hold short items."""
        above: list[tuple[int, ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            rest = above[self.link[state]]
            above[state] = (state, *rest) if state in self.shorts else rest
        self.above = above

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (first, one past the last; they may overlap), and the items with occurring windows."""
        nxt, link, length, window, above = self.next, self.link, self.length, self.window, self.above
        root = nxt[0]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = n = 0
        for i, word in enumerate(words, 1):
            there = nxt[state].get(word)
            if there is not None:
                state = there
                n += 1
            elif word in root:
                while there is None:
                    state = link[state]
                    there = nxt[state].get(word)
                n = length[state] + 1
                state = there
            else:
                state = n = 0
                continue
            if n >= window:
                top = self._top(state)
                items |= self.windows.get(top, set())
                spans.append((i - window, i))
            if above[state]:
                for s in above[state]:
                    for size, names in self.shorts[s].items():
                        if size <= n:
                            items |= names
                            spans.append((i - size, i))
        return spans, items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(items: DataFrame, window: int, item_id: str, text: str, block_words: int) -> Iterator[list]:
    """Item names and words, in blocks; an item longer than a block is cut into pieces that share window - 1 words."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    step = max(block_words - window + 1, 1)
    for row in items.select(column(item_id).cast("string").alias("i"), as_bytes(text).alias("t")).toLocalIterator():
        words = words_of(row.t)
        for start in range(0, max(len(words) - window + 1, 1), step) if words else ():
            piece = words[start : start + step + window - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append(("null" if row.i is None else row.i, piece))
            size += len(piece)
    if block:
        yield block


def _match_block(df: DataFrame, block: list, window: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)

    def make():
        automaton = SuffixAutomaton(shared.value, window)

        def compute(texts, spans, names):
            out_spans, out_names = [], []
            for value, old, known in zip(texts, spans.to_pylist(), names.to_pylist(), strict=True):
                found, items = automaton.match(words_of(value.as_py()))
                pairs = merged([*zip(old[::2], old[1::2], strict=True), *found]) if found else None
                out_spans.append([x for pair in pairs for x in pair] if pairs else old)
                out_names.append(sorted(items.union(known)))
            return [out_spans, out_names]

        return compute

    return add_columns(df, [F.col("text"), F.col("spans"), F.col("items")], "spans array<int>, items array<string>", make)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    remove: bool = False,
    max_length: int | None = 0,
    max_coverage: float | None = None,
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit if it lies in an occurrence of ``window`` consecutive item words, or of a whole shorter item. With
    ``remove``, maximal hit spans longer than ``max_length`` words leave the text, and all of them if they cover more
    than ``max_coverage`` of the document's words; None is no limit. The rest of the text stays as it is, with one
    space for each span.
    Null and empty texts have no words, items without words have no windows, a null item id counts as the id "null",
    repeated items count once. Columns of the result's names are replaced.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new and not (remove and c == text)]
    start = docs.select(
        *numbered(kept), as_bytes(text).alias("text"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")
    )
    for block in blocks_of(items, window, item_id, item_text, block_words):
        start = _match_block(start, block, window)

    def make():
        def compute(texts, spans, names):
            n_words, n_hit, sha, new = [], [], [], []
            for value, flat, found in zip(texts, spans.to_pylist(), names.to_pylist(), strict=True):
                data = value.as_py()
                total = len(words_of(data))
                pairs = [*zip(flat[::2], flat[1::2], strict=True)]
                hit = sum(b - a for a, b in pairs)
                n_words.append(total)
                n_hit.append(hit)
                sha.append(hashlib.sha256(",".join(found).encode()).hexdigest())
                if remove:
                    covered = max_coverage is not None and hit > max_coverage * total
                    cut = [(a, b) for a, b in pairs if covered or (max_length is not None and b - a > max_length)]
                    new.append(without_words(data, cut) if cut else data)
            counts = [len(found) for found in names.to_pylist()]
            flags = [n > 0 for n in n_hit]
            return [n_words, n_hit, counts, sha, flags, *([[x if x is None else x.decode("utf-8", "replace") for x in new]] if remove else [])]

        return compute

    ddl = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", new_text string" * remove
    out = add_columns(start, [F.col("text"), F.col("spans"), F.col("items")], ddl, make, [f"k{i}" for i in range(len(kept))])
    return out.select(*named(kept), *[F.col("new_text").alias(text)] * remove, *new)


def without_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the words of the given spans; each span, from its first to its last letter, becomes a space."""
    flat = data.translate(TABLE)
    starts = [i for i in range(len(flat)) if flat[i] != 0x20 and (i == 0 or flat[i - 1] == 0x20)]
    ends = [i + 1 for i in range(len(flat)) if flat[i] != 0x20 and (i + 1 == len(flat) or flat[i + 1] == 0x20)]
    parts, at = [], 0
    for a, b in spans:
        parts += [data[at : starts[a]], b" "]
        at = ends[b - 1]
    return b"".join([*parts, data[at:]])
