"""Token counts under a unigram model, with the forward scores of shared prefixes computed once.

The score of a segmentation is the sum of its pieces' scores; the forward score of a string is that of its best
segmentation, and of equal ones that with the fewest tokens. The distinct words of a batch that are not known yet are
inserted in a trie, in order. A node holds the forward score of its prefix, which follows from the nodes above it, so words
with a common prefix share the work. The token count of a word is read at its terminal node and remembered: frequent
words stay known when the trie or the memory of words is renewed.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame

from caseloom.llm.base import add_columns, as_bytes

MAX_NODES = 300_000  # nodes of a worker's trie; beyond, it starts anew, which changes no count
KNOWN_WORDS = 300_000  # terminal counts a worker remembers, twice: the older half goes when the newer is full
WORDS_AT_ONCE = 100_000  # words whose distinct ones are looked up together, and those of one text more
MARK = "▁"  # stands before each word


def rank_scores(path: str) -> dict[str, float]:
    """Scores for the pieces of a sentencepiece file: log-probabilities falling with the rank, 1 / (rank + 2).

    The public files hold merge ranks and no probabilities; models are not trained here. Bytes and controls are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = math.log(sum(1 / (r + 2) for r in range(len(names))))
    return {name: -math.log(r + 2) - total for r, name in enumerate(names)}


class ForwardTrie:
    """Trie of words with (forward score, tokens) at each node."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES, known_words: int = KNOWN_WORDS):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0  # of a byte that no piece covers
        self.max_nodes, self.known_words = max_nodes, known_words
        self.terminal: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]

    def count_all(self, words: list[bytes]) -> None:
        """Makes all ``words`` known in ``terminal``."""
        missing = set(words).difference(self.terminal)
        if not missing:
            return
        if len(self.terminal) + len(missing) > self.known_words:
            present = set(words)
            self.older = self.terminal
            self.terminal = {w: c for w, c in self.older.items() if w in present}
        fresh = []
        for word in missing:
            known = self.older.get(word)
            if known is None:
                fresh.append(word)
            else:
                self.terminal[word] = known
        for word in sorted(fresh):
            self.terminal[word] = self._insert(word.decode("utf-8", "replace"))

    def _insert(self, word: str) -> int:
        if len(self.next) > self.max_nodes:
            self.clear()
        whole = MARK + word
        node, path = 0, [0]
        for n, letter in enumerate(whole, 1):
            there = self.next[node].get(letter)
            if there is None:
                there = len(self.next)
                self.next[node][letter] = there
                self.next.append({})
                self.best.append(self._forward(whole, n, path))
            node = there
            path.append(node)
        return self.best[node][1]

    def _forward(self, whole: str, n: int, path: list[int]) -> tuple[float, int]:
        """Best score of the first ``n`` letters from those of shorter prefixes. A letter can always go as bytes."""
        size = len(whole[n - 1].encode("utf-8", "replace"))
        score, tokens = self.best[path[n - 1]]
        best, fewest = score + self.unknown * size, tokens + size
        for start in range(max(0, n - self.longest), n):
            piece = self.scores.get(whole[start:n])
            if piece is not None:
                score, tokens = self.best[path[start]]
                if (score + piece, -tokens - 1) > (best, -fewest):
                    best, fewest = score + piece, tokens + 1
        return best, fewest


_TRIES: dict[str, ForwardTrie] = {}  # a worker goes on with its trie in later tasks


def count_tokens(df: DataFrame, scores: dict[str, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_words (words between U+0020 and U+0009-U+000D) and n_tokens of the whole text.

    Null and empty texts have neither. Each word is segmented on its own, after a mark. Columns of these names are
    replaced; rows are independent, nothing is shuffled, and a worker's trie is bounded.
    """
    shared = df.sparkSession.sparkContext.broadcast(scores)  # as large as the vocabulary file
    key = uuid.uuid4().hex

    def make():
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = ForwardTrie(shared.value)
        trie = _TRIES[key]

        def compute(texts):
            n_words, n_tokens = [], []
            split = [(value.as_py() or b"").split() for value in texts]
            held: list[list[bytes]] = []
            size = 0

            def counted():
                trie.count_all([w for words in held for w in words])
                known = trie.terminal.__getitem__
                n_tokens.extend(sum(map(known, words)) for words in held)

            for words in split:
                n_words.append(len(words))
                if size + len(words) > WORDS_AT_ONCE and held:
                    counted()
                    held, size = [], 0
                held.append(words)
                size += len(words)
            counted()
            return [n_words, n_tokens]

        return compute

    return add_columns(df, [as_bytes(text)], "n_words long, n_tokens long", make, keep)
