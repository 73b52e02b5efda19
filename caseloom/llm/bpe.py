"""Byte-pair encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It is compiled by applying
one gadget per merge, in rank order. For a merge ``u v -> uv`` the gadget

* adds the token ``uv`` wherever ``u`` could be read, with a target that is a copy of the present target of ``v``;
* cuts the arc ``v`` out of the state reached by ``u``, since ``u v`` is now written ``uv``.

A state is thus named by the token that leads to it, and kept as what it was copied from, when, and which arcs it lost
later; ``arc`` reads the arc of a state out of these three tables.

Exactly one accepting path spells each string, and its beginning spells each prefix. So a machine that reads bytes is
deterministic: its state tells the tokens that can end at the present byte (the node of a suffix automaton of all labels) and the last
token of the path that spells the bytes so far, which is the only one of them with an arc from the last token of the
prefix before it. States and transitions are written to a table when they are first met; encoding a pre-split word
is one table look-up for each byte, and its path is read off the last tokens backwards. Decoding emits the label of each arc.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from caseloom.llm.base import add_columns, as_bytes

# Fixed value: the split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the White_Space characters. A run of others, with a space before it, is split on its own.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
KNOWN_WORDS = 1 << 18  # encoded words a worker remembers, twice: the older half goes when the newer is full
KNOWN_ARCS = 1 << 18
MAX_STATES = 1 << 18  # of a worker's table; beyond, it starts anew, which changes nothing
LONGEST_KNOWN = 64  # letters; longer words are read without writing states


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabulary files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Tables of the automaton; ids are those of the vocabulary file."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.labels = labels | {i: s.encode() for s, i in special.items()}
        self.special = special
        ids = {label: i for i, label in labels.items()}
        self.made = {ids[bytes([b])]: 0 for b in range(256)}  # when a token's arcs appear
        self.copied: dict[int, int] = {}  # the state a token's state is a copy of
        self.starts: dict[int, int] = {}  # the arc that must be there for a token's arc to be added
        self.cuts: dict[tuple[int, int], int] = {}  # (state, arc) and when the arc is cut
        for time, (u, v) in enumerate(merges, 1):
            self._gadget(ids[u], ids[v], ids[u + v], time)
        self.trie: dict[int, int] = {}  # of all labels: the child of a node by a byte
        ends: dict[int, int] = {}
        for token in self.made:
            node = 0
            for byte in labels[token]:
                node = self.trie.setdefault(node << 8 | byte, len(self.trie) + 1)
            ends[node] = token
        self.fail, self.ending, self.shorter = self._suffixes(ends)

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        if uv in self.made:
            raise ValueError("two merges make the same token")
        self.made[uv] = time
        self.starts[uv], self.copied[uv] = u, v
        self.cuts[u, v] = time

    def _suffixes(self, ends: dict[int, int]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """For each node the longest other one that ends its string, and the longest token that does; the next shorter one of a token."""
        kids: dict[int, list[tuple[int, int]]] = {}
        for key, there in self.trie.items():
            kids.setdefault(key >> 8, []).append((key & 255, there))
        fail, ending = np.zeros(len(self.trie) + 1, "i4"), np.full(len(self.trie) + 1, -1, "i4")
        shorter: dict[int, int] = {}
        queue = [0]
        for node in queue:  # grows while it is read
            for byte, there in kids.get(node, ()):
                queue.append(there)
                if node:
                    back = int(fail[node])
                    while back and back << 8 | byte not in self.trie:
                        back = int(fail[back])
                    fail[there] = self.trie.get(back << 8 | byte, 0)
                below = int(ending[fail[there]])
                token = ends.get(there, -1)
                if token >= 0:
                    shorter[token] = below
                ending[there] = token if token >= 0 else below
        return fail, ending, shorter

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` can be read in ``state`` once all gadgets are applied."""
        made, cuts = self.made, self.cuts
        last = len(made)  # the latest time at which a cut counts
        while True:
            cut = cuts.get((state, token))
            if cut is not None and cut <= last:
                return False
            a, b = made[state], made[token]
            if not a and not b:
                return True
            if a > b:  # the state is the younger: a copy made at time a, before that gadget's own cut
                last, state = a - 1, self.copied[state]
            else:  # the arc is the younger: added where its first part could still be read
                last, token = b, self.starts[token]


class Encoder:
    """Encodes and decodes texts; keeps what it learnt about frequent words and arcs."""

    def __init__(self, automaton: MergeAutomaton, known_words: int = KNOWN_WORDS):
        self.a, self.known_words = automaton, known_words
        self.split = regex.compile(SPLIT)
        self.chunks = re.compile(CHUNKS)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.arcs: dict[int, bool] = {}  # by state and token in one number
        self.fail, self.ending = (array("i", x.tobytes()) for x in (automaton.fail, automaton.ending))
        self._renew()
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.emit = [automaton.labels.get(i, b"") for i in range(max(automaton.labels) + 1)]
        self.size = [len(x) for x in self.emit]

    def forget(self) -> None:
        """Drops what was learnt, which takes memory that the next stage's tasks need; the automaton stays."""
        self.words, self.older, self.arcs = {}, {}, {}
        self._renew()

    def _renew(self) -> None:
        self.table: dict[int, int] = {}  # the next state by a state and a byte in one number
        self.node, self.last = [0], [-1]  # of each state; the first is that of an empty word

    def _learn(self, state: int, token: int) -> bool:
        if len(self.arcs) >= KNOWN_ARCS:
            self.arcs.clear()
        free = self.arcs[state << 32 | token] = self.a.arc(state, token)
        return free

    def _reached(self, node: int, byte: int, ends: list[int]) -> tuple[int, int]:
        """The node after ``byte``, and the last token of the path to there. ``ends``: the last tokens at all places before."""
        trie, fail = self.a.trie, self.fail
        there = trie.get(node << 8 | byte)
        while there is None:
            node = fail[node]
            there = trie.get(node << 8 | byte)
        token, place = self.ending[there], len(ends)
        while True:
            before = ends[place - self.size[token]]
            if before < 0:
                return there, token
            free = self.arcs.get(before << 32 | token)
            if free or free is None and self._learn(before, token):
                return there, token
            token = self.a.shorter[token]

    def _path(self, data: bytes) -> list[int]:
        """The one accepting path that spells ``data``."""
        ends = [-1]
        if len(data) <= LONGEST_KNOWN:
            if len(self.last) > MAX_STATES:
                self._renew()
            table, last = self.table, self.last
            state = 0
            for byte in data:
                there = table.get(state << 8 | byte)
                if there is None:
                    there = table[state << 8 | byte] = len(last)
                    node, token = self._reached(self.node[state], byte, ends)
                    self.node.append(node)
                    last.append(token)
                state = there
                ends.append(last[state])
        else:
            node = 0
            for byte in data:
                node, token = self._reached(node, byte, ends)
                ends.append(token)
        path, place = [], len(data)
        while place:
            path.append(ends[place])
            place -= self.size[ends[place]]
        return path[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a run of characters at whose ends the split pattern always splits."""
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isascii() and chunk.removeprefix(" ").isalpha():  # the pattern takes such a run as a whole
                found = self._path(chunk.encode())
            else:
                found = [i for w in self.split.findall(chunk) for i in self._path(w.encode())]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(chunk) <= LONGEST_KNOWN:
            if len(self.words) >= self.known_words:
                self.older, self.words = self.words, {}
            self.words[chunk] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        chunks = self.chunks.findall(text)
        parts = list(map(self.words.get, chunks))
        if None in parts:
            slow, known = self._chunk, self.words.get
            parts = [part or known(chunk) or slow(chunk) for part, chunk in zip(parts, chunks, strict=True)]
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        if len(parts) == 1:
            return self._plain(text)
        ids = self.a.special
        return b"".join(np.array([ids[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        emit = self.emit
        return b"".join(map(emit.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}  # a worker goes on with what it has in later tasks


def _encoder(key: str, automaton, known_words: int) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(automaton.value, known_words)
    return _ENCODERS[key]


def load_automaton(path: str) -> MergeAutomaton:
    """Compile the automaton of a byte-level tokenizer file (``path`` is local to the driver)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    added = spec.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take white space are not supported")
    special = {t["content"]: t["id"] for t in added}
    labels = {i: raw(t) for t, i in spec["model"]["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return MergeAutomaton(labels, [(raw(u), raw(v)) for u, v in pairs], special)


def encode_decode(
    df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, with_texts: bool = False,
    known_words: int = KNOWN_WORDS, release: bool = False,
) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256; with ``with_texts`` also ids (array of int) and decoded.

    Null and empty texts have no tokens. Columns of these names are replaced. Rows are independent: no shuffle, repeated
    rows give repeated results. A worker holds one text's ids and a memory of twice ``known_words`` words; with ``release``
    it drops what it learnt at the end of each task, for jobs whose other stages need the memory.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_automaton(tokenizer))  # as large as the vocabulary file
    key = uuid.uuid4().hex

    def make():
        encoder = _encoder(key, shared, known_words)

        def compute(texts):
            counts, ids_sha, decoded_sha, ids_out, texts_out = [], [], [], [], []
            for value in texts:
                data = value.as_py() or b""
                ids = encoder.encode(data.decode("utf-8", "replace"))
                back = encoder.decode(ids)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if with_texts:
                    ids_out.append(np.frombuffer(ids, "<u4").astype("int32"))
                    texts_out.append(back)
            return [counts, ids_sha, decoded_sha, *([ids_out, texts_out] if with_texts else [])]

        if release:
            compute.release = encoder.forget
        return compute

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_texts
    return add_columns(df, [as_bytes(text)], ddl, make, keep)
