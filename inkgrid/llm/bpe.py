"""Encoding with a public byte-level BPE vocabulary (problem 6).

Method: the merges are compiled into a deterministic automaton over tokens by
successive merge gadgets. It starts with one state that every byte leads back
to. For the merge (u, v) -> w the state that u leads to is copied, the copy
loses its transition on v, all transitions on u are redirected to the copy and
a transition on w to the state that v leads to is added wherever u had one.
As every token has a single target state at any time, copies form chains: a
state is stored as what it lost and when, and inherits the rest from the state
it was copied from (the target of the right part of its token when the token
was made). A token sequence is the BPE encoding of its bytes exactly if the
automaton accepts it, so a pre-split word is encoded by running its bytes
through the token trie and the automaton's transition table; transitions are
entered in the table when first asked for. Decoding emits the byte labels of
the token arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-split pattern published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Tokenization automaton of a byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.label: dict[int, bytes] = {}
        for word, i in vocab.items():
            if all(c in letters for c in word):
                self.label[i] = bytes(letters[c] for c in word)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(self.label) + 1
        #: by token: its parts, and the time of the merge that made it (bytes: time 0)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [0] * n
        #: by token u: what the chain of copies made for u lost, label -> time
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        made: set[int] = set()
        for time, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.lost[u].setdefault(v, time)
            if w not in made and len(self.label[w]) > 1:
                made.add(w)
                self.left[w], self.right[w], self.born[w] = u, v, time
        #: a token no merge makes has no arc, but the bytes have
        reach = {i for i in self.label if len(self.label[i]) == 1} | made
        #: trie over the byte labels of the arcs: state -> byte -> state, and the token that ends in a state
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for i in sorted(reach):
            s = 0
            for byte in self.label[i]:
                nxt = self.trie[s].get(byte)
                if nxt is None:
                    nxt = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                    self.trie[s][byte] = nxt
                s = nxt
            self.ends[s] = i
        self.whole = {self.label[i]: i for i in reach}
        self.table: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        import regex

        self.split = regex.compile(PATTERN)

    def step(self, u: int, v: int) -> bool:
        """Whether the state that token ``u`` leads to has a transition on token ``v``."""
        key = u << 20 | v
        ok = self.table.get(key)
        if ok is None:
            ok = self._transition(u, v)
            if len(self.table) < 4_000_000:
                self.table[key] = ok
        return ok

    def _transition(self, u: int, v: int) -> bool:
        # The state's chain: copies made for u at any time, then those of its right part made before u was, and so on.
        # A lost arc on a left part b of v matters if it was lost before the arc on the next larger part was added.
        a, until = u, 1 << 30
        while a >= 0:
            lost = self.lost[a]
            if lost:
                b, added = v, 1 << 30
                while b >= 0:
                    t = lost.get(b)
                    if t is not None and t < until and t <= added:
                        return False
                    added, b = self.born[b], self.left[b]
            until, a = self.born[a], self.right[a]
        return True

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word."""
        got = self.words.get(word)
        if got is not None:
            return got
        data = word.encode("utf-8", "surrogatepass")
        one = self.whole.get(data)
        got = [one] if one is not None else self._run(data)
        if len(self.words) < 300_000 and len(data) <= 64:
            self.words[word] = got
        return got

    def _run(self, data: bytes) -> list[int]:
        """The accepted path over the bytes.

        Each prefix of a word has one accepted path, so per position the last
        arc is kept; arcs that end there are tried against the automaton.
        """
        n = len(data)
        last = [-1] * (n + 1)
        trie, ends, step = self.trie, self.ends, self.step
        for i in range(n):
            u = last[i]
            if i and u < 0:
                continue
            s, j = 0, i
            while j < n:
                s = trie[s].get(data[j], -1)
                if s < 0:
                    break
                j += 1
                v = ends[s]
                if v >= 0 and last[j] < 0 and (u < 0 or step(u, v)):
                    last[j] = v
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(self.label[last[j]])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, without special tokens; null and empty text give the empty list."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for w in self.split.findall(text):
            got = words.get(w)
            out.extend(got if got is not None else self.encode_word(w))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding the ids are: the labels of the arcs in a row."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a file, built once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Automaton(path)
    return _LOADED[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import os

    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every document; the empty list for null and empty text.

    One row per input row; other columns of the input are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            ids = [a.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document; only the counts leave the Python workers."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            n = [len(a.encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, tokens long")
