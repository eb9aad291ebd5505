"""BPE encoding and decoding by dynamic programming over prefixes.

A suffix automaton of the vocabulary follows each word and tells, at every
prefix, which tokens end there.  Of those, one fits the last token of the
prefix before it; it is stored as the prefix's last token, and the back
pointers from the end of the word give the ids.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.automaton import Automaton
from quillon.llm.bpe import FINAL, NO_TOKEN, Memo, WordBpe, read_vocabulary
from quillon.llm.common import kept, read_texts

#: Words whose ids a worker remembers.
MAX_WORDS = 300_000


class TokenAutomaton:
    """Suffix automaton of all tokens; transitions in one table keyed by state and symbol."""

    def __init__(self, bpe: WordBpe):
        runs = Automaton()
        for symbols in bpe.symbols.values():
            at = 0
            for s in symbols:
                at = runs.extend(at, s)
        self.link, self.len = runs.link, runs.len
        self.step = {state << 9 | s: to for state, nxt in enumerate(runs.next) for s, to in nxt.items()}
        token_at: dict[int, list[tuple[int, int]]] = {}
        for t, symbols in bpe.symbols.items():
            at = 0
            for s in symbols:
                at = self.step[at << 9 | s]
            token_at.setdefault(at, []).append((len(symbols), t))
        #: by state: (length, token) of the tokens among its suffixes, longest first
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.tokens[self.link[s]]
            self.tokens[s] = (*sorted(token_at[s], reverse=True), *up) if s in token_at else up


class Encoder:
    """text -> ids, and ids -> text."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.automaton = bpe, TokenAutomaton(bpe)
        #: by word: its ids as bytes
        self.known = Memo(lambda w: struct.pack(f"<{len(ids := self.word(w))}I", *ids), MAX_WORDS)
        self.names = np.array([bpe.name.get(i, "") for i in range(max(bpe.name) + 1)], object)

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        a, fit = self.automaton, self.bpe.fit
        step, link, length_of, tokens = a.step, a.link, a.len, a.tokens
        last, start = [NO_TOKEN], [0]
        state = length = 0
        final = len(raw) - 1
        for i, s in enumerate(raw):
            if i == final:
                s += FINAL
            while (to := step.get(state << 9 | s)) is None:
                state = link[state]
                length = length_of[state]
            state, length = to, length + 1
            for n, t in tokens[state]:
                if n <= length and (n == i + 1 or fit[last[i + 1 - n] << 20 | t]):
                    last.append(t)
                    start.append(i + 1 - n)
                    break
            else:
                raise AssertionError("a prefix without a last token")
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, special = self.known.__getitem__, self.bpe.special
        return b"".join([struct.pack("<I", special[words[0]]) if odd else b"".join(map(known, words)) for odd, words in self.bpe.runs(text)])

    def decode(self, ids: bytes) -> str:
        """The tokens joined by blanks: the file names no decoder."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())

    def both(self, text: str) -> tuple[bytes, str]:
        """encode(text), and decode of that."""
        ids = self.encode(text)
        return ids, self.decode(ids)


def encoder(raw: bytes) -> Encoder:
    """Built once in each Python worker."""
    return kept(("encoder", raw), lambda: Encoder(WordBpe(raw)))


def _rows(raw, make: Callable[[bytes, str], tuple], types: list[pa.DataType], names: list[str]):
    def run(batches):
        e = encoder(raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [make(*e.both(t)) for t in read_texts(part.column(1))]
                columns = zip(*made, strict=True) if made else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["__id", *names])

    return run


def encoded(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: __id, ids (array of int), decoded.  Null counts as empty: no ids, empty text."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = _rows(raw, lambda ids, text: (np.frombuffer(ids, "<i4"), text), [pa.list_(pa.int32()), pa.string()], ["ids", "decoded"])
    return src.mapInArrow(rows, "__id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: __id, n_tokens, ids_sha256, decoded_sha256; ids and texts stay in the worker."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = _rows(raw, lambda ids, text: (len(ids) // 4, sha256(ids).hexdigest(), sha256(text.encode()).hexdigest()), [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])
    return src.mapInArrow(rows, "__id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
