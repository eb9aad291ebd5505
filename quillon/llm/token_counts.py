"""Token counts by a transducer compiled from the tokenizer.

A text is a stream of symbols: the bytes of its words, the last byte of each
marked.  A state of the transducer stands for the open token starts of a word:
for each, the place in the vocabulary's trie, the last token before it, and how
many tokens fewer had been emitted there.  A symbol leads to one next state, and
the transition carries by how much the count of emitted tokens changes.  A
word's last byte leads back to the start.  Transitions are compiled when first
met and kept in a table of bounded size.

Streams are cut into chunks of equal length, wherever that is in a word.  The
map of a chunk leads from states before it to the state behind it and the
tokens in between.  Its domain are the states that can be met there: the start,
and those in which the chunk before can end.  All chunks of many texts run side
by side, one symbol of each at a time, as array operations: first from the
start; then, up to the first word end, where all runs meet, from the states in
which the chunks before them ended.  Maps compose associatively, and a prefix
scan over a text's maps gives the count behind each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import FINAL, NO_TOKEN, WordBpe, read_vocabulary
from quillon.llm.common import kept, read_texts

#: Symbols of a chunk; chunks that run side by side; characters of texts that are worked on together.
CHUNK, LANES, BLOCK = 1024, 1 << 14, 1 << 22
#: Transitions that a worker keeps before it begins anew.
MAX_TRANSITIONS = 2_000_000
START = 0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: state before a chunk -> (state behind it, tokens)
ChunkMap = dict[int, tuple[int, int]]


class Transducer:
    """States, and transitions in a table with open addressing that arrays of (state, symbol) are looked up in."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.trie: dict[int, int] = {}
        self.token: list[int] = [NO_TOKEN]
        for t, symbols in bpe.symbols.items():
            at = 0
            for s in symbols:
                key = at << 9 | s
                at = self.trie.get(key)
                if at is None:
                    at = self.trie[key] = len(self.token)
                    self.token.append(NO_TOKEN)
            self.token[at] = t
        self.open = {k >> 9 for k in self.trie}
        self.reset()

    def reset(self) -> None:
        start = ((0, NO_TOKEN, 0),)
        self.states, self.number = [start], {start: START}
        self.known = 0
        self._table(1 << 16)

    def _table(self, slots: int) -> None:
        self.shift, self.mask = np.uint64(65 - slots.bit_length()), slots - 1
        self.keys, self.next, self.change = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)

    def _put(self, key: int, to: int, change: int) -> None:
        slot = int(key * int(_SPREAD) & (1 << 64) - 1) >> int(self.shift)
        while self.keys[slot] >= 0:
            slot = slot + 1 & self.mask
        self.keys[slot], self.next[slot], self.change[slot] = key, to, change

    def _compile(self, key: int) -> None:
        """Add the transition of state << 9 | symbol."""
        state, symbol = key >> 9, key & 511
        came, change = [], None
        for node, last, behind in self.states[state]:  # the longest open start comes first
            child = self.trie.get(node << 9 | symbol)
            if child is None:
                continue
            t = self.token[child]
            if change is None and t != NO_TOKEN and (last == NO_TOKEN or self.bpe.fit[last << 20 | t]):
                change, emitted = behind + 1, t
            came.append((child, last, behind))
        if change is None:
            raise AssertionError("a prefix without a last token")
        if symbol >= FINAL:
            to = START
        else:
            nxt = (*((c, last, b - change) for c, last, b in came if c in self.open), (0, emitted, 0))
            to = self.number.get(nxt)
            if to is None:
                to = self.number[nxt] = len(self.states)
                self.states.append(nxt)
        if 4 * self.known >= len(self.keys):
            old = self.keys, self.next, self.change
            self._table(4 * len(self.keys))
            for k, n, c in zip(*(x[old[0] >= 0].tolist() for x in old), strict=True):
                self._put(k, n, c)
        self._put(key, to, change)
        self.known += 1

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes of the counts)."""
        key = state << 9 | symbol
        while True:
            slot = (key.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)
            got = self.keys[slot]
            odd = np.flatnonzero(got != key)
            new: list[int] = []
            while len(odd):
                empty = got[odd] < 0
                if empty.any():
                    new += key[odd[empty]].tolist()
                    odd = odd[~empty]
                slot[odd] = slot[odd] + 1 & self.mask
                got[odd] = self.keys[slot[odd]]
                odd = odd[got[odd] != key[odd]]
            if not new:
                return self.next[slot], self.change[slot]
            for k in dict.fromkeys(new):
                self._compile(k)

    def run(self, stream: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states behind, tokens) of pieces of the stream, side by side."""
        exit_, count = entry.astype(np.int64), np.zeros(len(begin), np.int64)
        for at in range(0, len(begin), LANES):
            order = at + np.argsort(-length[at : at + LANES], kind="stable")
            size, where = length[order], begin[order]
            state, n = exit_[order], np.zeros(len(order), np.int64)
            going = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left").tolist()  # lanes longer than j
            for j, k in enumerate(going):
                state[:k], change = self.step(state[:k], stream[where[:k] + j])
                n[:k] += change
            exit_[order], count[order] = state, n
        return exit_, count

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stream of all texts, bounds by text, special tokens by text)."""
        parts, special = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            mine = []
            for odd, words in self.bpe.runs(text):
                if odd:
                    special[i] += 1
                elif words:
                    mine.append("\n".join(words))  # no word holds white space
            parts.append(("\n".join(mine) + "\n").encode() if mine else b"")
        raw = np.frombuffer(b"".join(parts), np.uint8)
        gap = raw == 10
        stream = raw.astype(np.int64)
        stream[np.flatnonzero(gap) - 1] += FINAL
        bounds = np.r_[0, np.cumsum(~gap)][np.cumsum([0, *map(len, parts)])]
        return stream[~gap], bounds, special

    def chunk_maps(self, stream: np.ndarray, bounds: np.ndarray, chunk: int) -> tuple[list[ChunkMap], np.ndarray]:
        """(maps of all chunks, bounds of each text's chunks)."""
        size = np.diff(bounds)
        chunks = -(-size // chunk)
        upto = np.r_[0, np.cumsum(chunks)]
        text = np.repeat(np.arange(len(size)), chunks)
        number = np.arange(len(text)) - upto[text]
        begin = bounds[text] + number * chunk
        length = np.minimum(chunk, bounds[text + 1] - begin)
        finals = np.flatnonzero(stream >= FINAL)
        behind = np.r_[finals, len(stream)][np.searchsorted(finals, begin)] + 1 - begin
        closed, head = behind <= length, np.minimum(behind, length)  # whether a word ends in the chunk; symbols up to there

        exits, counts = self.run(stream, begin, length, np.full(len(begin), START, np.int64))
        maps: list[ChunkMap] = [{START: (e, c)} for e, c in zip(exits.tolist(), counts.tolist(), strict=True)]
        # states in which a chunk can end, and that the next one of the text doesn't know yet
        lane = np.flatnonzero((number[1:] > 0) & (exits[:-1] != START)) + 1 if len(maps) else np.zeros(0, np.int64)
        entry = exits[lane - 1]
        plain = np.zeros(len(maps), np.int64)  # tokens of the head from the start
        plain[lane] = self.run(stream, begin[lane], head[lane], np.full(len(lane), START, np.int64))[1]
        while len(lane):
            to, n = self.run(stream, begin[lane], head[lane], entry)
            more = []
            for k, e, x, c, whole in zip(lane.tolist(), entry.tolist(), to.tolist(), n.tolist(), (~closed[lane]).tolist(), strict=True):
                if whole:
                    maps[k][e] = x, c
                    if k + 1 < len(maps) and number[k + 1] and x not in maps[k + 1]:
                        more.append((k + 1, x))
                else:
                    last, tokens = maps[k][START]
                    maps[k][e] = last, tokens - int(plain[k]) + c
            again = sorted(set(more))
            lane, entry = (np.array([p[i] for p in again], np.int64) for i in (0, 1))
            fresh = lane[plain[lane] == 0]
            plain[fresh] = self.run(stream, begin[fresh], head[fresh], np.full(len(fresh), START, np.int64))[1]
        return maps, upto

    def counts(self, texts: list[str], chunk: int | None = None) -> list[int]:
        """Tokens of each text."""
        if self.known > MAX_TRANSITIONS:
            self.reset()
        stream, bounds, special = self.symbols(texts)
        maps, upto = self.chunk_maps(stream, bounds, chunk or CHUNK)
        return [n + (prefix_scan(maps[a:b])[-1][START][1] if b > a else 0) for n, a, b in zip(special.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def compose(x: ChunkMap, y: ChunkMap) -> ChunkMap:
    """First x, then y, for states that y leads on from."""
    return {s: (y[t][0], n + y[t][1]) for s, (t, n) in x.items() if t in y}


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """The composition of the first 1, 2, 3, ... maps, in twice as many levels as their number has binary digits."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([compose(maps[i - 1], maps[i]) for i in range(1, len(maps), 2)])
    return [pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i]) if i else maps[0] for i in range(len(maps))]


def _blocks(texts: list[str]):
    """Runs of texts of BLOCK characters, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def _count_udf(raw):
    def run(batches):
        t = kept(("transducer", raw.value), lambda: Transducer(WordBpe(raw.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [n for texts in _blocks(read_texts(part.column(2))) for n in t.counts(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens.

    Null and empty texts have no tokens; special tokens in a text count one
    each; nothing is added, cut or padded.  Malformed UTF-8 is counted as
    U+FFFD; n_bytes are the bytes as they are.  Each row is counted for itself,
    repeated ones and those without an id too.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    text = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return src.mapInArrow(_count_udf(raw), "id long, n_bytes long, n_tokens long")
