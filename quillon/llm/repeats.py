"""Substring dedup by hashed units: passages that the corpus holds again go, the earliest occurrence stays.

A unit is a line, cut again behind sentence ends, because passages that were
pasted into other text begin and end within lines.  Units are normalised (A-Z
lower-cased, white space to single blanks) and digested.  Digests are grouped
over the whole corpus; the earliest ranked occurrence of each stays.

What goes are passages: runs of neighbouring units that are all later
occurrences and together have ``min_words`` words or ``min_chars`` characters.
A lone common line or sentence stays.  With ``min_words=1`` every repeated unit
goes.  The places in the original texts are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import kept, shared_dir, string_buffers, utf8_array, written
from quillon.llm.words import SPACED, WordHasher, mix

_STOPS = np.isin(np.arange(256), list(b".!?"))
_ROUND = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
#: Powers are made for so many words; longer runs of words make their own.
_POWERS = 1 << 19


class Units:
    """The units of whole texts, by arrays over UTF-8 bytes."""

    def __init__(self, sentences: bool):
        self.sentences, self.hasher = sentences, WordHasher(SPACED)
        self.powers = [self._powers(p, _POWERS) for p in _ROUND]

    @staticmethod
    def _powers(p: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return np.cumprod(np.full(n, p, np.uint64)), np.cumprod(np.full(n, pow(int(p), -1, 1 << 64), np.uint64))

    def documents(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For runs of rows: first row; by unit its row, its first and last word; words' starts, ends and bounds."""
        for i, h, bounds, starts, ends in self.hasher.documents(raw, off):
            if not len(h):
                yield i, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), starts, ends, []
                continue
            base = int(starts[0])
            lines = np.cumsum(raw[base : int(ends[-1])] == 10)
            last = _STOPS[raw[ends - 1]] if self.sentences else np.zeros(len(h), bool)
            last[:-1] |= lines[starts[1:] - base] > lines[ends[:-1] - 1 - base]
            closing = bounds[1:]
            last[closing[closing > 0] - 1] = True
            to = np.flatnonzero(last)
            at = np.r_[0, to[:-1] + 1]
            digests = []
            with np.errstate(over="ignore"):
                for p, (power, inverse) in zip(_ROUND, self.powers, strict=True):
                    if len(h) > len(power):
                        power, inverse = self._powers(p, len(h))
                    sums = np.cumsum(h * power[: len(h)])
                    digests.append(mix((sums[to] - np.where(at > 0, sums[at - 1], np.uint64(0))) * inverse[at] + (to - at).astype(np.uint64)).view(np.int64))
            yield i, np.searchsorted(bounds, at, "right") - 1, at, to, starts, ends, digests


def _unit_udf(sentences: bool):
    """(id, xx, text) -> (id, place, h1, h2) by unit; place: the upper half of xx, then the unit's number in its text."""

    def run(batches):
        units = kept(("units", sentences), lambda: Units(sentences))
        for batch in batches:
            xx = np.asarray(batch.column(1).fill_null(0))
            raw, off = string_buffers(batch.column(2))
            for i, row, *_, digests in units.documents(raw, off):
                if len(row):
                    first = np.r_[True, row[1:] != row[:-1]]
                    number = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
                    place = (xx[row + i] >> 32 << 32) | number
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array(place), *map(pa.array, digests)], ["id", "place", "h1", "h2"])

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """(id, place, later, first_id) of every unit that occurs more than once; ``later`` is false for the earliest occurrence.

    The rank is id (nulls first), then the text's hash, then the unit's number;
    repeated rows of one id and text count as one document.
    """
    text = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("xx"), text.alias("text"))
    units = src.mapInArrow(_unit_udf(sentences), "id long, place long, h1 long, h2 long")
    units = written(units, f"{shared_dir(docs.sparkSession)}/units")
    at = F.struct("id", "place")
    first = units.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("first") != F.col("last"))
    # other keys than the aggregate's give this side an exchange of its own: the join can split a hot digest
    first = first.select(F.bitwise_not("h1").alias("d1"), F.bitwise_not("h2").alias("d2"), "first")
    both = units.join(first, (F.bitwise_not("h1") == F.col("d1")) & (F.bitwise_not("h2") == F.col("d2")))
    return both.select("id", "place", (~at.eqNullSafe(F.col("first"))).alias("later"), F.col("first.id").alias("first_id"))


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """[from, to) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CUT = "id long, text string, n_removed long, n_words_removed long, n_words_repeated long, removed array<struct<start:long,end:long>>, n_units long"


def _cut_udf(sentences: bool, min_words: int, min_chars: int):
    """(id, text, repeated units as 2 * number + later) -> the text without its later passages."""

    def passages(flags, words, chars):
        """Runs of flagged units that are long enough; words and chars measure [from, to)."""
        return [(x, y) for x, y in _runs(flags) if words(x, y) >= min_words or chars(x, y) >= min_chars]

    def cut(units, part):
        raw, off = string_buffers(part.column(1))
        there, marks, n = part.column(1).is_valid().to_pylist(), part.column(2).to_pylist(), part.num_rows
        kept = [raw[a:b].tobytes() if ok else None for ok, a, b in zip(there, off[:-1].tolist(), off[1:].tolist(), strict=True)]
        n_units, counts, spans = np.zeros(n, np.int64), np.zeros((3, n), np.int64), [[] for _ in range(n)]
        for i, row, first, last, starts, ends, _ in units.documents(raw, off):
            bound = np.searchsorted(row, np.arange(row[-1] + 2 if len(row) else 1)).tolist()
            for k, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True), i):
                n_units[k] = b - a
                if not marks[k] or a == b:
                    continue
                base, stop, mine = int(off[k]), int(off[k + 1]), np.array(marks[k])
                begin, end = starts[first[a:b]], ends[last[a:b]]
                points = np.cumsum(raw[base:stop] & 0xC0 != 0x80)
                words = lambda x, y: int(last[a + y - 1] - first[a + x]) + 1
                chars = lambda x, y: int(points[end[y - 1] - 1 - base] - points[begin[x] - base]) + 1
                again, later = np.zeros(b - a, bool), np.zeros(b - a, bool)
                again[mine // 2] = True
                later[mine[mine % 2 == 1] // 2] = True
                counts[2, k] = sum(words(x, y) for x, y in passages(again, words, chars))
                out, done = [], base
                for x, y in passages(later, words, chars):
                    s, e, to = int(begin[x]), int(end[y - 1]), int(begin[y]) if y < b - a else stop
                    counts[0, k] += y - x
                    counts[1, k] += words(x, y)
                    spans[k].append({"start": int(points[s - base]) - 1, "end": int(points[e - 1 - base])})
                    out.append(raw[done:s].tobytes())
                    if x and 10 not in raw[int(end[x - 1]) : s] and 10 in raw[e:to]:
                        out.append(b"\n")
                    done = to
                if out:
                    kept[k] = b"".join([*out, raw[done:stop].tobytes()])
        return pa.RecordBatch.from_arrays([part.column(0), utf8_array(kept), *map(pa.array, counts), pa.array(spans, _SPAN), pa.array(n_units)], ["id", "text", "n_removed", "n_words_removed", "n_words_repeated", "removed", "n_units"])

    def run(batches):
        units = kept(("units", sentences), lambda: Units(sentences))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield cut(units, batch.slice(at, 2000))

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, min_chars: int = 200, sentences: bool = True) -> DataFrame:
    """One row per document: id, text (without its later passages), and what went.

    n_removed and n_words_removed count the units and words that went, removed
    has their places [start, end) in code points of the original text,
    n_words_repeated the words of passages that the corpus holds again, earliest
    occurrences among them, n_units all units.  The white space behind a passage
    goes with it; where that has a line break and the passage began within a line,
    one line break stays.

    Null texts stay null; they, empty and blank texts have no units.  Repeated
    rows of one id and text get equal results.  Malformed UTF-8 is kept as it is,
    each byte that continues no character counting as one.  ``sentences=False``
    makes whole lines the units.
    """
    found = repeated_units(docs, id_col, text_col, sentences)
    number = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    # as many as the text has units at most
    found = found.groupBy(F.col("id").alias("r_id"), F.shiftright("place", 32).alias("r_xx")).agg(F.collect_set(2 * number + F.col("later").cast("int")).alias("marks"))
    text = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.shiftright(F.xxhash64(text), 32).alias("xx"), text.alias("text"))
    both = src.join(found, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("xx") == F.col("r_xx")), "left")
    return both.select("id", "text", "marks").mapInArrow(_cut_udf(sentences, min_words, min_chars), _CUT)
