"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Documents are streamed word by word; the automaton keeps the length of the
longest match that ends at each word.  Where it reaches a window's length the
window's words are hit.  An item's windows are its runs of ``window`` words; an
item of fewer words is one window.

1. The neighbouring word pairs of all items set bits of a map of bounded size.
   One pass over the documents counts words and writes down the runs of words
   that are all linked by such pairs and long enough for a window: all other
   words lead an automaton back to its start.
2. Items are dealt to automata of bounded size, and the runs, a small part of
   the corpus, stream through one after the other.  Only one automaton is
   broadcast at a time, and no task holds two.

Words are equal if their 64-bit hashes are; two of n different words share one
with probability n^2 / 2^65, and a window would need that of all its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.automaton import Automaton
from quillon.llm.bitmap import all_set, bitmap, bits_for, places, places_of
from quillon.llm.common import kept, quoted, shared_dir, string_buffers, without_rows, written
from quillon.llm.words import ALNUM, WordHasher, mix


class SuffixAutomaton(Automaton):
    """Every run of words of the items, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        super().__init__()
        self.window = window
        ends: dict[int, set[str]] = defaultdict(set)
        last_of: dict[str, tuple[int, int]] = {}
        for name, words in items:
            at = 0
            for w in words:
                at = self.extend(at, w)
                ends[at].add(name)
        for name, words in items:  # states are final now: an item's own state may have been split off
            at = 0
            for w in words:
                at = self.next[at][w]
            if words and len(words) < window:
                last_of[name] = (at, len(words))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:
            up = self.link[s]
            if s in ends and self.len[up] >= window:
                ends[up] |= ends[s]
        self.of = {s: frozenset(names) for s, names in ends.items() if self.len[s] >= window > self.len[self.link[s]]}
        short: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, (s, n) in last_of.items():
            short[s][n].add(name)
        #: by state: its window's state, or -1; the short items that end its runs
        self.at_window, self.short = [-1] * len(self.len), [()] * len(self.len)
        for s in reversed(order):
            up = self.link[s]
            if self.len[s] >= window:
                self.at_window[s] = s if self.len[up] < window else self.at_window[up]
            self.short[s] = self.short[up] + tuple((n, frozenset(names)) for n, names in short[s].items()) if s in short else self.short[up]

    def stream(self, words: list[int]):
        """(end, length, items) of each window that occurs; end is the index after its last word."""
        state = length = 0
        for i, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                length = 0
            if length >= self.window:
                yield i, self.window, self.of[self.at_window[state]]
            for n, names in self.short[state]:
                if n <= length:
                    yield i, n, names


class Matcher:
    """An automaton of items' words, and what passes over words that can't match."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        hasher = WordHasher(ALNUM)
        raw, off = string_buffers(pa.array([t for _, t in items], pa.string()))
        rows = [h[b[j] : b[j + 1]] for _, h, b, _, _ in hasher.documents(raw, off) for j in range(len(b) - 1)]
        self.vocab = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.pairs = np.unique(np.concatenate([pair_hashes(h[:-1], h[1:]) for h in rows])) if rows else np.zeros(0, np.uint64)
        ids = [np.searchsorted(self.vocab, h).tolist() for h in rows]
        self.shortest = min([window, *(len(x) for x in ids if x)])
        self.automaton = SuffixAutomaton([(name, x) for (name, _), x in zip(items, ids, strict=True)], window)

    def words(self, h: np.ndarray) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(end, length, items) of the windows in a run of word hashes."""
        at, known = _within(h, self.vocab)
        link = np.r_[False, known[:-1] & known[1:]] if len(h) else known
        both = np.flatnonzero(link)
        if self.shortest > 1:
            link[both[~_within(pair_hashes(h[both - 1], h[both]), self.pairs)[1]]] = False
        for a, n in _linked_runs(link, known, self.shortest):
            for e, m, names in self.automaton.stream(at[a : a + n].tolist()):
                yield a + e, m, names


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(3) + b)


def _within(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return at, of[at] == x if len(of) else np.zeros(len(x), bool)


def _linked_runs(link: np.ndarray, known: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """(first word, words) of runs in which each word is linked with the one before it."""
    at = np.flatnonzero(~link)
    size = np.diff(np.r_[at, len(link)])
    keep = (size >= shortest) & known[at]
    return list(zip(at[keep].tolist(), size[keep].tolist(), strict=True))


class PairMap:
    """Bits for the items' words and neighbouring word pairs, which the runs of all windows are made of."""

    def __init__(self, bits: np.ndarray, shortest: int):
        self.bits, self.shortest = bits, shortest

    def _has(self, h: np.ndarray) -> np.ndarray:
        return all_set(self.bits, places_of(h, 8 * len(self.bits)))

    def runs(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(first word, words) of runs that may hold a window; none goes over a bound."""
        known = self._has(h)
        link = np.r_[False, known[:-1] & known[1:]] if len(h) else known
        both = np.flatnonzero(link)
        link[both[~self._has(pair_hashes(h[both - 1], h[both]))]] = False
        link[bounds[bounds < len(h)]] = False
        return _linked_runs(link, known, self.shortest)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(quoted(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))


def _keys_udf(batches):
    """Texts -> (hash of a word or a pair of neighbours, words of its text)."""
    hasher = kept("words", lambda: WordHasher(ALNUM))
    for batch in batches:
        for _, h, b, _, _ in hasher.documents(*string_buffers(batch.column(0))):
            for a, z in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                keys = np.r_[h[a:z], pair_hashes(h[a : z - 1], h[a + 1 : z])] if z > a else h[:0]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), z - a, np.int64))], ["key", "words"])


def _pair_map(items: DataFrame, window: int, n_bytes: int, max_bits: int, path: str) -> PairMap:
    """Made by tasks; the driver holds the map alone.  Words are no more than bytes, so 16 bits a byte are 8 a key or more."""
    keys = written(items.select("t").mapInArrow(_keys_udf, "key long, words long").distinct(), path)
    shortest = keys.agg(F.min("words")).first()[0]
    return PairMap(bitmap(keys.select("key"), places, bits_for(n_bytes, 16, max_bits)), min(window, shortest or window))


def _matcher(items, window: int) -> Matcher:
    """Built once in each Python worker; only the newest is held."""
    key = ("matcher", hashlib.sha256(repr(items.value).encode()).digest(), window)
    return kept(key, lambda: Matcher(items.value, window))


def _spans(found) -> list[tuple[int, int]]:
    """Merged [from, to) word ranges."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUN = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))
_RUNS = "array<struct<at:long,words:array<long>,starts:array<long>,ends:array<long>>>"
_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_SPANS = "array<struct<from:long,to:long>>"


def _runs_udf(shared):
    """(id, xx, text) -> words of the text, and its runs: number of the first word, hashes, byte places."""

    def run(batches):
        pairs, hasher = shared.value, kept("words", lambda: WordHasher(ALNUM))
        for batch in batches:
            raw, off = string_buffers(batch.column(2))
            count, runs = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for i, h, bounds, starts, ends in hasher.documents(raw, off):
                count[i : i + len(bounds) - 1] = np.diff(bounds)
                for a, n in pairs.runs(h, bounds):
                    d = int(np.searchsorted(bounds, a, "right")) - 1
                    base = int(off[i + d])
                    runs[i + d].append({"at": a - int(bounds[d]), "words": h[a : a + n].view(np.int64), "starts": starts[a : a + n] - base, "ends": ends[a : a + n] - base})
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(count), pa.array(runs, _RUN)], ["id", "xx", "n_words", "runs"])

    return run


def _match_udf(items, window: int):
    """(id, xx, runs) -> what this automaton finds."""

    def run(batches):
        matcher = _matcher(items, window)
        for batch in batches:
            spans, places, names, keep = [], [], [], []
            for k, runs in enumerate(batch.column(2).to_pylist()):
                mine, of = [], set()
                for r in runs:
                    found = list(matcher.words(np.array(r["words"], np.int64).view(np.uint64)))
                    of.update(x for _, _, x in found)
                    mine += [(r, a, b) for a, b in _spans((e - m, e) for e, m, _ in found)]
                if mine:
                    keep.append(k)
                    spans.append([{"from": r["at"] + a, "to": r["at"] + b} for r, a, b in mine])
                    places.append([{"from": r["starts"][a], "to": r["ends"][b - 1]} for r, a, b in mine])
                    names.append(sorted(frozenset().union(*of)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]), pa.array(spans, _SPAN), pa.array(places, _SPAN), pa.array(names, pa.list_(pa.string()))], ["id", "xx", "spans", "places", "items"])

    return run


def _merge_found(batches):
    """(id, xx, spans, places, items), all automata's one after the other -> the same, merged."""
    for batch in batches:
        spans, places, names = [], [], []
        for s, p, i in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            first = {x["from"]: y["from"] for x, y in zip(s, p, strict=True)}
            last = {x["to"]: y["to"] for x, y in zip(s, p, strict=True)}
            mine = _spans((x["from"], x["to"]) for x in s)
            spans.append([{"from": a, "to": b} for a, b in mine])
            places.append([{"from": first[a], "to": last[b]} for a, b in mine])
            names.append(sorted(set(i)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, _SPAN), pa.array(places, _SPAN), pa.array(names, pa.list_(pa.string()))], ["h_id", "h_xx", "spans", "places", "items"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, max_automaton_bytes: int = 2 << 20, max_map_bits: int = 1 << 28) -> DataFrame:
    """One row per document: id, xx (hash of the text), n_words, n_hit, spans (word ranges), places (UTF-8 byte ranges), items.

    Words are ASCII letters and digits (A-Z lower-cased) and all non-ASCII
    characters, malformed bytes among them.  Null and empty texts have no words
    and no hits; null item ids count as the empty string.  ``items`` has the ids
    whose windows occur.  Repeated rows of one id and text have equal hits.

    The map has 16 bits for each byte of the items, ``max_map_bits`` at most: more
    items set more of them, and more runs go to the automata, of ``max_automaton_bytes``
    of items each.  Neither changes the result.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    items = _items(benchmark, item_col, item_text_col)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    pairs = _pair_map(items, window, total, max_map_bits, f"{path}/keys")
    src = docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text_col)).alias("xx"), quoted(text_col).alias("text"))
    every = written(src.mapInArrow(_runs_udf(spark.sparkContext.broadcast(pairs)), f"id long, xx long, n_words long, runs {_RUNS}"), f"{path}/runs")

    runs = every.where("size(runs) > 0").select("id", "xx", "runs")
    n = max(1, -(-total // max_automaton_bytes))
    part, paths = F.pmod(F.xxhash64("i", "t"), F.lit(n)), []
    for k in range(n):
        mine = spark.sparkContext.broadcast([(r.i, r.t) for r in (items if n == 1 else items.where(part == k)).toLocalIterator()])
        paths.append(f"{path}/found-{k}")
        written(runs.mapInArrow(_match_udf(mine, window), f"id long, xx long, spans {_SPANS}, places {_SPANS}, items array<string>"), paths[-1])
        mine.destroy()
    found = spark.read.schema(f"id long, xx long, spans {_SPANS}, places {_SPANS}, items array<string>").parquet(*paths)
    # as many as a text has windows at most, for each automaton
    lists = [F.flatten(F.collect_list(F.struct("spans", "places", "items"))[c]).alias(c) for c in ("spans", "places", "items")]
    found = found.groupBy("id", "xx").agg(*lists).mapInArrow(_merge_found, f"h_id long, h_xx long, spans {_SPANS}, places {_SPANS}, items array<string>")
    both = every.select("id", "xx", "n_words").join(found, F.col("id").eqNullSafe(F.col("h_id")) & F.col("xx").eqNullSafe(F.col("h_xx")), "left")
    filled = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "places", "items")]
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return both.select("id", "xx", "n_words", *filled).select("id", "xx", "n_words", hit.alias("n_hit"), "spans", "places", "items")


def contaminated(n_words, n_hit, percent: int = 5):
    """The rule on columns: any hit, and hit words of at least ``percent`` hundredths of all."""
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, **how) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay as they were."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **how)
    gone = hits.where(contaminated(F.col("n_words"), F.col("n_hit"), percent)).select("id", "xx").distinct()
    return without_rows(docs, written(gone, f"{shared_dir(docs.sparkSession)}/gone"), id_col, text_col)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = 13, max_coverage: float = 0.5, **how) -> DataFrame:
    """(id, text, n_removed, dropped): the texts without hit spans of at least ``min_span`` words.

    A document more than ``max_coverage`` of which is hit is ``dropped``: its text is null.
    """
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **how).where("n_hit > 0").dropDuplicates(["id", "xx"])
    hits = written(hits, f"{shared_dir(docs.sparkSession)}/hits").select(F.col("id").alias("h_id"), F.col("xx").alias("h_xx"), "n_words", "n_hit", "spans", "places")
    src = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("xx"))
    both = src.join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("xx") == F.col("h_xx")), "left")
    long_ = F.filter(F.zip_with("spans", "places", lambda s, p: F.struct((s["to"] - s["from"]).alias("n"), p["from"].alias("from"), p["to"].alias("to"))), lambda x: x["n"] >= min_span)
    raw = F.encode("text", "UTF-8")
    cut = F.aggregate(long_, F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept")), lambda s, x: F.struct(x["to"].alias("at"), F.concat(s["kept"], F.substring(raw, (s["at"] + 1).cast("int"), (x["from"] - s["at"]).cast("int"))).alias("kept")))
    rest = F.decode(F.concat(cut["kept"], F.substring(raw, (cut["at"] + 1).cast("int"), F.length(raw))), "UTF-8")
    dropped = F.coalesce(F.col("n_hit") > max_coverage * F.col("n_words"), F.lit(False))
    return both.select("id", F.when(dropped, F.lit(None)).when(F.coalesce(F.size(long_), F.lit(0)) > 0, rest).otherwise(F.col("text")).alias("text"), F.coalesce(F.aggregate(long_, F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0)).alias("n_removed"), dropped.alias("dropped"))
