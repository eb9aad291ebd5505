"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
trigram's vector binds its letters' vectors, each permuted by its place; a
text bundles (adds) its trigrams' vectors, a language those of its training
texts.  A text has the language whose bundle has the largest cosine with its own.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, kept, quoted, read_texts

DIM = 1024
UNDETERMINED = "und"
#: Characters of texts that are worked on together; letters and trigrams in the tables of a worker.
RUN_CHARS, ALPHABET, TABLE_ROWS = 400_000, 160, 16_384
_GAP = 0x20


class Bundler:
    """texts -> trigrams -> bundles, DIM integers each.

    Trigrams are numbers of three code points.  Those of the first ``ALPHABET``
    letters met have rows in a table of vectors; others are built when needed.
    Both give the same integers.
    """

    def __init__(self):
        self.is_letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.letters: dict[int, np.ndarray] = {}
        self.small = np.full(sys.maxunicode + 1, -1, np.int32)  # a letter's place in the alphabet
        self.small[_GAP] = 0
        self.n_small = 1
        self._clear()

    def _clear(self) -> None:
        self.row_of = np.full(ALPHABET**3, -1, np.int32)
        self.table = np.zeros((TABLE_ROWS, DIM), np.int8)
        self.grams: list[int] = []

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = (np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def vector(self, gram: int) -> np.ndarray:
        """The binding of three permuted letters."""
        return np.roll(self._letter(gram >> 42), 2) * np.roll(self._letter((gram >> 21) & 0x1FFFFF), 1) * self._letter(gram & 0x1FFFFF)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of distinct trigrams' vectors, built in blocks."""
        out = np.zeros(DIM)
        for at in range(0, len(grams), 1024):
            out += counts[at : at + 1024] @ np.array([self.vector(g) for g in grams[at : at + 1024].tolist()], np.float64)
        return out

    def _grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, n + 1 bounds by text).  Words are parted by one gap and have one on each side."""
        codes = np.frombuffer("\0".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.flatnonzero(codes == 0)  # lower-casing may change lengths
        letter = self.is_letter[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        number = np.cumsum(keep)  # kept characters up to here
        codes = np.r_[_GAP, np.where(letter, codes, _GAP)[keep], _GAP]
        mid = codes[1:-1] != _GAP  # a trigram belongs to the text of its middle letter
        so_far = np.r_[0, np.cumsum(mid)]
        bounds = so_far[np.r_[0, number[ends], len(mid)]]
        return ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[mid], bounds

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the table; -1 for trigrams that can't be in it."""
        a, b, c = self.small[grams >> 42], self.small[(grams >> 21) & 0x1FFFFF], self.small[grams & 0x1FFFFF]
        if (min(a.min(initial=0), b.min(initial=0), c.min(initial=0)) < 0) and self.n_small < ALPHABET:
            for x in np.unique(np.r_[grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]).tolist():
                if self.small[x] < 0 and self.n_small < ALPHABET:
                    self.small[x] = self.n_small
                    self.n_small += 1
            return self.rows(grams)
        cell = (a.astype(np.int64) * ALPHABET + b) * ALPHABET + c
        cell[(a < 0) | (b < 0) | (c < 0)] = -1
        row = np.where(cell >= 0, self.row_of[cell], -1)
        if (new := (row < 0) & (cell >= 0)).any():
            fresh, first = np.unique(cell[new], return_index=True)
            for k, g in zip(fresh.tolist(), grams[new][first].tolist(), strict=True):
                if len(self.grams) < TABLE_ROWS:
                    self.row_of[k] = len(self.grams)
                    self.table[len(self.grams)] = self.vector(g)
                    self.grams.append(g)
            row = np.where(cell >= 0, self.row_of[cell], -1)
        return row

    def counted(self, texts: list[str | None]):
        """(index, rows, trigrams without a row) by text; the texts of a run are read together, a longer one in pieces."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and j - i < 512 and (j == i or size + len(texts[j] or "") <= RUN_CHARS):
                size += len(texts[j] or "")
                j += 1
            if size <= RUN_CHARS:
                pieces = [[(t or "").replace("\0", " ") for t in texts[i:j]]]
            else:
                pieces = [[x] for x in self._pieces((texts[i] or "").replace("\0", " "))]
            for piece in pieces:
                grams, bounds = self._grams(piece)
                row = self.rows(grams)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    r = row[a:b]
                    odd = r < 0
                    yield i + k, (r[~odd], grams[a:b][odd]) if odd.any() else (r, grams[:0])
            i = j

    def _pieces(self, text: str):
        """Cuts behind a character that is no letter, where one is near."""
        at = 0
        while at < len(text):
            to = min(len(text), at + RUN_CHARS)
            if to < len(text):
                to = next((k for k in range(to, max(at, to - 10_000), -1) if not self.is_letter[ord(text[k - 1])]), to)
            yield text[at:to]
            at = to


def _count_udf(batches):
    """(text, lang) -> (lang, gram, n), added up for some texts at a time."""
    b = kept("bundler", Bundler)
    sums: dict[str, np.ndarray] = {}
    odd: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush():
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            grams = np.array(b.grams, np.int64)[at] if len(at) else np.zeros(0, np.int64)
            extra, m = np.unique(np.concatenate(odd[lang]), return_counts=True) if odd.get(lang) else (grams[:0], grams[:0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + len(extra)), pa.string()), pa.array(np.r_[grams, extra]), pa.array(np.r_[n[at], m].astype(np.int64))], ["lang", "gram", "n"])
        sums.clear()
        odd.clear()

    for batch in (x.slice(at, 2000) for x in batches for at in range(0, x.num_rows, 2000)):
        langs = batch.column(1).to_pylist()
        for i, (rows, extra) in b.counted(read_texts(batch.column(0))):
            lang = langs[i]
            if lang not in sums:
                sums[lang] = np.zeros(TABLE_ROWS, np.int64)
            sums[lang] += np.bincount(rows, minlength=TABLE_ROWS)
            if len(extra):
                odd.setdefault(lang, []).append(extra)
                held += len(extra)
        if held > 1_000_000 or len(sums) > 200:
            yield from flush()
            held = 0
    yield from flush()


def _bundle_udf(batches):
    """(lang, gram, n) -> (lang, place, value): bundles of this partition's trigrams."""
    b, sums = kept("bundler", Bundler), {}
    for batch in batches:
        langs, grams, n = np.array(batch.column(0).to_pylist(), object), np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for lang in set(langs):
            at = langs == lang
            sums[lang] = sums.get(lang, 0) + b.bundle(grams[at], n[at]).astype(np.int64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "place", "value"])


class Profiles:
    """Unit vectors of languages, in the order of their names."""

    def __init__(self, bundles: dict[str, np.ndarray]):
        self.langs = sorted(bundles)
        self.units = np.array([bundles[x] / max(1e-9, float(np.linalg.norm(bundles[x]))) for x in self.langs]).reshape(-1, DIM)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = 1000) -> Profiles:
    """Profiles from all rows with a language and a text.

    Trigrams are counted by language in Spark and their vectors added up there;
    DIM numbers a language reach the driver.
    More than ``max_languages`` names raise ValueError.
    """
    src = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    grams = src.mapInArrow(_count_udf, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = grams.mapInArrow(_bundle_udf, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        if r.lang not in found:
            if len(found) == max_languages:
                raise ValueError(f"over {max_languages} languages")
            found[r.lang] = np.zeros(DIM)
        found[r.lang][r.place] = r.value
    return Profiles(found)


def _predict_udf(profiles, names: list[str]):
    def run(batches):
        p, b = profiles.value, kept("bundler", Bundler)
        units = p.units.T.astype(np.float32)
        for batch in (x.slice(at, 2000) for x in batches for at in range(0, x.num_rows, 2000)):
            vecs = np.zeros((batch.num_rows, 0 if not p.langs else len(p.langs)))
            norms, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            open_: dict[int, np.ndarray] = {}  # bundles of texts that come in pieces
            for i, (rows, extra) in b.counted(read_texts(batch.column(0))):
                n = np.bincount(rows)
                at = np.flatnonzero(n)
                v = n[at].astype(np.float32) @ b.table[at].astype(np.float32)
                if len(extra):
                    v = v + b.bundle(*np.unique(extra, return_counts=True))
                if total[i]:
                    v = v + open_[i]
                open_ = {i: v}
                total[i] += len(rows) + len(extra)
                norms[i] = np.linalg.norm(v)
                vecs[i] = v @ units
            cos = vecs / np.maximum(1e-9, norms)[:, None]
            sure = (total > 0) & bool(p.langs)
            best = cos.argmax(axis=1) if p.langs else np.zeros(batch.num_rows, int)
            langs = [p.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), sure.tolist(), strict=True)]
            scores = [min(1.0, max(0.0, round(float(c[k]), 6))) if ok else 0.0 for c, k, ok in zip(cos, best.tolist(), sure.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return run


def predict(docs: DataFrame, profiles: Profiles, keep: list[Column], text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The columns ``keep``, the language and its score (the cosine, 0 to 1) for every row; only the text decides.

    Null texts and texts without a letter are "und" with score 0, as is every
    text when nothing was learned.  Malformed UTF-8 counts as U+FFFD.  Of equal
    cosines the first language by name wins.  Each row is read for itself,
    repeated ones and those without an id too.
    """
    names = [*docs.select(*keep).columns, lang_name, score_name]
    # mapInArrow looks its columns up by name, so they have plain ones on their way
    plain = [f"c{i}" for i in range(len(names))]
    src = docs.select(quoted(text_col), *keep).toDF("text", *plain[:-2])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kinds = [f.dataType.simpleString() for f in src.schema.fields[1:]] + ["string", "double"]
    return src.mapInArrow(_predict_udf(shared, plain), ", ".join(map(" ".join, zip(plain, kinds, strict=True)))).toDF(*names)


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """``docs`` without rows of no determined language, or whose cosine is under ``min_score``; all columns stay as they were."""
    lang, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, profiles, list(map(quoted, docs.columns)), text_col, lang, score)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*map(quoted, docs.columns))
