"""A word-level BPE vocabulary with word ends, and how texts fall into its words.

The vocabulary file is a parameter; its bytes travel to the executors with the
plan, as the file's size doesn't depend on the corpus.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import regex

NO_TOKEN = -1
#: Characters of a text whose words are listed at a time, and up to the next white space.
SLICE = 1 << 19
#: Symbols are bytes; a word's last byte has 256 added.
FINAL = 256


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> bytes:
    return Path(path).read_bytes()


class WordBpe:
    """Tokens as runs of symbols, merges, and the test whether two tokens can stand side by side."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self.name = {i: t for t, i in vocab.items()}
        self.base = [vocab[c] for c in letters] + [vocab[c + end] for c in letters]
        symbols: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(self.base)}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in symbols:
                raise ValueError(f"{a + b} has two ways to be merged")
            symbols[z] = symbols[x] + symbols[y]
            self.left[z], self.right[z], self.rank[z], self.merge[x, y] = x, y, k, k
        self.symbols = symbols
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.name |= {i: t for t, i in self.special.items()}
        cut = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self._special = regex.compile(f"({cut})") if cut else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        #: the words of a normalised text; no word goes over white space
        self.words_of = _matcher(split["pattern"]["Regex"])
        #: results of fits, by a << 20 | b
        self.fit = Memo(lambda k: self.fits(k >> 20, k & 0xFFFFF), 1_000_000)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves token a followed by token b as they are.

        Both derivations are undone from the last merge to the first; at each
        time one pair of pieces touches at the seam.  If that pair has a merge
        that comes before the one that takes either piece, a and b don't stay.
        Of equal merges the left one comes first.
        """
        never = 1 << 60
        a_taken = b_taken = never
        rank, merge = self.rank, self.merge
        while True:
            r = merge.get((a, b))
            if r is not None and r < a_taken and r <= b_taken:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a_taken, a = ra, self.right[a]
            else:
                b_taken, b = rb, self.left[b]

    def pieces(self, text: str) -> list[str]:
        """Texts between special tokens at even places, special tokens at odd ones."""
        return self._special.split(text) if self._special and "<|" in text else [text]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, lower-cased, cut by the file's pattern."""
        return self.words_of(normalised(text))

    def runs(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(whether these are special tokens, words) over a whole text; a long text comes in slices, cut before white space."""
        for i, piece in enumerate(self.pieces(text)):
            if i % 2:
                yield True, [piece]
                continue
            at = 0
            while at < len(piece):
                gap = _BLANK(piece, at + SLICE) if len(piece) - at > SLICE else None
                to = gap.start() if gap else len(piece)
                yield False, self.words(piece[at:to])
                at = to


def normalised(text: str) -> str:
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _BEYOND(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            text = _lower_new(text)
        text = text.replace("Σ", "σ")  # no special final form
    return text.lower()


_BLANK = re.compile(r"[ \t\r\n]").search
_BEYOND = regex.compile("[\u0558-\U0010ffff]").search


def _ranges(chars: Iterable[str]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _matcher(pattern: str):
    """findall of a pattern of letters, numbers and white space, with the classes of the pattern's own engine spelled out.

    The engine is asked about characters that this Python doesn't know; it may know fewer than ``regex``.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    asked = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    known = {c for c, _ in Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(asked))}
    new = set(asked) - known
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(f"[{name}]", name)
    found = {name: [c for c in regex.findall(name, every) if c not in new] for name in (r"\p{L}", r"\p{N}", r"\s")}

    def spelled(last: str):
        letters, numbers, blanks = (_ranges(c for c in chars if c <= last) for chars in found.values())
        text = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        if r"\p" in text or r"\s" in text:
            raise ValueError("the vocabulary's pattern has classes that aren't known here")
        return re.compile(text).findall

    # classes beyond the first plane are looked through one range after the other
    first_plane, all_planes = spelled("\uffff"), spelled("\U0010ffff")
    return lambda text: (all_planes if _ASTRAL(text) else first_plane)(text)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search


def _lower_new(text: str) -> str:
    """Lower-casing by the library, whose tables are newer."""
    from tokenizers.normalizers import Lowercase

    return Lowercase().normalize_str(text)


class Memo(dict):
    """A function's results; the half used least lately goes when there are ``most``."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
