"""Encoding with a lower-casing word-end BPE file through its words.

Such a tokenizer (the tokenizers library's JSON, e.g. word_bpe_49k.json) drops white space, so a
text is the sequence of its pre-tokens and each pre-token is encoded by itself. The library
encodes each distinct pre-token of a worker once; texts are then put together from those. Only
texts, or for counts parts of them, whose characters, normaliser and pre-tokenizer are proven to act alike here and
in the library take this way; all others are given to the library as they are.

The proof is made when a file is loaded: the file's normaliser and pre-tokenizer must be the known
ones, and each character of the plain range, by itself and between letters, digits and marks, must
be cut here as the library cuts it. A file that fails is encoded by the library alone.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The normaliser and pre-tokenizer pattern of the file format handled here.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The plain range: Latin letters up to U+024F, without control characters that count as white space in one regular expression engine only.
_PLAIN = re.compile(r"[\t-\r -\x7e\xa0-ɏ]*")
_BLANK = re.compile(r"[ \t\n]+")
_NUMBERS = "0-9²³¹¼½¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W_{_NUMBERS}]+|[{_NUMBERS}]|(?:[^\s\w]|_)+")


class WordBpe:
    """One tokenizer file. ids(texts) and counts(texts) equal the library's, without special tokens."""

    def __init__(self, path: str, most_cached: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.most, self.cache, self.excess, self.pieces, self.rare = most_cached, {}, {}, {}, {}
        self.provable = self._known(spec) and self._same_cuts()
        self.whole = self._whole(spec["model"]) if self.provable else {}

    def _known(self, spec: dict) -> bool:
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        return [x["type"] for x in norm.get("normalizers", [])] == NORMALIZERS and split.get("pattern") == {"Regex": SPLIT} and split.get("invert") is True and split.get("behavior") == "Removed" and spec["post_processor"] is None

    def _same_cuts(self) -> bool:
        chars = [c for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c)]
        for c in chars:
            for text in (c, f"a{c}b", f"1{c}2", f"!{c}?", f"'{c}", f" {c} {c}{c}"):
                lowered = self.library.normalizer.normalize_str(text)
                theirs = [text_ for text_, _ in self.library.pre_tokenizer.pre_tokenize_str(lowered)]
                if lowered.split() != text.lower().split() or len(theirs) != len(_WORDS.findall(text.lower())):
                    return False
                if [len(x) for x in theirs] != [len(w.encode()) for w in _WORDS.findall(text.lower())]:
                    return False
        return True

    def _whole(self, model: dict) -> dict[str, int]:
        """Pre-tokens proven to encode alone as one token: each vocabulary entry that ends a word and
        spells one pre-token is encoded by the library, and is kept if that gives its own id.
        """
        from tokenizers.pre_tokenizers import ByteLevel

        letters = {x: bytes([b]) for b, x in _byte_letters().items()}
        assert set(letters) == set(ByteLevel.alphabet())
        words, ids = [], []
        for piece, number in model["vocab"].items():
            if not piece.endswith("</w>") or any(x not in letters for x in piece[:-4]):
                continue
            try:
                word = b"".join(letters[x] for x in piece[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if _PLAIN.fullmatch(word) and word == word.lower() and _WORDS.findall(word) == [word]:
                words.append(word)
                ids.append(number)
        found = self.library.encode_batch(words, add_special_tokens=False)
        return {w: i for w, i, e in zip(words, ids, found, strict=True) if e.ids == [i]}

    def plain(self, text: str) -> bool:
        return self.provable and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _merged(self, word: str) -> list[int]:
        """Ids of one pre-token, by the library's own merges."""
        found = self.pieces.get(word)
        if found is None:
            letters = word if word.isascii() else "".join(map(_byte_letters().__getitem__, word.encode()))
            found = self.pieces[word] = [t.id for t in self.library.model.tokenize(letters)]
        return found

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts without white space that are met for the first time."""
        if len(self.pieces) > self.most // 2:
            self.pieces = {}
        merged, cut = self._merged, _WORDS.findall
        collecting = gc.isenabled()
        gc.disable()  # millions of small lists without a cycle among them
        try:
            return [merged(w[0]) if len(w) == 1 else list(chain.from_iterable(map(merged, w))) for w in map(cut, chunks)]
        finally:
            if collecting:
                gc.enable()

    def _distinct(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct parts between white space, number of each part, parts of each text). No pre-token holds white space."""
        parts = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(offsets)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: its distinct parts are looked up, or encoded when first met, and put together."""
        out: list = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if self.plain(t)]
        if easy:
            parts, number, sizes = self._distinct([texts[i] for i in easy])
            rows = self._rows(parts)
            length = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            flat, start = np.frombuffer(b"".join(rows), np.uint32), np.cumsum(length) - length
            count = length[number]
            ends = np.cumsum(count)
            tokens = flat[np.arange(int(count.sum())) + np.repeat(start[number] - (ends - count), count)]
            edges = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
            for k, i in enumerate(easy):
                out[i] = tokens[edges[k] : edges[k + 1]]
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if x is None else x for t, x in zip(texts, out, strict=True)]

    def _rows(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as bytes. The parts met first, the frequent ones among them, are remembered."""
        cache = self.cache
        found = list(map(cache.get, parts))
        missing = [k for k, x in enumerate(found) if x is None]
        new = [parts[k] for k in missing]
        made = [array("I", x).tobytes() for x in self._learn(new)]
        for k, x in zip(missing, made, strict=True):
            found[k] = x
        if len(cache) < self.most:
            cache.update(zip(new, made, strict=True))
        return found

    def _count(self, chunks: list[str]) -> list[int]:
        """Tokens of texts without white space: a pre-token that is one whole token by proof counts one, the others are merged."""
        if len(self.pieces) > self.most // 2:
            self.pieces = {}
        whole, merged = self.whole, self._merged
        return [sum(1 if w in whole else len(merged(w)) for w in words) for words in map(_WORDS.findall, chunks)]

    def _rare(self, chunk: str) -> int:
        """Tokens of a text that is not plain, by the library."""
        if chunk not in self.rare:
            if len(self.rare) > self.most // 10:
                self.rare = {}
            self.rare[chunk] = len(self.library.encode(chunk, add_special_tokens=False).ids)
        return self.rare[chunk]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: what is one whole token by proof counts one without a look at the
        merges; the rest is merged once and its count remembered. In a text that is not plain
        only the parts between blanks that aren't go to the library: neither its
        normaliser nor its pre-tokens reach over a space, a tab or a line end.
        """
        if not self.provable:
            return [len(self.library.encode(t, add_special_tokens=False).ids) for t in texts]
        out, texts = [0] * len(texts), list(texts)
        for i, t in enumerate(texts):
            if not self.plain(t):
                chunks = _BLANK.split(t)
                odd = [not self.plain(c) for c in chunks]
                out[i] = sum(self._rare(c) for c, o in zip(chunks, odd, strict=True) if o)
                texts[i] = " ".join(c for c, o in zip(chunks, odd, strict=True) if not o)
        parts, number, sizes = self._distinct(texts)
        whole, excess = self.whole, self.excess
        count = np.array([1 if p in whole else excess.get(p, -1) for p in parts], np.int64)
        missing = np.flatnonzero(count < 0)
        new = [parts[k] for k in missing.tolist()]
        count[missing] = made = self._count(new)
        if len(excess) < self.most:
            excess.update(zip(new, made, strict=True))
        ends = np.r_[0, np.cumsum(count[number])]
        edges = np.r_[0, np.cumsum(sizes)]
        return (np.array(out, np.int64) + ends[edges[1:]] - ends[edges[:-1]]).tolist()


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


@lru_cache(2)
def load(path: str) -> WordBpe:
    """The tokenizer of a file, loaded once a worker."""
    return WordBpe(path)
