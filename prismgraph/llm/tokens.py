"""Exact ids of the tokenizers library, computed once per distinct unit of text.

A text is cut where the vocabulary's pre-tokenizer cuts it too: between runs of letters and digits, runs of other
signs, and white space. The library encodes each distinct unit once; a bounded cache keeps its ids. Texts for which
the cut is not provably the library's own (characters beyond the Latin blocks, separators on which regular
expression engines differ, strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: Entries of a worker's cache, and characters of the longest unit in it: some 100 MB. When full, the half that came last
#: goes: frequent units come early.
CACHE_UNITS, CACHE_CHARS = 400_000, 64

#: Outside of these characters, or with a sign that NFC or lower case may join to its neighbour, no cutting.
_STRANGE = re.compile("[^\\t\\n\\r\x20-\x7e\xa1-įı-ňŊ-ǃǍ-ǯǴ-ɏ‐-―‘-‟•…€]")
_FINE = re.compile(r" ?[^\W_]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")


_NO_SPACE = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    # tasks share their machine's cores already; threads of the library's own only cost memory and idle turns
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


class Encoder:
    """encode(texts) -> one array of 32-bit ids per text, equal to encode_batch(texts, add_special_tokens=False)."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        normalizer, before = (json.loads(x.__getstate__()) if x else {} for x in (self.library.normalizer, self.library.pre_tokenizer))
        steps = normalizer["normalizers"] if normalizer.get("type") == "Sequence" else [normalizer]
        self.lower = any(x.get("type") == "Lowercase" for x in steps)
        # a vocabulary that drops white space needs no units for it
        before = before.get("pretokenizers", [])
        self.drops = any(x.get("type") == "Split" and x["behavior"] == "Removed" and x["invert"] for x in before)
        self.model = self.library.model

    def units(self, text: str) -> list[str] | None:
        """The pieces that may be encoded alone, or None where only the whole may."""
        if _STRANGE.search(text) or any(s in text for s in self.special):
            return None
        text = text.lower() if self.lower else text
        return (_COARSE if "'" in text else _NO_SPACE if self.drops else _FINE).findall(text)

    def learn(self, units: list[str], cache: dict[str, bytes]) -> None:
        """Runs of letters are pre-tokens as they stand, once their bytes (and a space before them) are spelled in the
        vocabulary's letters, so the library's model takes them alone; all other units go through the whole library."""
        letters, tokenize = byte_letters(), self.model.tokenize
        words, rest, ids, ends = [], [], [], [0]
        for u in units:
            word = u[1:] if u[0] == " " else u
            if word.isalpha():
                spelled = word if word.isascii() else "".join([letters[b] for b in word.encode()])
                words.append(u)
                ids += [t.id for t in tokenize(spelled if word is u or self.drops else letters[32] + spelled)]
                ends.append(4 * len(ids))
            else:
                rest.append(u)
        raw = np.array(ids, dtype="<u4").tobytes()
        cache.update(zip(words, [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], strict=True))
        for unit, some in zip(rest, self.ids_of(rest), strict=True):
            cache[unit] = some

    def ids_of(self, texts: list[str]):
        """The library's ids of each text, some at a time: its encodings take far more room than their ids."""
        for part in in_chunks(texts, 200_000):
            for e in self.library.encode_batch_fast(texts[part], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(raw, dtype="<u4") for raw in self.raw(texts)]

    def raw(self, texts: list[str]) -> list[bytes]:
        """The ids as little-endian 32-bit integers."""
        if len(self.cache) > CACHE_UNITS:
            self.cache = dict(islice(self.cache.items(), CACHE_UNITS // 2))
        cache, out = self.cache, []
        whole: list[int] = []
        waiting: list[tuple] = []
        new: set[str] = set()
        for i, text in enumerate(texts):  # one text at a time: its units are gone before the next one's are made
            units = self.units(text)
            out.append(b"")
            if units is None:
                whole.append(i)
                continue
            found = list(map(cache.get, units))
            if None in found:
                gaps = [(j, units[j]) for j, ids in enumerate(found) if ids is None]
                new.update([u for _, u in gaps])
                waiting.append((i, found, gaps))
            else:
                out[i] = b"".join(found)
        self.learn(list(new), cache)
        for i, found, gaps in waiting:
            for j, u in gaps:
                found[j] = cache[u]
            out[i] = b"".join(found)
        for i, ids in zip(whole, self.ids_of([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for u in new:
            if len(u) > CACHE_CHARS:
                del cache[u]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per vocabulary and worker process."""
    return Encoder(path)


def in_chunks(texts: list[str], size: int = 2_000_000):
    """Slices of about size characters, so that a batch's ids and pieces stay small."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= size:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
