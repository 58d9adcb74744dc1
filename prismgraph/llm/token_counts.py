"""Op 5: exact token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch stand in one flat array of symbols. In each round every sequence merges all
occurrences of its lowest-ranked pair at once (from the left, without overlap); sequences without a pair to merge
leave. A merge makes pairs of higher rank only, so this is the order in which the library merges. What remains is
counted, per distinct piece, and summed per text through a bounded cache. A piece of n symbols takes up to n rounds, so
those above LONG are merged rank by rank over linked arrays instead, where a round touches the places of one rank alone:
their work grows with the merges made, not with symbols times rounds.

Edge cases: a null or empty text has 0 tokens; strings of added tokens count 1, as the library takes them by default;
texts and unbroken runs of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .tokens import _COARSE, _FINE, _STRANGE, CACHE_CHARS, CACHE_UNITS, byte_letters, in_chunks

#: Symbols of a piece above which it is merged rank by rank.
LONG = 512

#: The pre-tokenizer's pattern of byte-level BPE, a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        size = self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.bytes = np.array([vocab[x] for x in byte_letters()], dtype=np.int64)
        self.pattern = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cache: dict[str, int] = {}

    def symbols(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        out = np.zeros(len(pieces), dtype=np.int64)
        long = np.array([len(p) > LONG for p in pieces], dtype=bool)
        for some, merged in ((np.flatnonzero(~long), self.by_round), (np.flatnonzero(long), self.by_rank)):
            if len(some):
                out[some] = merged([pieces[i] for i in some])
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def by_rank(self, pieces: list[bytes]) -> np.ndarray:
        """All places of one rank at a time, from the lowest; symbols are linked to their neighbours by position."""
        none = len(self.ranks)
        left = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n, ends = len(ids), np.cumsum(left)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), left)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends - left] = -1
        rank = np.append(self.rank_of(ids[:-1], ids[1:]), none)
        rank[after < 0] = none
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, some in zip(r[np.append(0, cuts)].tolist() if len(r) else (), np.split(at, cuts), strict=len(r) > 0):
                if k not in places:
                    heapq.heappush(waiting, k)
                places.setdefault(k, []).append(some)

        put(np.arange(n))
        while waiting:
            k = heapq.heappop(waiting)
            some = places.pop(k)
            at = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            at = at[rank[at] == k]
            if not len(at):
                continue
            right = after[at]
            chained = np.append(False, right[:-1] == at[1:])
            if chained.any():  # of a run of overlapping places every other one counts, from the left
                i = np.arange(len(at))
                odd = (i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 1
                at, right = at[~odd], right[~odd]
            ids[at] = self.made[k]
            rank[right] = none
            then = after[right]
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            left -= np.bincount(piece[at], minlength=len(left))
            prior = before[at]
            changed = np.unique(np.concatenate([at, prior[prior >= 0]]))
            then = after[changed]
            rank[changed] = np.where(then >= 0, self.rank_of(ids[changed], ids[then]), none)
            put(changed)
        return left

    def by_round(self, pieces: list[bytes]) -> np.ndarray:
        """The lowest rank of every sequence in each round."""
        none = len(self.ranks)
        left = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), left)
        while len(ids) > 1:
            rank = np.where(seq[:-1] == seq[1:], self.rank_of(ids[:-1], ids[1:]), none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lengths = np.diff(np.append(starts, len(seq)))
            least = np.minimum.reduceat(rank, starts)
            low = np.repeat(least, lengths)
            hit = np.flatnonzero((rank == low) & (low < none))
            if not len(hit):
                break
            # of a run of overlapping hits every other one counts, from the left
            fresh = np.append(True, np.diff(hit) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            left -= np.bincount(seq[hit], minlength=len(left))
            ids[hit] = self.made[rank[hit]]
            keep = np.repeat(least < none, lengths)
            keep[hit + 1] = False
            ids, seq = ids[keep], seq[keep]
        return left

    def learn(self, units: list[str]) -> dict[str, int]:
        pieces = [self.pattern.findall(u) for u in units]
        distinct = sorted({p for some in pieces for p in some})
        counts: dict[str, int] = {}
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            counts |= dict(zip(some, self.symbols([p.encode() for p in some]).tolist(), strict=True))
        return {u: sum(map(counts.__getitem__, some)) for u, some in zip(units, pieces, strict=True)}

    def count(self, texts: list[str]) -> list[int]:
        extra, cut = [], []
        for t in texts:
            parts = [t]
            if self.special and self.special.search(t):
                parts = self.special.split(t)
            extra.append(len(parts) - 1)
            units: list[str] = []
            for p in parts:
                units += self.pattern.findall(p) if _STRANGE.search(p) else (_COARSE if "'" in p else _FINE).findall(p)
            cut.append(units)
        if len(self.cache) > CACHE_UNITS:
            self.cache = dict(islice(self.cache.items(), CACHE_UNITS // 2))
        cache = self.cache
        new = set().union(*cut).difference(cache)
        cache.update(self.learn(list(new)))
        out = [n + sum(map(cache.__getitem__, units)) for n, units in zip(extra, cut, strict=True)]
        for u in new:
            if len(u) > CACHE_CHARS:
                del cache[u]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no shuffle."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [n for part in in_chunks(texts) for n in counter(tokenizer).count(texts[part])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
