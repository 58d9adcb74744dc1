"""Op 10: n-gram Jaccard join with adaptive multi-match prefixes.

1. Equal texts become one (the smallest id stands for them); from here on texts are distinct.
2. Shingles are hashed to 56 bits, whatever the number of partitions, and sent to buckets (equal ranges of the hashes)
   as packed arrays. A bucket counts in how many texts each occurs and sends back those that occur twice or more. What
   occurs once cannot be shared, so a text of which less than the threshold's share comes back links with nothing.
   Shingles of many texts of one part are counted there: the bucket gets one count instead of their texts.
3. The order is by frequency, rarest first. A prefix of |x| - t + l shingles must share l of them with every text
   that reaches the threshold (t: least overlap). Each text takes the l in 1..MAX_MATCH of least estimated cost:
   the lists it would be read from, and the candidates that would be left to verify.
4. Candidate pairs come from the lists of shared prefix shingles: all pairs of a short list, counted over all lists
   against the smaller l; a long list links neighbours in size to a leader, which connects at least as much. So the
   connected parts of candidates hold every link, and no list is ever expanded into its pairs. Lists lie in ranges of
   (shingle, size, text), so one of any length is spread; what a range knows of its first and last list, a second pass
   puts together.
5. Each part is verified exactly: as a whole, or in blocks of size classes, then one text of each component that a block
   has found against others of them (copies of one text mostly meet here), then pairs of rows of blocks; those whose
   texts are all connected by then are left out, as they cannot change a component. A task returns a spanning forest only.

Edge cases: a text with fewer words than a shingle is one shingle of all its words; null, empty or wordless texts have
no shingles and link with nothing, not even with each other; rows that share an id count as one document; rows with
a null id are returned with a null component; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lower_ascii, parts, released, store
from .components import components

#: Bytes of a shingle's identity, the high ones of its 64-bit hash.
WIDTH = 7
MAX_MATCH = 4
#: A list of more members gives a leader's star instead of its pairs.
SHORT_LIST = 48
#: Texts that are verified together, and their shingles; and blocks of a size class that meet those of others together.
BLOCK, BLOCK_SHINGLES, BLOCKS = 200, 500_000, 8
#: Shingles of a part, and texts of it that share a shingle before it is counted there.
PART, FREQUENT = 6_000_000, 64

_SPLIT = re.compile(f"[{SPACE_CHARS}]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of each word, kept for LARGEST words of a worker."""

    LARGEST = 250_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.LARGEST:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return v


def words_of(text: str) -> list[str]:
    """Runs of anything but space and the controls tab to carriage return; text must be lower-cased already."""
    if text.isascii() and not re.search("[\x1c-\x1f]", text):
        return text.split()
    return [w for w in _SPLIT.split(text) if w]


def shingles(text: str, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    k = min(n, width)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _MULTIPLIERS[i % 5]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def partition_keys(n: int) -> list[int]:
    """For each of n partitions an integer that Spark's hash partitioning sends there: Murmur3 of an int, seed 42."""

    def murmur(x: int) -> int:
        rot = lambda v, r: ((v << r) | (v >> (32 - r))) & 0xFFFFFFFF
        k = rot(x * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rot(42 ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 4
        h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    keys: dict[int, int] = {}
    i = 0
    while len(keys) < n:
        keys.setdefault(murmur(i) % n, i)
        i += 1
    return [keys[p] for p in range(n)]


def planes(a: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of integers, all lowest bytes first: high bytes that are mostly equal compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


_PACKED = pa.schema([("key", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_PACKED_SQL = "key int, bucket int, part int, n int, a binary, b binary, c binary"


#: Values of `bucket` in rows that pass a bucket by: the texts of a part, and the texts of its frequent shingles.
HEADS, FREQUENTS = -1, -2
#: Stands for all texts of a part in a count, and in the answer to it.
EVERY = (1 << 32) - 1


def bucket_of(ident: np.ndarray, buckets: int) -> np.ndarray:
    return ((ident >> np.uint64(8 * WIDTH - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _scatter(width: int, buckets: int):
    """Texts -> packed (shingles, text numbers) for each bucket, and the texts' own (id, key, size) on the way through."""
    keys = partition_keys(buckets)

    def pack(part: int, hashes: list[np.ndarray], heads: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x) for x in hashes]
        ident = np.concatenate(hashes) >> np.uint64(64 - 8 * WIDTH)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        order = np.argsort(ident, kind="stable")
        ident, owner = ident[order], owner[order]
        first = np.append(True, (ident[1:] != ident[:-1]) | (owner[1:] != owner[:-1]))
        ident, owner = ident[first], owner[first]
        own = np.bincount(owner, minlength=len(sizes))  # less than the size where hashes fell together
        starts = np.flatnonzero(np.append(True, ident[1:] != ident[:-1])) if len(ident) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(ident)))
        often = np.repeat(counts >= FREQUENT, counts)
        there = part % buckets
        rows = [(keys[there], HEADS, part, len(heads), np.array([(i, *h, int(own[i])) for i, h in enumerate(heads)], dtype=np.int64).tobytes(), b"", b"")]
        if often.any():
            rows.append((keys[there], FREQUENTS, part, int(often.sum()), planes(ident[often], WIDTH), planes(owner[often], 4), b""))
        many = counts >= FREQUENT
        for who, known, weight in ((owner[~often], ident[~often], None), (None, ident[starts[many]] if len(starts) else ident, counts[many])):
            ends = np.searchsorted(bucket_of(known, buckets), np.arange(buckets + 1))
            for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if j > i:
                    rows.append((keys[b], b, part, j - i, planes(known[i:j], WIDTH), b"" if who is None else planes(who[i:j], 4), b"" if weight is None else planes(weight[i:j], 4)))
        return _rows(rows)

    def run(batches):
        from pyspark import TaskContext

        part, flushed, total = TaskContext.get().partitionId(), 0, 0
        memo = WordHashes()
        hashes: list[np.ndarray] = []
        heads: list[tuple] = []
        for batch in batches:
            for rep, k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                u = shingles(text, width, memo)
                hashes.append(u)
                heads.append((rep, k1, k2, len(u)))
                total += len(u)
                if total > PART:
                    yield pack(part + (flushed << 20), hashes, heads)
                    hashes, heads, total, flushed = [], [], 0, flushed + 1
        if heads:
            yield pack(part + (flushed << 20), hashes, heads)

    return run


def _count(buckets: int):
    """Per bucket: shingles of two texts or more, sent back to the part of each text with a code of their frequency."""
    keys = partition_keys(buckets)

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    yield pa.RecordBatch.from_pylist([r | {"key": keys[r["part"] % buckets]}], schema=_PACKED)
                else:
                    held.setdefault(r["bucket"], []).append(r)
        for bucket in sorted(held):
            rows = held.pop(bucket)
            ident = np.concatenate([unplanes(r["a"], WIDTH, r["n"]) for r in rows])
            owner = np.concatenate([unplanes(r["b"], 4, r["n"]).astype(np.uint32) if r["b"] else np.full(r["n"], EVERY, np.uint32) for r in rows])
            weight = np.concatenate([unplanes(r["c"], 4, r["n"]).astype(np.uint32) if r["c"] else np.ones(r["n"], np.uint32) for r in rows])
            part = np.repeat(np.array([r["part"] for r in rows], np.int32), [r["n"] for r in rows])
            del rows
            order = np.argsort(ident, kind="stable")
            ident, owner, part, weight = ident[order], owner[order], part[order], weight[order]
            starts = np.flatnonzero(np.append(True, ident[1:] != ident[:-1]))
            df = np.repeat(np.add.reduceat(weight.astype(np.int64), starts), np.diff(np.append(starts, len(ident))))
            keep = df > 1
            ident, owner, part = ident[keep], owner[keep], part[keep]
            code = np.minimum(np.ceil(8 * np.log2(df[keep])), 255).astype(np.uint8)
            order = np.argsort(part, kind="stable")
            ident, owner, part, code = ident[order], owner[order], part[order], code[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            out = [(keys[int(part[i]) % buckets], bucket, int(part[i]), int(j - i), planes(ident[i:j], WIDTH), planes(owner[i:j], 4), code[i:j].tobytes()) for i, j in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]
            if out:
                yield _rows(out)

    return run


def _gather(num: int, den: int):
    """Per part (its rows follow each other): each text with its shared shingles in the global order, kept where they can reach the threshold."""
    schema = pa.schema([("rep", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int64()), ("own", pa.int64()), ("tokens", pa.binary()), ("codes", pa.binary())])

    def close(rows):
        heads = np.concatenate([np.frombuffer(r["a"], dtype=np.int64).reshape(-1, 6) for r in rows if r["bucket"] == HEADS])
        often = [r for r in rows if r["bucket"] == FREQUENTS]
        rows = [r for r in rows if r["bucket"] >= 0]
        token = np.concatenate([unplanes(r["a"], WIDTH, r["n"]) for r in rows] or [np.empty(0, np.uint64)])
        owner = np.concatenate([unplanes(r["b"], 4, r["n"]).astype(np.uint32) for r in rows] or [np.empty(0, np.uint32)])
        code = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in rows] or [np.empty(0, np.uint8)])
        if often:  # every frequent shingle has its answer, as it occurs twice at least
            every = owner == EVERY
            known = np.argsort(token[every])
            ident, who = (np.concatenate([unplanes(r[c], w, r["n"]) for r in often]) for c, w in (("a", WIDTH), ("b", 4)))
            at = known[np.searchsorted(token[every][known], ident)]
            token, owner, code = np.concatenate([token[~every], ident]), np.concatenate([owner[~every], who.astype(np.uint32)]), np.concatenate([code[~every], code[every][at]])
        order = np.lexsort((token, code, owner))
        token, owner, code = token[order], owner[order], code[order]
        number = heads[:, 0].astype(np.uint32)
        i, j = np.searchsorted(owner, number, "left"), np.searchsorted(owner, number, "right")
        least = -(-num * heads[:, 4] // den) - (heads[:, 4] - heads[:, 5])
        alive = (j - i >= least) & (heads[:, 4] > 0)
        for lo in range(0, len(heads), 2000):
            hi = min(lo + 2000, len(heads))
            tokens = [token[a:b].astype("<u8").tobytes() if ok else None for a, b, ok in zip(i[lo:hi], j[lo:hi], alive[lo:hi], strict=True)]
            codes = [code[a:b].tobytes() if ok else None for a, b, ok in zip(i[lo:hi], j[lo:hi], alive[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(heads[lo:hi, c]) for c in range(1, 6)), pa.array(tokens, pa.binary()), pa.array(codes, pa.binary())], schema=schema)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["part"] != r["part"]:
                    yield from close(held)
                    held = []
                held.append(r)
        if held:
            yield from close(held)

    return run


def _prefixes(num: int, den: int):
    """Postings of each text's prefix: token, rep, size, match (shared prefix shingles that a partner must have)."""

    def run(batches):
        for batch in batches:
            out = []
            for rep, size, own, tokens, codes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                t = np.frombuffer(tokens, dtype="<u8")
                df = np.exp2(np.frombuffer(codes, dtype=np.uint8) / 8.0)
                least = -(-num * size // den) - (size - own)
                base = own - least - (own - len(t))  # shared shingles in the prefix, less the number of matches
                best, match = None, 1
                for m in range(1, min(MAX_MATCH, max(1, least)) + 1):
                    lists = float(df[: max(0, base + m)].sum())
                    cost = lists + lists / m**2 * 4
                    if best is None or cost < best:
                        best, match = cost, m
                some = t[: max(0, base + match)]
                if len(some):
                    out.append((some.astype(np.int64), np.full(len(some), rep), np.full(len(some), size), np.full(len(some), match, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "rep", "size", "match"])

    return run


class _Lists:
    """Pairs (u, v, need, met) from sorted postings. Members ascend in size, so a gap ends what a leader can stand for."""

    def __init__(self, num: int, den: int, whole: bool):
        self.num, self.den, self.whole = num, den, whole
        self.found: list[tuple[np.ndarray, ...]] = []
        self.edge: list[tuple[np.ndarray, ...]] = []
        self.open: tuple[np.ndarray, ...] | None = None  # of the open list: its members while it is short, else the last
        self.long = self.first = False
        self.leader = 0

    def put(self, u, v, need) -> None:
        if len(u):
            self.found.append((u, v, need, np.where(need < 0, MAX_MATCH, 1)))

    def star(self, rep: np.ndarray, size: np.ndarray, leader: int | None = None) -> int:
        """Members go to the leader before them; with one given, the first member follows it already. Gives the last leader."""
        at = np.arange(len(rep))
        new = np.append(leader is None, size[:-1] * self.den < self.num * size[1:])
        lead = np.maximum.accumulate(np.where(new, at, -1))
        to = np.where(lead < 0, leader or 0, rep[lead])
        member = ~new
        if leader is not None:
            member[0] = False  # it is the last member that was seen before
        self.put(to[member], rep[member], np.full(int(member.sum()), -1))
        return int(to[-1])

    def lists(self, t, rep, size, match) -> None:
        """Whole lists."""
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        n = np.diff(np.append(starts, len(t)))
        long = (n > SHORT_LIST) | (np.minimum.reduceat(match, starts) == 0)
        for i, k in zip(starts[long], n[long], strict=True):
            self.star(rep[i : i + k], size[i : i + k])
        some = np.repeat(~long & (n > 1), n)
        t, rep, size, match = t[some], rep[some], size[some], match[some]
        for d in range(1, SHORT_LIST):
            i = np.flatnonzero((t[d:] == t[:-d]) & (size[:-d] * self.den >= self.num * size[d:]))
            if not len(i):
                if d >= len(t) or not (t[d:] == t[:-d]).any():
                    break
                continue
            self.put(rep[i], rep[i + d], np.minimum(match[i], match[i + d]))

    def add(self, t, rep, size, match) -> None:
        """More members of the open list."""
        if self.open is None:
            self.open = (t, rep, size, match)
        elif not self.long:
            self.open = tuple(np.concatenate(x) for x in zip(self.open, (t, rep, size, match), strict=True))
        if not self.long and (len(self.open[0]) > SHORT_LIST or (self.open[3] == 0).any()):
            self.long, (t, rep, size, match) = True, self.open
            self.leader = self.star(rep, size)
            self.limit(t, rep, size, 0)
        elif self.long:
            _, last_rep, last_size, _ = self.open
            self.leader = self.star(np.append(last_rep, rep), np.append(last_size, size), self.leader)
        if self.long:
            self.open = (t[-1:], rep[-1:], size[-1:], match[-1:])

    def limit(self, t, rep, size, i) -> None:
        """A member at an end of this range's part of a long list."""
        if not self.whole:
            self.edge.append((t[[i]], rep[[i]], size[[i]], np.zeros(1, dtype=np.int64)))

    def close(self, last: bool) -> None:
        if self.open is None:
            return
        if self.long:
            self.limit(*self.open[:3], 0)
        elif self.whole or not (self.first or last):
            self.lists(*self.open)
        else:
            self.edge.append(self.open)
        self.open, self.long, self.first = None, False, False

    def take(self) -> pa.RecordBatch | None:
        """What was found, and the members of lists at the range's ends (token not null)."""
        if not self.found and not self.edge:
            return None
        u, v, need, met = (np.concatenate([x[c] for x in self.found] or [np.empty(0, np.int64)]) for c in range(4))
        t, rep, size, match = (np.concatenate([x[c] for x in self.edge] or [np.empty(0, np.int64)]) for c in range(4))
        self.found, self.edge = [], []
        token = pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(t, pa.int64())])
        cols = ((u, rep), (v, size), (np.where(need < 0, 1, need), match), (met, np.zeros(len(t), np.int64)))
        return pa.RecordBatch.from_arrays([token, *(pa.array(np.concatenate(x).astype(np.int64)) for x in cols)], names=["token", "u", "v", "need", "met"])


_PAIRS_SQL = "token long, u long, v long, need long, met long"


def _candidates(num: int, den: int, whole: bool):
    """Postings sorted by (token, size, rep) -> pairs; unless the lists are whole here, members of the first and last list of the range too."""

    def run(batches):
        x = _Lists(num, den, whole)
        begun = False
        for batch in batches:
            t, rep, size, match = (batch.column(c).to_numpy().astype(np.int64) for c in ("token", "rep", "size", "match"))
            if not len(t):
                continue
            ends = np.flatnonzero(t[1:] != t[:-1]) + 1
            done = 0
            if not begun:
                begun = x.first = True
            elif x.open is not None and x.open[0][0] != t[0]:
                x.close(False)
            if x.open is not None or x.first:  # the list that goes on, or the range's first
                done = int(ends[0]) if len(ends) else len(t)
                x.add(t[:done], rep[:done], size[:done], match[:done])
                if done < len(t):
                    x.close(False)
            if done < len(t):
                last = int(ends[-1])
                if last > done:
                    x.lists(t[done:last], rep[done:last], size[done:last], match[done:last])
                x.add(t[last:], rep[last:], size[last:], match[last:])
            if out := x.take():
                yield out
        x.close(True)
        if out := x.take():
            yield out

    return run


def _verify(num: int, den: int):
    """All texts of one task -> a spanning forest of their links. Texts of one label count as connected."""

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("rep").to_numpy(), t.column("size").to_numpy()))
        t = t.take(pa.array(order))
        rep, size, label = (t.column(c).to_numpy() for c in ("rep", "size", "label"))
        label = np.unique(label, return_inverse=True)[1]
        sets = [np.frombuffer(x, dtype="<u8") for x in t.column("tokens").to_pylist()]
        n = len(sets)
        length = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), length)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(token, np.cumsum(length)[:-1])
        order = np.argsort(token, kind="stable")
        holders = owner[order]
        starts = np.searchsorted(token[order], np.arange(token.max() + 2 if n else 1))
        links = []
        for x in range(n):
            other = np.flatnonzero(label != label[x])
            near = other[(other < x) & (size[other] * den >= num * size[x])] if len(other) else other
            if not len(near):
                continue
            if len(near) <= 16:
                shared = np.array([len(np.intersect1d(own[x], own[y], assume_unique=True)) for y in near])
            else:
                lists = [holders[starts[k] : starts[k + 1]] for k in own[x]]
                shared = np.bincount(np.concatenate(lists), minlength=n)[near]
            for y in near[(den * shared >= num * (size[x] + size[near] - shared)) & (shared > 0)]:
                if label[y] != label[x]:
                    links.append((rep[y], rep[x]))
                    label[label == label[y]] = label[x]
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def link_texts(texts: DataFrame, width: int = 5, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """texts (rep, k1, k2, text), distinct -> (rep, k1, k2, size) of all, and a spanning forest (u, v) of the links."""
    spark = texts.sparkSession
    n = parts(spark)
    packed = texts.sortWithinPartitions("rep", "k1").mapInArrow(released(_scatter(width, n)), _PACKED_SQL)
    counted = packed.repartition(n, "key").mapInArrow(released(_count(n)), _PACKED_SQL)
    gathered = counted.repartition(n, "key").sortWithinPartitions("part").mapInArrow(released(_gather(num, den)), "rep long, k1 long, k2 long, size long, own long, tokens binary, codes binary")
    every = store(gathered, "jaccard-texts", codec="lz4")
    alive = every.where("tokens is not null and rep is not null")

    postings = alive.select("rep", "size", "own", "tokens", "codes").mapInArrow(released(_prefixes(num, den)), "token long, rep long, size long, match int")
    ranged = postings.repartitionByRange(n, "token", "size", "rep").sortWithinPartitions("token", "size", "rep")
    pairs = store(ranged.mapInArrow(released(_candidates(num, den, False)), _PAIRS_SQL), "jaccard-pairs")
    # at most twice SHORT_LIST members a range
    limits = pairs.where("token is not null").select("token", F.col("u").alias("rep"), F.col("v").alias("size"), F.col("need").alias("match"))
    joined = limits.repartition(n, "token").sortWithinPartitions("token", "size", "rep").mapInArrow(_candidates(num, den, True), _PAIRS_SQL)
    pairs = pairs.where("token is null").unionByName(joined)
    edges = pairs.groupBy("u", "v").agg(F.min("need").alias("need"), F.sum("met").alias("met")).where("met >= need").select("u", "v")
    groups = components(edges, "jaccard-candidates").withColumnsRenamed({"node": "rep", "label": "comp"})

    # blocks: a part as a whole, or its size classes (factor den/num, so links stay within a class or its neighbour)
    classed = store(alive.select("rep", "size").join(groups, "rep").withColumn("class", F.floor(F.log("size") / F.log(F.lit(den / num)) + 1e-9).cast("int")), "jaccard-groups")
    counts = classed.groupBy("comp", "class").agg(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES).alias("blocks")).withColumn("salts", F.ceil("blocks").cast("int"))
    large = counts.groupBy("comp").agg((F.sum("blocks") > 1).alias("large"))
    counts = counts.join(large, "comp").select("comp", "class", "salts", "large")
    placed = classed.join(counts, ["comp", "class"])
    salt = F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")
    block = F.when(F.col("large"), F.struct("class", salt.alias("salt"))).otherwise(F.struct(F.lit(-1).alias("class"), F.lit(0).alias("salt")))
    placed = store(placed.select("comp", "rep", "size", "large", block.alias("block")), "jaccard-blocks")
    sets = alive.select("rep", "size", "tokens")
    schema = "u long, v long"
    texts_of = lambda rows: rows.select("comp", "block", "rep", "label").join(sets, "rep")
    whole = texts_of(placed.withColumn("label", F.col("rep")))
    links = store(whole.groupBy("comp", "block").applyInArrow(_verify(num, den), schema), "jaccard-links")
    large_ones = placed.where("large")
    if not large_ones.isEmpty():
        def labelled(links: DataFrame, name: str) -> DataFrame:
            known = components(links, name).withColumnsRenamed({"node": "rep"})
            return store(large_ones.join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep")), name)

        # the smallest text of each component of a block, against others of its part
        now = labelled(links, "jaccard-known")
        heads = now.groupBy("comp", "block", "label").agg(F.min(F.struct("rep", "size")).alias("r")).select("comp", "label", "r.*")
        sizes = heads.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n"))
        dealt = heads.join(sizes, "comp").withColumn("block", F.struct(F.lit(-1).alias("class"), F.pmod(F.xxhash64("rep"), F.col("n")).cast("int").alias("salt")))
        links = links.unionByName(store(texts_of(dealt).groupBy("comp", "block").applyInArrow(_verify(num, den), schema), "jaccard-heads"))
        # rows of blocks, each with itself and with those of its class and the next, unless one component holds both
        row = F.struct("block.class", F.floor(F.col("block.salt") / BLOCKS).cast("int").alias("salt"))
        now = labelled(links, "jaccard-labelled").withColumn("block", row)
        span = now.groupBy("comp", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        a, b = (span.withColumnsRenamed({"block": x, "lo": f"lo{x}", "hi": f"hi{x}"}) for x in ("x", "y"))
        pairs = a.join(b, "comp").where("x <= y and y.class - x.class <= 1").where("not (lox = hix and loy = hiy and lox = loy)").select("comp", "x", "y")
        sides = pairs.select("comp", F.col("x").alias("block"), "x", "y").unionByName(pairs.where("x < y").select("comp", F.col("y").alias("block"), "x", "y"))
        more = now.select("comp", "block", "rep", "label").join(sides, ["comp", "block"]).join(sets, "rep")
        links = links.unionByName(store(more.groupBy("comp", "x", "y").applyInArrow(_verify(num, den), schema), "jaccard-cross"))
    return every.select("rep", "k1", "k2", "size"), links


def join_documents(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: links are Jaccard similarities of num/den or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_ascii(text).alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64("text", F.lit("second")))
    members = store(rows.select("doc_id", "k1", "k2"), "jaccard-members")
    texts = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text")).select("rep", "k1", "k2", "text")
    sizes, links = link_texts(texts.where("rep is not null"), width, num, den)
    labels = components(links, "jaccard-labels").withColumnsRenamed({"node": "rep"})
    found = sizes.join(labels, "rep", "left").select("k1", "k2", F.col("size").alias("n_shingles"), F.coalesce("label", "rep").alias("component"))
    joined = members.join(found, ["k1", "k2"], "left")
    component = F.when(F.coalesce("n_shingles", F.lit(0)) == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return joined.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), component.alias("component_id"))
