"""Op 6: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens, its documents in ascending order of the id. Each window of W tokens is filled by
one round: each queue earns its share of the window as credit, gives as many whole tokens as its credit holds, and
carries the rest as deficit into the next window; slots that are left go to the largest deficits. A round's table
repeats after CYCLE windows, so the state before any window follows by arithmetic: partitions far apart carry the same
deficits without talking to each other. Where a queue runs dry within a round, that window is dealt alone and the next
phase begins with the queues that are left. Without targets the shares are those of the remaining tokens, so all queues
end together. More than max_queues sources form a tree of at most so many children a node: each node deals its children
by such rounds into a stream that is one queue of the node above, so small sources are spread over all windows as well.
A round of a node deals what its sources have of a window, or a token for each child where that is more.

Tokens are never moved between partitions: a document's place in its queue gives the windows its tokens lie in.

Edge cases: a null or empty text has the end id alone; a null source is a queue of its own; sources
named in targets hang at the root, however many; rows that share an id are kept; an empty table gives no pieces. A window's last
slots stay empty only in the very last window, or in none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, parts, released, store
from .tokens import encoder, in_chunks

CYCLE = 256
#: Windows whose tables are in memory at once.
AT_ONCE = 8192


@cache
def rounds(credits: tuple[int, ...], cycle: int, window: int) -> np.ndarray:
    """Tokens that each queue has given before each window of a cycle, [cycle + 1, queues].

    credits: what each queue earns in a window, in 1/cycle of a token; they sum to window * cycle.
    """
    earn = np.array(credits, dtype=np.int64)
    deficit = np.zeros(len(earn), dtype=np.int64)
    out = np.zeros((cycle + 1, len(earn)), dtype=np.int64)
    for w in range(cycle):
        deficit += earn
        give = np.maximum(deficit // cycle, 0)
        deficit -= give * cycle
        left = window - int(give.sum())
        order = np.argsort(-deficit, kind="stable")
        if left < 0:  # queues in debt gave nothing, so the others take back what is too much
            order = order[::-1]
            order = order[give[order] > 0]
        while left:
            some = order[: abs(left)]
            step = 1 if left > 0 else -1
            give[some] += step
            deficit[some] -= step * cycle
            left -= step * len(some)
            order = order if step > 0 else order[give[order] > 0]
        out[w + 1] = out[w] + give
    return out


@dataclass(frozen=True)
class Phase:
    first: int  # window
    count: int
    base: tuple[int, ...]  # given by each queue before the phase
    credits: tuple[int, ...]
    cycle: int

    def table(self, window: int) -> np.ndarray:
        if self.cycle == 1:
            return np.array([[0] * len(self.credits), self.credits], dtype=np.int64)
        return rounds(self.credits, self.cycle, window)


def plan(totals: list[int], window: int, targets: list[float] | None = None) -> list[Phase]:
    """The phases that give all tokens of all queues. Its size depends on the number of queues alone."""
    left = list(totals)
    out: list[Phase] = []
    first = 0
    while sum(left) > 0:
        base = tuple(t - x for t, x in zip(totals, left, strict=True))
        weights = [(targets[i] if targets else x) if x else 0 for i, x in enumerate(left)]
        if not sum(weights):
            weights = [float(x > 0) for x in left]
        whole = sum(weights)
        credits = [int(window * CYCLE * w / whole) for w in weights]
        for i in sorted(range(len(left)), key=lambda i: -weights[i])[: window * CYCLE - sum(credits)]:
            credits[i] += 1
        table = rounds(tuple(credits), CYCLE, window)
        per = table[-1]
        count = min((x // int(p) for x, p in zip(left, per, strict=True) if p), default=0) * CYCLE
        rest = np.array(left) - count // CYCLE * per
        fits = (table <= rest).all(axis=1)
        count += int(np.flatnonzero(fits)[-1]) if fits.any() else 0
        if count:
            out.append(Phase(first, count, base, tuple(credits), CYCLE))
            given = count // CYCLE * per + table[count % CYCLE]
            left = [x - int(g) for x, g in zip(left, given, strict=True)]
            first += count
            base = tuple(t - x for t, x in zip(totals, left, strict=True))
        if sum(left):  # a window that some queue cannot fill as planned: what it lacks comes from the largest others
            give = [min(x, int(q)) for x, q in zip(left, table[1], strict=True)]
            for i in sorted(range(len(left)), key=lambda i: -(left[i] - give[i])):
                give[i] += min(left[i] - give[i], window - sum(give))
            out.append(Phase(first, 1, base, tuple(give), 1))
            left = [x - g for x, g in zip(left, give, strict=True)]
            first += 1
    return out


class Schedule:
    def __init__(self, phases: list[Phase], window: int):
        self.phases, self.window = phases, window
        self.first = np.array([p.first for p in phases])
        self.base = np.array([p.base for p in phases]).reshape(len(phases), len(phases[0].base) if phases else 0)

    def given(self, w: np.ndarray) -> np.ndarray:
        """What every queue has given before each window, [windows, queues]."""
        at = np.maximum(np.searchsorted(self.first, w, "right") - 1, 0)
        out = np.empty((len(w), self.base.shape[1]), dtype=np.int64)
        for k in np.unique(at):
            p, rows = self.phases[k], at == k
            table, n = p.table(self.window), w[rows] - p.first
            out[rows] = self.base[k] + (n // p.cycle)[:, None] * table[-1] + table[n % p.cycle]
        return out

    def window_of(self, queue: int, position: int) -> int:
        k = int(np.searchsorted(self.base[:, queue], position, "right")) - 1
        p = self.phases[k]
        table, x = p.table(self.window)[:, queue], position - int(self.base[k, queue])
        turns, rest = divmod(x, int(table[-1]))
        return p.first + turns * p.cycle + int(np.searchsorted(table, rest, "right")) - 1

    def windows_of(self, queue: int, positions: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.base[:, queue], positions, "right") - 1
        out = np.empty(len(positions), dtype=np.int64)
        for k in np.unique(at):
            p, rows = self.phases[k], at == k
            table = p.table(self.window)[:, queue]
            turns, rest = np.divmod(positions[rows] - self.base[k, queue], table[-1])
            out[rows] = p.first + turns * p.cycle + np.searchsorted(table, rest, "right") - 1
        return out

    def cut(self, queue: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces that windows cut positions start..end-1 of a queue into: their range's number, window, first position, slot and length."""
        first, last = self.windows_of(queue, start), self.windows_of(queue, end - 1)
        out = []
        lo = 0
        while lo < len(start):  # a bounded number of windows at a time, or one range
            n = np.cumsum(last[lo:] - first[lo:] + 1)
            some = slice(lo, lo + max(1, int(np.searchsorted(n, AT_ONCE, "right"))))
            count = last[some] - first[some] + 1
            number = np.repeat(np.arange(some.start, some.start + len(count)), count)
            w = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count) + first[number]
            given = self.given(w)
            taken = self.given(w + 1) - given
            a, b = np.maximum(given[:, queue], start[number]), np.minimum(given[:, queue] + taken[:, queue], end[number])
            slot = taken[:, :queue].sum(axis=1) + a - given[:, queue]
            out.append([x[b > a] for x in (number, w, a, slot, b - a)])
            lo += len(count)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Tree:
    """Schedules of nodes, and for each source the (node, queue there) from its own to the root."""

    def __init__(self, nodes: list[tuple[list[Phase], int]], paths: list[list[tuple[int, int]]]):
        self.schedules, self.paths, self.window = [Schedule(*x) for x in nodes], paths, nodes[-1][1]

    def cut(self, source: int, start: int, end: int) -> tuple[np.ndarray, ...]:
        """The pieces of positions start..end-1 of a source, in order: first positions, windows, slots and lengths."""
        at, stream, length = (np.array([x], dtype=np.int64) for x in (start, start, end - start))
        for node, queue in self.paths[source]:
            number, w, a, slot, n = self.schedules[node].cut(queue, stream, stream + length)
            at, stream, length = at[number] + a - stream[number], w * self.schedules[node].window + slot, n
        return at, stream // self.window, stream % self.window, length


def tree(amounts: list[int], window: int, targets: list[float] | None, max_queues: int, named: int = 0) -> Tree:
    """amounts: tokens of each source, those named in targets first, then from the largest to the smallest."""
    nodes: list[tuple[list[Phase], int]] = []
    whole = sum(amounts[named:])
    paths: list[list[tuple[int, int]]] = [[] for _ in amounts]

    def node(members: list[tuple[int, list[int]]], window: int, shares: list[float] | None = None) -> None:
        """Makes a node of (tokens, sources)."""
        for i, (_, sources) in enumerate(members):
            for x in sources:
                paths[x].append((len(nodes), i))
        nodes.append((plan([n for n, _ in members], window, shares), window))

    own = max(named, max_queues - 1) if len(amounts) > max(named, max_queues) else len(amounts)
    pool = [(n, [i]) for i, n in enumerate(amounts)][own:]
    while len(pool) > 1:
        groups = -(-len(pool) // max_queues)
        dealt = [pool[i::groups] for i in range(groups)]
        for members in dealt:
            node(members, max(len(members), window * sum(n for n, _ in members) // whole))
        pool = [(sum(n for n, _ in members), [x for _, some in members for x in some]) for members in dealt]
    root = [(n, [i]) for i, n in enumerate(amounts[:own])] + pool
    node(root, window, targets and [*targets[:own], *[0.0] * len(pool)])
    return Tree(nodes, paths)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, queue_col: str) -> DataFrame:
    """Stored: doc_id, queue, shard, at (tokens of the queue before it in the shard), n, ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(queue_col).cast("string").alias("queue"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange(parts(docs.sparkSession), "queue", "doc_id", "tie").sortWithinPartitions("queue", "doc_id", "tie").select("doc_id", "queue", "text")

    def run(batches):
        from pyspark import TaskContext

        shard, at, last = TaskContext.get().partitionId(), 0, object()
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            queues = b.column(1).to_pylist()
            for part in in_chunks(texts):
                raw = [ids + end for ids in enc.raw(texts[part])]
                ns, ats = [len(x) // 4 for x in raw], []
                for q, n in zip(queues[part], ns, strict=True):
                    at, last = (at, last) if q == last else (0, q)
                    ats.append(at)
                    at += n
                n = part.stop - part.start
                yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], pa.array([shard] * n, pa.int32()), pa.array(ats, pa.int64()), pa.array(ns, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "queue", "shard", "at", "n", "ids"])

    return store(rows.mapInArrow(released(run), "doc_id long, queue string, shard int, at long, n long, ids binary"), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, targets: dict[str, float] | None = None, max_queues: int = 256, payload: bool = True, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, with payload, ids.

    targets: shares of the named sources in every window while they last; others have none until those are through.
    """
    done = tokenize(docs, tokenizer, end_id, id_col, text_col, queue_col)
    totals = done.groupBy("queue").agg(F.sum("n").alias("n"))
    ranked = sorted(totals.collect(), key=lambda r: (r.queue not in (targets or {}), -r.n, r.queue is not None, r.queue or ""))  # a row per source
    names = [r.queue for r in ranked]
    shares = [float(targets.get(q, 0)) for q in names] if targets else None
    sources = tree([r.n for r in ranked], window, shares, max_queues, sum(q in (targets or {}) for q in names))
    nodes, paths = [(x.phases, x.window) for x in sources.schedules], sources.paths
    # queue numbers: a join with a row per source
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, number int")
    sizes = done.groupBy("queue", "shard").agg(F.sum("n").alias("n"))
    sizes = sizes.join(F.broadcast(numbers), sizes["queue"].eqNullSafe(numbers["queue"]), "left").select(sizes["queue"], "shard", "n", "number")
    base = offsets(sizes, "shard", "n", "base", ("number",)).drop("n")
    named = base.withColumnRenamed("queue", "q").withColumnRenamed("shard", "s")
    # a row per shard and queue: small unless there are very many sources
    named = F.broadcast(named) if len(names) <= 100_000 else named
    placed = done.join(named, done["queue"].eqNullSafe(named["q"]) & (done["shard"] == named["s"])).select("doc_id", "number", (F.col("base") + F.col("at")).alias("position"), "n", "ids")

    def run(batches):
        sources = Tree(nodes, paths)
        for b in batches:
            if not b.num_rows:
                continue
            doc, ids = b.column("doc_id"), b.column("ids")
            # the ids of documents that follow each other lie side by side in the batch
            begin = np.frombuffer(ids.buffers()[1], np.int64 if pa.types.is_large_binary(ids.type) else np.int32)[ids.offset :]
            whole = memoryview(ids.buffers()[2] or b"")
            queue, position, n = (b.column(c).to_numpy() for c in ("number", "position", "n"))
            follows = (queue[1:] == queue[:-1]) & (position[1:] == position[:-1] + n[:-1])
            bounds = np.append(np.append(0, np.flatnonzero(~follows) + 1), len(n))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # runs of documents that follow each other
                if lo == hi:
                    continue
                first, last = int(position[lo]), int(position[hi - 1] + n[hi - 1])
                at, w, slot, _ = sources.cut(int(queue[lo]), first, last)
                cuts = np.union1d(at, position[lo:hi])
                ends = np.append(cuts[1:], last)
                d = np.searchsorted(position[lo:hi], cuts, "right") - 1 + lo
                k = np.searchsorted(at, cuts, "right") - 1
                start, length = cuts - position[d], ends - cuts
                place = int(begin[lo]) + 4 * (cuts - first)
                views = [whole[x:y] for x, y in zip(place.tolist(), (place + 4 * length).tolist(), strict=True)]
                cols = [doc.take(pa.array(d)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(list(map(zlib.crc32, views)), pa.int64()), pa.array(n[d], pa.int64()), pa.array(w[k], pa.int64()), pa.array(slot[k] + cuts - at[k], pa.int64())]
                names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if payload:
                    cols, names_ = [*cols, pa.array([bytes(v) for v in views], pa.binary())], [*names_, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names_)

    return placed.mapInArrow(released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * payload)
