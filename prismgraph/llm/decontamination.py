"""Op 9: benchmark decontamination by templates.

Words become template tokens: numbers, units and names (capitalised words that begin no sentence, unless a window has too
many of them) give typed placeholders and keep their value as a slot; other words are lower-cased without outer punctuation. Windows of WIDTH
tokens (all tokens of a shorter item) are hashed. A fixed-size bit table of the benchmark's window hashes passes the
few windows of documents that may match; those meet the benchmark's in an equi-join. On each diagonal (offset between
document and item) each value of the item must stand for one value of the document, so that a question with other numbers
or names is caught and a text that shares a frame only by accident is not. Where a value stands for several, the pair that
holds at most of its places is kept; windows with other pairs do not count, unless their values equal the item's. Every window, of many literal words or few, is also hashed with its
values in place and met by exact equality. A document is contaminated by an item if consistent diagonals and equal windows
cover at least `share` of the item's windows, or of those with LEAST literal words. Characters of scripts that set no
spaces are words of their own.

Edge cases: null or empty texts and items match nothing; items of fewer than LEAST_WORDS words or LEAST_CHARS characters
(those of unspaced scripts count twice) are not searched for but named in a warning and by `unsearchable`; items of equal template whose equal slots lie at the same places count as the one of smallest id; documents are told apart by id and text, so repeated rows get
equal verdicts; with an empty benchmark every document is clean, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, store

WIDTH = 8
#: Literal words that a window must have to be met by its template.
LEAST = 5
#: Words and characters that an item must have.
LEAST_WORDS, LEAST_CHARS = 3, 8
#: Bits of the table that documents' windows are tested against, whatever the benchmark's size.
TABLE_BITS = 24

# Words for numbers and units in English, French, Spanish and German (without those that are other common words of the four).
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "deux trois quatre cinq sept huit neuf dix onze douze treize vingt trente quarante cinquante soixante mille millions milliard milliards "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms pound pounds liter liters litre litres percent dollar dollars euro euros cent cents degree degrees mph kmh "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes heure heures jour jours semaine semaines mois année années seconde secondes degré degrés centime centimes "
    "metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros hora horas día días semana semanas meses año años minuto minutos segundo segundos grado grados dólar dólares "
    "gramm kilogramm stunde stunden tage tagen woche wochen monat monate monaten jahr jahre jahren minuten sekunde sekunden grad prozent".split()
)

_OUTER = "\"'`.,;:!?()[]{}<>«»“”‘’„…–—-*_~#|/\\、。，．！？；：「」『』（）《》【】〈〉・"
#: Characters of scripts without spaces (Thai to Myanmar, Khmer, kana, Han) and their punctuation.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f\uff66-\uff9f\U00020000-\U0003ffff]")
_MULT = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(32)], dtype=np.uint64)


class Canon(dict):
    """word -> number of its entry in the tables below; one per worker, emptied when LARGEST words are in it."""

    LARGEST = 250_000

    def __init__(self):
        super().__init__()
        self.room = 1 << 16
        self.start, self.inside = np.zeros(self.room, np.uint64), np.zeros(self.room, np.uint64)  # at a sentence's start, and inside; 0: no token
        self.literal = np.zeros(self.room, np.uint64)
        self.kind_start, self.kind_inside = np.zeros(self.room, np.int8), np.zeros(self.room, np.int8)
        self.ends = np.zeros(self.room, bool)
        self.value: list[str] = []

    def __missing__(self, word: str) -> int:
        import xxhash

        n = len(self.value)
        if n == self.room:
            self.room *= 2
            for name in ("start", "inside", "literal", "kind_start", "kind_inside", "ends"):
                setattr(self, name, np.resize(getattr(self, name), self.room))
        core = word.strip(_OUTER)
        low = core.lower()
        number = any(c.isdigit() for c in core)
        kind = 1 if number or low in NUMBER_WORDS else 2 if low in UNITS else 0
        name = not kind and core[:1].isupper() and not core.isupper()
        literal = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) | 8 if core else 0
        self.literal[n] = literal
        self.start[n] = kind or literal
        self.inside[n] = (3 if name else kind) or literal
        self.kind_start[n], self.kind_inside[n] = kind, 3 if name else kind
        self.ends[n] = word.rstrip("\"'”’»)]*_")[-1:] in tuple(".!?:…")
        self.value.append(low)
        self[word] = n
        return n

    def tokens(self, text: str):
        """(hashes, kinds, values' numbers) of the text's tokens."""
        if len(self) > self.LARGEST:
            self.clear()
            self.value = []
        if not text.isascii() and _UNSPACED.search(text):
            text = _UNSPACED.sub(r" \g<0> ", text)
        n = np.fromiter(map(self.__getitem__, text.split()), np.int64)
        first = np.append(True, self.ends[n[:-1]]) if len(n) else np.empty(0, bool)
        h = np.where(first, self.start[n], self.inside[n])
        k = np.where(first, self.kind_start[n], self.kind_inside[n])
        keep = h != 0
        return h[keep], k[keep], n[keep]


def templates(h: np.ndarray, k: np.ndarray, exact: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window, whether it has literal words enough, and whether names are slots in it.

    Where names leave too few literal words (German writes all nouns like names), they are literal themselves.
    """
    w, named = window_hashes(h, k == 0, width)
    v, plain = window_hashes(np.where(k == 3, exact, h), (k == 0) | (k == 3), width)
    return np.where(named, w, v), named | plain, named


def window_hashes(h: np.ndarray, literal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and whether it has literal words enough."""
    n = len(h) - width + 1
    out = np.full(max(n, 0), width, dtype=np.uint64)
    if n <= 0:
        return out, np.empty(0, bool)
    for i in range(width):
        out += h[i : i + n] * _MULT[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    words = np.append(0, np.cumsum(literal))
    return out, words[width:] - words[:-width] >= min(LEAST, width)


_HITS = "array<struct<hash: long, at: int, ok: boolean, places: array<int>, slots: array<string>>>"
_HIT_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("ok", pa.bool_()), ("places", pa.list_(pa.int32())), ("slots", pa.list_(pa.string()))]))


def _found(canon: Canon, text: str, widths: list[int] | None, table: np.ndarray | None):
    """Windows met by template (with slots, in items also their places) and by equality (slots null; of a window without slots, both are the same)."""
    h, k, n = canon.tokens(text)
    exact = canon.literal[n]
    hits = []
    for width in [min(WIDTH, len(h))] if widths is None else widths:
        w, ok, named = templates(h, k, exact, width)
        if not len(w):
            continue
        v = window_hashes(exact, k == 0, width)[0]
        plain = ok & (w == v)
        by_template, by_value = ok, ~plain
        if table is not None:
            by_template, by_value = ok & _in(table, w), by_value & _in(table, v)
        for p in np.flatnonzero(by_template):
            places = [q for q in range(int(p), int(p) + width) if k[q] and (named[p] or k[q] != 3)]
            slots = [f"{k[q]}:{canon.value[n[q]]}" for q in places]
            hits.append({"hash": int(w[p].astype(np.int64)), "at": int(p), "ok": True, "places": places if table is None else None, "slots": slots})
        for p in np.flatnonzero(by_value):
            hits.append({"hash": int(v[p].astype(np.int64)), "at": int(p), "ok": bool(ok[p]), "places": None, "slots": None})
    return hits, n


def _in(table: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((table[(w >> np.uint64(3)) & np.uint64(len(table) - 1)] >> (w & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _searchable(words: list[str]) -> bool:
    return len(words) >= LEAST_WORDS and sum(len(x) * (2 if _UNSPACED.match(x) else 1) for x in words) >= LEAST_CHARS


def _digest(*parts) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(repr(parts).encode("utf-8", "surrogatepass"))).astype(np.int64))


def _identities(hits: list[dict], width: int) -> tuple[int, int]:
    """Of an item: the template with its pattern of equal slots, and the words. One-to-one correspondences exist for all items of a pattern or for none."""
    first: dict[str, int] = {}
    frame = [(x["hash"], x["at"], [first.setdefault(y, len(first)) for y in x["slots"]]) for x in hits if x["slots"] is not None]
    words = _digest(width, [(x["hash"], x["at"]) for x in hits if x["slots"] is None or not x["slots"]])
    return (_digest(width, frame) if frame else words), words


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored: item_id, words (the item's identity), family (same template and pattern of equal slots), family_id, width, windows, frames (windows met by template), hits.

    One item of each wording; of each family, one item has the windows met by template. Those that cannot be searched for have width 0.
    """

    def run(batches):
        canon = Canon()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits, n = _found(canon, t or "", None, None)
                words = [canon.value[x] for x in n]
                if _searchable(words):
                    width = min(WIDTH, len(n))
                    family, own = _identities(hits, width)
                    rows.append((i, own, family, width, len(n) - width + 1, sum(x["slots"] is not None for x in hits), hits))
                elif words:
                    rows.append((i, _digest(i, words), 0, 0, 0, 0, []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), _HIT_TYPE)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["item_id", "words", "family", "width", "windows", "frames", "hits"])

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    done = items.mapInArrow(run, f"item_id long, words long, family long, width int, windows int, frames int, hits {_HITS}")
    best = store(done.groupBy("words").agg(F.min(F.struct("item_id", "family", "width", "windows", "frames", "hits")).alias("x")).select("words", "x.*"), "benchmark-items")
    heads = best.groupBy("family").agg(F.min(F.struct("item_id", "words")).alias("head"))
    best = best.join(heads, "family")
    hits = F.when(F.col("words") == F.col("head.words"), F.col("hits")).otherwise(F.filter("hits", lambda x: x["slots"].isNull()))
    return store(best.select("item_id", "words", "family", F.col("head.item_id").alias("family_id"), "width", "windows", "frames", hits.alias("hits")), "benchmark-windows")


def unsearchable(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id of the items that have a text but are too short to be searched for."""
    return benchmark_windows(benchmark, id_col, text_col).where("width = 0").select("item_id")


def bit_table(windows: DataFrame) -> np.ndarray:
    """2^TABLE_BITS bits: those of the windows' hashes. Partitions send tables of that fixed size, at most eight."""

    def run(batches):
        table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        for b in batches:
            w = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            np.bitwise_or.at(table, ((w >> np.uint64(3)) & np.uint64(len(table) - 1)).astype(np.int64), np.uint8(1) << (w & np.uint64(7)).astype(np.uint8))
        import zlib

        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], names=["t"])

    import zlib

    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in windows.select(F.explode("hits.hash").alias("hash")).coalesce(8).mapInArrow(run, "t binary").collect():
        out |= np.frombuffer(zlib.decompress(r.t), np.uint8)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, key, the item it repeats most of (null if clean), windows met and windows of it."""
    bench = benchmark_windows(benchmark)
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # at most WIDTH values
    if 0 in widths:
        short = bench.where("width = 0").select("item_id")
        warnings.warn(f"{short.count()} benchmark items are too short to be searched for, such as those of ids {[r.item_id for r in short.limit(20).collect()]}", stacklevel=2)
        widths.remove(0)
    table = bit_table(bench)

    def run(batches):
        canon = Canon()
        for b in batches:
            hits = [_found(canon, t, widths, table)[0] if t else [] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, _HIT_TYPE)], names=["doc_id", "key", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = store(rows.mapInArrow(released(run), f"doc_id long, key long, hits {_HITS}"), "leak-windows")
    left = found.where(F.size("hits") > 0).select("key", F.explode("hits").alias("d"))
    right = bench.select("item_id", "words", "family", "family_id", "windows", "frames", F.explode("hits").alias("b")).withColumn("hash", F.col("b.hash"))
    met = left.withColumn("hash", F.col("d.hash")).join(right, "hash")
    item = ("key", "family", "family_id", "words", "windows", "frames")
    # equal windows, per item
    equal = met.where(F.col("b.slots").isNull()).groupBy(*item).agg(F.collect_set(F.when(F.col("b.ok"), F.col("b.at"))).alias("ok_at"), F.collect_set(F.when(~F.col("b.ok"), F.col("b.at"))).alias("other_at"))
    # per family and diagonal: which of the item's windows were met, and which values stood for which
    alike = met.where(F.col("b.slots").isNotNull())
    empty = F.array().cast("array<string>")
    window = F.struct("b.at", "b.places", F.col("b.slots").alias("b"), F.coalesce("d.slots", empty).alias("d"))
    alike = alike.groupBy(*item, (F.col("d.at") - F.col("b.at")).alias("diagonal")).agg(F.collect_set(window).alias("x"))
    alike = alike.select(*item, "x.at", "x.places", "x.b", "x.d")

    def judge(batches):
        for b in batches:
            at = [sound_windows(*x) for x in zip(*(b.column(c).to_pylist() for c in ("at", "places", "b", "d")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(item)], pa.array(at, pa.list_(pa.int32()))], names=[*item, "at"])

    sound = alike.mapInArrow(judge, "key long, family long, family_id long, words long, windows int, frames int, at array<int>").where(F.size("at") > 0)
    frame = sound.groupBy(*item).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("frame_at"))
    # a family's windows count for each of its items that has equal windows, and for the one that stands for the family
    none = F.array().cast("array<int>")
    both = equal.join(frame.select("key", "family", "frame_at"), ["key", "family"], "left").withColumn("frame_at", F.coalesce("frame_at", none))
    both = both.unionByName(frame.withColumns({"ok_at": none, "other_at": none}))
    both = both.select("key", "family", "family_id", "windows", "frames", F.size(F.array_union("frame_at", "ok_at")).alias("n_ok"), F.size("other_at").alias("n_other"))
    of_all, of_frames = F.struct((F.col("n_ok") + F.col("n_other")).alias("met"), "windows"), F.struct(F.col("n_ok").alias("met"), F.col("frames").alias("windows"))
    by_frames = F.col("n_ok") * F.col("windows") >= (F.col("n_ok") + F.col("n_other")) * F.col("frames")
    covered = both.select("key", "family", "family_id", F.when((F.col("frames") > 0) & by_frames, of_frames).otherwise(of_all).alias("x")).select("key", "family", "family_id", "x.*")
    covered = covered.where(F.col("met") >= share * F.col("windows"))
    best = covered.groupBy("key").agg(F.max_by(F.struct(F.col("family_id").alias("item_id"), "met", "windows"), F.struct(F.col("met") / F.col("windows"), "met", -F.col("family_id"))).alias("best"), F.count_distinct("family").alias("n_items"))
    return found.select("doc_id", "key").join(best, "key", "left").select("doc_id", "key", F.col("best").isNotNull().alias("contaminated"), "best.item_id", "best.met", "best.windows", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def sound_windows(at: list[int], places: list[list[int]], items: list[list[str]], docs: list[list[str]]) -> list[int]:
    """Those windows of a diagonal whose values equal the item's, or whose pairs each hold at more than half of the places of the item's value."""
    pairs = [list(zip(p, b, d, strict=True)) for p, b, d in zip(places, items, docs, strict=True)]
    held = {p: (b, d) for some in pairs for p, b, d in some}
    votes, of_item = Counter(held.values()), Counter(b for b, _ in held.values())
    kept = {x for x, n in votes.items() if 2 * n > of_item[x[0]]}
    return sorted({a for a, some in zip(at, pairs, strict=True) if all(b == d for _, b, d in some) or all((b, d) in kept for _, b, d in some)})


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    return F.xxhash64(F.col(id_col).cast("long"), text_col)
