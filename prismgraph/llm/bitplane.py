"""Op 1: token ids as bit- or byte-plane blocks.

File format (Parquet container below one folder; one row per block, the blocks of a shard in order):
  shard int, block int, first long (ids of the shard before the block), n_ids int,
  planes array<binary>: the block's ids as little-endian 32-bit numbers, transposed into 4 byte planes or 32 bit
  planes and each compressed with zstandard; all-zero planes are empty; and the block's part of the index:
  doc_ids, rows, starts, lengths: the documents with ids in the block, their number in the shard, where they begin
  in the block and how many of their ids it holds. Reading the index alone touches no plane.

Edge cases: a null or empty text has the end id alone; rows with a null id come first; rows that share an id are kept
and lie in the order of a hash of their text; an empty table gives no blocks. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, parts, released
from .tokens import encoder, in_chunks

SCHEMA = (
    "shard int, block int, first long, n_ids int, planes array<binary>, "
    "doc_ids array<long>, rows array<long>, starts array<int>, lengths array<int>"
)


def to_planes(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """The compressed planes of one block."""
    import zstandard

    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        planes = np.ascontiguousarray(octets.T)
    else:
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    c = zstandard.ZstdCompressor(level=3)
    return [c.compress(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; the number of planes tells the mode."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    size = n if len(planes) == 4 else (n + 7) // 8
    raw = np.zeros((len(planes), size), dtype=np.uint8)
    for i, p in enumerate(planes):
        if p:
            raw[i] = np.frombuffer(d.decompress(p, max_output_size=size), dtype=np.uint8)
    if len(planes) != 4:
        raw = np.packbits(np.unpackbits(raw, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def _writer(tokenizer: str, end_id: int, block: int, mode: str):
    def write(batches):
        from pyspark import TaskContext

        shard, number, first, rows = TaskContext.get().partitionId(), 0, 0, 0
        pending: list[np.ndarray] = []  # ids of the block that is being filled
        index: list[tuple[int | None, int, int, int]] = []
        filled = 0
        out: list[dict] = []

        def close():
            nonlocal number, first, filled
            ids = np.concatenate(pending)
            cols = list(zip(*index, strict=True))
            out.append(dict(shard=shard, block=number, first=first, n_ids=len(ids), planes=to_planes(ids, mode), doc_ids=cols[0], rows=cols[1], starts=cols[2], lengths=cols[3]))
            number, first, filled = number + 1, first + len(ids), 0
            pending.clear()
            index.clear()

        enc = encoder(tokenizer)
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for part in in_chunks(texts):
                for doc_id, ids in zip(doc_ids[part], enc.encode(texts[part]), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    while len(ids):
                        some, ids = ids[: block - filled], ids[block - filled :]
                        pending.append(some)
                        index.append((doc_id, rows, filled, len(some)))
                        filled += len(some)
                        if filled == block:
                            close()
                    rows += 1
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
        if pending:
            close()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return write


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block: int = 65536, mode: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the blocks below path, shards and rows in ascending order of the id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange(parts(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(released(_writer(tokenizer, end_id, block, mode)), SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents with their ids: doc_id, shard, row, start (over all shards), ids (32-bit, little-endian)."""
    blocks = spark.read.schema(SCHEMA).parquet(path)

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("row", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for r in range(b.num_rows):
                x = b.slice(r, 1).to_pylist()[0]
                raw = from_planes(x["planes"], x["n_ids"]).tobytes()
                pieces = [raw[4 * s : 4 * (s + n)] for s, n in zip(x["starts"], x["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_ids"], pa.int64()), pa.array([x["shard"]] * len(pieces), pa.int32()), pa.array(x["rows"], pa.int64()), pa.array([x["first"] + s for s in x["starts"]], pa.int64()), pa.array(pieces, pa.binary())], schema=schema)

    pieces = blocks.mapInArrow(released(read), "doc_id long, shard int, row long, first long, ids binary")
    base = offsets(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")), "shard", "n", "base").select("shard", "base")
    return pieces.join(base, "shard").select("doc_id", "shard", "row", (F.col("base") + F.col("first")).alias("start"), "ids")


def combine_crc(a: int, b: int, n: int) -> int:
    """crc32 of two strings from theirs; n: bytes of the second. The first's register runs through n zero bytes."""
    square = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit, as a matrix over GF(2)

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    bits = 8 * n
    while bits:
        if bits & 1:
            a = times(square, a)
        square = [times(square, x) for x in square]
        bits >>= 1
    return a ^ b


def documents_of(pieces: DataFrame) -> DataFrame:
    """One row per document from read_ids: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches):
        for b in batches:
            raw = b.column("ids").to_pylist()
            cols = [b.column(c) for c in ("doc_id", "shard", "row", "start")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], names=["doc_id", "shard", "row", "start", "size", "crc"])

    @F.pandas_udf("long")
    def joined(found):
        out = []
        for some in found:
            some = sorted(some, key=lambda x: x["start"])
            crc = some[0]["crc"]
            for x in some[1:]:
                crc = combine_crc(int(crc), int(x["crc"]), int(x["size"]))
            out.append(int(crc))
        import pandas as pd

        return pd.Series(out, dtype="int64")

    found = pieces.mapInArrow(released(digest), "doc_id long, shard int, row long, start long, size long, crc long")
    docs = found.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), (F.sum("size") / 4).cast("long").alias("n_tokens"), F.collect_list(F.struct("start", "size", "crc")).alias("pieces"))
    return docs.select("doc_id", "start", "n_tokens", joined("pieces").alias("ids_crc32"))
