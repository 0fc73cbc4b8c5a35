"""Sum-of-squares packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

CAPACITY = 2048
SHARD = 20_000  # pieces in one packing problem, about
SEPARATOR = 0
_encoders: dict = {}


def encoder(path: str):
    """ids of a text, as the tokenizers library gives them for a byte-level BPE file.

    The vocabulary and the split pattern of the file are run by tiktoken, which is several
    times faster; the few texts it can't handle go to tokenizers itself.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        added = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        special = {t.content for t in slow.get_added_tokens_decoder().values() if t.special}
        back = {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(back[c] for c in w): i for w, i in slow.get_vocab(with_added_tokens=False).items() if w not in added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in added) or len(text) > 1_000_000:
                return slow.encode(text, add_special_tokens=False).ids
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # its regex engine gives up on very long runs of white space
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
                return slow.encode(text, add_special_tokens=False).ids

        del special
        _encoders[path] = encode
    return _encoders[path]


def _byte_chars() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level BPE vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return chars


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document (its ids, then the separator) into pieces of at most ``capacity`` tokens.

    All pieces but the first are full.  Returns _uid (unique, also where rows share a
    doc_id), doc_id, piece, start, length, _packed (the ids, as ``with_ids`` reads them).
    Ids are packed, four planes of bytes under zstd, as they are written and shuffled before they are read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid, pack_ = encoder(path), TaskContext.get().partitionId() << 36, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), SEPARATOR], "<u4")
                start, end, k = 0, (len(ids) - 1) % capacity + 1, 0
                while start < len(ids):
                    out.append((uid, doc_id, k, start, end - start, pack_(ids[start:end].view("u1").reshape(-1, 4).T.tobytes())))
                    uid += 1
                    start, end, k = end, end + capacity, k + 1
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_uid", "doc_id", "piece", "start", "length", "_packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return rows.mapInArrow(run, "_uid long, doc_id long, piece int, start long, length long, _packed binary")


def with_ids(cut: DataFrame) -> DataFrame:
    """Pieces with ids (little-endian unsigned 32-bit numbers) for _packed, beside their other columns."""
    kept = [c for c in cut.columns if c != "_packed"]
    schema = T.StructType([*cut.select(kept).schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ids = [np.frombuffer(unpack(p), "u1").reshape(4, -1).T.tobytes() for p in b.column("_packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(ids, pa.binary())], [*kept, "ids"])

    return cut.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack in the order given: bin and offset of each item, and the fill of each bin.

    An item goes where the sum of the squared numbers of open bins per residual gap becomes
    smallest; a new bin is one of the choices.  Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins don't count, nor do empty ones
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 * (count[g - s] - count[g] + 1), or less at gap 0
        open_ = count[s:capacity]
        delta = count[: capacity - s] - open_ + 1
        if len(delta):
            delta = 2 * delta
            delta[0] = 1 - 2 * open_[0]
            delta[open_ == 0] = 1 << 60
            best = int(delta.argmin())
            cost = int(delta[best])
        else:
            best, cost = 0, 1 << 60
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if cost <= fresh:
            gap = best + s
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(b)
    return where, offset, np.array(fill, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = 2) -> DataFrame:
    """Add sequence_id and offset to pieces (columns _uid, length, ...), by sum-of-squares packing.

    Full pieces are sequences of their own and never move.  The others are dealt to
    shards of about ``shard`` pieces by a hash, each packed alone, longest piece first, so
    time is linear in the input and a task's memory is bounded.  What a shard leaves in
    bins that aren't full is packed again, with the leftovers of other shards, in
    ``rounds`` - 1 further rounds over shards of the same size, so the space lost is a few
    bins per last-round shard.
    """
    n = items.where(F.col("length") < capacity).count()
    schema = "_uid long, length long, sequence_id long, offset long"

    def run(level: int, last: bool):
        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "_h", "_uid"], ascending=[False, True, True], ignore_index=True)
            where, offset, fill = sum_of_squares(pdf["length"].to_numpy(), capacity)
            number = (int(pdf["_shard"].iloc[0]) * 4 + level) * (1 << 34) + where
            done = np.ones(len(pdf), bool) if last else (fill == capacity)[where]
            return pd.DataFrame({"_uid": pdf["_uid"], "length": pdf["length"], "sequence_id": np.where(done, number, -1), "offset": np.where(done, offset, 0)})

        return packed

    full = items.where(F.col("length") >= capacity).select("_uid", "length", (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, out = items.where(F.col("length") < capacity).select("_uid", "length"), full
    for level in range(rounds):
        last = level == rounds - 1
        shards = max(1, round(n / shard))
        h = F.xxhash64("_uid", F.lit(level))
        dealt = left.withColumn("_h", h).withColumn("_shard", F.pmod("_h", F.lit(shards)))
        result = written(dealt.groupBy("_shard").applyInPandas(run(level, last), schema), "packed")
        out = out.unionByName(result.where("sequence_id <> -1"))
        if not last:
            left = result.where("sequence_id = -1").select("_uid", "length")
            n = left.count()
    return out.drop("length")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into as few sequences of at most ``capacity`` tokens as possible.

    Returns per piece: doc_id, piece, start, length, ids, ids_crc32 (derived from them),
    sequence_id, offset.  A sequence is its pieces' ids by offset.

    Null and empty texts are a separator alone.  Rows of equal doc_id are packed as
    documents of their own; a null id stays null.  An empty table gives no pieces.  Other
    columns are not read.
    """
    cut = written(pieces(docs, path, capacity, id_col, text_col), "pieces")
    packed = cut.join(pack(cut, capacity), "_uid").select("doc_id", "piece", "start", "length", "sequence_id", "offset", "_packed")
    return with_ids(packed).select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
