"""Media columns: payloads stored as 8-bit audio, in content-defined chunks that are shared between documents."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, small_batches, written

BLOCK = 192
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16_384
SAMPLE_RATE = 8_000
#: Blocks of the filter that tells which documents may have shared chunks, and 64-bit words in each: 4 MB at any size of the input.
FILTER_BLOCKS, FILTER_WORDS = 1 << 16, 4

_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with spaces to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK))


def wav_header(size: int) -> bytes:
    """Header of a mono file of ``size`` unsigned 8-bit samples (``size`` is even)."""
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", size)


def samples(media: bytes) -> bytes:
    """Read the stored samples back, checking the header against them."""
    (size,) = struct.unpack_from("<I", media, 40)
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or len(media) != 44 + size:
        raise ValueError("damaged media")
    return media[44:]


def gear_cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the rolling gear hash of the last 32 bytes has MASK_BITS zeros on top.

    A cut closer than MIN_CHUNK to the last one is passed over, and a chunk ends after
    MAX_CHUNK bytes at the latest.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):  # the sum of the last 2 * span bytes' values, each shifted by its distance
        h[span:] = h[span:] + (h[:-span] << np.uint32(span)) if len(h) > span else h[span:]
    cuts, last = [], 0
    for at in [*(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist(), len(data)]:
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
        if at - last >= MIN_CHUNK or (at == len(data) and at > last):
            cuts.append(at)
            last = at
    return cuts


def chunks(data: bytes) -> list[bytes]:
    out, last = [], 0
    for at in gear_cuts(data):
        out.append(data[last:at])
        last = at
    return out


def features(payload: bytes) -> str:
    """Mean, root mean square around the middle, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};peak={int(np.abs(x).max())}"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A key per distinct (id, text) pair: rows that repeat both share one media file."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\x01"), F.coalesce("text", F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_key", F.sha2(own, 256).substr(1, 32))


def _flagged(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return flagged(rows, keys, "_key", FILTER_BLOCKS, FILTER_WORDS)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """Digests of every document's chunks, in order: _key, seq, digest, size (no payloads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seqs, digests, sizes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, c in enumerate(chunks(payload_of(text.as_py()))):
                    keys.append(key)
                    seqs.append(k)
                    digests.append(hashlib.sha256(c).digest()[:20])
                    sizes.append(len(c))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(seqs, pa.int32()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["_key", "seq", "digest", "size"])

    return docs.select("_key", "text").mapInArrow(run, "_key string, seq int, digest binary, size int")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write media in deduplicated chunks: (manifests, shared chunks).

    A chunk that occurs more than once belongs to its first occurrence by (_key, seq).
    Manifests have per document its own chunks' bytes and the references to chunks of others
    (position, digest); the shared table has digest and bytes of chunks that are referred to.
    """
    keyed = _keyed(docs, id_col, text_col)
    lists = written(chunk_lists(keyed).dropDuplicates(["_key", "seq"]), "chunk-lists")
    seen = written(lists.groupBy("digest").agg(F.min(F.struct("_key", "seq")).alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1"), "chunk-owners")
    # The join finds who refers to whom.  Digests held by 1/1024 of all chunks number 1024 at most and are
    # broadcast; no other digest has more rows than that.
    total = lists.count()
    hot, rest = (seen.where(F.col("n") * 1024 >= total), seen.where(F.col("n") * 1024 < total))
    pairs = lists.join(F.broadcast(hot.select("digest", "own")), "digest").unionByName(lists.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.select("digest", "own"), "digest"))
    owner = (F.col("own._key") == F.col("_key")) & (F.col("own.seq") == F.col("seq"))
    moves = written(pairs.groupBy("_key").agg(F.sort_array(F.collect_list(F.when(~owner, F.struct("seq", "digest")))).alias("refs"), F.sort_array(F.collect_list(F.when(owner, F.col("seq")))).alias("shared")), "chunk-moves")
    # texts that certainly share nothing stay where they are; the others meet what they share in a shuffle
    told = _flagged(keyed, moves)
    none = moves.schema
    alone = told.where("not _maybe").select(*keyed.columns, *(F.lit(None).cast(none[c].dataType).alias(c) for c in ("refs", "shared")))
    placed = told.where("_maybe").drop("_maybe").join(moves.hint("shuffle_merge"), "_key", "left").unionByName(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                payload = payload_of(r["text"])
                parts, refs = chunks(payload), r["refs"] or []
                away = {x["seq"] for x in refs}
                rows.append((
                    r["doc_id"], r["_key"], len((r["text"] or "").encode("utf-8", "surrogatepass")), wav_header(len(payload)), [len(c) for c in parts],
                    b"".join(c for k, c in enumerate(parts) if k not in away), [x["seq"] for x in refs], [x["digest"] for x in refs],
                    [hashlib.sha256(parts[k]).digest()[:20] for k in r["shared"] or []], [parts[k] for k in r["shared"] or []],
                    hashlib.sha256(wav_header(len(payload)) + payload).digest(),
                ))
            cols = list(zip(*rows)) if rows else [[]] * 11
            types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "_key", "n_bytes", "header", "sizes", "own", "ref_seq", "ref_digest", "shared_digest", "shared", "media_sha"])

    schema = "doc_id long, _key string, n_bytes long, header binary, sizes array<int>, own binary, ref_seq array<int>, ref_digest array<binary>, shared_digest array<binary>, shared array<binary>, media_sha binary"
    manifests = written(placed.select("doc_id", "_key", "text", "refs", "shared").mapInArrow(run, schema), "media")
    shared = manifests.where("size(shared) > 0").select(F.explode(F.arrays_zip("shared_digest", "shared")).alias("c")).select(F.col("c.shared_digest").alias("digest"), F.col("c.shared").alias("bytes"))
    return manifests, shared.dropDuplicates(["digest"])


def read_back(manifests: DataFrame, shared: DataFrame) -> DataFrame:
    """Reconstruct each media file from its chunks, verify it, and compute features of its samples.

    Only documents that refer to chunks of others are joined with those.
    """
    spark = manifests.sparkSession
    refs = manifests.where("size(ref_seq) > 0").select("_key", F.explode(F.arrays_zip("ref_seq", "ref_digest")).alias("r")).select("_key", F.col("r.ref_seq").alias("seq"), F.col("r.ref_digest").alias("digest")).dropDuplicates(["_key", "seq"])
    counts = written(refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "chunk-uses")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # the bytes of at most 1024 chunks of at most MAX_CHUNK bytes are broadcast; the other chunks have fewer references each
    hot = F.broadcast(counts.where(F.col("n") * 1024 >= total).select("digest"))
    hot_bytes, rest_bytes = shared.join(hot, "digest", "left_semi"), shared.join(hot, "digest", "left_anti")
    fetched = refs.join(F.broadcast(hot_bytes), "digest").unionByName(refs.join(hot, "digest", "left_anti").join(rest_bytes, "digest"))
    fetched = fetched.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("fetched"))
    need = ["doc_id", "_key", "n_bytes", "header", "sizes", "own", "media_sha"]
    whole = manifests.where("size(ref_seq) = 0").select(*need, F.lit(None).cast("array<struct<seq:int,bytes:binary>>").alias("fetched"))
    joined = manifests.where("size(ref_seq) > 0").select(*need).join(fetched, "_key").select(*need, "fetched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                other, parts, at = {x["seq"]: x["bytes"] for x in r["fetched"] or []}, [], 0
                for k, size in enumerate(r["sizes"]):
                    if k in other:
                        parts.append(other[k])
                    else:
                        parts.append(r["own"][at : at + size])
                        at += size
                media = r["header"] + b"".join(parts)
                if hashlib.sha256(media).digest() != r["media_sha"]:
                    raise ValueError(f"media of document {r['doc_id']} can't be reconstructed")
                back = samples(media)
                out.append((r["doc_id"], r["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back), len(parts)))
            cols = list(zip(*out)) if out else [[]] * 9
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    small_batches(spark, 500)
    return whole.mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as an 8-bit mono WAV file in shared chunks, read it back, and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_chunks; equal texts have equal values.

    A null text is stored as an empty one.  Rows that repeat id and text share a file and
    give a row each; a null id is passed through.  An empty table gives an empty result.
    Other columns are not read.  A file whose digest differs after reading raises.
    """
    small_batches(docs.sparkSession, 500)
    return read_back(*store(docs, id_col, text_col))
