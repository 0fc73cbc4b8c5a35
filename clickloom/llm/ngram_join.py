"""N-gram Jaccard self-join with PartEnum signatures."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, join_groups, shuffles, small_batches, written

BUCKET = 2_000_000  # signatures that one reducing task holds at a time, about
BINS = 256
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; one for a shorter text; none without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    acc = mix(w[:n] + _M3)
    for j in range(1, k):
        acc = mix(acc * _M3 + w[j : j + n])
    return np.unique(acc)


def digest(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def histogram(s: np.ndarray) -> bytes:
    """Counts of the features by BINS parts of their domain; half of what two sets' counts differ by can't exceed what the sets do."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


class Scheme:
    """PartEnum for sets with 100 * intersection >= percent * union.

    Such sets of sizes s and t differ in at most (100 - percent) * (s + t) / (100 + percent)
    features.  Bands are ranges of this bound: band b serves pairs whose bound is at most
    limit[b], and a set takes part in each band that a partner's size can lead to (one or two).

    In band b with bound K, the domain falls into n1 first-level parts, each of parts2 second-level
    parts.  As at most floor(K / 2) first-level parts can hold two differences or more, at least
    slack = n1 - floor(K / 2) hold one at most, and there the two sets agree on some subset that
    leaves one second-level part out: a shared signature.  Subsets that hold fewer than ``weak``
    features say little.  A set with fewer than ``slack`` first-level parts that have such a
    subset leaves those subsets out and still shares a signature with every partner, since whether
    a shared subset is weak is the same on both sides; a set with more of them keeps all.
    """

    def __init__(self, percent: int):
        self.percent = percent
        #: Second-level parts of each first-level one; every subset that leaves one out is enumerated.
        self.parts2 = 3 if percent >= 85 else 2
        self.weak = 3 if percent >= 85 else 1
        self.limit = [1]
        while self.limit[-1] < 1 << 40:
            self.limit.append(max(self.limit[-1] + 1, int(self.limit[-1] * 1.3)))

    def bound(self, s: int, t: int) -> int:
        return (100 - self.percent) * (s + t) // (100 + self.percent)

    def bands(self, s: int) -> list[int]:
        low = self.bound(s, -(-self.percent * s // 100))
        high = self.bound(s, s * 100 // self.percent)
        if high == 0:
            return []  # only equal sets
        of = lambda k: next(b for b, limit in enumerate(self.limit) if k <= limit)
        return list(range(of(max(low, 1)), of(high) + 1))

    def parts(self, band: int) -> tuple[int, int]:
        """First-level parts and slack of a band."""
        k = self.limit[band]
        base = k // 2
        size = k * (100 + self.percent) / (2 * (100 - self.percent)) / 1.5  # of the smallest sets here
        slack = 1
        for _ in range(8):  # more parts hold fewer features each, and more of them are weak
            share = size * (self.parts2 - 1) / self.parts2 / (base + slack)
            rare = sum(math.exp(-share) * share**i / math.factorial(i) for i in range(self.weak))
            slack = 1 + (math.ceil(min(0.3, 1.2 * self.parts2 * rare) * (base + slack)) if base > 3 else 0)
        return base + slack, slack

    def signatures(self, s: np.ndarray) -> np.ndarray:
        out = []
        value = mix(s ^ _M2)
        low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
        first, second = s >> np.uint64(16), ((s & np.uint64(0xFFFF)) % np.uint64(self.parts2)).astype(np.int64)
        for band in self.bands(len(s)):
            n1, slack = self.parts(band)
            cell = (first % np.uint64(n1)).astype(np.int64) * self.parts2 + second
            count = np.bincount(cell, minlength=n1 * self.parts2).reshape(n1, self.parts2)
            # sums of 32-bit halves stay exact in doubles for sets of up to two million features
            total = (np.bincount(cell, low, n1 * self.parts2).astype(np.uint64) + (np.bincount(cell, high, n1 * self.parts2).astype(np.uint64) << np.uint64(32))).reshape(n1, self.parts2)
            count = count.sum(axis=1, keepdims=True) - count
            total = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total
            weak = count < self.weak
            keep = ~weak if np.count_nonzero(weak.any(axis=1)) < slack else np.ones_like(weak)
            place = np.arange(n1 * self.parts2, dtype=np.uint64).reshape(n1, self.parts2) + np.uint64(band << 40)
            out.append(mix(mix(place + _M3) ^ mix(total + count.astype(np.uint64) * _M1))[keep])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, e1, e2 (digest of the set), hist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, e1, e2, hist = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, hashes)
                d = digest(s)
                n.append(len(s))
                e1.append(d[0])
                e2.append(d[1])
                hist.append(histogram(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(e1, pa.int64()), pa.array(e2, pa.int64()), pa.array(hist, pa.binary())], ["doc_id", "n", "e1", "e2", "hist"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, e1 long, e2 long, hist binary")


def buckets_of(docs: DataFrame, words: int, scheme: Scheme, buckets: int) -> DataFrame:
    """sig, e1, x of the signatures that several sets share; x is the smallest e1 among them.

    Sets are computed anew here: that costs less than keeping all signatures on disk.  A
    task sends signatures packed by bucket (a hash range of signatures), with each set's digest
    once per bucket, so little more than the signatures themselves is shuffled.  A set met before
    in the same task gives none again, so copies collapse before the shuffle.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        sigs: list[np.ndarray] = []
        ents: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            sig, ent = np.concatenate(sigs), np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            bucket = ((sig >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            sig, ent, bucket = sig[order], ent[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            digests = np.array(ents, np.int64)
            out = []
            for k in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[k], ends[k + 1]
                own, counts = np.unique(ent[a:b], return_counts=True)
                out.append((k, sig[a:b].tobytes(), digests[own].tobytes(), counts.astype("<u4").tobytes()))
            if out:  # sets that only equal ones are similar to have no signatures
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "sigs", "ents", "counts"])
            sigs.clear()
            ents.clear()

        size = 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words, hashes)
                d = digest(s)
                if len(s) and d not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(d)
                    sigs.append(scheme.signatures(s))
                    ents.append(d[0])
                    size += len(sigs[-1])
                    if size > 1_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for b in batches:
            for k, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.setdefault(k, []).append(tuple(row))
        for k in list(held):
            rows = held.pop(k)
            sig = np.frombuffer(b"".join(r[0] for r in rows), np.int64)
            e1 = np.repeat(np.frombuffer(b"".join(r[1] for r in rows), np.int64), np.frombuffer(b"".join(r[2] for r in rows), "<u4"))
            order = np.argsort(sig)
            sig, e1 = sig[order], e1[order]
            same = sig[1:] == sig[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            sig, e1 = sig[shared], e1[shared]
            order = np.lexsort((e1, sig))
            sig, e1 = sig[order], e1[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (e1[1:] != e1[:-1])  # a set that several tasks met
            sig, e1 = sig[new], e1[new]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(sig)))
            keep = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(e1[keep]), pa.array(np.repeat(e1[first], size)[keep])], ["sig", "e1", "x"])

    sent = docs.where("doc_id is not null").select("text").mapInArrow(send, "bucket int, sigs binary, ents binary, counts binary")
    return sent.repartition(buckets, "bucket").mapInArrow(meet, "sig long, e1 long, x long")


def spare(scheme: Scheme, na, nb, ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """How many more differences sets of these sizes and histograms may have and be linked; negative if they can't be."""
    bound = (100 - scheme.percent) * (na + nb) // (100 + scheme.percent)
    apart = np.abs(ha.astype(np.int16) - hb.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return np.where(scheme.percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb), bound - apart, -1)


def screened(pairs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """Give pairs of sets (x, y by e1) their documents, sizes and histograms, and drop those that can't be linked."""
    side = lambda p: reps.select(F.col("e1").alias(p), F.col("rep").alias(f"{p}_doc"), F.col("n").alias(f"{p}_n"), F.col("hist").alias(f"{p}_hist"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hist = [np.frombuffer(b"".join(b[f"{p}_hist"].to_pylist()), np.uint8).reshape(-1, BINS) for p in "xy"]
                ok = spare(scheme, b["x_n"].to_numpy(), b["y_n"].to_numpy(), *hist) >= 0
                yield b.select(["x", "y", "x_doc", "y_doc"]).filter(pa.array(ok))

    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_doc", "y_doc", "x_n", "y_n", "x_hist", "y_hist").mapInArrow(run, "x long, y long, x_doc long, y_doc long")


def sweep(batches: Iterator[pa.RecordBatch], scheme: Scheme, closest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket (sig) and two components that may be linked; rows come sorted by sig.

    With ``closest``, each row gives one pair at most, with the row that it can be linked to most easily.
    A bucket that ends with a batch may go on in the next one, so its rows are carried over.
    """

    def pairs(sig, e1, n, comp, hist) -> np.ndarray:
        out, at, d = [np.empty((0, 2), np.int64)], np.arange(len(sig)), 1
        best, mate = np.full(len(sig), -1), np.arange(len(sig))
        while len(at):  # rows that still have a row of their bucket d places on
            at = at[at + d < len(sig)]
            at = at[sig[at] == sig[at + d]]
            for k in range(0, len(at), 50_000):
                i = at[k : k + 50_000]
                i = i[comp[i] != comp[i + d]]
                room = spare(scheme, n[i], n[i + d], hist[i], hist[i + d])
                i, room = i[room >= 0], room[room >= 0]
                if closest:
                    for own, other in ((i, i + d), (i + d, i)):
                        more = room > best[own]
                        best[own[more]], mate[own[more]] = room[more], other[more]
                else:
                    out.append(np.stack([np.minimum(e1[i], e1[i + d]), np.maximum(e1[i], e1[i + d])], axis=1))
            d += 1
        if closest:
            i = np.flatnonzero(best >= 0)
            out.append(np.stack([np.minimum(e1[i], e1[mate[i]]), np.maximum(e1[i], e1[mate[i]])], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def result(p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], ["x", "y"])

    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [*(b[c].to_numpy() for c in ("sig", "e1", "n", "component")), np.frombuffer(b"".join(b["hist"].to_pylist()), np.uint8).reshape(-1, BINS)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        whole = int(np.searchsorted(held[0], held[0][-1]))
        if whole:
            yield result(pairs(*(x[:whole] for x in held)))
            held = [x[whole:] for x in held]
    if held is not None:
        yield result(pairs(*held))


def candidate_texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """Texts of the documents (doc_id) that some signature names, fetched once for all checks.

    The join is a shuffle at every size; the small side is the one that is hashed.
    """
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(need.distinct().hint("shuffle_hash"), "doc_id", "left_semi"), "candidate-texts")


def linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Check candidate pairs on whole texts: u, v (documents)."""
    both = pairs.join(texts.select(F.col("doc_id").alias("y_doc"), F.col("text").alias("y_text")), "y_doc").join(texts.select(F.col("doc_id").alias("x_doc"), F.col("text").alias("x_text")), "x_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = WordHashes(), OrderedDict()

        def features(key: tuple, text: str) -> np.ndarray | None:
            """The set, if it is the one that the pair means (an id may have several rows)."""
            full = (*key, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
            if full not in kept:
                s = shingle_set(text, words, hashes)
                kept[full] = s if digest(s)[0] == key[1] else None
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[full]

        for b in batches:
            u, v = [], []
            for x, y, xd, yd, xt, yt in zip(*(b[c].to_pylist() for c in ("x", "y", "x_doc", "y_doc")), b["x_text"], b["y_text"]):
                xs, ys = features((xd, x), xt.as_py() or ""), features((yd, y), yt.as_py() or "")
                if xs is not None and ys is not None:
                    same = len(np.intersect1d(xs, ys, assume_unique=True))
                    if same and 100 * same >= percent * (len(xs) + len(ys) - same):
                        u.append(xd)
                        v.append(yd)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return both.select("x", "y", "x_doc", "y_doc", "x_text", "y_text").mapInArrow(run, "u long, v long")


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of distinct word shingles have 100 * intersection >= percent * union.

    Returns per row: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Words are maximal runs of anything but ASCII white space, A-Z lower-cased.  A text with
    fewer words than a shingle is one shingle; a null text, or one without words, has
    none and is linked with nothing.  Rows that repeat an id count as one node.  A row with a null id
    has its n_shingles and a null component, and links nothing.  Other columns are not read.

    Equal sets are one node from the start, so copies are never paired.  Each signature's
    bucket is first a star: its first member against the others, which joins whole groups
    of near copies with a number of pairs that is linear in their size.  Only in buckets whose
    members are then not yet in one component, the other pairs between components are
    screened by an exact bound and checked too.  So no link between components is missed, and
    neither copies nor near copies make pairs of pairs.
    """
    scheme = Scheme(percent)
    small_batches(docs.sparkSession, 500)
    rows = written(set_rows(docs, words), "shingle-sets")
    known = rows.where("n > 0 and doc_id is not null")
    reps = written(known.groupBy("e1", "e2", "n").agg(F.min("doc_id").alias("rep"), F.first("hist").alias("hist"), F.count(F.lit(1)).alias("_n")), "set-groups")

    features = rows.agg(F.sum("n")).first()[0] or 0
    buckets = written(buckets_of(docs, words, scheme, max(shuffles(docs.sparkSession), features // BUCKET)), "buckets")
    star = written(screened(buckets.where("e1 <> x").select("x", F.col("e1").alias("y")).distinct(), reps, scheme), "star-pairs")
    texts = candidate_texts(docs, reps.join(buckets.select("e1").distinct(), "e1", "left_semi").select(F.col("rep").alias("doc_id")))
    links = connected(linked(star, texts, words, percent))

    # What the stars left apart: first each row's closest row of another component of its bucket, then all pairs.
    tested = star.select("x", "y")
    side = lambda p: reps.select(F.col("e1").alias(p), F.col("rep").alias(f"{p}_doc"))
    for closest in (True, False):
        label = reps.select("e1", "rep", "n", "hist").join(links.select(F.col("node").alias("rep"), "component"), "rep", "left").select("e1", "n", "hist", F.coalesce("component", "rep").alias("component"))
        placed = buckets.select("sig", "e1").join(label.select("e1", "component"), "e1")
        split = placed.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("sig")
        rest = buckets.select("sig", "e1").join(split, "sig").join(label, "e1").select("sig", "e1", "n", "hist", "component")
        dealt = rest.repartition(shuffles(docs.sparkSession), "sig").sortWithinPartitions("sig")
        found = dealt.mapInArrow(lambda batches, c=closest: sweep(batches, scheme, c), "x long, y long")
        # written before the join: else the join is moved below distinct and gets each pair once per bucket
        more = written(written(found.distinct(), "sweep-pairs").join(tested, ["x", "y"], "left_anti"), "new-pairs")
        if more.isEmpty():
            continue
        tested = tested.union(more)
        new = linked(more.join(side("x"), "x").join(side("y"), "y"), texts, words, percent)
        links = connected(new.union(links.select("node", "component")))

    groups = reps.join(links.select(F.col("node").alias("rep"), "component"), "rep", "left").select("e1", "e2", F.coalesce("component", "rep").alias("_component"), "rep", "_n").where("_n > 1 or _component <> rep").drop("rep")
    out = join_groups(rows.select("doc_id", "n", "e1", "e2"), groups, ["e1", "e2"], F.col("doc_id").cast("string"))
    linked_row = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked_row, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: The rows of ``components`` with words=3, percent=90.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), u AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (m + n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.node = e.x
), k AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, k.component_id FROM s JOIN k ON s.doc_id = k.doc_id
"""
