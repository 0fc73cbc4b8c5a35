"""Removal of repeated byte strings by a hash-compared suffix sort at sampled positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, shuffles, small_batches, written

LENGTH = 200
GRAM = 64  # bytes of an anchor; every string of LENGTH bytes holds the anchor chosen in it
SPAN = LENGTH - GRAM  # bytes by which such a string can reach over its anchor, on either side together
PACK = 500_000  # anchors that a task gathers before it sends them
GROUP = 1_000  # different surroundings of one anchor that are sorted together, about; more are dealt to several groups
BLOCK = 8_000_000
#: Ranges of the places s (how far before its anchor a string starts).  All strings of a range hold the
#: same core around the anchor.
RANGES = [(lo, min(lo + 34, SPAN)) for lo in range(0, SPAN + 1, 35)]

_B, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES, _BYTES2 = _mix(np.arange(1, 257, dtype=np.uint64) * _B), _mix(np.arange(1, 257, dtype=np.uint64) * _B2)
_powers: dict[np.uint64, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _B) -> np.ndarray:
    if len(_powers.get(base, ())) <= n or len(_powers[base]) > max(1 << 20, 4 * n):
        size = 1 << max(10, int(n).bit_length())
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]).astype(np.uint64), dtype=np.uint64)
    return _powers[base]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every ``k``-byte string of ``data``, by doubling."""
    p = powers(k)
    have, size, out, done = _BYTES[data], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = have
            else:  # what is done, then the next ``size`` bytes
                n = len(data) - done - size + 1
                out = out[:n] * p[size] + have[done : done + n]
            done += size
        if done == k:
            return _mix(out)
        have = have[:-size] * p[size] + have[size:]
        size *= 2


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: in each run of SPAN + 1 grams, the last of those whose hash is smallest.

    The choice looks at nothing but the bytes of that run, which are LENGTH bytes, so equal
    strings of LENGTH bytes choose equal anchors at equal places.  (Hashes are compared by
    their upper 40 bits, so that the place fits beside them.)
    """
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, GRAM)
    w, found = SPAN + 1, []
    for at in range(0, len(h) - w + 1, BLOCK):
        part = h[at : at + BLOCK + w - 1]
        key = (part & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | (np.uint64((1 << 24) - 1) - np.arange(len(part), dtype=np.uint64))
        # sliding minimum: of the tail of one block of w and the head of the next
        x = np.concatenate([key, np.full(-len(part) % w, np.uint64((1 << 64) - 1))]).reshape(-1, w)
        head = np.minimum.accumulate(x, axis=1).ravel()
        tail = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(tail[: len(part) - w + 1], head[w - 1 : len(part)])
        low = low[np.concatenate([[True], low[1:] != low[:-1]])] & np.uint64((1 << 24) - 1)
        found.append(at + (1 << 24) - 1 - low.astype(np.int64))
    at = np.unique(np.concatenate(found))
    return at, h[at]


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around anchors, SPAN on either side of the gram (0 outside the text), and how many there are left and right."""
    left, right = np.minimum(at, SPAN), np.minimum(len(data) - at, LENGTH)
    padded = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    return padded[at[:, None] + np.arange(SPAN + LENGTH)], left, right


def _prefix_hashes(rows: np.ndarray, table: np.ndarray = _BYTES, base: np.uint64 = _B) -> np.ndarray:
    """hash[i, j] of the first j bytes of row i, each byte weighted by a power of its position."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum(table[rows] * powers(rows.shape[1], base)[: rows.shape[1]], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def common_extension(prefix: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that rows i and j have in common from their start, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = prefix[i, mid] == prefix[j, mid]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_order(group: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by (group, bytes) with a mergesort, and what each has in common with the one before it.

    ``group`` ascends.  Runs are merged pairwise for all groups at once: the place of an
    element in the other run is found by binary search, and each comparison is a binary
    search for the common extension over prefix hashes, so it is logarithmic in the length.
    """
    prefix, n = _prefix_hashes(rows), len(rows)
    order = np.arange(n)
    start = np.searchsorted(group, group)  # first place of the group
    size = np.searchsorted(group, group, "right") - start

    def less(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        lcp = common_extension(prefix, length, a, b)
        ends_a, ends_b = lcp >= length[a], lcp >= length[b]
        x, y = rows[a, np.minimum(lcp, rows.shape[1] - 1)], rows[b, np.minimum(lcp, rows.shape[1] - 1)]
        return np.where(ends_a | ends_b, np.where(ends_a & ends_b, ties, ends_a), x < y)

    width = 1
    while n and width < size.max():
        live = np.flatnonzero(size > width)
        off = live - start[live]
        block = off // width
        mate = start[live] + (block ^ 1) * width  # first place of the run to merge with
        end = np.minimum(mate + width, start[live] + size[live])
        low, high = np.minimum(mate, end), end.copy()
        first = low.copy()
        right = (block & 1).astype(bool)
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            goes = less(order[mid], order[live[k]], right[k])  # ties: elements of the left run come first
            low[k], high[k] = np.where(goes, mid + 1, low[k]), np.where(goes, high[k], mid)
        new = start[live] + (block // 2) * 2 * width + off % width + (low - first)
        merged = order.copy()
        merged[new] = order[live]
        order = merged
        width *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = np.where(group[1:] == group[:-1], common_extension(prefix, length, order[1:], order[:-1]), 0)
    return order, lcp


def string_keys(group: np.ndarray, rows: np.ndarray, table: np.ndarray = _BYTES, base: np.uint64 = _B) -> np.ndarray:
    """A hash of each string of LENGTH bytes around each anchor, with its place and the anchor's own hash."""
    s = np.arange(SPAN + 1)
    prefix, p = _prefix_hashes(rows, table, base), powers(SPAN + LENGTH + 1, base)
    # freed of its place by the power of the distance to the end
    value = (prefix[:, SPAN - s + LENGTH] - prefix[:, SPAN - s]) * p[s][None, :]
    return _mix(value ^ _mix(s.astype(np.uint64) + base)[None, :] ^ _mix(group.view(np.uint64) * _M2)[:, None])


def repeated_starts(group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which strings of LENGTH bytes around each anchor occur around another anchor of its group.

    Result[i, s]: the string that starts s bytes before anchor i (0 <= s <= SPAN).
    """
    n = len(rows)
    out = np.zeros((n, SPAN + 1), bool)
    # how far each anchor's bytes agree with any other's, to the right and to the left
    reach = []
    for view, length in ((rows[:, SPAN:], right), (rows[:, :SPAN][:, ::-1], left)):
        order, lcp = suffix_order(group, np.ascontiguousarray(view), length)
        best = np.zeros(n, np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        reach.append(best)
    s = np.arange(SPAN + 1)
    may = (s >= LENGTH - reach[0][:, None]) & (s <= reach[1][:, None])
    live = np.flatnonzero(may.any(axis=1))
    if not len(live):
        return out
    key = string_keys(group[live], rows[live])
    i, j = np.nonzero(may[live])
    key = key[i, j]
    order = np.argsort(key)
    key, i, j = key[order], live[i[order]], j[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    for at in range(0, len(same), 100_000):  # equal hashes are checked on the bytes
        k = same[at : at + 100_000]
        a = rows[i[k][:, None], (SPAN - j[k])[:, None] + np.arange(LENGTH)]
        b = rows[i[k + 1][:, None], (SPAN - j[k + 1])[:, None] + np.arange(LENGTH)]
        ok = k[(a == b).all(axis=1) & (group[i[k]] == group[i[k + 1]]) & (j[k] == j[k + 1])]
        out[i[ok], j[ok]] = out[i[ok + 1], j[ok + 1]] = True
    return out


def merged(who: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals; they come sorted by (who, a), and those of one ``who`` are equally long but at a text's start."""
    if not len(who):
        return who, a, b
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (a[1:] > b[:-1])])
    first = np.flatnonzero(new)
    return who[first], a[first], b[np.append(first[1:], len(who)) - 1]


def anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """What anchors that occur more than once tell of a text (e1, e2); docs has e1, e2 and text.

    Rows with kinds 0 are intervals a to b that are repeated: unions of surroundings (all that a
    string of LENGTH bytes around an anchor can hold) that occur twice as a whole.  Rows with kinds > 1
    have an anchor at a with the hash h, which has so many different surroundings; they name
    one of each.

    Surroundings are equal if the anchor's 64-bit hash and two 64-bit hashes of all their bytes agree.
    A task settles what it meets twice itself and sends one of each surroundings, with
    whether there were more, packed by bucket (a hash range of anchors).  So what meets in a bucket is at most
    one row for each different surroundings and packet, however often they occur.  A text met before
    in the same task is not sent again.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        turn = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            if not held:
                return
            ents = np.array([x[0] for x in held], np.int64)
            who = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            pos, h, c1, c2 = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
            held.clear()
            order = np.argsort(h ^ (c1 >> np.uint64(1)), kind="stable")
            same = (h[order[1:]] == h[order[:-1]]) & (c1[order[1:]] == c1[order[:-1]]) & (c2[order[1:]] == c2[order[:-1]])
            again, before = np.concatenate([[False], same]), np.concatenate([same, [False]])
            twice = np.sort(order[again | before])
            x, a, b = merged(who[twice], np.maximum(pos[twice] - SPAN, 0), pos[twice] + LENGTH)
            spans = np.column_stack([ents[x], a, b]).astype("<i8")
            own, many = order[~again], before[~again]
            bucket = ((h[own] >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint32)
            order = np.lexsort((own, bucket))
            own, many, bucket = own[order], many[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(ends)).tolist():
                at = own[ends[k] : ends[k + 1]]
                texts, counts = np.unique(who[at], return_counts=True)
                out.append((k, h[at].tobytes(), c1[at].tobytes(), c2[at].tobytes(), pos[at].astype("<u4").tobytes(), many[ends[k] : ends[k + 1]].tobytes(), ents[texts].tobytes(), counts.astype("<u4").tobytes(), b""))
            for k in range(0, len(spans), 4_096):  # these only pass through
                turn += 1
                out.append((turn % buckets, *[b""] * 7, spans[k : k + 4_096].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], SENT)

        size = 0
        for batch in batches:
            for e1, e2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (e1, e2) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add((e1, e2))
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                at, h = anchors(data)
                if not len(at):
                    continue
                held.append(((e1, e2), at, h, *context_hashes(data, at)))
                size += len(at)
                if size > PACK:
                    yield from flush()
                    size = 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(e1, e2, a, b, kinds, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in (e1, e2, a, b, kinds, h)], ["e1", "e2", "a", "b", "kinds", "h"])

        held: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            for k, *row, spans in zip(*(batch.column(i).to_pylist() for i in range(len(SENT)))):
                if spans:
                    x = np.frombuffer(spans, "<i8").reshape(-1, 4)
                    yield result(*x.T, *np.zeros((2, len(x)), np.int64))
                else:
                    held.setdefault(k, []).append(tuple(row))
        for k in list(held):
            rows = held.pop(k)
            h, c1, c2, pos, many, ents, counts = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in enumerate(("<u8", "<u8", "<u8", "<u4", "?", "<i8", "<u4")))
            who = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(h, kind="stable")
            h = h[order]
            same = h[1:] == h[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | many[order]
            order, h = order[keep], h[keep]
            c1, c2, pos, many, (e1, e2) = c1[order], c2[order], pos[order].astype(np.int64), many[order], ents.reshape(-1, 2)[who[order]].T
            order = np.lexsort((~many, pos, e2, e1, c2, c1, h))
            h, c1, c2, pos, many, e1, e2 = (x[order] for x in (h, c1, c2, pos, many, e1, e2))
            new = np.ones(len(h), bool)  # not a text that several tasks met
            new[1:] = (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1]) | (pos[1:] != pos[:-1])
            h, c1, c2, pos, many, e1, e2 = (x[new] for x in (h, c1, c2, pos, many, e1, e2))
            if not len(h):
                continue
            first_h = np.concatenate([[True], h[1:] != h[:-1]])
            first_c = first_h | np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
            gid, cid = np.cumsum(first_h) - 1, np.cumsum(first_c) - 1
            kinds = np.bincount(gid[first_c])[gid]
            full = (np.bincount(cid) + np.bincount(cid, many) > 1)[cid]
            look = (kinds > 1) & first_c  # one of each surroundings, if there are others
            yield result(e1[full], e2[full], np.maximum(pos[full] - SPAN, 0), pos[full] + LENGTH, *np.zeros((2, int(full.sum())), np.int64))
            yield result(e1[look], e2[look], pos[look], pos[look], kinds[look], h[look].view(np.int64))

    sent = docs.mapInArrow(send, "bucket int, " + ", ".join(f"{c} binary" for c in SENT[1:]))
    return sent.repartition(buckets, "bucket").mapInArrow(meet, "e1 long, e2 long, a long, b long, kinds long, h long")


SENT = ["bucket", "h", "c1", "c2", "pos", "many", "ents", "counts", "spans"]


def context_hashes(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the surroundings of anchors, freed of their place, together with how they lie around the anchor."""
    n, out = len(data), []
    a, b = np.maximum(at - SPAN, 0), np.minimum(at + LENGTH, n)
    for table, base in ((_BYTES, _B), (_BYTES2, _B2)):
        p = powers(n + 1, base)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * p[:n], dtype=np.uint64)])
        value = (prefix[b] - prefix[a]) * p[n - a]  # times the power n, the same for one text only
        back = np.uint64(pow(pow(int(base), -1, 1 << 64), n, 1 << 64))
        out.append(_mix(value * back ^ _mix((at - a).astype(np.uint64) * base + (b - at).astype(np.uint64))))
    return out


def _arrays(b: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [*(b[c].to_numpy() for c in names), np.frombuffer(b"".join(b["ctx"].to_pylist()), np.uint8).reshape(-1, SPAN + LENGTH)]


def core_keys(rows: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Two hashes of the bytes that all strings of places lo to hi hold."""
    return [_mix(x[:, SPAN + LENGTH - hi] - x[:, SPAN - lo]) for x in (_prefix_hashes(rows, *kind) for kind in ((_BYTES, _B), (_BYTES2, _B2)))]


def edge_rows(surroundings: DataFrame, buckets: int) -> DataFrame:
    """Strings of LENGTH bytes around anchors with different surroundings, compared in groups of about GROUP members of one anchor.

    Rows with a null r are repeated intervals a to b of a text (e1, e2).  Where an anchor has several
    groups, rows with r (a range of RANGES) name the anchor (h, and a, its place in the text), two hashes of the range's
    core, and as bits which strings of the range the other groups should see (one of each different
    string of this group), and which of them this group has once.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "sub", "e1", "e2", "pos", "left", "right", "kinds")

        def settle(h, sub, e1, e2, pos, left, right, kinds, ctx) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])])).astype(np.int64)
            starts = repeated_starts(group, ctx, left, right)
            hit = np.flatnonzero(starts.any(axis=1))
            # the strings around an anchor all hold it, so what they cover is one interval
            first, last = SPAN - starts[hit, ::-1].argmax(axis=1), starts[hit].argmax(axis=1)
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(e1[hit]), pa.array(e2[hit]), pa.array(pos[hit] - first), pa.array(pos[hit] - last + LENGTH), *[none] * 6], EDGE)
            wide = np.flatnonzero(kinds > GROUP)
            if not len(wide):
                return
            s, rows = np.arange(SPAN + 1), ctx[wide]
            valid = (s <= left[wide][:, None]) & (LENGTH - s <= right[wide][:, None])
            alone = valid & ~starts[wide]
            show = alone.copy()
            i, j = np.nonzero(valid & starts[wide])
            at = np.unique(string_keys(group[wide], rows)[i, j], return_index=True)[1]
            show[i[at], j[at]] = True
            for r, (lo, hi) in enumerate(RANGES):
                own = np.flatnonzero(show[:, lo : hi + 1].any(axis=1))
                bits = [x[own, lo : hi + 1] @ (1 << np.arange(hi - lo + 1)) for x in (show, alone)]
                at = wide[own]
                c1, c2 = (x.view(np.int64) for x in core_keys(rows[own], lo, hi))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (e1[at], e2[at], pos[at], pos[at], h[at], np.full(len(at), r), c1, c2, *bits)], EDGE)

        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = _arrays(b, names)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(held[0]) >= 10_000:
                other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(other):  # the last group may go on in the next batch
                    whole = int(other[-1]) + 1
                    yield from settle(*(x[:whole] for x in held))
                    held = [x[whole:] for x in held]
        if held is not None:
            yield from settle(*held)

    sub = F.pmod(F.xxhash64("e1", "e2", "pos"), F.ceil(F.col("kinds") / GROUP)).alias("sub")
    dealt = surroundings.select("*", sub).repartition(buckets, "h", "sub").sortWithinPartitions("h", "sub")
    return dealt.mapInArrow(sort, ", ".join(f"{c} long" for c in EDGE))


EDGE = ["e1", "e2", "a", "b", "h", "r", "k1", "k2", "show", "alone"]


def across_groups(cores: DataFrame, surroundings: DataFrame) -> DataFrame:
    """Intervals e1, e2, a, b around anchors of several groups that hold strings of another group.

    Only strings whose core is found again are looked at.  Equal strings of all groups are combined before
    the shuffle; each one that its group has once is then compared byte by byte with the first of
    its equals, or, for the first itself, with the last.
    """
    place, core, key = F.struct("e1", "e2", "pos"), ["h", "r", "k1", "k2"], ["h", "s", "k1", "k2"]
    around = surroundings.select("h", "e1", "e2", "pos", "ctx").dropDuplicates(["h", "e1", "e2", "pos"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, e1, e2, pos, ctx = _arrays(b, ("h", "e1", "e2", "pos"))
            show, alone = (np.zeros((len(h), SPAN + 1), bool) for _ in range(2))
            for i, ranges in enumerate(b["ranges"].to_pylist()):
                for x in ranges:
                    lo, hi = RANGES[x["r"]]
                    for out, bits in ((show, x["show"]), (alone, x["alone"])):
                        out[i, lo : hi + 1] = bits >> np.arange(hi - lo + 1) & 1
            i, s = np.nonzero(show)
            k1, k2 = (string_keys(h, ctx, *x)[i, s].view(np.int64) for x in ((_BYTES, _B), (_BYTES2, _B2)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[i], e1[i], e2[i], pos[i], s, k1, k2, alone[i, s])], ["h", "e1", "e2", "pos", "s", "k1", "k2", "alone"])

    cores = cores.withColumnRenamed("a", "pos")
    again = cores.groupBy(*core).agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select(*core)
    seen = cores.join(again, core).groupBy("h", "e1", "e2", "pos").agg(F.collect_list(F.struct("r", "show", "alone")).alias("ranges"))
    strings = around.join(seen, ["h", "e1", "e2", "pos"]).mapInArrow(spell, "h long, e1 long, e2 long, pos long, s long, k1 long, k2 long, alone boolean")
    strings = written(strings, "group-strings")

    twice = strings.groupBy(*key).agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    own = strings.where("alone").join(twice, key).withColumn("mate", F.when(place == F.col("x"), F.col("y")).otherwise(F.col("x")))
    pairs = own.groupBy("h", "e1", "e2", "pos", "mate").agg(F.collect_set("s").alias("s"))  # SPAN + 1 numbers at most
    theirs = around.select(F.col("h").alias("mate_h"), F.struct("e1", "e2", "pos").alias("mate"), F.col("ctx").alias("mate_ctx"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for e1, e2, pos, starts, x, y in zip(*(b[c].to_pylist() for c in ("e1", "e2", "pos", "s", "ctx", "mate_ctx"))):
                same = [s for s in starts if x[SPAN - s : SPAN - s + LENGTH] == y[SPAN - s : SPAN - s + LENGTH]]
                if same:
                    out.append((e1, e2, pos - max(same), pos - min(same) + LENGTH))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["e1", "e2", "a", "b"])

    both = pairs.join(around, ["h", "e1", "e2", "pos"]).join(theirs, (F.col("h") == F.col("mate_h")) & (pairs["mate"] == theirs["mate"]))
    return both.select("e1", "e2", "pos", "s", "ctx", "mate_ctx").mapInArrow(verify, "e1 long, e2 long, a long, b long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of 200 bytes that also starts anywhere else.

    Returns per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256;
    with_text adds kept (bytes) and spans (array of start, end).

    Strings are judged on the input, within and across documents, and never cross
    documents.  Null counts as empty; texts under 200 bytes lose nothing.  Of equal texts
    every one loses all (from 200 bytes).  Rows that repeat an id are documents of their own;
    null ids are passed through.  An empty table gives an empty result.

    Every string of 200 bytes holds an anchor that its own bytes choose, so equal strings meet
    at equal anchors.  Anchors that occur once are dropped.  Surroundings of an anchor that occur as a whole elsewhere
    are repeated; that is decided by 192 bits of hashes.  Around the others, the text is sorted
    to the right and, reversed, to the left by a mergesort whose comparisons are binary
    searches over prefix hashes; that gives the longest extension shared with any other
    occurrence.  Strings within reach are matched by hash and verified byte by byte.  An anchor with
    very many surroundings is sorted in groups, and strings that groups share are verified as well.
    A text is known by 124 bits of two hashes of all its bytes.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("text").alias("e1"), F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long").alias("e2"))
    rows = written(keyed.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "e1", "e2", F.octet_length("text").cast("long").alias("n")), "texts")
    reps = rows.groupBy("e1", "e2").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("copies"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffles(spark), total // (LENGTH * 100_000))
    found = written(anchor_rows(keyed.select("e1", "e2", "text"), buckets), "anchors")

    edges = found.where("kinds > 0").groupBy("e1", "e2").agg(F.collect_list(F.struct(F.col("a").alias("pos"), "kinds", "h")).alias("at")).join(reps.select("e1", "e2", "_id"), ["e1", "e2"])
    cut = keyed.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(edges, ["e1", "e2", "_id"]).select("e1", "e2", "text", "at")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e1, e2, text, at in zip(b["e1"].to_pylist(), b["e2"].to_pylist(), b["text"], b["at"].to_pylist()):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                for k in range(0, len(at), 5_000):
                    part = at[k : k + 5_000]
                    pos = np.array([x["pos"] for x in part], np.int64)
                    ctx, left, right = contexts(data, pos)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x["h"] for x in part], pa.int64()), pa.array([e1] * len(part), pa.int64()), pa.array([e2] * len(part), pa.int64()), pa.array(pos), pa.array([x["kinds"] for x in part], pa.int64()),
                        pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array([r.tobytes() for r in ctx], pa.binary()),
                    ], ["h", "e1", "e2", "pos", "kinds", "left", "right", "ctx"])

    surroundings = cut.mapInArrow(around, "h long, e1 long, e2 long, pos long, kinds long, left int, right int, ctx binary")
    surroundings = written(surroundings.dropDuplicates(["h", "e1", "e2", "pos"]), "surroundings")
    near = written(edge_rows(surroundings, buckets), "edges")
    spans = found.where("kinds = 0").select("e1", "e2", "a", "b").unionByName(near.where("r is null").select("e1", "e2", "a", "b"))
    cores = near.where("r is not null")
    if not cores.isEmpty():  # some anchor has several groups
        spans = spans.unionByName(across_groups(cores, surroundings.where(F.col("kinds") > GROUP)))

    spans = spans.groupBy("e1", "e2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    # a copied text goes whole, so its spans are not needed, and what is broadcast for texts with very many copies is small
    known = spans.join(reps.where("copies > 1").select("e1", "e2", "copies"), ["e1", "e2"], "full")
    known = known.select("e1", "e2", F.when(F.col("copies").isNull(), F.col("spans")).alias("spans"), F.col("copies").isNotNull().alias("copied"), F.coalesce("copies", F.lit(1)).alias("_n"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, spans_, copied in zip(b["doc_id"].to_pylist(), b["text"], b["spans"].to_pylist(), b["copied"].to_pylist()):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                n, gone = len(raw), []
                if copied and n >= LENGTH:
                    gone = [(0, n)]
                else:
                    for x in spans_ or []:
                        a, e = x["a"], min(x["b"], n)
                        if gone and a <= gone[-1][1]:
                            gone[-1] = (gone[-1][0], max(gone[-1][1], e))
                        else:
                            gone.append((a, e))
                kept, last = [], 0
                for a, e in gone:
                    kept.append(raw[last:a])
                    last = e
                kept.append(raw[last:])
                rest = b"".join(kept)
                out.append((doc_id, n, n - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), *((rest, [{"start": a, "end": e} for a, e in gone]) if with_text else ())))
            cols = list(zip(*out)) if out else [[]] * (7 if with_text else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] if with_text else [])]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,end:long>>" if with_text else "")
    return join_groups(keyed, known, ["e1", "e2"], F.col("doc_id").cast("string")).select("doc_id", "text", "spans", "copied").mapInArrow(remove, schema)


#: The rows of ``remove_repeats``, by grouping all strings of 200 bytes.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM p) WHERE c > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY doc_id, k),
z AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS aa, list(e ORDER BY a) AS ee FROM s GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN aa IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(aa) + 2), lambda j: substr(h, CAST(2 * coalesce(ee[j - 1], 0) + 1 AS BIGINT), CAST(2 * (coalesce(aa[j], length(h) // 2) - coalesce(ee[j - 1], 0)) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""
