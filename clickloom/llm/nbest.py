"""SentencePiece encoding and decoding with N-best segmentations over the piece lattice."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches
from .tokencount import MARK, model, pretokens, safe_cuts

NBEST = 4
WORKER_CACHE = 400_000
SCALE = 1 << 16  # scores are multiples of 1 / SCALE, so that sums of them are exact
RANK_COST = 5.0
SHORT = 48  # characters up to which words are segmented many at a time
BLOCK = 8_192  # words that are segmented at a time
NONE = -(1 << 60)
_lattices: dict = {}


def piece_scores(sp) -> dict[int, float]:
    """Score by id of the pieces that spell text.

    A unigram model's scores are log-probabilities and taken as they are.  A BPE model's are
    the order of its merges, and their sum over a text means nothing; there, a piece's
    log-probability is taken from its rank by Zipf's law, -(RANK_COST + ln(rank)).
    """
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    given = [s for s in map(sp.get_score, ids) if s > -1e8]  # -1e9 marks pieces outside the order
    if all(s == int(s) for s in given) and all(a > b for a, b in zip(given, given[1:])):
        return {i: -(RANK_COST + math.log(k)) for k, i in enumerate(ids, 1)}
    return {i: sp.get_score(i) for i in ids}


class Lattice:
    """Pieces and scores of a model; a character that no piece spells is its bytes, at a penalty."""

    def __init__(self, path: str):
        sp = self.sp = model(path)
        scores = piece_scores(sp)
        self.score = {sp.id_to_piece(i): (round(s * SCALE), i) for i, s in scores.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.unknown = min(s for s, _ in self.score.values() if s > -1e8 * SCALE) - 10 * SCALE
        self.unk_id = sp.unk_id()
        self.spelled = set(scores)
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.joins = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.safe = safe_cuts(sp)
        self._trie()

    def _trie(self) -> None:
        """The pieces as a trie in arrays: the child of node s by character code c is target[base[s] + c], if check[base[s] + c] = s."""
        letters = sorted({c for p in self.prefixes for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        node = {"": 0} | {p: i for i, p in enumerate(sorted(self.prefixes), 1)}
        children: dict[int, list[tuple[int, int]]] = {}
        for p, i in node.items():
            if p:
                children.setdefault(node[p[:-1]], []).append((self.code[ord(p[-1])], i))
        room, rng = 16 * len(node), np.random.default_rng(0)
        self.base = np.zeros(len(node), np.int64)
        self.check, self.target = np.full(room + len(letters) + 1, -1, np.int32), np.zeros(room + len(letters) + 1, np.int32)
        for s, own in sorted(children.items(), key=lambda x: -len(x[1])):
            codes, to = np.array(own).T
            while (self.check[(at := int(rng.integers(room))) + codes] >= 0).any():
                pass
            self.base[s], self.check[at + codes], self.target[at + codes] = at, s, to
        self.node_score, self.node_id, self.node_length = np.full(len(node), NONE), np.full(len(node), -1), np.zeros(len(node), np.int64)
        for p, i in node.items():
            self.node_length[i] = len(p)
            if p in self.score:
                self.node_score[i], self.node_id[i] = self.score[p]

    def parts(self, word: str) -> list[str]:
        """Cut where no piece holds the two characters that meet, so that each part has a lattice of its own."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.joins]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def edges(self, text: str) -> list[list[tuple[int, int]]]:
        """By end position: (start, score), longest piece first."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for start in range(len(text)):
            for end in range(start + 1, len(text) + 1):
                piece = text[start:end]
                if piece not in self.prefixes and end > start + 1:
                    break
                if (hit := self.score.get(piece)) is not None:
                    out[end].append((start, hit[0]))
                elif end == start + 1:
                    out[end].append((start, self.unknown))
        return out

    @staticmethod
    def forward(edges: list[list[tuple[int, int]]]) -> list[int]:
        """Viterbi scores of the best segmentation of every prefix."""
        best = [0]
        for here in edges[1:]:
            best.append(max([best[start] + s for start, s in here]))
        return best

    def top(self, text: str, n: int) -> list[tuple[int, list[str]]]:
        """The ``n`` best segmentations in order, by A* from the end of the text.

        The forward score of a position is exactly what remains to be gained from it, so
        every pop that reaches the start is the next best segmentation.  Of equal scores, what was
        found last is followed first, the longest piece before others, so the first
        one goes straight to the start.  Paths are chains of parents.
        """
        edges = self.edges(text)
        ahead = self.forward(edges)
        found: list[tuple[int, list[str]]] = []
        parent, place = [-1], [len(text)]
        queue: list[tuple[int, int, int]] = [(-ahead[len(text)], 0, 0)]  # loss, -node, gained
        while queue and len(found) < n:
            _, node, gained = heapq.heappop(queue)
            node, at = -node, place[-node]
            if at == 0:
                cuts = []
                while node >= 0:
                    cuts.append(place[node])
                    node = parent[node]
                found.append((gained, [text[a:b] for a, b in zip(cuts, cuts[1:])]))
                continue
            for start, s in reversed(edges[at]):
                parent.append(node)
                place.append(start)
                heapq.heappush(queue, (-(gained + s + ahead[start]), 1 - len(place), gained + s))
        return found

    def two_best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word: best score, what the second best loses against it (-1 if there is none), and the best one's packed ids.

        Forward Viterbi with two scores per position.  Short words go through the trie
        together, position by position; long ones, and those with characters that no piece
        spells, by their parts, one after the other.
        """
        score, gap, packed = np.zeros(len(words), np.int64), np.full(len(words), -1), [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        order, rest = order[(sizes[order] <= SHORT) & (sizes[order] > 0)], np.flatnonzero(sizes > SHORT).tolist()
        for at in range(0, len(order), BLOCK):
            group = order[at : at + BLOCK]
            score[group], gap[group], own = self._two_best_of_short([words[k] for k in group.tolist()], sizes[group])
            for k, x in zip(group.tolist(), own):
                packed[k] = x
            rest += [k for k, x in zip(group.tolist(), own) if x is None]
        for k in rest:
            score[k], gap[k], pieces = 0, -1, []
            for part in self.parts(words[k]):
                s, g, p = self._two_best_of_long(part)
                score[k] += s
                gap[k] = g if gap[k] < 0 else gap[k] if g < 0 else min(gap[k], g)
                pieces += p
            packed[k] = self.packed(pieces)
        return score, gap, packed

    def _two_best_of_short(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """``words`` come longest first; the ids are None where a piece is unknown."""
        n, longest = len(words), int(sizes[0])
        codes = np.zeros((longest + 1, n), np.int32)
        flat = self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(n), sizes)] = flat
        best, second = np.full((longest + 1, n), NONE), np.full((longest + 1, n), NONE)
        via = np.full((longest + 1, n), -1, np.int32)  # node of the last piece; -1 is a character that no piece spells
        best[0] = 0
        for start in range(longest):
            row = np.arange(int(np.searchsorted(-sizes, -start)))  # words longer than start
            state = np.zeros(len(row), np.int64)
            for end in range(start + 1, longest + 1):
                slot = self.base[state] + codes[end - 1, row]
                hit = self.check[slot] == state
                if end == start + 1:
                    node = np.where(hit & (self.node_id[self.target[slot]] >= 0), self.target[slot], -1)
                    s = np.where(node >= 0, self.node_score[node], self.unknown)
                    at = row
                    row, state = row[hit], self.target[slot[hit]]
                else:
                    row, state = row[hit], self.target[slot[hit]]
                    if not len(row):
                        break
                    is_piece = self.node_id[state] >= 0
                    at, node = row[is_piece], state[is_piece]
                    s = self.node_score[node]
                x, top, next_ = best[start, at] + s, best[end, at], second[end, at]
                better = x > top  # of equal ones the first, which is the longest piece, stays
                second[end, at] = np.where(better, np.maximum(top, second[start, at] + s), np.maximum(next_, x))
                best[end, at] = np.maximum(x, top)
                via[end, at[better]] = node[better]
        column = np.arange(n)
        score, gap = best[sizes, column], best[sizes, column] - second[sizes, column]
        gap[second[sizes, column] <= NONE // 2] = -1
        # back along the best pieces, all words at once
        at, live, steps, strange = sizes.copy(), column, [], np.zeros(n, bool)
        count = np.zeros(n, np.int64)
        while len(live):
            node = via[at[live], live]
            strange[live[node < 0]] = True
            steps.append((live, self.node_id[node]))
            count[live] += 1
            at[live] -= np.where(node >= 0, self.node_length[node], 1)
            live = live[at[live] > 0]
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]), "<u4")
        for k, (who, own) in enumerate(steps, 1):
            ids[ends[who] - count[who] + (count[who] - k)] = own
        raw, cuts = ids.tobytes(), (ends * 4).tolist()
        return score, gap, [None if odd else raw[a:b] for odd, a, b in zip(strange.tolist(), [0, *cuts], cuts)]

    def _two_best_of_long(self, text: str) -> tuple[int, int, list[str]]:
        edges = self.edges(text)
        best, second, via = [0], [NONE], [0]
        for here in edges[1:]:
            top, next_, at = NONE, NONE, 0
            for start, s in here:
                x = best[start] + s
                if x > top:
                    top, next_, at = x, max(top, second[start] + s), start
                elif x > next_:
                    next_ = x
            best.append(top)
            second.append(next_)
            via.append(at)
        cuts, at = [len(text)], len(text)
        while at:
            at = via[at]
            cuts.append(at)
        cuts.reverse()
        return best[-1], best[-1] - second[-1] if second[-1] > NONE // 2 else -1, [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (hit := self.score.get(p)) is not None:
                out.append(hit[1])
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unk_id)
        return out

    def packed(self, pieces: list[str]) -> bytes:
        return np.array(self.ids(pieces), "<u4").tobytes()

    def plain(self) -> tuple[pa.Array, np.ndarray]:
        """By id: what a piece adds to a text, and whether that depends on what stands around it."""
        pieces = [self.sp.id_to_piece(i).replace(MARK, " ") for i in range(self.sp.get_piece_size())]
        ascii_ = {i: chr(b) for b, i in self.bytes.items() if b < 128}  # whatever bytes are next to it
        return pa.array([ascii_.get(i, p) for i, p in enumerate(pieces)], pa.string()), np.array([i not in self.spelled and i not in ascii_ for i in range(len(pieces))])

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids: marks become spaces, runs of byte pieces become characters, the first space goes."""
        return self.sp.decode(ids)


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def library_packed(sp, words: list[str]) -> list[bytes]:
    """Packed ids that the library gives each pre-token, wherever it stands.

    The library puts one mark before every text, so the space that a pre-token starts with is dropped first; others,
    and a space alone, are encoded behind a line feed, which is a pre-token of its own.
    """
    spaced = [len(w) > 1 and w[0] == " " for w in words]
    found = sp.encode([w[1:] if own else "\n" + w for w, own in zip(words, spaced)], num_threads=1)
    base = len(sp.encode("\n"))
    return [np.array(x if own else x[base:], "<u4").tobytes() for x, own in zip(found, spaced)]


def merge_top(lists: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` smallest sums of one entry from each ascending list, with the entries chosen."""
    sums: list[tuple[int, tuple[int, ...]]] = [(0, ())]
    for own in lists:
        sums = heapq.nsmallest(n, ((s + x, (*c, k)) for s, c in sums for k, x in enumerate(own)))
    return sums


class Encoder:
    """N-best segmentations of texts, with what is known of their pre-tokens in a cache of bounded size."""

    class _Words(dict):
        """Number of a pre-token; new ones are noted."""

        def __init__(self):
            super().__init__()
            self.new: list[str] = []

        def __missing__(self, word: str) -> int:
            self[word] = k = len(self)
            self.new.append(word)
            return k

    def __init__(self, path: str, nbest: int):
        self.lat, self.nbest = lattice(path), nbest
        self._forget()

    def _forget(self) -> None:
        self.words, self.names, self.packed, self.library, self.tops = self._Words(), [], [], [], {}
        self.score, self.gap, self.size = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _learn(self) -> None:
        new, at = self.words.new, len(self.names)
        if not new:
            return
        while len(self.score) < len(self.words):
            self.score, self.gap, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.score, self.gap, self.size))
        score, gap, packed = self.lat.two_best([w.replace(" ", MARK) for w in new])
        self.packed += packed
        self.library += [a if a == b else b for a, b in zip(packed, library_packed(self.lat.sp, new))]
        self.score[at : at + len(new)], self.gap[at : at + len(new)], self.size[at : at + len(new)] = score, gap, [len(x) for x in packed]
        self.names += new
        self.words.new = []

    def _top(self, k: int) -> tuple[list[int], list[bytes]]:
        """Losses and ids of the n best segmentations of pre-token k."""
        if k not in self.tops:
            found = self.lat.top(self.names[k].replace(" ", MARK), self.nbest)
            self.tops[k] = [int(self.score[k]) - s for s, _ in found], [self.lat.packed(p) for _, p in found]
        return self.tops[k]

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[float, list[float], list[bytes], bytes]]:
        """Best score, the n best scores, their packed ids, and the library's own packed ids, of each text."""
        if len(self.words) > WORKER_CACHE:
            self._forget()
        number = self.words.__getitem__
        rows = [list(map(number, pretokens(t, self.lat.safe))) for t in texts]
        self._learn()
        for numbers in rows:
            row = np.array(numbers, np.int64)
            whole = b"".join(map(self.packed.__getitem__, numbers))
            best, gaps = int(self.score[row].sum()), self.gap[row]
            open_ = np.flatnonzero(gaps >= 0)
            most = self.nbest - 1
            if len(open_) > most:
                edge = np.partition(gaps[open_], most - 1)[most - 1] if most else -1
                less, same = open_[gaps[open_] < edge], open_[gaps[open_] == edge]
                open_ = np.sort(np.concatenate([less, same[: most - len(less)]]))
            tops = [self._top(k) for k in row[open_].tolist()]
            sums = merge_top([losses for losses, _ in tops], self.nbest)
            size = self.size[row]
            ends = np.cumsum(size)[open_].tolist()
            starts = [e - s for e, s in zip(ends, size[open_].tolist())]
            lists = []
            for _, chosen in sums:
                parts, last = [], 0
                for c, a, e, (_, own) in zip(chosen, starts, ends, tops):
                    if c:
                        parts += (whole[last:a], own[c])
                        last = e
                lists.append(b"".join([*parts, whole[last:]]) if last else whole)
            yield best / SCALE, [(best - x) / SCALE for x, _ in sums], lists, b"".join(map(self.library.__getitem__, numbers))


def decode_lists(lists: pa.ListArray, lat: Lattice, plain: tuple[pa.Array, np.ndarray]) -> list[list[str | None] | None]:
    """Texts of lists of packed id sequences, each decoded whole.

    Sequences of plain pieces are put together in one go; those with bytes, the unknown
    piece or control pieces, and those that begin with more than one space, go to sentencepiece.
    """
    names, odd = plain
    raw = lists.flatten().to_pylist()
    ids = np.frombuffer(b"".join([x or b"" for x in raw]), "<u4")
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in raw)])
    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), names.take(pa.array(ids))).cast(pa.list_(pa.string())), "").to_pylist()
    strange = np.concatenate([[0], np.cumsum(odd[ids])])[ends]
    for i, (x, t) in enumerate(zip(raw, texts)):
        if x is None:
            texts[i] = None
        elif strange[i + 1] > strange[i] or t[:2] == "  ":
            texts[i] = lat.decode(ids[ends[i] : ends[i + 1]].tolist())
        else:
            texts[i] = t[1:] if t[:1] == " " else t
    sizes = pc.list_value_length(lists).to_pylist()
    starts = np.cumsum([0, *(n or 0 for n in sizes)]).tolist()
    return [None if n is None else texts[a : a + n] for a, n in zip(starts, sizes)]


def encode(docs: DataFrame, path: str, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The library's encoding and the ``nbest`` best segmentations of every whole text.

    Returns doc_id, text (as given), best_score, nbest_scores (descending), nbest_ids (each one's
    ids as little-endian unsigned 32-bit numbers, in the order of the scores), encoded_ids (the
    library's own encoding, in the same form).  Scores are sums of
    ``piece_scores``.  For a BPE model, the best segmentation is not always the one its
    merges lead to; that one is encoded_ids.

    No piece crosses a pre-token, so a document's lattice is the chain of its pre-tokens'
    lattices.  Workers keep the forward scores of each pre-token and what its second
    best loses, and its ids by the library, in a cache of bounded size.  A segmentation among the ``nbest`` differs from
    the best one only in the ``nbest`` - 1 pre-tokens that lose least, first ones first on
    ties; only for those the search is run, and their lists merged.  The scores are those of a
    search over the lattice of the whole text.

    Null and empty texts have one segmentation without pieces.  Ids are passed through,
    null or repeated; other columns are not read.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, nbest)
        for batch in batches:
            cols = list(zip(*encoder(batch.column(1).to_pylist()))) or [[]] * 4
            types = [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "text", "best_score", "nbest_scores", "nbest_ids", "encoded_ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string, best_score double, nbest_scores array<double>, nbest_ids array<binary>, encoded_ids binary")


def library_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ids (little-endian unsigned 32-bit numbers) as the library encodes every whole text in one piece; null counts as empty.

    ``encode`` puts the same ids together from those of pre-tokens.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        for batch in batches:
            ids = [np.array(x, "<u4").tobytes() for x in sp.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, path: str, ids_col: str = "nbest_ids", out_col: str = "decoded") -> DataFrame:
    """Add the texts of a column of lists of id sequences (little-endian unsigned 32-bit numbers).

    Every sequence is decoded whole.  A null list, or a null sequence in one, stays null.
    """
    small_batches(encoded.sparkSession, 500)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        plain = lat.plain()
        for batch in batches:
            out = pa.array(decode_lists(batch.column(at), lat, plain), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, StructType([*encoded.schema, *StructType.fromDDL(f"{out_col} array<string>")]))


def segment(docs: DataFrame, path: str, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the library's encoding and the ``nbest`` best segmentations of every whole text, encoded and decoded again.

    Returns doc_id, n_pieces (ids of the best one), best_score, nbest_scores (descending),
    nbest_crc32 (crc32 of each one's ids as little-endian unsigned 32-bit numbers),
    round_trip (every one of them, decoded whole, is the text; a text that holds the
    space mark itself comes back with spaces, as from the library), encoded_pieces, encoded_crc32 and
    encoded_round_trip (the same of the library's own encoding), encoded_rank (its place among the ``nbest``, from 1; null if
    it is none of them).

    ``encode`` and ``decode`` in one pass over the texts, a few at a time; nulls and repeated rows as there.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, nbest)
        plain = encoder.lat.plain()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple] = []
            found = list(encoder(texts))
            for a in range(0, len(found), 64):
                part = found[a : a + 64]
                decoded = decode_lists(pa.array([[*x[2], x[3]] for x in part], pa.list_(pa.binary())), encoder.lat, plain)
                for t, (best, scores, ids, own), (*back, own_back) in zip(texts[a : a + 64], part, decoded):
                    rank = ids.index(own) + 1 if own in ids else None
                    rows.append((len(ids[0]) // 4, best, scores, [zlib.crc32(x) for x in ids], all(x == (t or "") for x in back), len(own) // 4, zlib.crc32(own), own_back == (t or ""), rank))
            cols = list(zip(*rows)) or [[]] * 9
            types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    names = ["doc_id", "n_pieces", "best_score", "nbest_scores", "nbest_crc32", "round_trip", "encoded_pieces", "encoded_crc32", "encoded_round_trip", "encoded_rank"]
    schema = "doc_id long, n_pieces long, best_score double, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean, encoded_pieces long, encoded_crc32 long, encoded_round_trip boolean, encoded_rank int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)
