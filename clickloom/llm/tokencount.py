"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Rows that the table of frequent pre-tokens is counted on, about, its size, and the letters of its longest entry.  These are
#: bounds on memory and time only: any pre-token that the table lacks is encoded, so counts are exact.
SAMPLE_ROWS, TABLE_SIZE, TABLE_WORD = 2_000, 50_000, 64
WORKER_CACHE = 400_000

#: A space starts a pre-token and nothing else does: in the vocabulary, the space mark stands at the
#: start of a piece or in a run of marks only, and no piece holds a line feed (checked by safe_cuts).
PRETOKEN = re.compile(r"\n| *[^ \n]+| +")
MARK = "▁"

_models: dict = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pretokens(text: str | None, safe: bool = True) -> list[str]:
    """Pre-tokens of a text behind the space that the library puts before it; none of an empty one.

    The library takes the space mark in a text for a space, so runs of both are one run.
    """
    if not text:
        return []
    text = " " + text.replace(MARK, " ")
    return PRETOKEN.findall(text) if safe else [text]


def safe_cuts(sp) -> bool:
    """Whether no piece crosses a boundary of PRETOKEN and the normaliser leaves text as it is."""
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        if "\n" in piece or MARK in piece.lstrip(MARK) or sp.is_unused(i):
            return False
    probe = "a  b\n\n c\t Ａ é "
    return sp.normalize(probe) == MARK + probe.replace(" ", MARK)


def frequent(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample of rows from all partitions, as a compact table.

    Tasks count their own rows and send the most frequent short pre-tokens, about twice the table in all;
    no text reaches the driver.
    """
    total = docs.count()
    if not total:
        return {}
    own = max(500, 2 * TABLE_SIZE // max(1, docs.rdd.getNumPartitions()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(pretokens(text.as_py()))
                if len(counts) > WORKER_CACHE:
                    counts = Counter({w: n for w, n in counts.items() if n > 1})
        top = heapq.nlargest(own, ((n, w) for w, n in counts.items() if len(w) <= TABLE_WORD))
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w in top], pa.string()), pa.array([n for n, _ in top], pa.int64())], ["word", "n"])

    sample = docs.select(text_col).sample(min(1.0, SAMPLE_ROWS / total), seed=3)
    found: Counter = Counter()
    for word, n in sample.mapInArrow(count, "word string, n long").toLocalIterator():
        found[word] += n
    words = [w for w, _ in heapq.nlargest(TABLE_SIZE, found.items(), key=lambda x: (x[1], x[0]))]
    return dict(zip(words, pretoken_lengths(model(path), words)))


def pretoken_lengths(sp, words: list[str]) -> list[int]:
    """Tokens of each pre-token, wherever it stands: its spaces become marks and no other mark is added.

    The model puts one mark before every text, so the space that a pre-token starts with
    is dropped first; one without a space is measured behind a line feed, which is a
    pre-token of its own with a known length.
    """
    out = []
    base = None
    spaced = [w[1:] if w[:1] == " " else None for w in words]
    plain = [x for x in spaced if x]
    encoded = iter(sp.encode(plain, num_threads=1) if plain else [])
    for w, x in zip(words, spaced):
        if x:
            out.append(len(next(encoded)))
        elif x is None:
            if base is None:
                base = len(sp.encode("\n"))
            out.append(len(sp.encode("\n" + w)) - base)
        else:
            out.append(1)
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Tier one is a broadcast table of at most TABLE_SIZE frequent pre-tokens; tier two is a
    cache of bounded size in each worker, filled by encoding what it lacks.  No pre-token
    is ever shuffled.  If the model's vocabulary has pieces that cross pre-tokens, texts
    are encoded whole instead.  Null and empty texts have 0 bytes and 0 tokens.  Ids are
    passed through, null or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    safe = safe_cuts(model(path))
    table = spark.sparkContext.broadcast(frequent(docs, path, text_col) if safe else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known, cache = model(path), table.value, {}
        both = _Both(cache, known)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            if not safe:
                n = [len(x) for x in sp.encode(texts, num_threads=1)]
            else:
                # a special string inside a text is ordinary text for this library
                words = list(map(pretokens, texts))
                if len(cache) > WORKER_CACHE:
                    cache.clear()
                missing = list({w for ws in words for w in ws} - known.keys() - cache.keys())
                cache.update(zip(missing, pretoken_lengths(sp, missing)))
                n = [sum(map(both.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class _Both(dict):
    """Tier one, and behind it tier two."""

    def __init__(self, cache: dict, known: dict):
        super().__init__(known)
        self.cache = cache

    def __missing__(self, key):
        return self.cache[key]
