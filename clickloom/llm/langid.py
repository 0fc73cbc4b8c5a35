"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_bucket, row_of, small_batches

SYMBOLS = 64  # 0: anything but a letter; 1-26: a-z; the others: further letters, folded
DIM = 512
BLOCK = 64  # documents per matrix product


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    table[128:] = [(c % (SYMBOLS - 27) + 27) if chr(c).isalpha() else 0 for c in range(128, 0x110000)]
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    return table


_state: dict = {}


def _worker(seed: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol table and letter vectors, made once per worker."""
    if "table" not in _state:
        _state["table"] = _symbol_table()
    if ("letters", seed, dim) not in _state:
        _state["letters", seed, dim] = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
    return _state["table"], _state["letters", seed, dim]


def codes(text: str | None, table: np.ndarray) -> np.ndarray | None:
    """Trigram codes of a text, padded with one non-letter at both ends; None without a letter."""
    if not text:
        return None
    symbols = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    if not symbols.any():
        return None
    c = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    return c[c > 0]


def trigram_vectors(c: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bind letter vectors into trigram vectors; the position of a letter is a permutation (a rotation)."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[c // (SYMBOLS * SYMBOLS)] * second[c // SYMBOLS % SYMBOLS] * letters[c % SYMBOLS]


def learn(rows: DataFrame, seed: int = 7, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Bundle a prototype per language from all rows of (text, lang) with a non-null lang.

    Tasks count trigrams per language and only sums are shuffled; what reaches the driver
    is at most SYMBOLS**3 counts for each language, whatever the number of documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _worker(seed, dim)
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                nz = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(nz), pa.string()), pa.array(nz, pa.int64()), pa.array(n[nz], pa.int64())], ["lang", "code", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                if (c := codes(text, table)) is not None:
                    if lang not in sums:
                        if len(sums) >= 32:
                            yield from flush()
                        sums[lang] = np.zeros(SYMBOLS**3, np.int64)
                    np.add.at(sums[lang], c, 1)
        yield from flush()

    found = rows.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    letters = _worker(seed, dim)[1]
    prototypes = np.zeros((len(langs), dim), np.float32)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        c, n = own["code"].to_numpy(), own["n"].to_numpy().astype(np.float64)
        for at in range(0, len(c), 4096):
            prototypes[i] += (n[at : at + 4096] / n.sum()) @ trigram_vectors(c[at : at + 4096], letters).astype(np.float32)
        prototypes[i] /= max(np.linalg.norm(prototypes[i]), 1e-12)
    return langs, prototypes


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, seed: int = 7, dim: int = DIM, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Predict the language of every whole text: doc_id, lang_pred, score.

    A document is the bundle of its trigram vectors; its language is the prototype with
    the largest cosine, which is the score (0 where negative).  Ties go to the first
    language by name.  Null texts, and texts without a letter, give ``und`` and 0.0, as do
    all texts if no language was learned.  Ids are passed through, null or repeated.  With
    ``whole``, all columns of a row come along in a struct ``row``.
    """
    small_batches(docs.sparkSession)
    langs_, protos = list(langs), prototypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, letters = _worker(seed, dim)
        for batch in batches:
            texts = batch.column(1)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            block: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                if not block or not langs_:
                    block.clear()
                    return
                joined = np.concatenate([c for _, c in block])
                seen = np.zeros(SYMBOLS**3, bool)
                seen[joined] = True
                distinct = np.flatnonzero(seen)
                at = np.cumsum(seen, dtype=np.int32) - 1
                rows = np.repeat(np.arange(len(block)), [len(c) for _, c in block])
                counts = np.bincount(rows * len(distinct) + at[joined], minlength=len(block) * len(distinct)).reshape(len(block), -1).astype(np.float32)
                bundles = counts @ trigram_vectors(distinct, letters).astype(np.float32)
                cosines = bundles @ protos.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                for (i, _), best, c in zip(block, cosines.argmax(axis=1), cosines.max(axis=1)):
                    pred[i], score[i] = langs_[best], min(1.0, max(0.0, float(c)))
                block.clear()

            size = 0
            for i, text in enumerate(texts):
                if (c := codes(text.as_py(), table)) is not None and len(c):
                    block.append((i, c))
                    size += len(c)
                    if len(block) >= BLOCK or size > 1_000_000:
                        settle()
                        size = 0
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    rest = [row_of(docs).alias("row")] if whole else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    return rows.mapInArrow(run, StructType([*StructType.fromDDL("doc_id long, lang_pred string, score double"), *rows.schema[2:]]))


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: crc32(doc_id) mod 4 is not 2 (a null doc_id is not held out), lang is known."""
    return docs.where(F.coalesce(crc_bucket(F.col("doc_id"), 4), F.lit(0)) != 2).where("lang is not null")


def identify(docs: DataFrame, train: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 4 is not 2, then predict all of ``docs``.

    Returns doc_id, held_out, lang_pred, score, and with ``whole`` the struct row of all
    columns.  A null doc_id is never held out.
    """
    train = docs if train is None else train
    small_batches(docs.sparkSession)
    langs, prototypes = learn(training_rows(train))
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs, langs, prototypes, whole=whole).select("doc_id", held.alias("held_out"), "lang_pred", "score", *(["row"] if whole else []))
