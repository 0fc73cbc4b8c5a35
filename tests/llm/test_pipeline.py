"""Every stage of the pipeline against a plain version, each on its own input."""

from __future__ import annotations

import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .conftest import frame
from .test_operators import brute_components, lower, plain_languages
from clickloom.llm import langid, secrets


@pytest.fixture(scope="module")
def steps(spark, texts):
    """Input and output of each stage."""
    docs, out = frame(spark, texts).cache(), []
    for _, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, docs, "").cache()
        out.append((docs, nxt))
        docs = nxt
    return out


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns(steps):
    assert all(b.columns == a.columns for a, b in steps[:-1])


def test_language(steps):
    a, b = map(by_id, steps[0])
    plain = plain_languages({i: (r["text"], r["lang"]) for i, r in a.items()})
    assert set(b) == {i for i, r in a.items() if plain[i][0] != "und" and (plain[i][1] >= corpus_pipeline.MIN_COSINE or len(r["text"]) < corpus_pipeline.MIN_CHARS)}
    assert any(plain[i][0] != "und" for i in set(a) - set(b))
    assert all(r["lang"] for r in b.values()) and all(b[i]["lang"] == a[i]["lang"] for i in b if a[i]["lang"])
    assert langid.DIM > 0


def test_exact(steps):
    a, b = map(by_id, steps[1])
    last = {lower(r["text"]): i for i, r in sorted(a.items())}
    assert set(b) == set(last.values()) and len(b) < len(a)


def test_near(steps):
    a, b = map(by_id, steps[2])
    ids = sorted(a)
    found = brute_components([a[i]["text"] for i in ids], 5, 80)
    assert set(b) == {ids[c] for _, c in found.values()}


def test_secrets(steps):
    a, b = map(by_id, steps[3])
    assert set(a) == set(b)
    for i, r in a.items():
        want = list(r["text"])
        for s, _, e in secrets.reference_spans(r["text"]):
            want[s:e] = "*" * (e - s)
        assert b[i]["text"] == "".join(want)
    assert any(a[i]["text"] != b[i]["text"] for i in a)


def test_packing(steps):
    a, b = by_id(steps[4][0]), steps[4][1].collect()
    assert {r["doc_id"] for r in b} == set(a) and max(r["offset"] + r["length"] for r in b) <= 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


LINK = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and on and on it goes again"


def through(spark, stage, rows):
    """(doc_id, text) of what a stage keeps of such rows."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect()), key=repr)


def test_language_of_repeated_and_null_ids(spark):
    rows = [(7, "some words"), (7, "12 34"), (7, "some words"), (None, "other words"), (None, "!!")]
    assert through(spark, corpus_pipeline.language_stage, rows) == [(7, "some words"), (7, "some words"), (None, "other words")]


def test_exact_of_repeated_and_null_ids(spark):
    rows = [(7, "A"), (7, "B"), (9, "a"), (7, "C"), (7, "C"), (7, "c"), (None, "A"), (None, "D"), (None, "d"), (None, "E"), (None, None), (None, "")]
    got = through(spark, corpus_pipeline.exact_stage, rows)
    assert [x for x in got if x[1]] == [(7, "B"), (7, "C"), (9, "a"), (None, "D"), (None, "E")] and len(got) == 6


def test_near_of_repeated_and_null_ids(spark):
    rows = [(7, LINK), (7, "nothing like it"), (5, LINK + " more"), (8, "twice the same"), (8, "twice the same"), (None, LINK + " still"), (None, "of no number"), (None, "of no number"), (None, "alone")]
    assert through(spark, corpus_pipeline.near_stage, rows) == sorted([(7, "nothing like it"), (5, LINK + " more"), (8, "twice the same"), (None, "of no number"), (None, "alone")], key=repr)


def test_secrets_of_repeated_and_null_ids(spark):
    rows = [(7, "password = hunter22"), (7, "plain text that is longer"), (7, None), (None, "token: abcdef12 x"), (None, "none"), (None, "")]
    got = through(spark, corpus_pipeline.secret_stage, rows)
    assert len(got) == 6 and {(7, "plain text that is longer"), (7, None), (None, "none"), (None, "")} <= set(got)
    for i, t in (rows[0], rows[3]):
        want = list(t)
        for s, _, e in secrets.reference_spans(t):
            want[s:e] = "*" * (e - s)
        assert "*" in want and (i, "".join(want)) in got


CLASHES = ["row", "key", "at", "kept", "spans", "_lang", "own", "group", "stays", "no_text", "lang_pred", "score", "_row", "_at", "_key", "_n", "rules", "component_id", "odd name", "a.b"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_clashing_names_and_empty_tables(spark, name, stage):
    rows = [(1, "password = hunter22 and so on"), (2, "PASSWORD = hunter22 and so on"), (3, LINK), (4, LINK + " more"), (None, "letters"), (6, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *(f"{c}{i}" for c in CLASHES)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    out = stage(spark, docs, "")
    if name == "packing":
        assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 6, None}
    else:
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in CLASHES)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_language_decides(spark):
    plain = "the quick dog and the slow fox went over the hill to see the house"
    rows = [(i, plain + str(i), "en", "s", 1) for i in range(8)] + [(100, "ЖЖЖЩЩЩ ЩЖЩЖ" * 12, "en", "s", 1), (101, plain, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_stage(spark, docs.where("doc_id <> 100"), "").collect()}
    assert out == {**{i: "en" for i in range(8)}, 101: "en"}
    scores = {r["doc_id"]: r["score"] for r in langid.identify(docs, train=docs.where("doc_id < 50")).collect()}
    assert scores[100] < corpus_pipeline.MIN_COSINE < min(scores[i] for i in range(8))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, unlabelled, "").count() == 10


def test_ties_in_stages(spark):
    rows = [(5, "tie"), (5, "tie"), (5, "TIE"), (5, "Tie")]
    assert len(through(spark, corpus_pipeline.exact_stage, rows)) == 1
    assert len(through(spark, corpus_pipeline.near_stage, [(5, LINK), (5, LINK), (5, LINK + " x")])) == 1


def test_very_many_secrets_in_one_text(spark):
    text = " é ".join(f"token: abcdef{i}" for i in range(10_000))
    began = time.monotonic()
    ((_, got),) = through(spark, corpus_pipeline.secret_stage, [(1, text)])
    want = list(text)
    for s, _, e in secrets.reference_spans(text):
        want[s:e] = "*" * (e - s)
    assert got == "".join(want) and time.monotonic() - began < 120


def shuffled_rows(df):
    """Rows that the last job of ``df`` wrote to a shuffle whose rows have a text."""
    df.collect()
    plans, n = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.finalPhysicalPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            if kind == "ShuffleExchangeExec" and "text:string" in p.schema().simpleString():
                n += p.metrics().apply("shuffleRecordsWritten").value()
            plans += [p.children().apply(k) for k in range(p.children().size())]
    return n


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_stage, corpus_pipeline.near_stage])
def test_rows_that_meet_nothing_are_not_shuffled(spark, stage):
    """At any size of the tables: without broadcasts of measured size, as where there are very many copies."""
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(12)), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, rows[0][1], "en", "s", 1), (901, rows[1][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stage(spark, docs, "")
        assert out.count() == 300
        assert shuffled_rows(out) < 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
