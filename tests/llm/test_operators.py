"""Each operator against a plain version of its contract, on texts of every odd kind."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from clickloom.llm import exact, langid, media, nbest, ngram_join, packing, secrets, suffix, tokencount, toxicity
from tests.oracle import compare

from .conftest import SCHEMA, frame

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


OPERATORS = {
    "langid": lambda d: langid.identify(d),
    "packing": lambda d: packing.pack_documents(d, BYTE),
    "tokencount": lambda d: tokencount.count_tokens(d, PIECE),
    "ngram_join": lambda d: ngram_join.components(d, 3, 90),
    "secrets": lambda d: secrets.scan_digests(d),
    "suffix": lambda d: suffix.remove_repeats(d),
    "exact": lambda d: exact.exact_groups(d),
    "nbest": lambda d: nbest.segment(d, PIECE),
    "media": lambda d: media.media_columns(d),
    "toxicity": lambda d: toxicity.score(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "1 as quality")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_repeated_rows_and_clashing_names(spark, texts, name):
    rows = [(None, "a text of no number", None, None, None), (None, None, None, None, None), (7, "same row", "en", "s", 8), (7, "same row", "en", "s", 8), (7, "other text", "en", "s", 8)]
    df = frame(spark, texts[:8], 100, clash=True)
    df = df.unionByName(spark.createDataFrame(rows, SCHEMA), allowMissingColumns=True)
    out = OPERATORS[name](df).collect()
    assert len(out) == 13
    assert Counter(r["doc_id"] for r in out)[7] == 3 and sum(r["doc_id"] is None for r in out) == 2


def test_language(spark, docs, texts):
    rng = random.Random(1)
    a, b = [f"{x}{y}" for x in ("th", "wh", "sh") for y in ("e", "ing", "ly")], [f"{x}{y}" for x in ("sch", "zu", "ge") for y in ("ung", "keit", "ä")]
    made = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(40)), "xx" if i % 2 else "yy", "s", 0) for i in range(80)] + [(100, "12 !", "xx", "s", 0), (101, None, "yy", "s", 0), (102, "", None, "s", 0)]
    out = table(langid.identify(spark.createDataFrame(made, SCHEMA)), "doc_id")
    assert all(out[i]["lang_pred"] == ("xx" if i % 2 else "yy") and 0 < out[i]["score"] <= 1 for i in range(80))
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (100, 101, 102))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())


def plain_languages(rows):
    """{id: (language, cosine)} of {id: (text, label)}, letter by letter: bind, bundle, compare."""
    table, letters = langid._worker(7, langid.DIM)
    letters = letters.astype(int)

    def bundle(text):
        symbols = [int(table[ord(c)]) for c in f" {text.lower()} "] if text else []
        if not any(symbols):
            return None
        out = np.zeros(langid.DIM)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            if a or b or c:
                out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    bundles = {i: bundle(t) for i, (t, _) in rows.items()}
    learned = {}
    for i, (_, lang) in rows.items():
        if lang and bundles[i] is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learned[lang] = learned.get(lang, 0) + bundles[i]
    out = {}
    for i, v in bundles.items():
        cosines = [(-float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), lang) for lang, p in learned.items()] if v is not None else []
        out[i] = (min(cosines)[1], max(0.0, -min(cosines)[0])) if cosines else ("und", 0.0)
    return out


def test_language_is_the_plain_cosine(docs, texts):
    out = table(langid.identify(docs), "doc_id")
    want = plain_languages({i: (t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)})
    for i, (lang, cosine) in want.items():
        assert np.isclose(out[i]["score"], cosine, atol=1e-4)
        assert out[i]["lang_pred"] == lang or cosine == 0 and lang != "und"


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert j.where("lang = lang_pred").count() >= 0.97 * j.count()


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(BYTE)
    out = table(packing.pack_documents(docs, BYTE), "doc_id", "piece")
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for (d, _), r in out.items() if d == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    bins = {}
    for r in out.values():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in out.values()) // 2048) + 1


def test_packed_ids_are_the_texts(docs, texts):
    from tokenizers import Tokenizer

    slow, own, bins = Tokenizer.from_file(BYTE), {}, {}
    for r in packing.pack_documents(docs, BYTE).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        own.setdefault(r["doc_id"], []).append((r["piece"], ids))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], ids))
    for i, t in enumerate(texts):
        ids = [x for _, part in sorted(own[i]) for x in part]
        assert ids[-1] == 0 and slow.decode(ids[:-1], skip_special_tokens=False) == (t or "")
    whole = [[x for _, part in sorted(b) for x in part] for b in bins.values()]
    assert max(map(len, whole)) <= 2048 and sum(w.count(0) for w in whole) >= len(texts)


def test_sum_of_squares_choice():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 60, 400)
    where, offset, fill = packing.sum_of_squares(items, 64)
    count, bins = Counter(), []
    for s, w in zip(items.tolist(), where.tolist()):
        def cost(gap):
            c = count.copy()
            if gap < 64:
                c[gap] -= 1
            if gap - s:
                c[gap - s] += 1
            return sum(v * v for v in c.values())

        best = min(cost(g) for g in {*(g for g in bins if g >= s), 64})
        gap = bins[w] if w < len(bins) else 64
        assert gap >= s and cost(gap) == best
        if w == len(bins):
            bins.append(64)
        else:
            count[gap] -= 1
        bins[w] -= s
        if bins[w]:
            count[bins[w]] += 1


def test_token_counts(docs, texts):
    sp = tokencount.model(PIECE)
    out = table(tokencount.count_tokens(docs, PIECE), "doc_id")
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)


def test_token_counts_of_space_marks(spark):
    """The library takes the space mark in a text for a space."""
    sp, rng = tokencount.model(PIECE), random.Random(6)
    made = ["▁  x", " ▁ ▁ x", "a▁▁  b", "▁ ", "▁", "▁▁\n▁ a▁b ▁"] + ["".join(rng.choice(" ▁▁ ab\nhe") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    out = table(tokencount.count_tokens(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), PIECE), "doc_id")
    assert [out[i]["n_tokens"] for i in range(len(made))] == [len(sp.encode(t)) for t in made]


def brute_components(texts, words, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(docs, texts, words, percent):
    out = {i: (r["n_shingles"], r["component_id"]) for i, r in table(ngram_join.components(docs, words, percent), "doc_id").items()}
    assert out == brute_components(texts, words, percent)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    rng, scheme = np.random.default_rng(percent), ngram_join.Scheme(percent)
    for _ in range(300):
        n = int(rng.integers(3, 400))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        a = pool[:n]
        for _ in range(50):
            cut, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
            b = np.sort(np.concatenate([a[cut:], pool[n : n + add]]))
            same = len(a) - cut
            if same and 100 * same >= percent * (len(a) + len(b) - same):
                break
        else:
            continue
        assert np.array_equal(a, b) or len(np.intersect1d(scheme.signatures(a), scheme.signatures(np.unique(b))))


def test_ngram_join_chain(spark):
    """A chain of near copies is one component, though its ends are far apart."""
    rng = random.Random(9)
    w, chain = [f"w{i}" for i in range(100)], []
    for _ in range(30):
        w = list(w)
        w[rng.randrange(100)] = f"n{rng.random()}"
        chain.append(" ".join(w))
    out = {i: (r["n_shingles"], r["component_id"]) for i, r in table(ngram_join.components(frame(spark, chain), 3, 90), "doc_id").items()}
    assert out == brute_components(chain, 3, 90)


def test_toxicity(spark):
    rng = random.Random(2)
    calm, rude = [f"{a}{b}" for a in "bcdfg" for b in ("ana", "olo", "eri", "usu")], ["grobbik", "vexmor", "snarlit", "drekka", "blivver"]
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(calm) for _ in range(40)]
        bad = i % 5 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            t[rng.randrange(40)] = rng.choice(rude)
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, int(bad), 1))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None)]
    out = table(toxicity.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")), "doc_id")
    held = [(out[i]["predicted"], y) for i, y, _ in labels if out[i]["held_out"]]
    assert len(held) > 60 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert out[1000]["score"] == out[1001]["score"] < 0.5


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.1)
    other = np.where(y[:, None], rng.random((4000, 2)) < 0.6, rng.random((4000, 2)) < 0.1)
    votes = np.column_stack([vote, vote, vote, other]).astype(float)
    model = toxicity.fit_label_model(votes, np.where(y, 0.97, 0.01))
    assert model.correlation[0, 1] > 0.9 and abs(model.correlation[0, 3]) < 0.3
    assert abs(model.rates[3, 1] - 0.6) < 0.06 and abs(model.rates[3, 0] - 0.1) < 0.04


def test_label_model_is_plain_em():
    """The posteriors against the same sums one vote at a time; correlations are those of the last round."""
    rng = random.Random(3)
    votes = [[float(rng.random() < (0.7 if y else 0.1)) for _ in range(4)] for y in [i % 3 == 0 for i in range(60)]]
    for v in votes:
        v[1] = v[0]  # a copy
    start = [0.9 if i % 3 == 0 else 0.1 for i in range(60)]
    for abstains in ([False] * 4, [True, True, False, True]):
        model = toxicity.fit_label_model(np.array(votes), np.array(start), np.array(abstains))
        q = start
        for _ in range(25):
            rates = [[min(1 - 1e-4, max(1e-4, (sum(w * v[k] for w, v in zip(side, votes)) + 0.05) / (sum(side) + 1.0))) for side in ([1 - x for x in q], q)] for k in range(4)]
            cov = [[sum(w * (v[a] - rates[a][y]) * (v[b] - rates[b][y]) for y, side in enumerate(([1 - x for x in q], q)) for w, v in zip(side, votes)) / 60 for b in range(4)] for a in range(4)]
            corr = [[1.0 if a == b else cov[a][b] / np.sqrt(max(cov[a][a], 1e-6) * max(cov[b][b], 1e-6)) for b in range(4)] for a in range(4)]
            share = [1 / np.sqrt(sum(max(0.0, x) for x in row if abs(x) >= 0.2)) for row in corr]
            logits = []
            for v, s in zip(votes, start):
                z = np.log(s / (1 - s))
                for k in range(4):
                    z += share[k] * v[k] * np.log(rates[k][1] / rates[k][0])
                    if not abstains[k]:
                        z += share[k] * (1 - v[k]) * np.log((1 - rates[k][1]) / (1 - rates[k][0]))
                logits.append(z)
            q = [1 / (1 + np.exp(-z)) for z in logits]
        assert np.allclose(model.posterior(np.array(votes), np.array(start)), q, atol=1e-6)


def test_toxicity_scores_are_the_plain_sums(texts):
    rng = random.Random(4)
    words = sorted({x for t in texts for x in toxicity.words_of(t)})
    weights = {toxicity.word_hash(w): rng.uniform(-2, 2) for w in words[::7]}
    c = toxicity.Classifier(weights, np.array([0.5, -0.25, 1.0, 0.75, 0.125]), -1.0)
    for t in [*texts, "WHAT A LONG LOUD LINE!!! you are an idiot, f**k go away"]:
        found = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        found |= {f"^{w[:k]}" for w in found for k in toxicity.STEMS if len(w) > k}
        z = -1.0 + sum(weights.get(toxicity.word_hash(w), 0.0) for w in found)
        z += sum(x for x, p in zip(c.patterns, toxicity.PATTERNS) if t and re.search(p, t))
        assert np.isclose(c.score(t), 1 / (1 + np.exp(-max(-30, min(30, z)))))


def test_secrets(docs, texts):
    out = table(secrets.scan_digests(docs), "doc_id")
    for i, t in enumerate(texts):
        spans = [f"{k}:{a}:{b}" for a, k, b in secrets.reference_spans(t)]
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        assert out[i]["spans"] == ",".join(spans)
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert set(q("(abc|xyz)[0-9]+")) == {frozenset({"abc"}), frozenset({"xyz"})}
    assert q("[0-9a-f]{24,}") == [] and q("ab?c") == []
    assert set(q("abx?cd")) == {frozenset({"abc", "bcd"}), frozenset({"abx", "bxc", "xcd"})}


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, texts):
    out = table(suffix.remove_repeats(docs), "doc_id")
    assert [tuple(out[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute_repeats(texts)


@pytest.mark.parametrize("group,pack", [(10, 500_000), (2, 50), (1_000, 50)])
def test_suffix_dedup_in_small_groups(spark, group, pack, monkeypatch):
    """An anchor with many surroundings, met in groups of ``group``; passages repeat whole, in part, and with what stands next to them."""
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "PACK", pack)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop qrstuvwxyzé") for _ in range(n))
    line, short, left, right = noise(260), noise(150), [noise(80) for _ in range(6)], [noise(80) for _ in range(6)]
    made = [noise(rng.randint(0, 90)) + rng.choice(left)[rng.randint(0, 60) :] + rng.choice([line, short]) + rng.choice(right)[: rng.randint(0, 80)] + noise(rng.randint(0, 90)) for _ in range(70)]
    made += [made[0], made[1], None, "", line, short, line + line, "ab" * 300, "ab" * 130 + "c"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    out = table(suffix.remove_repeats(df), "doc_id")
    assert [tuple(out[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(made))] == brute_repeats(made)


def test_suffix_dedup_keeps_text(docs, texts):
    for r in suffix.remove_repeats(docs, with_text=True).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        for s in reversed(r["spans"]):
            raw = raw[: s["start"]] + raw[s["end"] :]
        assert raw == bytes(r["kept"]) and hashlib.sha256(raw).hexdigest() == r["kept_sha256"]


def test_suffix_order():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (300, 40)).astype(np.uint8)
    length, group = rng.integers(0, 41, 300), np.sort(rng.integers(0, 5, 300))
    order, lcp = suffix.suffix_order(group, rows, length)
    key = lambda i: (group[i], bytes(rows[i, : length[i]]))
    got = [key(i) for i in order]
    assert got == sorted(map(key, range(300)))
    for a, b, n in zip(got, got[1:], lcp[1:]):
        want = 0
        while a[0] == b[0] and want < min(len(a[1]), len(b[1])) and a[1][want] == b[1][want]:
            want += 1
        assert n == want


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, texts, keep):
    out = table(exact.exact_groups(docs, keep=keep), "doc_id")
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    for i, t in enumerate(texts):
        g = groups[lower(t)]
        k = (max if keep == "largest" else min)(g)
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"], out[i]["text_sha256"]) == (k, len(g), i == k, hashlib.sha256(lower(t).encode()).hexdigest())


def test_exact_merge_sorts_in_every_round(spark):
    rows = spark.createDataFrame([(i % 37 if i % 11 else None, bytes([i % 23]), i % 23, 1) for i in range(2000)], "_id long, _sha binary, _chk long, _len int").repartition(13)
    for runs, keep in ((1, "largest"), (8, "largest"), (16, "smallest")):
        merged = exact.merge_runs(rows, runs, keep)
        got = {bytes(r["_sha"])[0]: (r["_keep"], r["_n"]) for r in merged.collect()}
        want = {}
        for i in range(2000):
            want.setdefault(i % 23, []).append(i % 37 if i % 11 else None)
        pick = max if keep == "largest" else min
        assert got == {k: (pick(x for x in v if x is not None), len(v)) for k, v in want.items()}
        plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        rounds = runs.bit_length() - 1
        assert len(re.findall(r"\bSort \[", plan)) >= rounds and len(re.findall(r"\bWindow \[", plan)) == rounds
        assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_dedup_is_the_sql(spark):
    from clickloom.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert compare(spark, queries.queries()[name], sql, "/root/testdata/sf0.01") == ""


def all_segmentations(lat, text):
    if not text:
        return [(0, [])]
    out = []
    for k in range(1, len(text) + 1):
        hit = lat.score.get(text[:k])
        s = hit[0] if hit else lat.unknown if k == 1 else None
        if s is not None:
            out += [(s + x, [text[:k], *rest]) for x, rest in all_segmentations(lat, text[k:])]
    return out


WORDS_ = ["▁hello", "▁fox", "é", "▁日本", "aaaaaa", "▁ther.", "\n", "▁▁▁x", "😀", "▁x😀y"]


@pytest.mark.parametrize("word", WORDS_)
def test_nbest_is_brute_force(word):
    lat = nbest.lattice(PIECE)
    want = sorted((s for s, _ in all_segmentations(lat, word)), reverse=True)
    got = lat.top(word, 5)
    assert [s for s, _ in got] == want[:5] and all("".join(p) == word for _, p in got)
    assert len({tuple(p) for _, p in got}) == len(got)


def test_two_best_agree_with_the_search():
    lat, rng = nbest.lattice(PIECE), random.Random(8)
    words = [*WORDS_, "", *("▁" * rng.randint(0, 2) + "".join(rng.choice("etaoinshrd éß_.日") for _ in range(rng.randint(1, 90))) for _ in range(300))]
    for w, score, gap, packed in zip(words, *lat.two_best(words)):
        best, *others = lat.top(w, 2)
        assert (score, packed) == (best[0], lat.packed(best[1]))
        assert gap == (best[0] - others[0][0] if others else -1)


def test_nbest_of_very_long_words():
    lat = nbest.lattice(PIECE)
    for word in ("a" * 200_000, "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(200_000))):
        began = time.process_time()
        found = lat.top(word, 4)
        assert len(found) == 4 and all("".join(p) == word for _, p in found) and found[0][0] >= found[3][0]
        assert time.process_time() - began < 60


def test_best_segmentation_mostly_is_the_library_one(spark):
    sp, lat = tokencount.model(PIECE), nbest.lattice(PIECE)
    words = [w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in tokencount.pretokens(r["text"]) if w[0] == " " and w.strip()]
    distinct = Counter(words)
    agree = sum(distinct[w] for w, own in zip(distinct, lat.two_best([w.replace(" ", "▁") for w in distinct])[2]) if np.frombuffer(own, "<u4").tolist() == sp.encode(w[1:]))
    assert agree >= 0.75 * len(words)


def test_nbest_of_documents(docs, texts):
    lat = nbest.lattice(PIECE)
    out = table(nbest.segment(docs, PIECE), "doc_id")
    for i, t in enumerate(texts):
        r = out[i]
        assert r["round_trip"] == (lat.decode(lat.ids([p for w in nbest.pretokens(t) for p in lat.top(w.replace(" ", "▁"), 1)[0][1]])) == t if t else True)
        assert r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) and len(set(r["nbest_crc32"])) == len(r["nbest_crc32"])
        if t and len(t) <= 8:
            want = sorted((s for s, _ in all_segmentations(lat, "▁" + t.replace(" ", "▁"))), reverse=True)[:4]
            assert r["nbest_scores"] == [s / nbest.SCALE for s in want]


def test_library_ids(docs, texts):
    sp = tokencount.model(PIECE)
    out = table(nbest.library_ids(docs, PIECE), "doc_id")
    assert all(np.frombuffer(out[i]["ids"], "<u4").tolist() == sp.encode(t or "") for i, t in enumerate(texts))


ODD = ["  two before", " one before", "trail ", " ", "    ", "\n", "\n \n", "a\n\nb", "▁mark ▁ ▁▁x", "\x00\x01 é\u0301", "<s> </s><unk><0x41>", "\u3000x\u200b\t\r\n", "😀😀 x"]


def test_nbest_holds_the_library_encoding(spark, docs, texts):
    sp, lat = tokencount.model(PIECE), nbest.lattice(PIECE)
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string"))
    out, digests = table(nbest.encode(both, PIECE), "doc_id"), table(nbest.segment(both, PIECE), "doc_id")
    assert len(out) == len(texts) + len(ODD)
    for i, r in out.items():
        want, d = sp.encode(r["text"] or ""), digests[i]
        assert np.frombuffer(r["encoded_ids"], "<u4").tolist() == want
        assert (d["encoded_pieces"], d["encoded_crc32"]) == (len(want), zlib.crc32(r["encoded_ids"]))
        assert d["encoded_round_trip"] == (sp.decode(want) == (r["text"] or ""))
        assert d["encoded_rank"] == (r["nbest_ids"].index(r["encoded_ids"]) + 1 if r["encoded_ids"] in r["nbest_ids"] else None)


def test_nbest_is_a_search_over_the_whole_text(texts):
    lat = nbest.lattice(PIECE)
    some = [t for t in [*texts, *ODD] if t]
    for t, (best, scores, ids, _) in zip(some, nbest.Encoder(PIECE, 4)(some)):
        want = lat.top((" " + t).replace(" ", "▁"), 4)
        assert scores == [x / nbest.SCALE for x, _ in want] and best == scores[0] and len(set(ids)) == len(ids)


def test_nbest_ids_and_decoding(spark, docs, texts):
    lat = nbest.lattice(PIECE)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(["  two before", " one before", "▁mark", "\x00\x01 é\u0301", "    "])], "doc_id long, text string")
    encoded = nbest.encode(docs.select("doc_id", "text").union(more), PIECE)
    own = table(nbest.decode(encoded, PIECE), "doc_id")
    digests = table(nbest.segment(docs.select("doc_id", "text").union(more), PIECE), "doc_id")
    assert len(own) == len(texts) + 5
    for i, r in own.items():
        lists = [np.frombuffer(x, "<u4").tolist() for x in r["nbest_ids"]]
        assert len({tuple(x) for x in lists}) == len(lists) == len(r["nbest_scores"])
        assert r["decoded"] == [lat.decode(x) for x in lists]
        d = digests[i]
        assert d["n_pieces"] == len(lists[0]) and d["nbest_crc32"] == [zlib.crc32(x) for x in r["nbest_ids"]]
        assert d["round_trip"] == all(x == (r["text"] or "") for x in r["decoded"])
    some = spark.createDataFrame([(1, [b"", None]), (2, None)], "k int, nbest_ids array<binary>")
    assert sorted((r["k"], r["decoded"]) for r in nbest.decode(some, PIECE).collect()) == [(1, ["", None]), (2, None)]


def test_media(docs, texts):
    out = table(media.media_columns(docs), "doc_id")
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        wav = media.wav_header(len(payload)) + payload
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(wav), hashlib.sha256(wav).hexdigest(), media.features(payload))


def test_media_filter_has_every_key(spark, monkeypatch):
    keys = spark.range(3000).selectExpr("cast(id as string) as _key")
    flagged = media._flagged(spark.range(20_000).selectExpr("cast(id as string) as _key", "id"), keys)
    assert flagged.where("id < 3000 and _maybe").count() == 3000 and flagged.where("id >= 3000 and not _maybe").count() > 16_000
    monkeypatch.setattr(media, "FILTER_BLOCKS", 8)  # full: all rows go the other way, none is lost
    full = media._flagged(spark.range(20_000).selectExpr("cast(id as string) as _key", "id"), keys)
    assert full.count() == 20_000 and full.where("id < 3000 and not _maybe").count() == 0


def test_media_of_null_ids_and_shared_chunks(spark):
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh \n") for _ in range(30_000))
    rows = [(None, "5\x01T"), (5, "T"), (5, "T"), (None, long_), (1, long_), (2, long_ + "end"), (3, "x" + long_), (None, None), (4, ""), (6, "y" * 70_000)]
    out = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((i, hashlib.sha256(media.payload_of(t)).hexdigest(), len((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["payload_sha256"], r["n_bytes"]) for r in out) == want


def test_wav_is_readable():
    import io
    import wave

    payload = media.payload_of("some samples")
    with wave.open(io.BytesIO(media.wav_header(len(payload)) + payload)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(b"some bytes in front" + data)
    assert b"".join(a) == data and all(len(c) <= media.MAX_CHUNK for c in a)
    assert len(set(a) & set(b)) >= len(a) - 2
