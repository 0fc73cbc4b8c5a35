"""Sources, encoders, sketches, auctions, metrics and streams on small frames."""

from __future__ import annotations

import hashlib
import math
import os
import zlib

import pytest
from pyspark.sql import functions as F

from clickloom import cli, contracts, reports, schema
from clickloom.functions import scalar as X
from clickloom.operators import auction, drift, features, metrics, profile, significance, sketches, validate
from clickloom.plans import pipelines
from clickloom.sources import clicklog as C
from clickloom.streaming import queries as S


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,day,hod", [("14102100", 20141021, 0), ("14102123.0", 20141021, 23), (" 2014102105 ", 20141021, 5), ("1010100", 20010101, 0)])
def test_hour(spark, text, day, hod):
    assert one(spark, X.hour_day, text) == day and one(spark, X.hour_of_day, text) == hod


@pytest.mark.parametrize("text", ["", "abc", "héllo wörld", "日本語", "x" * 3000])
def test_checksums(spark, text):
    assert one(spark, X.adler32, text) == zlib.adler32(text.encode())
    assert one(spark, lambda c: F.crc32(F.encode(c, "UTF-8")), text) == zlib.crc32(text.encode())


@pytest.mark.parametrize("value", ["17", None])
def test_unit_hash(spark, value):
    want = int(hashlib.md5(f"split_v1|{value or '__NULL__'}".encode()).hexdigest()[:8], 16) / 2**32
    assert one(spark, lambda c: X.unit_hash("split_v1", c), value) == want


def test_statistics(spark):
    r = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 10)], "k int, n int").select("k", "n", X.wilson(F.col("k"), F.col("n"))[0].alias("lo"), X.wilson(F.col("k"), F.col("n"))[1].alias("hi"), X.z_score(F.col("k"), F.col("n"), F.lit(0.2)).alias("z"), X.ratio(F.col("k"), F.col("n")).alias("r")).collect()
    assert (r[0].lo, r[0].hi, r[0].z, r[0].r) == (0, 0, 0, 0)
    assert r[1].lo == 0 and r[2].hi == 1 and r[3].lo < 0.3 < r[3].hi
    assert math.isclose(r[3].z, 0.1 / math.sqrt(0.016))


def test_splits(spark):
    df = spark.range(100).select(F.col("id").alias("_id"), (F.col("id") % 10).cast("int").alias("_day"))
    out = C.SplitSpec(train_end_day=5, valid_day=6, test_days=[7, 8]).assign(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 60, "valid": 10, "test": 20}
    with pytest.raises(ValueError, match="overlap"):
        C.SplitSpec(train_end_day=5, valid_day=5).assign(df)
    with pytest.raises(ValueError):
        C.SplitSpec(method="random", train_ratio=0.9).assign(df)
    with pytest.raises(ValueError):
        C.SplitSpec(method="else").assign(df)
    assert C.SplitSpec(method="none").assign(df).where("split = 'train'").count() == 100


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = [(1, "14102100", "a", None), (0, "14102101", "b", "x"), (1, "14102200", "a", "x"), (0, "14102300", "c", "y")]
    spark.createDataFrame(rows, "click int, hour string, C3 string, app_id string").coalesce(1).write.parquet(f"{root}/raw")
    spark.createDataFrame([("14102400", "a")], "hour string, site_id string").write.parquet(f"{root}/external")
    config = {"source": "click_log", "params": {"train_path": f"{root}/raw", "test_path": f"{root}/external"}, "split": {"train_end_day": 20141021, "valid_day": 20141022, "test_day": 20141023}}
    return root, config, pipelines.materialize(spark, config, f"{root}/log")


def test_materialize(spark, store):
    root, config, totals = store
    assert totals == {"train": 2, "valid": 1, "test": 2}
    log = C.read_canonical(spark, f"{root}/log")
    assert validate.schema_problems(log, schema.FEATURES) == []
    assert sorted(r["_id"] for r in log.where("split <> 'test'").collect()) == ["0", "1", "2"]
    t = log.where("_id = '0' and split = 'train'").first()
    assert (t["site_id"], t["app_id"], t["device_ip"], t["_hod"], t["_label_click"]) == ("a", "__MISSING__", "__MISSING__", 0, 1)
    assert log.where("_label_click is null").count() == 1 and validate.violations(log).agg(F.sum("violations")).first()[0] == 0
    plan = C.read_canonical(spark, f"{root}/log", "valid")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    pipelines.materialize(spark, config, f"{root}/log")
    assert pipelines.files_index(spark, f"{root}/log").agg(F.sum("rows")).first()[0] == 5


def test_strict_scan_and_missing_label(spark, store):
    root = store[0]
    with pytest.raises(ValueError, match="missing"):
        C.ClickLogSource(f"{root}/raw", strict=True).scan(spark, f"{root}/raw")
    with pytest.raises(ValueError, match="click"):
        s = C.ClickLogSource(f"{root}/external")
        s.canonicalize(s.scan(spark, f"{root}/external"))
    with pytest.raises(ValueError):
        C.SOURCES.register("click_log")(object)
    with pytest.raises(KeyError):
        C.SOURCES.get("none such")


def test_profile_of_a_store(spark, store):
    root = store[0]
    names = pipelines.run_profile(spark, f"{root}/log", f"{root}/out", ["site_id", "app_id"])
    assert len(names) == 13 and all(os.path.exists(f"{root}/out/{n}") for n in names)
    assert spark.read.parquet(f"{root}/out/pair_interaction_summary").count() == 1


def log_frame(spark, rows):
    """(split, day, value, label)"""
    return spark.createDataFrame([(str(i), d, 0, y, v, s) for i, (s, d, v, y) in enumerate(rows)], "_id string, _day int, _hod int, _label_click int, f string, split string")


def test_missing_and_ties(spark):
    m = schema.MISSING
    log = log_frame(spark, [("train", 1, v, 1) for v in [m, m, m, "b", "b", "a", "a", "c"]] + [("test", 9, v, None) for v in ["a", "z", m]])
    c = profile.cube(log, ["f"]).cache()
    assert [r["value"] for r in profile.top_k(c, 3).orderBy("rank").collect()] == [m, "a", "b"]
    assert profile.coverage(c, [4], 4).first()["coverage_non_missing"] == 8 / 5
    assert profile.coverage(c, [3], 3, exclude_missing=True).first()["coverage_non_missing"] == 1.0
    r = profile.out_of_vocabulary(c, 3).first()
    assert (r["oov_row_rate"], r["oov_unique_est"]) == (1 / 3, 1)
    assert {r["bin"] for r in drift.psi_components(c, 1).collect()} == {m, schema.OTHER}
    assert profile.ctr_by_day(log).where("split = 'test'").count() == 0


def test_novelty_counts_first_day_once(spark):
    log = log_frame(spark, [("train", 1, "a", 0), ("train", 1, "a", 0), ("train", 2, "a", 0), ("train", 2, "b", 0), ("test", 3, "c", 0), ("test", 3, "c", 0), ("test", 3, "a", 0), ("test", 3, "b", 0)])
    out = {r["day"]: r["new_row_rate"] for r in drift.novelty(profile.cube(log, ["f"])).collect()}
    assert out == {1: 0.5, 2: 0.5, 3: 0.5}


def test_pairs_without_columns(spark):
    log = log_frame(spark, [("train", 1, "a", 1)])
    cells = significance.pair_cells(log, profile.cube(log, ["f"]), [("no", "such")])
    assert significance.pair_combos(cells).count() == 0 and significance.pair_summary(cells).count() == 0


@pytest.mark.parametrize("n", [1, 200, 20_000])
def test_hyperloglog(spark, n):
    df = spark.range(n).select(F.lit("f").alias("feature"), F.md5(F.col("id").cast("string").cast("binary")).alias("value"))
    reg = sketches.hll_registers(df, ["feature"])
    assert abs(sketches.hll_estimate(sketches.hll_merge(reg, reg, ["feature"]), ["feature"]).first()["estimate"] - n) <= max(1, 0.04 * n)
    if n == 200:
        want: dict[int, int] = {}
        for i in range(n):
            h = zlib.crc32(hashlib.md5(str(i).encode()).hexdigest().encode())
            want[h & 16383] = max(want.get(h & 16383, 0), 18 - (h >> 14).bit_length() + 1)
        assert {r["bucket"]: r["rank"] for r in reg.collect()} == want


def test_bloom(spark):
    df = spark.range(300).select(F.lit("f").alias("feature"), F.col("id").cast("string").alias("value"))
    bits = sketches.bloom_bits(df.where("value < 150"), ["feature"])
    out = {r["value"]: r["may_contain"] for r in sketches.bloom_contains(df, bits, ["feature"]).collect()}
    assert all(out[str(i)] for i in range(150)) and sum(out[str(i)] for i in range(150, 300)) < 30


def test_auctions(spark, tmp_path):
    bids = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 9.0), ("a", "z", 7.0), ("b", "x", 4.0)], "auction_id string, bidder_id string, bid_price double")
    price = lambda **k: {(r["auction_id"], r["bidder_id"]): r["price"] for r in auction.simulate(bids, ["bidder_id"], **k).collect()}
    assert price() == {("a", "y"): 7.0, ("b", "x"): 0.0}
    assert price(slots=2, rule="first_price") == {("a", "y"): 9.0, ("a", "z"): 7.0, ("b", "x"): 4.0}
    assert price(slots=2, rule="vcg", reserve=1.0) == {("a", "y"): 5.0, ("a", "z"): 5.0, ("b", "x"): 1.0}
    nested = auction.build_auctions(bids, ["auction_id"]).select("auction_id", F.lit(3).cast("long").alias("timestamp"), "bids")
    C.write_auctions(nested, f"{tmp_path}/s")
    back = C.read_auctions(spark, f"{tmp_path}/s")
    assert back.first()["auction_type"] == "second_price" and auction.stream_totals(back).first()["total_bids"] == 4
    assert one(spark, lambda c: auction.bid_price("cpa", c, F.lit(0.5), target_cpa=4.0), 0.5, "double") == 1.0


def test_budget_passes_over_what_does_not_fit(spark):
    e = spark.createDataFrame([(1, i, c) for i, c in enumerate([60.0, 50.0, 30.0, 20.0])], "b long, t int, cost double")
    s = auction.budget_state(auction.spend_budgets(e, 100.0, ["b"], ["t"]), 100.0, ["b"]).first()
    assert (s["spent"], s["remaining"], s["accepted"]) == (90.0, 10.0, 2)


def test_kpis_count_impressions_once(spark):
    e = spark.createDataFrame([(True, True, False, False, 2.0, 0.0)], "winner boolean, impression boolean, click boolean, conversion boolean, spend double, value double")
    assert auction.kpis(e).first()["impressions"] == 1 and auction.kpis(e, impressions_mode="legacy").first()["impressions"] == 2
    assert auction.kpis(e).first()["cpc"] is None


def test_metrics_at_the_edges(spark):
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y_true int, y_pred double")
    assert metrics.auc(ties).first()["auc"] == 0.5
    assert metrics.auc(ties.where("y_true = 1")).first()["auc"] is None
    assert math.isclose(metrics.logloss(ties).first()["logloss"], math.log(2))
    sure = spark.createDataFrame([(i % 2, 0.99 if i % 2 else 0.01, i) for i in range(100)], "y_true int, y_pred double, i int")
    assert metrics.evaluate(sure).first()["auc"] == 1.0 and metrics.temperature(sure).first()["temperature"] < 1
    s = metrics.significance(sure.withColumn("z", F.lit(0)), "i", "y_true", "z", 50).first()
    assert s["difference"] == 0.5 and s["significant"]
    g = metrics.offline_online_gap(spark.createDataFrame([("auc", 0.8)], "metric string, value double"), spark.createDataFrame([("auc", 0.4)], "metric string, value double")).first()
    assert (g["gap"], g["ratio"]) == (0.4, 2.0)


def test_encoders(spark):
    df = spark.createDataFrame([("a", "1,2,3", 4.0), ("a", "4", None), ("b", None, 60.0)], "v string, s string, x double")
    spec = features.FeatureMap([features.FeatureSpec("v", "vocab", {"size": 1}), features.FeatureSpec("s", "sequence", {"max_len": 2}), features.FeatureSpec("x", "bucket", {"boundaries": [10, 50]})])
    out = {(r["v"], tuple(r["s"] or ()), r["x"]) for r in spec.fit_transform(df).collect()}
    assert out == {(1, ("2", "3"), 0), (1, ("4",), None), (0, (), 2)}
    assert one(spark, lambda c: features.hash_bucket(c, 10), "abc") == zlib.crc32(b"abc") % 10


def test_streams(spark):
    e = S.read_stream(spark, "/root/testdata/sf0.001", "events.parquet")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = {r["start"].strftime("%Y%m%d"): (r["impressions"], r["clicks"]) for r in S.run_once(S.ctr_windows(e), "w").collect()}
    want = {r["d"]: (r["n"], r["k"]) for r in batch.groupBy(F.date_format("ts", "yyyyMMdd").alias("d")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "click").cast("long")).alias("k")).collect()}
    assert len(got) >= len(want) - 3 and all(want[d] == x for d, x in got.items())
    long = e.select(F.lit("user").alias("feature"), F.col("user_id").cast("string").alias("value"))
    assert S.run_once(S.first_seen(long), "f").count() == batch.select("user_id").distinct().count()
    assert S.run_once(S.running_counts(long), "r", "complete").agg(F.sum("count")).first()[0] == batch.count()
    costs = e.select(F.lit(1).cast("long").alias("budget_id"), F.col("event_id").alias("seq"), F.col("value").alias("cost"))
    own = auction.spend_budgets(batch.select(F.lit(1).cast("long").alias("b"), F.col("event_id").alias("t"), F.col("value").alias("cost")), 500.0, ["b"], ["t"])
    assert S.run_once(S.spend_stream(costs, 500.0), "b").where("accepted").count() == own.where("accepted").count()


def test_contracts(spark, tmp_path):
    m = contracts.DatasetManifest("log", "1", splits={"train": "p"}, features=["a"])
    m.save(f"{tmp_path}/x/m.json")
    assert contracts.DatasetManifest.load(f"{tmp_path}/x/m.json") == m
    run = contracts.RunFolder(str(tmp_path / "runs"), "r")
    run.save_config({"a": 1})
    run.save_metrics(contracts.Metrics(auc=0.7))
    assert contracts.runs(spark, str(tmp_path / "runs")).first()["run_id"] == run.id
    assert contracts.run_metrics(spark, str(tmp_path / "runs")).first()["value"] == 0.7
    c = contracts.resolve_paths({"data_path": "a/b", "class_path": "m.C", "s3_root": "s3://x", "n": [{"out_dir": "/z"}]}, "/r")
    assert c == {"data_path": "/r/a/b", "class_path": "m.C", "s3_root": "s3://x", "n": [{"out_dir": "/z"}]}
    assert contracts.dict_hash({"a": 1, "b": 2}) == contracts.dict_hash({"b": 2, "a": 1})


def test_delimited_source_and_batches(spark, tmp_path):
    ddl, labels = C.FAMILIES["multitask_ecommerce"]
    (tmp_path / "x.csv").write_text("user_id,item_id,category_id,merchant_id,brand_id,price,time,clk,cvr\nu,i,c,m,b,1.5,7,1,0\n")
    s = C.DelimitedSource(str(tmp_path / "x.csv"), ddl, labels=labels)
    assert s.load(spark).first()["price"] == 1.5 and s.get_features()[0] == "user_id" and "clk" not in s.get_features()
    assert [len(b) for b in C.mini_batches(spark.range(70), 32)] == [32, 32, 6]


def test_without_the_training_data_part():
    """The entry module stands without it."""
    import subprocess
    import sys

    code = "import sys; sys.modules['clickloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_auc_and_ks_across_slices(spark):
    """Scores of few and of many slices, ties, and scores outside 0 to 1, against all pairs."""
    rows = [(i % 3 == 0, g, s) for i in range(150) for g, s in (("near", 0.5 + (i * 37 % 50) * 1e-9), ("wide", (i * 61 % 97) / 50 - 0.4))]
    df = spark.createDataFrame([(int(y), g, s) for y, g, s in rows], "y_true int, g string, y_pred double")
    got = {r["group"]: r for r in metrics.evaluate(df, "g").collect()}
    for g in ("near", "wide"):
        pos, neg = [s for y, h, s in rows if h == g and y], [s for y, h, s in rows if h == g and not y]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        ks = max(abs(sum(p <= t for p in pos) / len(pos) - sum(n <= t for n in neg) / len(neg)) for t in pos + neg)
        assert math.isclose(got[g]["auc"], auc) and math.isclose(got[g]["ks"], ks)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.1234567, None), ("c", 2.0, 3)], "k string, x double, n int")
    text = reports.build_report("Run", {"t": df, "long": spark.range(5)}, f"{tmp_path}/r/report.md", rows=3)
    assert "| a\\|b | 0.123457 |  |" in text and text.count("(the first 3 rows)") == 1
    assert (tmp_path / "r" / "report.md").read_text() == text
    assert reports.save_tables({"t": df}, f"{tmp_path}/tables") == ["t"] and (tmp_path / "tables" / "outputs.txt").read_text() == f"{tmp_path}/tables/t\n"
    assert reports.save_curve(df, f"{tmp_path}/c/x.csv") == 2 and (tmp_path / "c" / "x.csv").read_text().splitlines()[2] == "c,2.0,3"
    assert reports.save_curve(df.limit(0), f"{tmp_path}/c/none.csv") == 0


def test_command_line(spark, tmp_path, store):
    root, config, totals = store
    contracts.dump_config(config, f"{tmp_path}/config.json")
    assert contracts.load_config(f"{tmp_path}/config.json") == config
    assert cli.main(["materialize", f"{tmp_path}/config.json", f"{tmp_path}/log"], spark) == totals
    assert spark.read.option("header", True).csv(f"{tmp_path}/log_files_index").columns == ["split", "day", "file", "rows"]
    assert len(cli.main(["load", f"{tmp_path}/config.json", "--rows", "2"], spark)["first"]) == 2
    assert cli.main(["validate", f"{tmp_path}/log"], spark)["ok"]
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 9.0), ("b", "x", 4.0)], "auction_id string, bidder_id string, bid_price double")
    C.write_auctions(auction.build_auctions(df, ["auction_id"]), f"{tmp_path}/stream")
    assert cli.main(["simulate", f"{tmp_path}/stream", f"{tmp_path}/spent", "--budget", "6"], spark) == {"bidders": 2}
    spark.createDataFrame([(1, 0.9), (0, 0.1)], "y_true int, y_pred double").write.parquet(f"{tmp_path}/scored")
    assert cli.main(["evaluate", f"{tmp_path}/scored"], spark)[metrics.ALL]["auc"] == 1.0
    runs = [contracts.RunFolder(f"{tmp_path}/runs", n) for n in "ab"]
    for r, auc in zip(runs, (0.5, 0.75)):
        r.save_config({})
        r.save_metrics(contracts.Metrics(auc=auc))
    assert [r["run_id"] for r in cli.main(["runs", f"{tmp_path}/runs"], spark)["runs"]] == [r.id for r in runs]
    assert cli.main(["compare", f"{tmp_path}/runs", runs[0].id, runs[1].id], spark)["metrics"] == [{"metric": "auc", "first": 0.5, "second": 0.75, "difference": 0.25}]
    assert os.path.exists(cli.main(["export", f"{tmp_path}/runs", runs[0].id, f"{tmp_path}/a.zip"], spark)["file"])
    with pytest.raises(FileNotFoundError):
        reports.export_run(f"{tmp_path}/runs", "none", f"{tmp_path}/b.zip")


def test_row_ids_have_no_gaps(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 > 0").select(F.col("id").alias("a.b"), F.lit("x").alias("place"))
    out = C.with_row_id(df, "n")
    assert out.columns == ["a.b", "place", "n"] and sorted(r["n"] for r in out.collect()) == list(range(666))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_errors_of_logs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        C.ClickLogSource(str(tmp_path / "none")).load(spark)
    spark.createDataFrame([(1, None), (0, None)], "click int, hour string").write.parquet(str(tmp_path / "log"))
    with pytest.raises(ValueError, match="hour"):
        C.ClickLogSource(str(tmp_path / "log"), split=C.SplitSpec("none")).load(spark)
    source = C.ClickLogSource("p", split=C.SplitSpec("none"), features=["C1"])
    assert C.build_source(source.config()) == source


def test_bootstrap_of_any_metric(spark):
    scored = spark.createDataFrame([(i, int(i % 3 == 0), ((i * 37) % 100) / 100 + (0.3 if i % 3 == 0 else 0.0)) for i in range(600)], "i int, y_true int, y_pred double")
    scored = scored.withColumn("y_pred", F.least("y_pred", F.lit(0.99))).withColumn("flat", F.lit(0.3))
    whole = metrics.evaluate(scored).first()
    for name in ("auc", "logloss", "ks"):
        r = metrics.bootstrap(scored, "i", name, 40).first()
        assert math.isclose(r["estimate"], whole[name]) and r["lower"] < r["estimate"] < r["upper"] + 0.1
    rate = lambda c: c.groupBy("group").agg((F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("value"))
    a, b = metrics.bootstrap(scored, "i", rate, 40).first(), metrics.bootstrap_mean(scored, "i", "y_true", 40).first()
    assert all(math.isclose(a[c], b[c]) for c in ("estimate", "lower", "upper"))
    s = metrics.significance(scored, "i", "y_pred", "flat", 40, metric="auc").first()
    assert math.isclose(s["difference"], whole["auc"] - 0.5) and s["significant"]


def test_bootstrap_cells_by_hand(spark):
    """The interval against weights drawn one by one."""
    import hashlib

    u = lambda text: int(hashlib.md5(f"bootstrap_v1|{text}".encode()).hexdigest()[:8], 16) / 2**32
    steps = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(6)]
    rows = [(i, float((i * 7) % 11)) for i in range(50)]
    means = []
    for b in range(30):
        w = [sum(u(f"{math.floor(u(i) * metrics.CELLS)}:{b}") >= s for s in steps) for i, _ in rows]
        means.append(sum(x * k for (_, x), k in zip(rows, w)) / sum(w))
    means.sort()
    at = lambda q: means[int(q * 29)] + (q * 29 - int(q * 29)) * (means[min(29, int(q * 29) + 1)] - means[int(q * 29)])
    r = metrics.bootstrap_mean(spark.createDataFrame(rows, "i int, x double"), "i", "x", 30).first()
    assert math.isclose(r["lower"], at(0.025)) and math.isclose(r["upper"], at(0.975))


def test_results_come_in_order(spark):
    c = profile.cube(C.canon_events(spark, "/root/testdata/sf0.001"), ["k", "value_bin"])
    psi = [(r["feature"], r["split"], r["day"]) for r in drift.psi_by_field_day(c, 5).collect()]
    rates = [(r["feature"], -r["imps"]) for r in significance.ctr_by_value(c, 5, (1, 2)).collect()]
    assert psi == sorted(psi) and rates == sorted(rates)


def test_recorded_auctions_grow_and_replay(spark, tmp_path):
    path = str(tmp_path / "auctions")
    make = lambda ids: spark.createDataFrame([(str(i), i, 1, "second_price") for i in ids], "auction_id string, timestamp long, num_slots int, auction_type string")
    C.write_auctions(make(range(5)), path)
    C.append_auctions(make(range(5, 8)), path)
    a = C.read_auctions(spark, path)
    assert a.count() == 8 and C.auction_at(a, 6)["auction_id"] == "6" and C.auction_at(a, -1)["auction_id"] == "7" and C.auction_at(a, 8) is None
    from clickloom.streaming import queries as streams

    assert streams.run_once(C.stream_auctions(spark, path).select("auction_id"), "replayed").count() == 8


def test_saved_features_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("b", 8.0)], "v string, x double")
    m = features.FeatureMap([features.FeatureSpec("v", "vocab", {"size": 1}), features.FeatureSpec("x", "normalize")])
    assert features.FeatureMap.from_json(m.to_json()) == m
    fitted = m.fit(df)
    fitted.save(str(tmp_path / "fitted"))
    again = features.FittedFeatureMap.load(spark, str(tmp_path / "fitted"))
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, fitted.transform(df).collect()))
    run = contracts.RunFolder(str(tmp_path / "runs"))
    run.save_config({"a": 1})
    (tmp_path / "model.bin").write_bytes(b"1")
    run.save_checkpoint(str(tmp_path / "model.bin"), 3)
    got = contracts.get_run(str(tmp_path / "runs"), run.id)
    assert run.checkpoints() == ["step_000000003.bin"] == got["files"]["checkpoints"] and got["config"] == {"a": 1} and "packages" in got["environment"]
    with pytest.raises(KeyError):
        contracts.get_run(str(tmp_path / "runs"), "none")


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from clickloom import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=context))
