"""The queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import auction, drift, features, metrics, profile, significance, sketches, validate
from ..schema import MISSING, OTHER
from ..sources.clicklog import EVENT_FEATURES, ClickLogSource, SplitSpec, canon_events, event_log, with_row_id
from ..streaming import queries as streams
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
VOCAB, TOP, PSI_K, MIN_IMPS = 60, 20, 10, 20

LOG = f"""
log0 AS (
  SELECT CAST(event_id AS VARCHAR) AS _id, CAST(strftime(ts, '%Y%m%d') AS INT) AS _day, CAST(hour(ts) AS INT) AS _hod,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS _label_click, CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN json_extract_string(props, '$.k') = '0' THEN '{MISSING}' ELSE json_extract_string(props, '$.k') END AS k,
         CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) AS value_bin, CAST(hour(ts) AS VARCHAR) AS hour_str
  FROM events
), log AS (
  SELECT *, CASE WHEN _day <= 20240124 THEN 'train' WHEN _day IN (20240125, 20240126, 20240127) THEN 'valid' WHEN _day IN (20240128, 20240129, 20240130) THEN 'test' END AS split
  FROM log0 WHERE _day <= 20240130
), longform AS (
  {" UNION ALL ".join(f"SELECT split, _day AS day, _label_click AS label, '{f}' AS feature, {f} AS value FROM log" for f in EVENT_FEATURES)}
), cube AS (SELECT split, day, feature, value, count(*) AS n_rows, sum(label) AS clicks FROM longform GROUP BY ALL
), counts AS (SELECT feature, value, sum(n_rows) AS count, sum(clicks) AS clicks FROM cube WHERE split = 'train' GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) AS rank, sum(count) OVER (PARTITION BY feature) AS n,
         sum(CASE WHEN value <> '{MISSING}' THEN count ELSE 0 END) OVER (PARTITION BY feature) AS nm,
         sum(count) OVER (PARTITION BY feature ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING) AS running
  FROM counts)
"""
SHARES = f"""
top AS (SELECT feature, value FROM ranked WHERE rank <= {PSI_K}
), bins AS (SELECT feature, value AS bin FROM top UNION SELECT feature, '{OTHER}' FROM top UNION SELECT feature, '{MISSING}' FROM top
), binned AS (SELECT c.*, CASE WHEN t.value IS NULL THEN '{OTHER}' ELSE c.value END AS bin FROM cube c LEFT JOIN top t ON c.feature = t.feature AND c.value = t.value
), tr AS (SELECT feature, bin, sum(n_rows) AS n FROM binned WHERE split = 'train' GROUP BY ALL
), trn AS (SELECT feature, sum(n) AS train_n FROM tr GROUP BY ALL
), dy AS (SELECT split, day, feature, bin, sum(n_rows) AS m FROM binned WHERE split <> 'train' GROUP BY ALL
), dyn AS (SELECT split, day, feature, sum(m) AS n_rows FROM dy GROUP BY ALL
), shares AS (
  SELECT d.feature, d.split, d.day, b.bin, coalesce(tr.n, 0) / trn.train_n AS p, coalesce(dy.m, 0) / d.n_rows AS q, d.n_rows
  FROM dyn d JOIN bins b ON d.feature = b.feature JOIN trn ON trn.feature = d.feature
  LEFT JOIN tr ON tr.feature = d.feature AND tr.bin = b.bin LEFT JOIN dy ON dy.split = d.split AND dy.day = d.day AND dy.feature = d.feature AND dy.bin = b.bin)
"""

# CRC-32 and Adler-32 of the values, byte by byte
HASHES = """vals AS (SELECT DISTINCT feature, value FROM longform), bytes AS (SELECT *, list_transform(range(1, 1 + length(value)), lambda i: ord(substr(value, i, 1))::BIGINT) AS b FROM vals),
hashes AS (SELECT feature, value,
  xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS crc,
  CAST((length(b) + list_sum(list_transform(b, lambda x, i: x * (length(b) - i + 1)))) % 65521 * 65536 + (1 + list_sum(b)) % 65521 AS BIGINT) AS adler FROM bytes)"""
# estimate of distinct values from the registers of (by, crc)
HLL = """reg AS (SELECT {by}, crc & 16383 AS bucket, max(19 - CASE WHEN crc >> 14 > 0 THEN length(bin(crc >> 14)) ELSE 0 END) AS rank FROM {rows} GROUP BY ALL),
est0 AS (SELECT {by}, 0.7213 / (1 + 1.079 / 16384) * 16384.0 * 16384 / (sum(pow(2.0, -rank)) + 16384 - count(*)) AS raw, 16384 - count(*) AS zeros FROM reg GROUP BY ALL),
est AS (SELECT {by}, CASE WHEN raw <= 2.5 * 16384 AND zeros > 0 THEN 16384.0 * (ln(16384) - ln(zeros)) ELSE raw END AS estimate FROM est0)"""


def query(sql: str | None = None, digits: int = 9):
    """Register a query under its function's name; doubles are rounded on both sides, as sums differ in their last bits."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"})

        run.__doc__ = f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return add


def _r(x: str, digits: int = 9) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


def _cube(spark: SparkSession, d: str) -> DataFrame:
    return profile.cube(canon_events(spark, d), EVENT_FEATURES)


for _by, _col in (("day", "_day"), ("hod", "_hod")):

    def _ctr(spark, d, by=_by):
        return getattr(profile, f"ctr_by_{by}")(canon_events(spark, d))

    _ctr.__name__ = f"ctr_by_{_by}"
    query(f"WITH {LOG} SELECT split, {_col} AS {_by}, count(*) AS impressions, CAST(sum(_label_click) AS BIGINT) AS clicks, {_r('sum(_label_click) / count(*)')} AS ctr FROM log GROUP BY ALL")(_ctr)


@query(f"WITH {LOG} SELECT split, day, feature, value, n_rows, n_rows AS n_labeled, CAST(clicks AS BIGINT) AS clicks FROM cube")
def value_cube(spark, d):
    return _cube(spark, d)


@query(f"WITH {LOG} SELECT feature, CAST(rank AS INT) AS rank, value, CAST(count AS BIGINT) AS count, {_r('count / n')} AS pct_of_train_rows FROM ranked WHERE rank <= {TOP}")
def topk_train(spark, d):
    return profile.top_k(_cube(spark, d), TOP)


@query(f"WITH {LOG} SELECT feature, CAST(rank AS INT) AS k, {_r('running / nm')} AS coverage_non_missing FROM ranked WHERE rank IN ({', '.join(map(str, sorted({*profile.COVERAGE_KS, VOCAB})))})")
def coverage_train(spark, d):
    return profile.coverage(_cube(spark, d), vocab_k=VOCAB)


@query(f"WITH {LOG} SELECT feature, {_r(f'''sum(CASE WHEN value = '{MISSING}' THEN count ELSE 0 END) / sum(count)''')} AS missing_rate_train FROM counts GROUP BY feature")
def missing_train(spark, d):
    return profile.missing_rate(_cube(spark, d))


@query(f"""WITH {LOG} SELECT feature, CAST(max(rank) AS INT) AS max_k_used, {_r(f"max(CASE WHEN rank <= {VOCAB} THEN running / nm END)")} AS "coverage@vocab_k",
{", ".join(f'CAST(min(CASE WHEN running / nm >= {p / 100} THEN rank END) AS INT) AS "min_k@{p}", min(CASE WHEN running / nm >= {p / 100} THEN rank END) IS NOT NULL AS "min_k@{p}_reached"' for p in (90, 95, 99))}
FROM ranked WHERE rank <= 5000 GROUP BY feature""")
def min_k_train(spark, d):
    return profile.min_k(_cube(spark, d), VOCAB)


@query(f"""WITH {LOG}, v AS (SELECT c.split, c.feature, c.value, c.n_rows, (r.value IS NULL AND c.value <> '{MISSING}') AS oov FROM cube c LEFT JOIN (SELECT * FROM ranked WHERE rank <= {VOCAB}) r ON c.feature = r.feature AND c.value = r.value WHERE c.split <> 'train')
SELECT split, feature, CAST({VOCAB} AS INT) AS vocab_k, {_r('sum(CASE WHEN oov THEN n_rows ELSE 0 END) / sum(n_rows)')} AS oov_row_rate, count(DISTINCT CASE WHEN oov THEN value END) AS oov_unique_est FROM v GROUP BY split, feature""")
def oov_vs_train_vocab(spark, d):
    return profile.out_of_vocabulary(_cube(spark, d), VOCAB)


_clip = lambda x, e: f"least(greatest({x}, {e}), 1.0)"
_psi = lambda e: f"({_clip('q', e)} - {_clip('p', e)}) * ln({_clip('q', e)} / {_clip('p', e)})"


@query(f"WITH {LOG}, {SHARES} SELECT feature, split, day, {_r(f'sum({_psi(1e-6)})')} AS psi, CAST(any_value(n_rows) AS BIGINT) AS n_rows FROM shares GROUP BY feature, split, day")
def psi_by_field_day(spark, d):
    return drift.psi_by_field_day(_cube(spark, d), PSI_K)


@query(f"WITH {LOG}, {SHARES} SELECT feature, split, day, bin, {_r(_clip('p', 1e-10))} AS p, {_r(_clip('q', 1e-10))} AS q, {_r(_psi(1e-10))} AS psi_contrib FROM shares")
def psi_components_day(spark, d):
    return drift.psi_components(_cube(spark, d), PSI_K)


@query(f"""WITH {LOG}, f AS (SELECT feature, value, min(day) AS day FROM cube WHERE split = 'train' AND value <> '{MISSING}' GROUP BY ALL),
t AS (SELECT split, day, feature, sum(n_rows) AS n_rows FROM cube GROUP BY ALL),
n AS (SELECT 'train' AS split, day, feature, count(*) AS new FROM f GROUP BY ALL UNION ALL
      SELECT split, day, feature, sum(n_rows) FROM cube c WHERE split <> 'train' AND value <> '{MISSING}' AND NOT EXISTS (SELECT 1 FROM f WHERE f.feature = c.feature AND f.value = c.value) GROUP BY ALL)
SELECT CASE WHEN t.split = 'train' THEN 'train_incremental' ELSE 'vs_full_train' END AS scope, t.split, t.day, t.feature, {_r('coalesce(n.new, 0) / t.n_rows')} AS new_row_rate, CAST(t.n_rows AS BIGINT) AS n_rows
FROM t LEFT JOIN n ON t.split = n.split AND t.day = n.day AND t.feature = n.feature""")
def new_value_rate_by_day(spark, d):
    return drift.novelty(_cube(spark, d))


@query(f"""WITH {LOG}, v AS (SELECT c.feature, CASE WHEN r.value IS NULL THEN '{OTHER}' ELSE c.value END AS value, c.count, c.clicks FROM counts c LEFT JOIN (SELECT * FROM ranked WHERE rank <= {TOP}) r ON c.feature = r.feature AND c.value = r.value),
g AS (SELECT feature, value, sum(count) AS imps, sum(clicks) AS clicks, sum(sum(clicks)) OVER (PARTITION BY feature) / sum(sum(count)) OVER (PARTITION BY feature) AS p0 FROM v GROUP BY feature, value),
w AS (SELECT *, clicks / imps AS ctr, (clicks / imps + 3.8416 / (2 * imps)) / (1 + 3.8416 / imps) AS c, 1.96 * sqrt((clicks / imps) * (1 - clicks / imps) / imps + 3.8416 / (4.0 * imps * imps)) / (1 + 3.8416 / imps) AS m,
             (clicks / imps - p0) / sqrt(greatest(p0 * (1 - p0) / imps, 1e-12)) AS z FROM g)
SELECT feature, value, CAST(imps AS BIGINT) AS imps, CAST(clicks AS BIGINT) AS clicks, {_r('ctr')} AS ctr, {_r('ctr / greatest(p0, 1e-12)')} AS lift_vs_global, {_r('greatest(0, c - m)')} AS wilson_lo, {_r('least(1, c + m)')} AS wilson_hi, {_r('z')} AS zscore_vs_global,
       imps >= 100 AS pass_min_imps_100, imps >= 200 AS pass_min_imps_200, imps >= 200 AND abs(z) >= 8 AS is_suspicious FROM w""")
def ctr_by_value_train(spark, d):
    return significance.ctr_by_value(_cube(spark, d), TOP, (100, 200))


PAIRS = [("k", "user_id"), ("hour_str", "value_bin")]
CELLS = (
    f"top AS (SELECT feature, value FROM ranked WHERE rank <= {PSI_K}), "
    + "cells0 AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}__X__{b}' AS pair, '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN ta.value IS NULL THEN '{OTHER}' ELSE log.{a} END AS a_bin, CASE WHEN tb.value IS NULL THEN '{OTHER}' ELSE log.{b} END AS b_bin, count(*) AS imps, sum(_label_click) AS clicks "
        f"FROM log LEFT JOIN top ta ON ta.feature = '{a}' AND ta.value = log.{a} LEFT JOIN top tb ON tb.feature = '{b}' AND tb.value = log.{b} WHERE split = 'train' GROUP BY ALL"
        for a, b in PAIRS
    )
    + """), cells1 AS (SELECT *, sum(imps) OVER (PARTITION BY pair) AS n, sum(clicks) OVER (PARTITION BY pair) / sum(imps) OVER (PARTITION BY pair) AS p0, clicks / imps AS ctr,
  sum(clicks) OVER (PARTITION BY pair, a_bin) / sum(imps) OVER (PARTITION BY pair, a_bin) AS ctr_a, sum(clicks) OVER (PARTITION BY pair, b_bin) / sum(imps) OVER (PARTITION BY pair, b_bin) AS ctr_b FROM cells0),
cells AS (SELECT *, ctr / greatest(p0, 1e-12) AS lift_joint, ctr / greatest(ctr_a * ctr_b / greatest(p0, 1e-12), 1e-12) AS lift_over_marginal, ln(greatest(ctr / greatest(ctr_a * ctr_b / greatest(p0, 1e-12), 1e-12), 1e-12)) AS log_interaction FROM cells1)"""
)


def _cells(spark, d):
    log = canon_events(spark, d)
    return significance.pair_cells(log, profile.cube(log, EVENT_FEATURES), PAIRS, PSI_K)


@query(f"WITH {LOG}, {CELLS} SELECT pair, feature_a, feature_b, a_bin, b_bin, imps, CAST(clicks AS BIGINT) AS clicks, {_r('ctr')} AS ctr, {_r('lift_joint')} AS lift_joint, {_r('lift_over_marginal')} AS lift_over_marginal, {_r('log_interaction')} AS log_interaction FROM cells WHERE imps >= {MIN_IMPS}")
def pair_interaction_combos(spark, d):
    return significance.pair_combos(_cells(spark, d), MIN_IMPS)


_mi = lambda c, y: f"CASE WHEN {c} > 0 THEN ({c} / n) * ln(({c} / n) / greatest((imps / n) * ({y}), 1e-12)) ELSE 0 END"


@query(f"""WITH {LOG}, {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY a_bin, b_bin) AS i, row_number() OVER (PARTITION BY pair ORDER BY CASE WHEN imps >= {MIN_IMPS} THEN 0 ELSE 1 END, abs(log_interaction) DESC, a_bin, b_bin) AS j FROM cells),
s AS (SELECT pair, feature_a, feature_b, sum({_mi('clicks', 'p0')} + {_mi('(imps - clicks)', '1 - p0')}) AS mi, count(*) AS n_combos FROM cells GROUP BY ALL),
b AS (SELECT f.pair, CASE WHEN t.imps >= {MIN_IMPS} AND abs(t.log_interaction) > abs(f.log_interaction) THEN t ELSE f END AS x FROM o f JOIN o t ON f.pair = t.pair AND f.i = 1 AND t.j = 1)
SELECT s.pair, s.feature_a, s.feature_b, {_r('mi')} AS mi_y_combo, n_combos, x.a_bin AS best_combo_a, x.b_bin AS best_combo_b, x.imps AS best_combo_imps, {_r('x.log_interaction')} AS best_combo_log_interaction FROM s JOIN b ON s.pair = b.pair""")
def pair_interaction_summary(spark, d):
    return significance.pair_summary(_cells(spark, d), MIN_IMPS)


_SPLIT = SplitSpec(method="random")


@query("SELECT split, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT event_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS split FROM (SELECT event_id, CAST(concat('0x', substr(md5(concat('split_v1|', event_id)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM events)) GROUP BY split")
def random_split(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_id").alias("_id"))
    return _SPLIT.assign(e).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.sum("event_id").alias("total"))


@query(f"WITH {LOG} SELECT split, count(*) AS n_rows, count(DISTINCT _day) AS n_days, count(*) FILTER (_label_click IS NULL) AS null_labels, count(*) FILTER (_label_click NOT IN (0, 1)) AS bad_labels, count(*) FILTER (_id IS NULL) AS null_ids, 0::BIGINT AS violations FROM log GROUP BY split")
def schema_violations(spark, d):
    return validate.violations(canon_events(spark, d))


@query(f"WITH {LOG}, m AS (SELECT split, feature, avg(CASE WHEN value = '{MISSING}' THEN 1.0 ELSE 0.0 END) AS r FROM longform GROUP BY ALL) SELECT split, feature, {_r('r')} AS missing_rate, CAST(row_number() OVER (PARTITION BY split ORDER BY r DESC, feature) AS INT) AS place FROM m")
def most_missing(spark, d):
    return validate.most_missing(canon_events(spark, d), EVENT_FEATURES)


@query("SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS short_day, CAST(strftime(ts, '%Y%m%d') AS INT) AS long_day, CAST(strftime(ts, '%Y%m%d') AS INT) AS float_day, CAST(hour(ts) AS SMALLINT) AS short_hod, CAST(hour(ts) AS SMALLINT) AS long_hod, CAST(hour(ts) AS SMALLINT) AS float_hod FROM events")
def hour_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    forms = {"short": F.date_format("ts", "yyMMddHH"), "long": F.concat(F.lit(" "), F.date_format("ts", "yyyyMMddHH")), "float": F.concat(F.date_format("ts", "yyMMddHH"), F.lit(".0"))}
    return e.select("event_id", *(X.hour_day(t).alias(f"{n}_day") for n, t in forms.items()), *(X.hour_of_day(t).alias(f"{n}_hod") for n, t in forms.items()))


@query(f"WITH {LOG}, {HASHES}, rows_ AS (SELECT DISTINCT l.split, l.feature, h.crc FROM longform l JOIN hashes h USING (feature, value)), {HLL.format(by='split, feature', rows='rows_')} SELECT split, feature, {_r('estimate', 6)} AS estimate FROM est", digits=6)
def hll_distinct(spark, d):
    """Estimated distinct values by split and feature, from registers."""
    long = profile.long_form(canon_events(spark, d), EVENT_FEATURES)
    return sketches.hll_estimate(sketches.hll_registers(long, ["split", "feature"]), ["split", "feature"])


@query(f"""WITH {LOG}, {HASHES}, t AS (SELECT DISTINCT l.feature, h.crc, h.adler FROM longform l JOIN hashes h USING (feature, value) WHERE split = 'train'),
bits AS (SELECT feature, crc & 67108863 AS bit FROM t UNION SELECT feature, adler & 67108863 FROM t), later AS (SELECT DISTINCT l.feature, l.value, h.crc & 67108863 AS b1, h.adler & 67108863 AS b2 FROM longform l JOIN hashes h USING (feature, value) WHERE split <> 'train')
SELECT feature, (feature, b1) IN (SELECT (feature, bit) FROM bits) AND (feature, b2) IN (SELECT (feature, bit) FROM bits) AS may_contain, count(*) AS n FROM later GROUP BY ALL""")
def bloom_novelty(spark, d):
    """Values of later splits that a train filter may hold, by feature."""
    long = profile.long_form(canon_events(spark, d), EVENT_FEATURES)
    bits = sketches.bloom_bits(long.where("split = 'train'").select("feature", "value").distinct(), ["feature"])
    return sketches.bloom_contains(long.where("split <> 'train'"), bits, ["feature"]).groupBy("feature", "may_contain").agg(F.count(F.lit(1)).alias("n"))


# scored rows: the smoothed train rate of k
SCORED = f"""scored AS (SELECT l._id, l._label_click AS y, coalesce((r.clicks + 2) / (r.count + 10), 0.2) AS p, l.split FROM log l LEFT JOIN counts r ON r.feature = 'k' AND r.value = l.k WHERE l.split <> 'train')"""


def scored_events(spark, d):
    log = canon_events(spark, d)
    rate = log.where("split = 'train'").groupBy("k").agg(((F.sum("_label_click") + 2) / (F.count(F.lit(1)) + 10)).alias("r"))
    return log.where("split <> 'train'").join(rate, "k", "left").select("_id", F.col("_label_click").alias("y_true"), F.coalesce("r", F.lit(0.2)).alias("y_pred"), "split")


EVAL = """u AS (SELECT split AS grp, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL),
a AS (SELECT grp, sum(pos * (b + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM u) GROUP BY grp),
l AS (SELECT split AS grp, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS logloss FROM scored GROUP BY ALL),
b0 AS (SELECT split AS grp, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY ALL),
c AS (SELECT grp, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM b0 GROUP BY grp),
k AS (SELECT grp, max(abs(cp - cn)) AS ks FROM (SELECT grp, sum(pos) OVER w / sum(pos) OVER (PARTITION BY grp) AS cp, sum(neg) OVER w / sum(neg) OVER (PARTITION BY grp) AS cn FROM u WINDOW w AS (PARTITION BY grp ORDER BY p ROWS UNBOUNDED PRECEDING)) GROUP BY grp)"""


@query(f"""WITH {LOG}, {SCORED}, {EVAL} SELECT a.grp AS "group", {_r('auc')} AS auc, {_r('2 * auc - 1')} AS gini, {_r('logloss')} AS logloss, {_r('ece')} AS ece, {_r('mce')} AS mce, {_r('ks')} AS ks FROM a JOIN l USING (grp) JOIN c USING (grp) JOIN k USING (grp)""")
def evaluate_by_split(spark, d):
    return metrics.evaluate(scored_events(spark, d), "split")


@query(f"""WITH {LOG}, {SCORED} SELECT '{metrics.ALL}' AS "group", CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, {_r('avg(p)')} AS mean_predicted, {_r('avg(y)')} AS mean_actual FROM scored GROUP BY ALL""")
def reliability_curve(spark, d):
    return metrics.reliability(scored_events(spark, d))


_POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 ELSE 6 END"

# rows summed by cell, then every cell weighted in each of the replicates
_U = "CAST(concat('0x', substr(md5(concat('bootstrap_v1|', {0})), 1, 8)) AS BIGINT) / 4294967296.0"
_CELLS = f"""cells AS (SELECT CAST(floor({_U.format('_id')} * {metrics.CELLS}) AS INT) AS cell, sum({{x}}) AS x, count(*) AS n FROM scored GROUP BY 1),
r AS (SELECT x, n, b, {_U.format("cell, ':', b")} AS u FROM cells, range({metrics.REPLICATES}) t(b)),
m AS (SELECT b, sum(x * {_POISSON}) / sum(n * {_POISSON}) AS m FROM r GROUP BY b)"""


@query(f"""WITH {LOG}, {SCORED}, {_CELLS.format(x='y')}
SELECT {_r('(SELECT avg(y) FROM scored)')} AS estimate, {_r('quantile_cont(m, 0.025)')} AS lower, {_r('quantile_cont(m, 0.975)')} AS upper FROM m""")
def bootstrap_ctr(spark, d):
    return metrics.bootstrap_mean(scored_events(spark, d), "_id", "y_true")


@query(f"""WITH {LOG}, {SCORED}, g AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS temperature FROM range(51) t(i)), x AS (SELECT temperature, y, 1 / (1 + exp(-ln(p / (1 - p)) / temperature)) AS q FROM scored, g),
m AS (SELECT temperature, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS logloss FROM x GROUP BY ALL) SELECT {_r('temperature')} AS temperature, {_r('logloss')} AS logloss FROM m ORDER BY m.logloss, m.temperature LIMIT 1""")
def temperature_fit(spark, d):
    return metrics.temperature(scored_events(spark, d))


def _bids(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("auction_id"), F.col("l_suppkey").alias("bidder_id"), "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("bid_price"))


@query("""SELECT auction_id, CAST(slot AS INT) AS slot, bidder_id, l_linenumber, l_partkey, round(bid_price, 9) AS bid_price, round(coalesce(nxt, 0.0), 9) AS price, 0.0::DOUBLE AS platform_fee
FROM (SELECT l_orderkey AS auction_id, l_suppkey AS bidder_id, l_linenumber, l_partkey, l_extendedprice AS bid_price, row_number() OVER w AS slot, lead(l_extendedprice) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_partkey)) WHERE slot <= 2""")
def second_price_auction(spark, d):
    return auction.simulate(_bids(spark, d), ["bidder_id", "l_linenumber", "l_partkey"], slots=2)


@query("""SELECT bidder_id, count(*) AS won, round(sum(bid_price), 2) AS spend FROM (SELECT l_suppkey AS bidder_id, l_extendedprice AS bid_price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_partkey) AS slot FROM lineitem) WHERE slot = 1 GROUP BY bidder_id""", digits=2)
def first_price_spend(spark, d):
    won = auction.simulate(_bids(spark, d), ["bidder_id", "l_linenumber", "l_partkey"], rule="first_price")
    return won.groupBy("bidder_id").agg(F.count(F.lit(1)).alias("won"), F.sum("price").alias("spend"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey % 50 AS budget_id, o_orderkey AS seq, o_totalprice / 1000 AS cost, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT budget_id, i, cost, cost <= 3000 AS accepted, CASE WHEN cost <= 3000 THEN cost ELSE 0.0 END AS spent FROM e WHERE i = 1
      UNION ALL SELECT e.budget_id, e.i, e.cost, f.spent + e.cost <= 3000, CASE WHEN f.spent + e.cost <= 3000 THEN f.spent + e.cost ELSE f.spent END FROM f JOIN e ON e.budget_id = f.budget_id AND e.i = f.i + 1)
SELECT budget_id, round(max(spent), 6) AS spent, count(*) FILTER (accepted) AS accepted, count(*) AS events, round(3000 - max(spent), 6) AS remaining, round(max(spent) / 3000, 6) AS utilization FROM f GROUP BY budget_id""", digits=6)
def greedy_budgets(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("budget_id"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000).alias("cost"))
    return auction.budget_state(auction.spend_budgets(o, 3000.0, ["budget_id"], ["seq"]), 3000.0, ["budget_id"])


def _kpi_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.col("event_type")
    return e.select(t, (F.col("value") >= 50).alias("winner"), t.isin("view", "click", "purchase").alias("impression"), (t == "click").alias("click"), (t == "purchase").alias("conversion"), (F.col("value") / 100).alias("spend"), "value", F.date_format("ts", "yyyyMMdd").cast("int").alias("day"))


_KPI = """WITH e AS (SELECT value >= 50 AS winner, event_type IN ('view', 'click', 'purchase') AS impression, event_type = 'click' AS click, event_type = 'purchase' AS conversion, value / 100 AS spend, value, CAST(strftime(ts, '%Y%m%d') AS INT) AS day FROM events),
g AS (SELECT day, sum(CASE WHEN winner THEN spend ELSE 0 END) AS spend, {imps} AS impressions, count(*) FILTER (click) AS clicks, count(*) FILTER (conversion) AS conversions, sum(CASE WHEN conversion THEN value ELSE 0 END) AS revenue FROM e GROUP BY day)
SELECT day, round(spend, 6) AS spend, impressions, clicks, conversions, round(revenue, 6) AS revenue, round(clicks / nullif(impressions, 0), 6) AS ctr, round(conversions / nullif(impressions, 0), 6) AS cvr, round(spend / nullif(clicks, 0), 6) AS cpc, round(spend / nullif(conversions, 0), 6) AS cpa, round(1000 * spend / nullif(impressions, 0), 6) AS rpm FROM g"""


@query(_KPI.format(imps="count(*) FILTER (impression)"), digits=6)
def kpi_by_day(spark, d):
    return auction.kpis(_kpi_events(spark, d), ["day"])


@query(_KPI.format(imps="count(*) FILTER (impression) + count(*) FILTER (winner)"), digits=6)
def kpi_by_day_legacy(spark, d):
    return auction.kpis(_kpi_events(spark, d), ["day"], "legacy")


@query(f"WITH {LOG} SELECT l._id, coalesce(r.rank, 0)::INT AS id FROM log l LEFT JOIN (SELECT * FROM ranked WHERE feature = 'k' AND rank <= {VOCAB}) r ON l.k = r.value")
def vocabulary_encoding(spark, d):
    log = canon_events(spark, d)
    m = features.FeatureMap([features.FeatureSpec("k", "vocab", {"vocab_size": VOCAB})])
    return m.fit(log.where("split = 'train'")).transform(log).select("_id", F.col("k").alias("id"))


@query("SELECT event_id, CAST((value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT + (value >= 250)::INT AS INT) AS bucket, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS normalized, round(ln(1 + value), 6) AS logged FROM events", digits=6)
def numeric_encodings(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("value").alias("bucket"), F.col("value").alias("normalized"), F.col("value").alias("logged"))
    specs = [features.FeatureSpec("bucket", "bucket", {"boundaries": [10, 50, 100, 250]}), features.FeatureSpec("normalized", "normalize"), features.FeatureSpec("logged", "log")]
    return features.FeatureMap(specs).fit_transform(e)


@query("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), ',') AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY user_id")
def user_sequences(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return features.build_sequences(e, "user_id", "ts", "event_type", "event_id", 20).select("user_id", F.array_join("sequence", ",").alias("sequence"))


_before = lambda n: f"CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS d{n}_n"


@query(f"SELECT user_id, day, n, {_before(1)}, {_before(7)}, {_before(30)} FROM (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS day, count(*) AS n FROM events GROUP BY ALL)")
def cross_day_windows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.unix_date(F.to_date("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return features.cross_day(e, "user_id", "day", ["n"])


@query(f"WITH {LOG}, {HASHES} SELECT feature, value, crc, adler, {_r("CAST(concat('0x', substr(md5(concat('split_v1|', value)), 1, 8)) AS BIGINT) / 4294967296.0", 12)} AS unit FROM hashes", digits=12)
def value_hashes(spark, d):
    """Every distinct value with its three stable hashes."""
    v = profile.long_form(canon_events(spark, d), EVENT_FEATURES).select("feature", "value").distinct()
    return v.select("feature", "value", F.crc32(F.encode("value", "UTF-8")).alias("crc"), X.adler32(F.col("value")).alias("adler"), X.unit_hash("split_v1", F.col("value")).alias("unit"))


@query(f"""WITH {LOG}, {HASHES}, rows_ AS (SELECT DISTINCT c.split, c.feature, h.crc FROM cube c JOIN hashes h USING (feature, value) WHERE c.split <> 'train' AND c.value <> '{MISSING}' AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.rank <= {VOCAB} AND r.feature = c.feature AND r.value = c.value)),
{HLL.format(by='split, feature', rows='rows_')} SELECT split, feature, {_r('estimate', 6)} AS estimate FROM est""", digits=6)
def oov_approx_distinct(spark, d):
    """Estimated distinct values of valid and test that the train vocabulary lacks."""
    c = _cube(spark, d)
    out = c.where(f"split <> 'train' AND value <> '{MISSING}'").join(profile.vocabulary(c, VOCAB), ["feature", "value"], "left_anti")
    return sketches.hll_estimate(sketches.hll_registers(out, ["split", "feature"]), ["split", "feature"])


@query(f"WITH {LOG}, {HASHES} SELECT l._id, CAST(a.crc % 1000 AS BIGINT) AS user_id, CAST(b.crc % 10000 AS BIGINT) AS k FROM log l JOIN hashes a ON a.feature = 'user_id' AND a.value = l.user_id JOIN hashes b ON b.feature = 'k' AND b.value = l.k")
def hash_encoding(spark, d):
    m = features.FeatureMap([features.FeatureSpec("user_id", "hash", {"hash_size": 1000}), features.FeatureSpec("k", "hash")])
    return m.fit_transform(canon_events(spark, d).select("_id", "user_id", "k")).select("_id", F.col("user_id").cast("long").alias("user_id"), F.col("k").cast("long").alias("k"))


@query("SELECT event_id, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week, CAST(hour(ts) AS INT) AS hour_of_day FROM events")
def calendar_encoding(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", *(c.alias(n) for n, c in features.calendar(F.col("ts")).items()))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY i), '>') AS path FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i > n - 5 GROUP BY user_id")
def sequence_encoding(spark, d):
    """The last five items of a joined sequence, by the encoder."""
    e = spark.read.parquet(f"{d}/events.parquet")
    joined = features.build_sequences(e, "user_id", "ts", "event_type", "event_id", 50).select("user_id", F.array_join("sequence", ",").alias("path"))
    m = features.FeatureMap([features.FeatureSpec("path", "sequence", {"max_len": 5, "sep": ","})])
    return m.fit_transform(joined).select("user_id", F.array_join("path", ">").alias("path"))


@query(f"""WITH {LOG}, {SCORED}, {_CELLS.format(x='abs(y - p) - abs(y - 0.2)')}, p AS (SELECT least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) AS p_value FROM m)
SELECT {_r('(SELECT avg(abs(y - p) - abs(y - 0.2)) FROM scored)')} AS difference, {_r('p_value')} AS p_value, p_value < 0.05 AS significant FROM p""")
def significance_test(spark, d):
    """Is the score's absolute error another than that of a constant?"""
    y = F.col("y_true")
    rows = scored_events(spark, d).select("_id", F.abs(y - F.col("y_pred")).alias("a"), F.abs(y - 0.2).alias("b"))
    return metrics.significance(rows, "_id", "a", "b")


@query(f"""WITH {LOG}, {SCORED}, {EVAL}, e AS (SELECT a.grp, auc, logloss, ece, mce, ks FROM a JOIN l USING (grp) JOIN c USING (grp) JOIN k USING (grp)), m AS (UNPIVOT e ON auc, logloss, ece, mce, ks INTO NAME metric VALUE v)
SELECT x.metric, {_r('x.v')} AS offline, {_r('y.v')} AS online, {_r('x.v - y.v')} AS gap, {_r('x.v / y.v')} AS ratio FROM m x JOIN m y ON x.metric = y.metric AND x.grp = 'valid' AND y.grp = 'test'""")
def offline_online_gap(spark, d):
    names = ["auc", "logloss", "ece", "mce", "ks"]
    m = metrics.evaluate(scored_events(spark, d), "split").unpivot("group", names, "metric", "value")
    return metrics.offline_online_gap(m.where("group = 'valid'"), m.where("group = 'test'"))


@query("""SELECT auction_id, CAST(slot AS INT) AS slot, bidder_id, l_linenumber, l_partkey, round(bid_price, 6) AS bid_price, round(price, 6) AS price, round(price * 0.1, 6) AS platform_fee
FROM (SELECT *, coalesce(max(CASE WHEN slot = 3 THEN bid_price END) OVER (PARTITION BY auction_id), 1000.0) AS price FROM (SELECT l_orderkey AS auction_id, l_suppkey AS bidder_id, l_linenumber, l_partkey, l_extendedprice AS bid_price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_partkey) AS slot FROM lineitem WHERE l_extendedprice >= 1000)) WHERE slot <= 2""", digits=6)
def vcg_auction(spark, d):
    """Two slots, a reserve and a platform fee."""
    return auction.simulate(_bids(spark, d), ["bidder_id", "l_linenumber", "l_partkey"], 2, "vcg", reserve=1000.0, fee=0.1)


@query("SELECT event_id, round(pctr * 1000, 9) AS ecpm, round(pctr * pcvr * 20, 9) AS cpa, round(pctr * pcvr * value / 2, 9) AS roi, round(sqrt(pctr), 9) AS custom FROM (SELECT event_id, value, (event_id % 100) / 1000.0::DOUBLE AS pctr, (user_id % 10) / 10.0::DOUBLE AS pcvr FROM events)")
def bid_strategies(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    pctr, pcvr, value = (F.col("event_id") % 100) / 1000, (F.col("user_id") % 10) / 10, F.col("value")
    bid = lambda s, **k: auction.bid_price(s, pctr, pcvr, value, **k)
    return e.select("event_id", bid("ecpm").alias("ecpm"), bid("cpa", target_cpa=20.0).alias("cpa"), bid("roi", target_roi=2.0).alias("roi"), bid(lambda p, *_: F.sqrt(p)).alias("custom"))


@query("SELECT count(DISTINCT l_orderkey) AS total_auctions, count(*) AS total_bids, count(*) FILTER (l_linestatus = 'O') AS total_impressions, count(*) FILTER (l_returnflag = 'R') AS total_clicks, count(*) FILTER (l_linenumber = 1) AS total_conversions, min(l_orderkey) AS start_time, max(l_orderkey) AS end_time FROM lineitem")
def auction_stream_totals(spark, d):
    """Bids nested under their auctions, and the totals of that stream."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    key = F.col("l_orderkey")
    bids = li.select(key.alias("auction_id"), key.alias("timestamp"), F.col("l_suppkey").alias("bidder_id"), F.col("l_extendedprice").alias("bid_price"), (F.col("l_linestatus") == "O").alias("impression"), (F.col("l_returnflag") == "R").alias("click"), (F.col("l_linenumber") == 1).alias("conversion"))
    return auction.stream_totals(auction.build_auctions(bids, ["auction_id", "timestamp"]))


_FOLD = """WITH RECURSIVE {first}, f AS (SELECT {by}, i, cost, cost <= {limit} AS accepted, CASE WHEN cost <= {limit} THEN cost ELSE 0.0 END AS spent FROM e WHERE i = 1
UNION ALL SELECT {eby}, e.i, e.cost, f.spent + e.cost <= {limit}, CASE WHEN f.spent + e.cost <= {limit} THEN f.spent + e.cost ELSE f.spent END FROM f JOIN e ON {on} AND e.i = f.i + 1)
SELECT {by}, round(max(spent), 4) AS spent, count(*) FILTER (accepted) AS accepted, count(*) AS events, round({limit} - max(spent), 4) AS remaining, round(max(spent) / {limit}, 4) AS utilization FROM f GROUP BY {by}"""


@query(_FOLD.format(by="bidder_id", eby="e.bidder_id", on="e.bidder_id = f.bidder_id", limit="1000003.0", first="""w AS (SELECT l_orderkey AS auction_id, l_suppkey AS bidder_id, row_number() OVER o AS slot, coalesce(lead(l_extendedprice) OVER o, 0.0) AS cost FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_partkey)),
e AS (SELECT *, row_number() OVER (PARTITION BY bidder_id ORDER BY auction_id) AS i FROM w WHERE slot = 1)"""), digits=4)
def auction_replay(spark, d):
    """Second-price auctions, then greedy budgets of the winners in auction order."""
    return pipelines.replay(_bids(spark, d), ["bidder_id", "l_linenumber", "l_partkey"], 1_000_003.0)


@query(_FOLD.format(by="budget_id, day", eby="e.budget_id, e.day", on="e.budget_id = f.budget_id AND e.day = f.day", limit="97.0", first="e AS (SELECT user_id % 20 AS budget_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS day, value / 10 AS cost, row_number() OVER (PARTITION BY user_id % 20, strftime(ts, '%Y%m%d') ORDER BY event_id) AS i FROM events)"), digits=4)
def daily_budgets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("budget_id"), F.date_format("ts", "yyyyMMdd").cast("int").alias("day"), "event_id", (F.col("value") / 10).alias("cost"))
    return auction.budget_state(auction.spend_budgets(e, 97.0, ["budget_id", "day"], ["event_id"]), 97.0, ["budget_id", "day"])


@query(f"""SELECT CAST(event_id AS VARCHAR) AS _id, CAST(strftime(ts, '%Y%m%d') AS INT) AS _day, CAST(hour(ts) AS SMALLINT) AS _hod, CAST(event_type = 'click' AS TINYINT) AS _label_click, CAST(user_id AS VARCHAR) AS "C14",
coalesce(nullif(json_extract_string(props, '$.k'), '0'), '{MISSING}') AS site_domain, '{MISSING}' AS site_id FROM events""")
def canonical_log(spark, d):
    """Raw rows with an aliased, a partly missing and an absent feature, brought into canonical form."""
    k = F.get_json_object("props", "$.k")
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (F.col("event_type") == "click").cast("int").alias("click"), F.date_format("ts", "yyMMddHH").alias("hour"), F.col("user_id").alias("C14"), F.when(k != "0", k).alias("C4"))
    return ClickLogSource(features=["C14", "site_domain", "site_id"]).canonicalize(raw)


@query("SELECT strftime(ts, '%Y%m%d%H') AS hour, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY ALL")
def stream_ctr_windows(spark, d):
    """Rates by event-time window, computed by a stream."""
    rates = streams.to_table(streams.ctr_windows(streams.read_stream(spark, d, "events.parquet"), width="1 hour"), "ctr_windows", "complete")
    return rates.select(F.date_format("start", "yyyyMMddHH").alias("hour"), "impressions", "clicks")


@query(f"WITH {LOG} SELECT feature, value, CAST(sum(n_rows) AS BIGINT) AS count FROM cube GROUP BY ALL")
def stream_running_counts(spark, d):
    long = profile.long_form(event_log(streams.read_stream(spark, d, "events.parquet")), EVENT_FEATURES)
    return streams.to_table(streams.running_counts(long), "running_counts", "complete")


@query(f"WITH {LOG} SELECT DISTINCT feature, value FROM cube")
def stream_first_seen(spark, d):
    long = profile.long_form(event_log(streams.read_stream(spark, d, "events.parquet")), EVENT_FEATURES).select("feature", "value")
    return streams.to_table(streams.first_seen(long), "first_seen")


_SESSIONS = """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS events FROM b GROUP BY user_id, s"""
_FORM = "yyyy-MM-dd HH:mm:ss"


@query(_SESSIONS)
def user_sessions(spark, d):
    return streams.sessions(spark.read.parquet(f"{d}/events.parquet"), gap="12 hours").select("user_id", F.date_format("start", _FORM).alias("start"), F.date_format("end", _FORM).alias("end"), "events")


@query(_SESSIONS)
def stream_sessions(spark, d):
    """The same by a stream."""
    found = streams.to_table(streams.sessions(streams.read_stream(spark, d, "events.parquet"), gap="12 hours"), "sessions", "complete")
    return found.select("user_id", F.date_format("start", _FORM).alias("start"), F.date_format("end", _FORM).alias("end"), "events")


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks
FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(CAST(k AS INT)) AS s FROM events, range(3) t(k)) GROUP BY ALL""")
def stream_sliding_windows(spark, d):
    """Rates over three hours, a window beginning each hour."""
    rates = streams.to_table(streams.ctr_windows(streams.read_stream(spark, d, "events.parquet"), width="3 hours", slide="1 hour"), "sliding_windows", "complete")
    return rates.select(F.date_format("start", _FORM).alias("start"), "impressions", "clicks")


@query("""WITH RECURSIVE e AS (SELECT o_custkey % 50 AS budget_id, o_orderkey AS seq, o_totalprice / 1000 AS cost, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT budget_id, i, seq, cost, cost <= 3000 AS accepted, CASE WHEN cost <= 3000 THEN cost ELSE 0.0 END AS spent FROM e WHERE i = 1
      UNION ALL SELECT e.budget_id, e.i, e.seq, e.cost, f.spent + e.cost <= 3000, CASE WHEN f.spent + e.cost <= 3000 THEN f.spent + e.cost ELSE f.spent END FROM f JOIN e ON e.budget_id = f.budget_id AND e.i = f.i + 1)
SELECT budget_id, seq, round(cost, 6) AS cost, accepted FROM f""", digits=6)
def stream_budgets(spark, d):
    """Greedy budgets over a stream, with one number of state each."""
    o = streams.read_stream(spark, d, "orders.parquet").select((F.col("o_custkey") % 50).alias("budget_id"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1000).alias("cost"))
    return streams.to_table(streams.spend_stream(o, 3000.0), "budgets")


@query(f"WITH {LOG} SELECT feature, count(DISTINCT value) AS n_values, true AS close FROM longform GROUP BY feature")
def builtin_sketch(spark, d):
    """Is the estimate of the built-in sketch within 3 % of the distinct values?"""
    long = profile.long_form(canon_events(spark, d), EVENT_FEATURES)
    exact = long.groupBy("feature").agg(F.count_distinct("value").alias("n_values"))
    return exact.join(sketches.approx_distinct(long, ["feature"]), "feature").select("feature", "n_values", (F.abs(F.col("estimate") - F.col("n_values")) <= 0.03 * F.col("n_values")).alias("close"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(count(*) - 1 AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS distinct_ids FROM events")
def row_ids(spark, d):
    """Rows numbered without gaps."""
    return with_row_id(spark.read.parquet(f"{d}/events.parquet"), "row_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count_distinct("row_id").alias("distinct_ids"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
