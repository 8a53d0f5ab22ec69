"""Small literal cases of each operator."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from antigen.functions import bits, labels, special
from antigen.functions.metrics import confusion, with_metrics
from antigen.operators import baselines, cleaning, deploy, detectors, evaluation, features, matching, sampling, stats
from antigen.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_headers():
    assert files.clean_header([" Feature  A ", "﻿Label", "Label", "Feature A"]) == ["Feature A", "Label", "Label__2", "Feature A__2"]


def test_ragged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,tcp,normal,20\n2,udp,neptune,21\n")
    (tmp_path / "b.csv").write_text("1\ttcp\tNormal\n")
    names = ["x", "protocol", "label", "difficulty"]
    a, b = (files.read_positional(spark, str(tmp_path / n), names, "difficulty") for n in ("a.csv", "b.csv"))
    assert [tuple(r) for r in a.collect()] == [("1", "tcp", "normal", "20"), ("2", "udp", "neptune", "21")]
    assert [tuple(r) for r in b.collect()] == [("1", "tcp", "Normal", None)]
    (tmp_path / "c.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        files.read_positional(spark, str(tmp_path / "c.csv"), names, "difficulty")


def test_flow_files(spark, tmp_path):
    (tmp_path / "day").mkdir()
    for n in ("a", "b"):
        (tmp_path / "day" / f"{n}.csv").write_text(" Flow Duration , Label\n1,BENIGN\nbad,DDoS\n")
    df = files.read_flow_files(spark, str(tmp_path))
    assert df.columns == ["Flow Duration", "Label", "source_file", "source_row"]
    assert sorted((r.source_file[-5:], r.source_row, r.Label) for r in df.collect()) == [(n, i, t) for n in ("a.csv", "b.csv") for i, t in enumerate(("BENIGN", "DDoS"))]


def test_rows_of_a_split_file_are_numbered_through(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{'z' * 50}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_flow_files(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 1 and sorted((r.source_row, int(r.x)) for r in rows.collect()) == [(i, i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bounded_scan_tells_whether_it_is_whole(spark):
    df = frame(spark, [("a", i) for i in range(3)] + [("b", i) for i in range(2)], "s string, i int")
    assert sorted(map(tuple, files.bounded(df, "s", ["i"], 2).collect())) == [("a", 0, False), ("a", 1, False), ("b", 0, True), ("b", 1, True)]


def test_result_tables_and_prepared_data(spark, tmp_path):
    df = frame(spark, [(1, 0.1), (2, 1 / 3)], "a int, b double")
    files.write_table(df, str(tmp_path / "t"))
    files.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tables(spark, [str(tmp_path / "t")], "a int, b double").collect())) == [(1, 0.1), (2, 1 / 3)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_tables(spark, [str(tmp_path / "t"), str(tmp_path / "absent")], "a int, b double").collect()
    build = lambda x: x.where("a > 1")
    seen = [files.prepared(str(tmp_path / "p"), c, x, build)[1] for c, x in (({"k": 1}, df), ({"k": 1}, df.repartition(2)), ({"k": 2}, df), ({"k": 1}, df.where("a = 2")), ({"k": 1}, df))]
    assert seen == [False, True, False, False, True]


def test_journals_of_many_files(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / "j").mkdir(exist_ok=True)
        (tmp_path / "j" / n).write_text('{"a": 1}\n{"a": 2')
    assert column(files.read_journal(spark, str(tmp_path / "j"), "a int"), "a", "a") == [1, 1]


def test_journal(spark, tmp_path):
    good = '{"a": 1}\n\n{"a": 2}\n'
    (tmp_path / "torn").write_text(good + '{"a": 3')
    assert column(files.read_journal(spark, str(tmp_path / "torn"), "a int"), "a", "a") == [1, 2]
    (tmp_path / "bad").write_text('{"a": 1}\n[3]\n{"a": 2}\n')
    with pytest.raises(ValueError):
        files.read_journal(spark, str(tmp_path / "bad"), "a int")


def test_labels(spark):
    df = frame(spark, [(" Normal. ",), ("Web Attack � Brute Force",), ("DDoS",), ("BENIGN",)], "l string")
    out = df.select(labels.normalize_simple("l").alias("a"), labels.family_by_pattern("l").alias("f")).collect()
    assert out[0].a == "normal" and [r.f for r in out] == ["Unknown", "Brute Force", "DoS/DDoS", "Normal"]


def test_cleaning(spark):
    rows = [("1", "1", "BENIGN"), ("1", "1", "BENIGN"), ("inf", None, "DDoS"), ("bad", "2", "PortScan"), ("5", "5", None)]
    df = frame(spark, rows, "a string, b string, label string").withColumn("src", F.lit("s"))
    out = cleaning.clean(df, ["a", "b"], "label")
    assert sorted((r.a, r.b, r.label) for r in out.na.fill(-1).collect()) == [(-1, 2, "portscan"), (1, 1, "benign"), (1, 1, "benign")]
    report = [r for r in cleaning.quality_report(df, ["a", "b"], "label", "src").collect() if r.src == "ALL_SOURCES"][0]
    assert (report.rows_read, report.no_label, report.not_numbers, report.not_finite, report.no_feature, report.kept) == (5, 1, 1, 1, 1, 3)
    more = {r.src: r for r in cleaning.quality_report(df.withColumn("at", F.monotonically_increasing_id()), ["a", "b"], "label", "src", ["src", "at"]).collect()}
    assert (more["ALL_SOURCES"].copies, more["s"].remaining) == (1, 2)


def test_rare_labels_are_pooled(spark):
    rows = [(str(i), "normal", 0) for i in range(6)] + [(str(i), "ddos", 1) for i in range(6, 12)] + [("12", "x", 1), ("13", "y", 1)]
    out = sampling.safe_strata(frame(spark, rows, "id string, label string, y int"))
    assert {r.stratum: r["count"] for r in out.groupBy("stratum").count().collect()} == {"normal": 6, "ddos": 6, "__RARE_ATTACK__": 2}
    assert out.select("strategy", "pooled").distinct().collect() == [("original_label_with_rare_pooling", 2)]
    one = sampling.safe_strata(frame(spark, [(str(i), "normal", 0) for i in range(4)], "id string, label string, y int"))
    assert {(r.stratum, r.strategy, r.pooled) for r in one.collect()} == {("normal", "original_label", 0)}
    odd = sampling.safe_strata(frame(spark, rows[:13], "id string, label string, y int"))
    assert {(r.stratum, r.strategy) for r in odd.collect()} == {("0", "binary_fallback"), ("1", "binary_fallback")}
    assert {r.strategy for r in sampling.safe_strata(frame(spark, rows, "id string, label string, y int"), by_label=False).collect()} == {"binary"}


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("label"))
    once = sampling.stratified_split(df, "label", 0.3, 0.2, 1)
    again = sampling.stratified_split(df.repartition(7), "label", 0.3, 0.2, 1)
    assert once.exceptAll(again).count() == 0
    assert {r.split: r["count"] for r in once.groupBy("split").count().collect()} == {"test": 300, "validation": 141, "train": 559}  # strata of 334, 333 and 333 rows


def test_larger_samples_hold_smaller_ones(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    assert sampling.lowest(df, 50, 3).join(sampling.lowest(df, 120, 3), "id", "left_anti").count() == 0


def test_distances(spark):
    df = frame(spark, [(0b101, 0b111), (0b100, 0b111)], "a long, b long")
    w = [0.5, 0.25, 0.25]
    out = df.select(bits.hamming("a", "b").alias("h"), bits.weighted_hamming("a", "b", w).alias("w"), (1 - bits.weighted_hamming("a", "b", w)).alias("s"), bits.jaccard("a", "b").alias("j")).collect()
    assert [tuple(r) for r in out] == [(1, 0.25, 0.75, 2 / 3), (2, 0.75, 0.25, 1 / 3)]
    assert bits.normalized([0, 0]) == [0.5, 0.5]
    with pytest.raises(ValueError):
        bits.normalized([1, -1])


def test_weight_tables_cover_many_bits(spark):
    w = [0.01 * (i + 1) for i in range(20)]
    got = spark.range(0, 1 << 20, 77773).select("id", bits.weight_of(F.col("id"), w).alias("s")).collect()
    assert all(abs(r.s - sum(x for i, x in enumerate(w) if r.id >> i & 1)) < 1e-9 for r in got)


def test_selection_keeps_what_self_does_not_match(spark):
    pool = frame(spark, [(0, 0b000), (1, 0b111), (2, 0b101)], "detector_id long, pattern long")
    own = frame(spark, [(0b000,), (0b001,), (0b000,)], "bits long")
    kept = detectors.select_detectors(pool, own, 3, 0)
    assert sorted(r.detector_id for r in kept.collect()) == [1, 2]
    direct = detectors.select_by(pool, own, lambda a, b: bits.hamming(a, b) <= 0)
    assert sorted(r.detector_id for r in direct.collect()) == [1, 2]
    assert sorted((r.bits, r.pred) for r in detectors.detected(frame(spark, [(0b111,), (0b000,)], "bits long"), kept, 3, 0).collect()) == [(0b000, 0), (0b111, 1)]
    assert {r.pred for r in detectors.detected(own, kept.limit(0), 3, 1).collect()} == {0}
    assert detectors.select_detectors(pool, own.limit(0), 3, 1).count() == 3


def test_empty_pool(spark):
    rows = frame(spark, [(0,)] * 10, "bits long")
    pool = detectors.select_detectors(detectors.candidates(spark, 20, 3, 1), rows, 3, 3)
    assert pool.count() == 0
    assert {r.score for r in detectors.nearest(rows, pool, bits.hamming, True).collect()} == {math.inf}
    assert {r.score for r in detectors.nearest(rows, pool, bits.jaccard, False).collect()} == {0.0}


def test_ball_and_direct_plans_agree(spark):
    pool, own = detectors.candidates(spark, 200, 10, 5), spark.range(0, 1024, 41).select(F.col("id").alias("bits"))
    for r in (0, 1, 2):
        direct = detectors.select_by(pool, own, lambda a, b, r=r: bits.hamming(a, b) <= r)
        assert sorted(x.detector_id for x in detectors.select_detectors(pool, own, 10, r).collect()) == sorted(x.detector_id for x in direct.collect())


def test_distinct_patterns_score_like_all_rows(spark):
    rows = spark.range(2000).select("id", (F.col("id") * 37 % 310).alias("bits"))
    pool = detectors.candidates(spark, 50, 10, 2)
    whole = rows.crossJoin(pool).groupBy("id").agg(F.min(bits.hamming("bits", "pattern")).cast("double").alias("score"))
    assert detectors.nearest(rows, pool, bits.hamming, True).select("id", "score").exceptAll(whole).count() == 0


def calibrated(spark, rows, target, distance):
    df = frame(spark, rows, "score double, y int").withColumn("run", F.lit(1))
    return evaluation.calibrate(df, ["run"], [target], distance).first()


def test_calibration(spark):
    got = calibrated(spark, [(0.0, 0), (1.0, 0), (2.0, 0), (3.0, 0), (0.0, 1), (1.0, 1)], 0.25, True)
    assert (got.threshold, got.flagged, got.strict) == (0.0, 1, False)
    got = calibrated(spark, [(0.0, 0), (0.5, 0), (0.5, 0), (1.0, 0)], 0.5, False)
    assert (got.threshold, got.achieved) == (1.0, 0.25)
    got = calibrated(spark, [(2.0, 0), (2.0, 0)], 0.1, True)
    assert got.strict and got.degenerate and got.flagged == 0
    for distance, infinite, threshold in ((True, math.inf, 0.0), (False, -math.inf, 1.0)):
        got = calibrated(spark, [(infinite, 0), (infinite, 0), (0.0, 1)], 0.25, distance)
        assert (got.threshold, got.strict, got.flagged, got.benign, got.degenerate) == (threshold, False, 0, 2, True)


def test_cumulated_by_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = {(g, rnd.choice([-math.inf, math.inf, *(rnd.gauss(0, 1) for _ in range(9))])): rnd.randint(0, 5) for g in "ab" for _ in range(400)}
    df = frame(spark, [(g, x, n) for (g, x), n in rows.items()], "g string, x double, n long")
    for rising in (True, False):
        got = {(r.g, r.x): r.upto_n for r in evaluation.cumulated(df, ["g"], "x", ["n"], rising).collect()}
        assert got == {(g, x): sum(n for (h, y), n in rows.items() if g == h and (y <= x if rising else y >= x)) for g, x in rows}


def test_places_and_quantiles_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("g"))
    rows = sampling.placed(df.withColumn("h", sampling.uniform_hash(5, "id")), ["g"], F.col("h")).collect()
    for g in ("few", "many"):
        own = sorted((r.h, r.id, r["at"], r.n) for r in rows if r.g == g)
        assert [o[2] for o in own] == list(range(1, len(own) + 1)) and {o[3] for o in own} == {len(own)}
    data = {"even": np.round(rng.normal(size=20000), 2), "odd": rng.lognormal(size=3001), "one": np.array([4.0]), "ties": np.array([1.0] * 50 + [2.0])}
    long = frame(spark, [(f, float(v)) for f, x in data.items() for v in x] + [("even", None)], "feature string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.feature, r.share): r.value for r in features.quantiles(long, shares).collect()}
    assert got == {(f, s): pytest.approx(float(np.quantile(x, s)), abs=1e-12) for f, x in data.items() for s in shares}


@pytest.mark.parametrize("ordered", [1 << 20, 100, 1])
def test_quantiles_of_every_size(spark, monkeypatch, ordered):
    """Groups of 1 to 200 values and of many more sizes, all deciles; with cells that are parted again and again."""
    import numpy as np

    monkeypatch.setattr(features, "ORDERED", ordered)
    rng = np.random.default_rng(7)
    sizes = [*range(1, 201), 500, 1005, 1694, 1887, 2273, 2347, 2466, 2852, 3000, 5000, 20000] if ordered > 1 else [1, 2, 3, 7, 12, 1005, 2347]
    data = {f"n{n}": np.round(rng.normal(size=n), rng.integers(0, 6)) for n in sizes} | {"hot": np.append(np.zeros(900), [1.0, -np.inf, np.inf]), "whole": np.arange(50.0)}
    data["hot"] = np.append(data["hot"], [2.0] * 40)
    long = frame(spark, [(f, float(v)) for f, x in data.items() for v in x] + [("none", None)], "feature string, x double")
    shares = [0.0, *(i / 10 for i in range(1, 10)), 1.0]
    rows = features.quantiles(long, shares).collect()
    got = {(r.feature, r.share): r.value for r in rows}
    assert len(rows) == len(got) == len(data) * len(shares)
    for f, x in data.items():
        order = np.sort(x)
        for s in shares:
            place = s * (len(x) - 1)
            low, high = order[math.floor(place)], order[min(len(x) - 1, math.floor(place) + 1)]
            want = low if place == math.floor(place) else low + (high - low) * (place - math.floor(place))
            assert got[f, s] == pytest.approx(want, abs=1e-12), (f, s)
            if np.isfinite(x).all():
                assert got[f, s] == pytest.approx(float(np.quantile(x, s)), abs=1e-9), (f, s)


def test_errors_instead_of_cuts(spark):
    words = frame(spark, [(str(i),) for i in range(20)], "w string")
    with pytest.raises(ValueError):
        features.vocabulary(words, "w", 19)
    assert len(features.vocabulary(words, "w", 20)) == 20
    ranks = features.ranked(frame(spark, [("a", 0.3), ("b", 0.2)], "feature string, mi double"))
    assert [r.feature for r in features.top(ranks, 1).collect()] == ["a"]
    for k in (0, 3):
        with pytest.raises(ValueError):
            features.top(ranks, k)
    with pytest.raises(Exception, match="fewer than two"):
        sampling.resamples(frame(spark, [("1", 0), ("2", 0), ("3", 1)], "id string, y int"), [1], 0.8).collect()
    runs = frame(spark, [("a", 0.5, 0.2), ("b", 0.5, 0.9)], "g string, f1 double, fpr double")
    with pytest.raises(Exception, match="keeps the limit"):
        stats.locked(runs, ["g"], [F.desc("f1")], F.col("fpr") <= 0.5).collect()
    assert stats.locked(runs, [], [F.desc("f1")], F.col("fpr") <= 0.5).first().g == "a"


def test_wide_masks(spark):
    got = [r.pattern for r in detectors.candidates(spark, 400, 60, 7).collect()]
    assert len(set(got)) == 400 and all(100 < sum(p >> b & 1 for p in got) < 300 for b in range(60))
    assert [r.pattern for r in detectors.candidates(spark, 400, 20, 7).collect()] == [p & 0xFFFFF for p in got]
    with pytest.raises(ValueError):
        detectors.candidates(spark, 4, 63, 7)


def test_feature_tables(spark):
    df = frame(spark, [(1, 2.0, 3.0)], "id int, b double, a double")
    out = features.reindexed(df, ["a", "absent", "b"], ["id"], 7.0)
    assert out.columns == ["id", "a", "absent", "b"] and tuple(out.first()) == (1, 3.0, 7.0, 2.0)
    names = frame(spark, [(["x", "y"],), ([],)], "n array<string>").select(features.joined_names(F.col("n")).alias("t")).select("t", features.parted_names("t").alias("n"))
    assert [tuple(r) for r in names.collect()] == [("x|y", ["x", "y"]), ("", [])]
    p = features.fitted(features.statistics(frame(spark, [(1.0, None), (2.0, None)], "a double, gone double"), ["a", "gone"]))
    assert features.with_values(p, ["a", "gone"]) == ["a"]
    helpers = frame(spark, [(1, 2, 3, 4, 5)], "__source int, label int, port int, x int, difficulty int")
    assert cleaning.predictors(helpers, leaky=["port"]).columns == ["x"] and cleaning.predictors(helpers, keep=["label"]).columns == ["label", "port", "x"]


def test_deployed_pipeline(spark):
    rows = [(i, str(i % 7) if i % 5 else "bad", "ab"[i % 2], None) for i in range(40)]
    train = frame(spark, rows, "id int, n string, kind string, gone string")
    p = deploy.fit(train, ["n", "gone"], ["kind"])
    assert p.columns == ["n", "kind_a", "kind_b"] == p.selected
    p.detectors, p.threshold = [0b011, 0b110], 0.0
    new = frame(spark, [(1, "6", "a"), (2, "x", "unseen"), (3, None, "b"), (4, "0", "a")], "id int, n string, kind string")
    n = sorted(float(r[1]) for r in rows if r[1] != "bad")
    median = (n[15] + n[16]) / 2
    got = {r.id: (r.bits, r.score, r.pred) for r in p.transform(new, ["id"]).collect()}
    high = lambda x: int((median if x is None else x) > sorted(float(r[1]) if r[1] != "bad" else median for r in rows)[20])
    want = {1: high(6) | 2, 2: high(None), 3: high(None) | 4, 4: 2}
    for i, b in want.items():
        d = min(bin(b ^ x).count("1") for x in p.detectors)
        assert got[i] == (b, float(d), int(d <= 0)), i
    p.detectors = []
    assert {(r.score, r.pred) for r in p.transform(new, ["id"]).collect()} == {(math.inf, 0)}


def test_table_diff_and_numbers(spark):
    a = frame(spark, [(0, "x", 1), (1, "y", 2), (2, None, 3)], "p int, f string, g int")
    b = frame(spark, [(0, "x", 1), (1, "z", 2), (3, "w", 4)], "p int, f string, g int")
    got = {(r.field, r.a, r.b, r.n) for r in cleaning.table_diff(a, b, ["p"], ["f", "g"]).collect()}
    assert got == {("f", "y", "z", 1), ("f", None, "w", 1), ("g", "3", None, 1), ("g", None, "4", 1)}
    rows = spark.range(9000).select((F.col("id") % 3).alias("s"), F.col("id").cast("string").alias("k"))
    out = files.numbered(rows, "s", ["k"], "at").collect()
    for s in range(3):
        assert [r["at"] for r in sorted((r for r in out if r.s == s), key=lambda r: r.k)] == list(range(3000))


def test_metrics(spark):
    df = frame(spark, list(zip([0, 0, 1, 1, 1], [0, 1, 1, 0, 1], ["Normal", "Normal", "DoS", "Probe", "DoS"])), "y int, pred int, category string")
    m = with_metrics(df.agg(*confusion())).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.fpr, m.recall) == (1, 1, 1, 2, 0.5, 2 / 3)
    c = {r.category: r for r in evaluation.category_analysis(df.withColumn("run", F.lit(1)), ["run"]).collect()}
    assert c["Normal"].false_alarms == 1 and c["DoS"].detected == 2 and c["Normal"].recall is None and c["Probe"].recall == 0
    none = with_metrics(df.limit(0).agg(*confusion()).na.fill(0)).first()
    assert none.f1 == none.mcc == none.fpr == 0


def test_areas(spark):
    df = frame(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, y int").withColumn("run", F.lit(1))
    assert evaluation.roc_auc(df, ["run"]).first().roc_auc == 0.75
    assert abs(evaluation.average_precision(df, ["run"]).first().average_precision - 0.8333333) < 1e-6
    assert evaluation.roc_auc(df.where("y = 1"), ["run"]).first().roc_auc is None


def test_scaling_and_imputation(spark):
    train = frame(spark, [(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    p = features.fitted(features.statistics(train, ["a", "b"]))
    test = frame(spark, [(5.0, 7.0), (None, None)], "a double, b double")
    assert [tuple(r) for r in test.select(features.scaled("a", p["a"]), features.scaled("b", p["b"])).collect()] == [(2.0, 0.0), (None, 0.0)]
    assert test.select(features.imputed("a", p["a"])).collect()[1].a == 2.0


def test_discrete_mask(spark):
    df = frame(spark, [(0.0, 0.2), (1.0, 0.9)], "flag double, measure double")
    assert {r.feature: r.is_discrete for r in features.discrete_mask(df, ["flag", "measure"]).collect()} == {"flag": True, "measure": False}


def test_information_and_mrmr(spark):
    rows = [(a, b, a, a) for _ in range(10) for a, b in ((0, 1), (0, 0), (1, 1), (1, 0))]
    df = frame(spark, rows, "a int, b int, z int, y int")
    mi = {r.feature: r.mi for r in features.mutual_information(features.melted(df, ["y"], ["a", "b", "z"]), ["feature"]).collect()}
    assert abs(mi["a"] - math.log(2)) < 1e-12 and abs(mi["b"]) < 1e-12
    red = {(r.a, r.b): r.mi for r in features.pair_information(df, ["a", "b", "z"]).collect()}
    assert abs(red["a", "z"] - math.log(2)) < 1e-12
    assert features.mrmr(mi, red)[:2] == ["a", "b"]


def test_neighbour_information_by_brute_force(spark):
    import random

    rnd = random.Random(6)
    rows = [(rnd.gauss(i % 2, 1), i % 2) for i in range(120)] + [(0.5, 0)] * 6 + [(9.0, 2)]
    df = frame(spark, rows, "x double, y int").withColumn("feature", F.lit("f"))
    got = features.knn_information(df).first().mi

    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, n))

    used = [(x, y) for x, y in rows if sum(q == y for _, q in rows) > 1]
    total = 0.0
    for i, (x, y) in enumerate(used):
        d = sorted(abs(x - a) for j, (a, b) in enumerate(used) if j != i and b == y)
        k = min(3, len(d))
        r = d[k - 1]
        m = sum((abs(x - a) < r) if r > 0 else a == x for a, _ in used)
        total += psi(k) - psi(len(d) + 1) - psi(m)
    assert abs(got - max(0, psi(len(used)) + total / len(used))) < 1e-6


def test_holm_and_special(spark):
    df = frame(spark, [(0.01,), (0.04,), (0.03,), (None,)], "p double").withColumn("family", F.lit(1))
    assert [round(r.p_holm, 10) for r in stats.holm(df, ["family"]).where("p is not null").orderBy("p").collect()] == [0.03, 0.06, 0.06]
    assert abs(special.t_quantile(0.975, 19) - 2.093024054) < 1e-7 and abs(special.t_quantile(0.975, 1) - 12.7062047) < 1e-5
    low, high = special.clopper_pearson(5, 10)
    assert abs(low - 0.187086) < 1e-5 and abs(high - 0.812914) < 1e-5 and special.clopper_pearson(0, 10)[0] == 0.0


def test_signed_ranks(spark):
    df = frame(spark, [(1, d) for d in (1.0, 2.0, -1.0, 3.0, 0.0)] + [(2, 0.0)], "g int, diff double")
    got = {r.g: r for r in stats.signed_ranks(df, ["g"]).collect()}
    assert (got[1].n, got[1].w_plus, got[1].w_minus, got[1].effect) == (4, 8.5, 1.5, 0.7)
    p = {r.g: r.p for r in stats.with_signed_p(stats.signed_ranks(df, ["g"])).collect()}
    assert p[2] == 1.0 and 0 < p[1] < 1
    exact = frame(spark, [(1, 1.0), (1, -2.0), (1, 3.0), (1, 4.0), (1, 5.5)], "g int, diff double")
    assert stats.with_signed_p(stats.signed_ranks(exact, ["g"])).first().p == 0.1875  # 3 of 32 choices of signs, twice


def test_signed_rank_distribution_by_brute_force():
    from itertools import product

    for n in (1, 4, 9):
        totals = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert special.wilcoxon_p(w, n) == min(1.0, 2 * sum(t <= w for t in totals) / 2**n)


def test_binomial_interval_by_tails():
    for x, n in ((0, 7), (3, 20), (20, 20), (41, 250)):
        low, high = special.clopper_pearson(x, n)
        tail = lambda p, ks: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
        assert x == 0 or abs(tail(low, range(x, n + 1)) - 0.025) < 1e-9
        assert x == n or abs(tail(high, range(x + 1)) - 0.025) < 1e-9


def test_intervals_of_many_runs(spark):
    df = spark.range(250).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"), F.col("id").cast("string").alias("seed"))
    r = stats.interval(df, ["g"], "x").first()
    assert abs(r.high - r.low - 2 * 1.969537 * 72.3129 / 250**0.5) < 1e-3 and r.n == 250
    one, none = stats.interval(df.limit(1), ["g"], "x").first(), stats.interval(df.limit(2).withColumn("x", F.lit(None).cast("double")), ["g"], "x").first()
    assert (one.std, one.low, one.high) == (0.0, one.mean, one.mean) and (none.n, none.mean, none.low) == (0, None, None)
    both = stats.repeated_runs(df.limit(3).withColumn("g", F.lit(None).cast("int")), ["g"], ["x"]).first()
    assert (both.g, both.runs, both.seeds, both.metric) == (None, 3, "0|1|2", "x")


def test_sub_family_correction(spark):
    df = frame(spark, [(1, 0.01), (2, 0.04), (1, 0.03), (2, None)], "k int, p double")
    got = {(r.k, r.p): (r.p_holm, r.p_holm_sub) for r in stats.holm_with_subfamily(df, F.col("k") == 1).collect()}
    assert got[1, 0.01] == pytest.approx((0.03, 0.02)) and got[1, 0.03] == pytest.approx((0.06, 0.03)) and got[2, 0.04][1] is None


def test_pairs_reject_repeated_keys(spark):
    df = frame(spark, [(1, "a", 0.5), (1, "b", 0.7), (2, "a", 0.1)], "k int, m string, f1 double")
    assert [tuple(r) for r in stats.paired(df, ["k"], "m", "a", "b", ["f1"]).collect()] == [(1, 0.5, 0.7)]
    with pytest.raises(Exception, match="repeated"):
        stats.paired(df.union(df), ["k"], "m", "a", "b", ["f1"]).collect()


def test_bootstrap_is_repeatable(spark):
    df = frame(spark, [(1, 0.1), (1, 0.3), (2, 0.2), (2, 0.2)], "g int, d double")
    a, b = (sorted(map(tuple, stats.bootstrap(df, ["g"], "d", 200, 1).collect())) for _ in range(2))
    assert a == b and a[1][1:] == (0.2, 0.2, 0.2)
    # the draws by plain integers, each group from a stream of its own; what is not finite counts as missing
    import numpy as np

    own = {1: [0.5, -0.25, 1.0, 2.0, -3.0], 2: [0.1, 0.7, 0.2], 3: [4.0]}
    df = frame(spark, [(g, v) for g, vs in own.items() for v in vs] + [(2, None), (2, math.inf), (4, None)], "g int, d double")
    got = {r.g: (r.mean, r.low, r.high) for r in stats.bootstrap(df, ["g"], "d", 300, 2026).collect()}
    for at, g in enumerate(own):
        v, means = sorted(own[g]), []
        for b in range(300):
            drawn = []
            for i in range(len(v)):
                x = ((2026 + at) * 2654435761 + b * len(v) + i) % 2**32
                for _ in range(2):
                    x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
                drawn.append(v[((x >> 16) ^ x) % len(v)])
            means.append(sum(drawn) / len(v))
        want = (np.mean(v), np.quantile(means, 0.025), np.quantile(means, 0.975))
        assert got[g] == pytest.approx(want, abs=1e-12)
    assert got[4] == (None, None, None) and got[1][1] < got[1][0] < got[1][2]


def test_isolation_forest_ranks_outliers_first(spark):
    rows = [(i, (i % 10) / 10, (i % 7) / 7) for i in range(400)] + [(1000, 9.0, -9.0)]
    df = frame(spark, rows, "id long, a double, b double")
    out = baselines.isolation_scores(df, df, ["a", "b"], "id")
    assert out.orderBy(F.desc("score")).first().id == 1000


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "deep er").mkdir()
    (tmp_path / "a.csv").write_text("x,y,label\n1,2,benign\n3,4,benign\n")
    (tmp_path / "b.csv").write_text("y,x,label\n20,10,attack\n")
    (tmp_path / "deep er" / "c[1].csv").write_text('\ufeffx, extra  name ,y,label\n5,"7,7",6,benign\n')
    (tmp_path / "d.csv").write_text("x,y,label\n8,9,late\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("label,x\n")
    (tmp_path / "notes.txt").write_text("x,y\n0,0\n")
    df = files.read_flow_files(spark, str(tmp_path))
    assert df.columns == ["x", "y", "label", "extra name", "source_file", "source_row"]
    got = sorted((r.x, r.y, r.label, r["extra name"], r.source_file.rsplit("/", 1)[1], r.source_row) for r in df.collect())
    assert got == [("1", "2", "benign", None, "a.csv", 0), ("10", "20", "attack", None, "b.csv", 0), ("3", "4", "benign", None, "a.csv", 1), ("5", "6", "benign", "7,7", got[3][4], 0), ("8", "9", "late", None, "d.csv", 0)]
    (tmp_path / "only").mkdir()
    with pytest.raises(ValueError):
        files.read_flow_files(spark, str(tmp_path / "only"))


def test_least_step_and_caps_by_brute_force(spark):
    import random

    rnd = random.Random(8)
    own = {g: sorted({round(rnd.gauss(0, 10), 3) for _ in range(n)}) for g, n in (("a", 700), ("b", 40), ("c", 1), ("d", 2))}
    df = frame(spark, [(g, x) for g, xs in own.items() for x in xs], "g string, x double").repartition(5)
    got = {r.g: r.least_step for r in evaluation.least_step(df, ["g"], "x").collect()}
    assert got == {g: (pytest.approx(min(b - a for a, b in zip(xs, xs[1:])), abs=1e-12) if len(xs) > 1 else None) for g, xs in own.items()}
    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("y")).withColumn("h", sampling.uniform_hash(3, "id"))
    every = rows.collect()
    for n in (1, 2, 7, 100, 4999, 9000):
        want = []
        for y in (0, 1):
            of = sorted((r.h, r.id) for r in every if r.y == y)
            want += of[: max(1, math.floor(n * len(of) / 5000 + 0.5))]
        got = [(r.priority, r.id) for r in sampling.class_cap(rows.drop("h"), n, 3).collect()]
        assert got == sorted(want)[:n], n
    plan = sampling.class_cap(rows.drop("h"), 100, 3)._jdf.queryExecution().toString()
    assert "_range" in plan and plan.count("row_number") <= 8


@pytest.mark.parametrize("parts", [64, 3])
def test_neighbour_information_in_ranges(spark, monkeypatch, parts):
    """Classes of few and many rows, ties of half of all rows, and classes whose rows lie far apart."""
    import numpy as np

    ranges = evaluation.in_ranges
    monkeypatch.setattr(features, "in_ranges", lambda *a: ranges(*a, parts))
    rng = np.random.default_rng(2)
    data = {
        "wide": ([*rng.normal(size=300), *rng.normal(3, 1, 200), *(100 + rng.normal(size=5))], [0] * 300 + [1] * 200 + [2] * 5),
        "ties": ([0.0] * 200 + list(rng.integers(0, 4, 200).astype(float)), list(rng.integers(0, 2, 400))), "few": ([1.0, 2.0, 4.0, 4.0, 9.0], [0, 0, 1, 1, 2]),
    }
    rows = [(f, float(x), int(y)) for f, (xs, ys) in data.items() for x, y in zip(xs, ys)] + [("few", None, 0)]
    got = {r.feature: r.mi for r in features.knn_information(frame(spark, rows, "feature string, x double, y int").repartition(4)).collect()}
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    for f, (xs, ys) in data.items():
        xs, ys = np.array(xs), np.array(ys)
        kept = [y for y in set(ys.tolist()) if (ys == y).sum() > 1]
        xs, ys = xs[np.isin(ys, kept)], ys[np.isin(ys, kept)]
        terms = []
        for i, (x, y) in enumerate(zip(xs, ys)):
            same = np.sort(np.abs(np.delete(xs, i)[np.delete(ys, i) == y] - x))
            k = min(3, len(same))
            r = same[k - 1] * (1 - 1e-9)
            terms.append(psi(k) - psi(len(same) + 1) - psi(int((np.abs(xs - x) <= r).sum())))
        assert got[f] == pytest.approx(max(0.0, psi(len(xs)) + np.mean(terms)), abs=1e-9), f


def test_rank_correlation_by_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5))
    x[:, 1] = np.round(x[:, 0])
    x[:, 3] = 4.0
    df = frame(spark, [(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 1.0, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, d double, e double").repartition(3)
    got = {(r.a, r.b): r.rho for r in features.rank_correlation(df, "id", list("ecadb")).collect()}
    import pandas as pd

    ranks = pd.DataFrame(x, columns=list("abcde")).rank()
    want = {(a, b): None if "d" in (a, b) else pytest.approx(float(np.corrcoef(ranks[a], ranks[b])[0, 1]), abs=1e-12) for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]}
    assert got == want


def test_a_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    """Ended within each batch in turn, then resumed; files that come later are read as well."""
    from antigen.streaming import twins

    spark.range(60).repartition(4, "id").write.parquet(str(tmp_path / "in"))
    for stop in (0, 1, 3):
        stream = lambda: twins.stream_of(spark, str(tmp_path / "in"), 1)
        first = twins.resumed(stream(), str(tmp_path / f"out{stop}"), stop=stop)
        assert 0 < first.count() <= 60
        if stop == 3:
            spark.range(60, 70).write.mode("append").parquet(str(tmp_path / "in"))
        got = sorted(r.id for r in twins.resumed(stream(), str(tmp_path / f"out{stop}")).collect())
        assert got == list(range(70 if stop == 3 else 60))
        assert sorted(r.id for r in twins.resumed(stream(), str(tmp_path / f"out{stop}")).collect()) == got


def test_weighted_and_wide_selection(spark):
    """Measures of the trie, the product and the one pass agree; a radius of too many masks goes by the trie."""
    pool, own = detectors.candidates(spark, 300, 14, 5), spark.range(0, 16384, 401).select(F.col("id").alias("bits"))
    weights = bits.normalized([float(i % 5 + 1) for i in range(14)])
    measure = matching.Weighted(tuple(weights))
    direct = detectors.select_by(pool, own, lambda a, b: bits.weighted_hamming(a, b, weights) <= 0.2)
    ids = lambda df: sorted(r.detector_id for r in df.collect())
    assert ids(detectors.select_by(pool, own, measure, 0.2)) == ids(direct) and 0 < direct.count() < 300
    assert detectors.ball_masks(14, 6) > detectors.MASKS
    hits = detectors.select_by(pool, own, lambda a, b: bits.hamming(a, b) <= 6)
    assert ids(detectors.select_detectors(pool, own.limit(3), 14, 6)) == ids(detectors.select_by(pool, own.limit(3), lambda a, b: bits.hamming(a, b) <= 6)) and hits.count() == 0
    rows = spark.range(500).select("id", (F.col("id") * 37 % 310).alias("bits"))
    for m, plain, distance in ((measure, lambda a, b: 1 - bits.weighted_hamming(a, b, weights), False), (matching.hamming(14), bits.hamming, True), (matching.Jaccard(14), bits.jaccard, False)):
        want = detectors.nearest(rows, pool, plain, distance).select("id", F.round("score", 10).alias("s"))
        for few in (1024, 10):
            detectors.FEW = few
            assert detectors.nearest(rows, pool, m, distance).select("id", F.round("score", 10).alias("s")).exceptAll(want).count() == 0
    detectors.FEW = 1024
    hit = {r.id: r.pred for r in detectors.detected_by(rows, pool, measure, 0.05).collect()}
    near = {r.id: r.score for r in detectors.nearest(rows, pool, measure, True).collect()}
    assert hit == {i: int(s <= 0.05) for i, s in near.items()} and set(hit.values()) == {0, 1}
    empty = detectors.nearest(rows, pool.limit(0), measure, False)
    assert {r.score for r in empty.collect()} == {0.0}


def test_performance_summary_of_unlike_tables(spark):
    detectors = spark.createDataFrame([("a", None, 10, 0.5, 0.1), ("a", None, 9, 0.7, None), ("b", "x", 9, 0.25, 0.2)], "method string, dataset string, seed int, f1 double, mcc double")
    trees = spark.createDataFrame([("lr", "x", 2, 0.5), ("lr", "x", 2, 1.0)], "model string, dataset string, seed int, f1 double")
    got = stats.performance_summary({"detector": (detectors, "method"), "baseline": (trees, "model")}, ["dataset"], ["f1", "mcc"])
    rows = {(r["approach"], r["procedure"], r["dataset"], r["metric"]): r for r in got.collect()}
    assert len(rows) == 5  # no mcc of the baseline
    r = rows["detector", "a", None, "f1"]
    assert (r["runs"], r["seeds"], r["n"]) == (2, "9|10", 2) and abs(r["mean"] - 0.6) < 1e-12
    half = 12.706204736432095 * np.std([0.5, 0.7], ddof=1) / np.sqrt(2)
    assert abs(r["high"] - r["mean"] - half) < 1e-9
    one = rows["detector", "a", None, "mcc"]
    assert (one["runs"], one["n"], one["std"], one["low"], one["high"]) == (2, 1, 0.0, 0.1, 0.1)
    assert rows["baseline", "lr", "x", "f1"]["seeds"] == "2"
    assert stats.performance_summary({"none": (trees.limit(0), "model")}, ["dataset"], ["f1"]).count() == 0


def test_locks_hold_each_row_against_its_own_limit(spark):
    rows = spark.createDataFrame([("m", 0.1, 1, 0.9, 0.3), ("m", 0.1, 2, 0.5, 0.1), ("m", 0.3, 1, 0.9, 0.3)], "method string, target double, k int, f1 double, fpr double")
    keeps = lambda df: stats.locked(df, ["method", "target"], [F.desc("f1")], F.col("fpr") <= F.col("target") + 1e-12)
    assert {(r["target"], r["k"]) for r in keeps(rows).collect()} == {(0.1, 2), (0.3, 1)}
    with pytest.raises(Exception, match="no configuration keeps the limit"):
        keeps(rows.where("k = 1")).collect()
