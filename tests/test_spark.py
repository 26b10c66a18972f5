"""Operators on small hand-made tables: edge cases, invariants and failure paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairspan.operators import classify, pairs, quality, resample, similarity, stats
from pairspan.plans import catalog
from pairspan.plans.study import process_dataset
from pairspan.session import fresh_path
from pairspan.sources import files
from pairspan.spi import basic, infotheory, spectral
from pairspan.streaming.incremental import append_missing


def values(df):
    return {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in df.collect()}


def test_constant_series_gives_null_never_an_error(panel):
    for family in ("cov", "spearman", "xcorr", "mi", "dcorr", "spectral", "lmfit", "te_symbolic"):
        v = values(catalog.FAMILIES[family][0](panel))
        assert all(x is None or np.isfinite(x) for x in v.values())
    cov = values(basic.spi_cov(panel))
    assert cov[("cov_EmpiricalCovariance", "s2", "a", "b")] is None
    assert cov[("cov_EmpiricalCovariance", "s2", "a", "c")] is not None


def test_missing_node_leaves_its_pairs_out(panel):
    v = values(basic.spi_cov(panel))
    assert ("cov_EmpiricalCovariance", "s4", "a", "b") in v
    assert not any(k[1] == "s4" and "c" in k[2:] for k in v)


def test_lagged_copy_is_seen(panel):
    gc = values(infotheory.spi_gc_gaussian(panel))
    name = "gc_gaussian_k-1_kt-1_l-1_lt-1"
    assert gc[(name, "s3", "a", "b")] is None or gc[(name, "s3", "a", "b")] > gc[(name, "s3", "b", "a")]


def test_salted_join_gives_the_same_pairs(panel):
    plain = pairs.pair_self_join(panel).groupBy(*pairs.PAIR).agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    salted = pairs.pair_self_join(panel, node_blocks=3, block=7).groupBy(*pairs.PAIR).agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    a, b = ({tuple(r)[:3]: r.s for r in df.collect()} for df in (plain, salted))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], nan_ok=True) if a[k] is not None else b[k] is None for k in a)


def test_steps_one_side_lacks_are_left_out(spark):
    rows = [("s", "a", t, float(t)) for t in range(5)] + [("s", "b", t, float(-t)) for t in (1, 3, 4)]
    df = spark.createDataFrame(rows, "sample_id string, node string, t int, z double")
    got = sorted((r.t, r.x, r.y) for r in pairs.pair_self_join(df).collect())
    assert got == [(1, 1.0, -1.0), (3, 3.0, -3.0), (4, 4.0, -4.0)]


def test_precision_is_the_inverse(panel, spark):
    one = panel.where("sample_id = 's1'")
    v = values(basic.spi_prec(one))
    pdf = one.toPandas().pivot(index="t", columns="node", values="z")
    s = (pdf.T @ pdf / 40).to_numpy()
    assert v[("prec_EmpiricalCovariance", "s1", "a", "b")] == pytest.approx(np.linalg.inv(s)[0, 1])


def test_spectral_ranges(panel):
    m = spectral.measures(spectral.pair_spectra(panel, False)).where("cohmag IS NOT NULL")
    r = m.agg(F.max("cohmag").alias("c"), F.min("wpli").alias("l"), F.max("plv").alias("p")).first()
    assert r.c <= 1 + 1e-9 and r.l >= 0 and r.p <= 1 + 1e-9


def test_envelope_correlation_of_a_copy_is_one(spark):
    t = np.arange(32)
    v = np.sin(t) * (1 + t / 10)
    rows = [("s", n, int(i), float(x)) for n in "ab" for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "sample_id string, node string, t int, z double")
    assert values(spectral.spi_pec(df))[("pec", "s", "a", "b")] == pytest.approx(1.0)


PANEL = "sample_id string, node string, t int, z double"


def test_lags_are_steps_not_places(spark):
    rows = [("s", "a", t, float(t)) for t in (0, 1, 2, 5, 6)] + [("s", "b", t, float(10 * t)) for t in (1, 2, 3, 6, 7)]
    got = {(r.node_from, r.lag, r.t, r.x, r.y) for r in pairs.lag_self_join(spark.createDataFrame(rows, PANEL), [0, 1]).where("node_from = 'a'").collect()}
    assert got == {("a", lag, t, float(t), 10.0 * (t + lag)) for lag in (0, 1) for t in (0, 1, 2, 5, 6) if t + lag in (1, 2, 3, 6, 7)}


def test_series_with_a_missing_step(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=40)
    rows = [("s", "a", t, float(x)) for t, x in enumerate(v)] + [("s", "b", t, float(x)) for t, x in enumerate(v) if t != 17]
    df = spark.createDataFrame(rows, PANEL)
    assert values(spectral.spi_pec(df))[("pec", "s", "a", "b")] == pytest.approx(1.0)
    assert {r.cohmag for r in spectral.measures(spectral.pair_spectra(df, False)).collect()} == {None}
    held = [(v[t], v[t + 1]) for t in range(39) if t != 17 and t + 1 != 17]  # x and y at t, y at t + 1
    want = -0.5 * np.log(1 - np.corrcoef(*zip(*held, strict=True))[0, 1] ** 2)
    assert values(infotheory.spi_tlmi(df))[("tlmi_gaussian", "s", "a", "b")] == pytest.approx(want)
    top = max(abs(sum(v[t] * v[t + l] for t in range(40) if 0 <= t + l < 40 and t + l != 17)) for l in range(-9, 10)) / 39
    assert values(basic.spi_xcorr(df))[("xcorr_max_sig-True", "s", "a", "b")] == pytest.approx(top)


def test_two_steps_and_empty_panel(spark, panel):
    tiny = panel.where("t < 2")
    assert basic.spi_cov(tiny).count() > 0
    assert catalog.spi_all(panel.where("false"), ["cov", "kendall", "mi"]).count() == 0


def test_quality_rules(spark):
    rows = [("ok", "s1", 1.0), ("ok", "s2", 2.0), ("same", "s1", 1.0), ("same", "s2", 1.0), ("part", "s1", 1.0), ("part", "s1", 2.0), ("hole", "s1", None), ("hole", "s2", 5.0)]
    fact = spark.createDataFrame(rows, "spi string, sample_id string, value double")
    assert {r.spi for r in quality.qc_nonconstant(fact).collect()} == {"ok", "part", "hole"}
    assert {r.spi for r in quality.qc_keep(fact).select("spi").distinct().collect()} == {"ok", "hole"}


def test_splits_and_permutations(spark):
    rows = [(f"s{i}", "rare" if i == 0 else ("x" if i < 8 else "y"), str(i % 4)) for i in range(21)]
    s = spark.createDataFrame(rows, "sample_id string, grp string, subject string")
    q = {r.grp: (r.q_train, r.q_test) for r in resample.class_quotas(s, 0.5, 0.5).collect()}
    assert sum(a for a, _ in q.values()) == 10 and sum(b for _, b in q.values()) == 11
    parts = resample.split_stratified(s, 4, 0.5, 0.5).groupBy("resample", "part").count().collect()
    assert {(r.part, r["count"]) for r in parts} == {("train", 10), ("test", 11)}
    logo = resample.split_leave_group_out(s)
    assert logo.where("part = 'test' AND subject <> resample").count() == 0 and logo.count() == 84
    p = resample.permute_labels(s, 3, within="subject").join(s, "sample_id")
    true = {(r.subject, r.grp): r["count"] for r in s.groupBy("subject", "grp").count().collect()}
    for perm in (1, 2, 3):
        dealt = {(r.subject, r.label): r["count"] for r in p.where(F.col("perm") == perm).groupBy("subject", "label").count().collect()}
        assert dealt == true


def test_machines_agree_on_separable_data(spark):
    rng = np.random.default_rng(5)
    rows, samples = [], []
    for i in range(24):
        g = "a" if i % 2 else "b"
        samples.append((f"s{i:02d}", g, str(i)))
        for f in range(4):
            rows.append(("k", f"s{i:02d}", f"f{f}", float(rng.normal() + (4 if g == "a" else -4))))
    feats = spark.createDataFrame(rows, "spi string, sample_id string, feature string, value double")
    tasks = classify.with_labels(resample.split_stratified(spark.createDataFrame(samples, "sample_id string, grp string, subject string"), 2, 0.5, 0.5))
    small = classify.svm_fit_many(feats, tasks)
    wide = classify.svm_fit_all_spis(feats, tasks)
    for df in (small, wide):
        assert [(r.n_test, r.n_correct) for r in df.collect()] == [(12, 12)] * 2


@pytest.fixture(scope="module")
def overlapping(spark):
    """Three overlapping classes; samples lack some features."""
    rng = np.random.default_rng(8)
    samples = [(f"s{i:02d}", "abc"[i % 3], str(i)) for i in range(45)]
    rows = [("k", s, f"f{f:02d}", float(rng.normal() + (ord(g) - 97) * (f < 3))) for s, g, _ in samples for f in range(12) if rng.random() < 0.9]
    table = spark.createDataFrame(samples, "sample_id string, grp string, subject string")
    tasks = classify.with_labels(resample.split_stratified(table, 3, 0.5, 0.5), resample.permute_labels(table, 2))
    return spark.createDataFrame(rows, "spi string, sample_id string, feature string, value double"), tasks, rows


def counts(df):
    return {(r.resample, r.perm): (r.n_test, r.n_correct) for r in df.collect()}


def test_machines_equal_plain_fits_whatever_the_blocks(overlapping):
    from pairspan.functions.svm import fit_classes, vote

    feats, tasks, rows = overlapping
    at = {s: i for i, s in enumerate(sorted({r[1] for r in rows}))}
    x = np.zeros((45, 12))
    for _, s, f, v in rows:
        x[at[s], int(f[1:])] = v
    want = {}
    held = tasks.collect()
    for key in {(r.resample, r.perm) for r in held}:
        train = sorted((at[r.sample_id], r.label) for r in held if (r.resample, r.perm) == key and r.part == "train")
        test = [(at[r.sample_id], r.label) for r in held if (r.resample, r.perm) == key and r.part == "test"]
        t, u = x[[i for i, _ in train]], x[[i for i, _ in test]]
        z, w = (t - t.mean(0)) / t.std(0), (u - t.mean(0)) / t.std(0)
        pred = vote(w @ z.T, *fit_classes(z @ z.T, np.array([g for _, g in train])))
        want[key] = (len(test), int((pred == np.array([g for _, g in test])).sum()))
    assert counts(classify.svm_fit_many(feats, tasks)) == want
    assert counts(classify.svm_fit_all_spis(feats, tasks, feature_width=5, sample_rows=10, perm_blocks=2)) == want


def test_fit_rows_are_bounded_and_every_test_row_is_scored(overlapping):
    feats, tasks, _ = overlapping
    kept = classify.fit_rows(tasks.where("perm = 0 AND part <> 'unused'"), 9)
    assert {r["count"] for r in kept.where("part = 'train'").groupBy("resample").count().collect()} <= {7, 8, 9}
    assert {n for n, _ in counts(classify.svm_fit_many(feats, tasks, max_fit_rows=9)).values()} == {23}


def test_tasks_without_rows_stay(overlapping):
    feats, tasks, _ = overlapping
    part = F.when(F.col("resample") == 1, "train").when(F.col("resample") == 2, "test").otherwise(F.col("part"))
    got = counts(classify.svm_fit_many(feats, tasks.withColumn("part", part)))
    assert got[1, 0] == (0, 0) and got[2, 1] == (45, None) and got[3, 2][1] is not None


def test_machine_meets_the_optimality_conditions():
    from pairspan.functions.svm import fit_pair

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 5)), np.repeat([1.0, -1.0], 30)
    x[:30] += 0.5
    coef, offset = fit_pair(x @ x.T, y)
    alpha, margin = coef * y, y * (x @ x.T @ coef + offset)
    assert abs(coef.sum()) < 1e-4 and alpha.min() > -1e-6 and alpha.max() < 1 + 1e-6
    assert (margin[alpha < 1e-4] > 1 - 1e-3).all() and (margin[alpha > 1 - 1e-4] < 1 + 1e-3).all()
    assert np.allclose(margin[(alpha > 1e-3) & (alpha < 1 - 1e-3)], 1, atol=1e-3)
    with pytest.raises(ArithmeticError):
        fit_pair(np.full((4, 4), np.nan), np.array([1.0, 1, -1, -1]))


def naive_wpgma(d):
    d, live, out = dict(d), sorted({k for p in d for k in p}), []
    while len(live) > 1:
        (a, b), h = min(d.items(), key=lambda e: (round(e[1], 12), e[0]))
        out.append((a, b, h))
        live.remove(b)
        for k in live:
            if k != a:
                x, y = d.pop(tuple(sorted((a, k)))), d.pop(tuple(sorted((b, k))))
                d[tuple(sorted((a, k)))] = (x + y) / 2
        d.pop((a, b))
    return out


def test_linkage_matches_closest_pair_first(spark):
    rng = np.random.default_rng(11)
    names = list("abcdefgh")
    d = {(p, q): float(rng.random()) for i, p in enumerate(names) for q in names[i + 1 :]}
    dist = spark.createDataFrame([(*k, v) for k, v in d.items()], "a string, b string, d double")
    tree, members = similarity.wpgma_linkage(dist)
    got = sorted((r.a, r.b, round(r.height, 9)) for r in tree.collect())
    assert got == sorted((a, b, round(h, 9)) for a, b, h in naive_wpgma(d))
    cut = similarity.cluster_cut(dist, 0.3)
    low = [m for m in naive_wpgma(d) if m[2] <= 0.3]
    assert cut.select("cluster").distinct().count() == len(names) - len(low)
    assert similarity.module_names(cut).count() == len(names)


def test_p_values_are_strict_and_bounded(spark):
    acc = spark.createDataFrame([("p", "k", i, v) for i, v in enumerate((0.5, 0.7))], "problem string, spi string, resample int, accuracy double")
    nul = spark.createDataFrame([("p", "k", i, v) for i, v in enumerate((0.6, 0.6, 0.2, 0.9))], "problem string, spi string, perm int, null_accuracy double")
    r = stats.p_values(acc, nul, ["problem"]).first()
    assert r.p_value == pytest.approx(0.75) and not r.significant


def test_tolerant_read_and_rejects(spark):
    path = fresh_path(spark, "t")
    spark.range(5).write.parquet(f"{path}/good")
    spark.createDataFrame([("junk",)], "v string").coalesce(1).write.text(f"{path}/bad")
    good = files.scan_tolerant(spark, path, "id long")
    assert good.count() == 5
    lost = [r.file for r in files.rejected_files(spark, path, good).collect()]
    assert len(lost) == 1 and "/bad/" in lost[0]


def test_only_missing_samples_are_computed(spark, panel):
    path = fresh_path(spark, "inc")
    append_missing(panel.where("sample_id IN ('s1', 's2')"), path, basic.spi_cov, spark)
    before = spark.read.parquet(path).count()
    append_missing(panel, path, basic.spi_cov, spark)
    whole = spark.read.parquet(path)
    assert whole.count() == basic.spi_cov(panel).count() > before
    assert whole.dropDuplicates(["spi", *pairs.PAIR]).count() == whole.count()


def test_rows_that_lack_a_feature_keep_their_columns(spark):
    from pairspan.operators.reshape import feature_vectors

    rows = [("cov", "s1", "a", 1.0), ("cov", "s1", "b", 2.0), ("cov", "s2", "b", 3.0), ("cov", "s3", "a", None), ("cov", "s3", "b", 4.0), ("mi", "s1", "c", 5.0)]
    long = spark.createDataFrame(rows, "spi string, sample_id string, feature string, value double")
    got = {(r.spi, r.sample_id): r.vector for r in feature_vectors(long, ["spi", "sample_id"]).collect()}
    assert got == {("cov", "s1"): [1.0, 2.0], ("cov", "s2"): [0.0, 3.0], ("cov", "s3"): [None, 4.0], ("mi", "s1"): [5.0]}
    every = {r.sample_id: (r.features, r.vector) for r in feature_vectors(long, ["sample_id"]).collect()}
    assert every["s2"] == (["a", "b", "c"], [0.0, 3.0, 0.0])


def test_centroid_fills_absent_cells(spark):
    """A feature that a sample lacks counts as 0, in training and in test rows; the plain version agrees under every permutation."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 5)) + np.arange(24)[:, None] % 3
    x[rng.random(x.shape) < 0.2] = 0
    feats = [("a", f"s{i:02d}", f"f{j}", float(x[i, j])) for i in range(24) for j in range(5) if x[i, j] != 0]
    part = np.where(np.arange(24) % 4 == 0, "test", "train")
    labels = {p: [f"c{i % 3}" for i in (range(24) if p == 0 else rng.permutation(24))] for p in range(3)}
    tasks = [(1, p, f"s{i:02d}", str(part[i]), labels[p][i]) for p in labels for i in range(24)]
    got = classify.centroid_classify(
        spark.createDataFrame(feats, "spi string, sample_id string, feature string, value double"),
        spark.createDataFrame(tasks, "resample int, perm int, sample_id string, part string, label string"),
    )
    want = set()
    scale = x[part == "train"].std(axis=0)
    for p, own in labels.items():
        own = np.array(own)
        centres = {c: (x[(part == "train") & (own == c)] / scale).mean(axis=0) for c in sorted(set(own))}
        for i in np.flatnonzero(part == "test"):
            want.add((p, f"s{i:02d}", own[i], min(centres, key=lambda c: round(((x[i] / scale - centres[c]) ** 2).sum(), 8))))
    assert {(r.perm, r.sample_id, r.label, r.pred) for r in got.collect()} == want
    assert got.where(F.col("spi") != "a").count() == 0


def test_configuration_errors(spark, panel):
    config = lambda *rows: catalog.config_rows(spark, list(rows))
    for wrong in (("x", "no_such_family", {}), ("cds", "cds", {"width": "3"})):
        with pytest.raises(ValueError):
            catalog.spi_from_config(panel, config(wrong))
    with pytest.raises(Exception, match="no values of statistic nothing"):
        catalog.spi_from_config(panel, config(("nothing", "cov", {}))).collect()
    strict = catalog.spi_from_config(panel, config(("xcorr_max_sig-True_bar-2.5", "xcorr", {"bar": "2.5"})))
    assert {r.spi for r in strict.collect()} == {"xcorr_max_sig-True_bar-2.5"}


def test_too_many_rows_asked_for(spark):
    s = spark.createDataFrame([(f"s{i}", f"c{i % 2}") for i in range(10)], "sample_id string, grp string")
    with pytest.raises(Exception, match="exceed"):
        resample.split_stratified(s, 2, 8, 5).collect()


def test_study_leaves_subjects_out(spark):
    """A statistic that every subject has is kept, though one sample lacks it; each subject is a fold."""
    rows = [(spi, f"s{i}", a, b, float((i * 7 + len(a + b) + k * i) % 11)) for k, spi in enumerate(("p", "q")) for i in range(12) for a, b in (("a", "b"), ("a", "cc")) if not (spi == "q" and i == 3)]
    fact = spark.createDataFrame(rows, "spi string, sample_id string, node_from string, node_to string, value double")
    info = spark.createDataFrame([("p", "Undirected"), ("q", "Undirected")], "spi string, directionality string")
    samples = spark.createDataFrame([(f"s{i}", f"g{i % 2}", f"u{i % 3}") for i in range(12)], "sample_id string, grp string, subject string")
    out = process_dataset(fact, info, samples, n_perm=1, leave_out="subject").per_spi.collect()
    assert {(r.spi, r.resample) for r in out} == {(spi, u) for spi in ("p", "q") for u in ("u0", "u1", "u2")}
