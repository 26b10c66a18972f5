"""Splits, permutations and classifiers on the pair statistics of the event panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairspan import fixtures as fx
from pairspan.functions.numeric import rounded
from pairspan.operators import classify, quality, resample, windows
from pairspan.plans.study import process_dataset
from pairspan.session import cut_lineage
from pairspan.workloads.registry import query
from pairspan.workloads.sqltext import EV, SPI, r6, with_


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return fx.event_samples(spark, sf)


def _quota(name: str, train: str, test: str) -> str:
    return f"""{name}c AS (SELECT grp, count(*) AS nc FROM meta GROUP BY 1), {name}t AS (SELECT *, sum(nc) OVER () AS n FROM {name}c),
{name}a AS (SELECT *, {train} AS ntr FROM {name}t), {name}b AS (SELECT *, {test} AS nte, nc * ntr / n::DOUBLE AS ex FROM {name}a),
{name}d AS (SELECT *, floor(ex) + CASE WHEN row_number() OVER (ORDER BY round(ex - floor(ex), 9) DESC, grp) <= ntr - sum(floor(ex)) OVER () THEN 1 ELSE 0 END AS qtr FROM {name}b),
{name}e AS (SELECT *, (nc - qtr) * nte / (sum(nc - qtr) OVER ())::DOUBLE AS ex2 FROM {name}d),
{name} AS (SELECT grp, qtr, floor(ex2) + CASE WHEN row_number() OVER (ORDER BY round(ex2 - floor(ex2), 9) DESC, grp) <= nte - sum(floor(ex2)) OVER () THEN 1 ELSE 0 END AS qte FROM {name}e)"""


def _split(n: int, quota: str) -> str:
    return f"""sp AS (SELECT r AS resample, sample_id, m.grp, CASE WHEN place <= qtr THEN 'train' WHEN place <= qtr + qte THEN 'test' ELSE 'unused' END AS part
  FROM (SELECT r, sample_id, grp, row_number() OVER (PARTITION BY r, grp ORDER BY md5(concat_ws('|', '42', r::VARCHAR, sample_id))) AS place FROM meta, range(1, {n + 1}) k(r)) m JOIN {quota} q ON q.grp = m.grp)"""


_HALF = _quota("qh", "floor(n * 0.5)", "least(ceil(n * 0.5), n - floor(n * 0.5))")
_COUNTS = _quota("qn", "60", "70")


@query("split_stratified", with_(EV, f", {_HALF}, {_split(30, 'qh')} SELECT CAST(resample AS INTEGER) AS resample, sample_id, grp, part FROM sp"))
def _(spark, sf):
    return resample.split_stratified(_samples(spark, sf), 30, 0.5, 0.5)


@query("split_stratified_counts", with_(EV, f", {_COUNTS}, {_split(30, 'qn')} SELECT CAST(resample AS INTEGER) AS resample, sample_id, grp, part FROM sp"))
def _(spark, sf):
    return resample.split_stratified(_samples(spark, sf), 30, 60, 70)


@query(
    "split_leave_group_out",
    with_(EV, "SELECT sample_id, grp, m.subject, f.subject AS resample, CASE WHEN m.subject = f.subject THEN 'test' ELSE 'train' END AS part FROM meta m, (SELECT DISTINCT subject FROM meta) f"),
)
def _(spark, sf):
    return resample.split_leave_group_out(_samples(spark, sf))


def _perm(n: int, extra: str) -> str:
    return f"""tk AS (SELECT p AS perm, sample_id, grp, subject FROM meta, range(1, {n + 1}) k(p)),
fx AS (SELECT *, row_number() OVER (PARTITION BY perm{extra} ORDER BY md5(concat_ws('|', '0', sample_id))) AS place FROM tk),
dl AS (SELECT *, row_number() OVER (PARTITION BY perm{extra} ORDER BY md5(concat_ws('|', '42', perm::VARCHAR, sample_id))) AS place FROM tk),
pm AS (SELECT CAST(f.perm AS INTEGER) AS perm, f.sample_id, d.grp AS label FROM fx f JOIN dl d ON f.perm = d.perm AND f.place = d.place {'AND f.subject = d.subject' if extra else ''})"""


@query("permute_labels", with_(EV, f", {_perm(100, '')} SELECT * FROM pm"))
def _(spark, sf):
    return resample.permute_labels(_samples(spark, sf), 100)


@query("permute_labels_grouped", with_(EV, f", {_perm(100, ', subject')} SELECT * FROM pm"))
def _(spark, sf):
    return resample.permute_labels(_samples(spark, sf), 100, within="subject")


def _features(spark, sf):
    info = fx.spi_info(spark)
    return classify.features(quality.qc_keep(cut_lineage(quality.spi_in_list(fx.spi_fact(spark, sf), info))), info)


_FEATS = """listed AS MATERIALIZED (SELECT * FROM spi WHERE spi IN (SELECT spi FROM spi_info)), good AS (SELECT spi FROM listed GROUP BY 1
  HAVING count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) > 1 AND count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM listed)),
ft AS (SELECT s.spi, sample_id, concat_ws('_', node_from, node_to) AS feature, coalesce(value, 0) AS value FROM listed s JOIN spi_info i ON s.spi = i.spi
  WHERE s.spi IN (SELECT spi FROM good) AND node_from <> node_to AND (directionality = 'Directed' OR node_from < node_to))"""


def _scaled(n_splits: int, n_perm: int) -> str:
    dealt = "UNION ALL SELECT resample, pm.perm, sp.sample_id, part, label FROM sp JOIN pm ON pm.sample_id = sp.sample_id WHERE part <> 'unused'" if n_perm else ""
    return f"""{_HALF}, {_split(n_splits, 'qh')}, {_FEATS}, {_perm(n_perm, '')},
tasks AS (SELECT resample, 0 AS perm, sample_id, part, grp AS label FROM sp WHERE part <> 'unused' {dealt}),
rw AS (SELECT f.spi, t.resample, t.perm, t.sample_id, t.label, t.part, feature, value,
  avg(value) FILTER (part = 'train') OVER w AS mu, stddev_pop(value) FILTER (part = 'train') OVER w AS sd FROM ft f JOIN tasks t ON f.sample_id = t.sample_id
  WINDOW w AS (PARTITION BY f.spi, t.resample, t.perm, feature)),
sc AS (SELECT spi, resample, perm, sample_id, label, part, feature, (value - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS scaled FROM rw)"""


@query("zscore_features", with_(SPI, f", {_scaled(30, 0)} SELECT spi, CAST(resample AS INTEGER) AS resample, sample_id, feature, {r6('scaled', 'scaled')} FROM sc WHERE perm = 0"))
def _(spark, sf):
    tasks = classify.with_labels(resample.split_stratified(_samples(spark, sf), 30, 0.5, 0.5)).where("part <> 'unused'")
    rows = _features(spark, sf).join(tasks, "sample_id").withColumn("is_train", F.col("part") == "train")
    out = windows.zscore_features(rows, ["spi", "resample"])
    return out.select("spi", "resample", "sample_id", "feature", rounded("scaled").alias("scaled"))


def _centroids(n_splits: int, n_perm: int) -> str:
    return f"""{_scaled(n_splits, n_perm)},
ce AS (SELECT spi, resample, perm, feature, label AS pred, avg(scaled) AS c FROM sc WHERE part = 'train' GROUP BY 1, 2, 3, 4, 5),
ds AS (SELECT s.spi, s.resample, s.perm, s.sample_id, s.label, c.pred, round(sum((s.scaled - c.c) * (s.scaled - c.c)), 8) AS d FROM sc s
  JOIN ce c ON s.spi = c.spi AND s.resample = c.resample AND s.perm = c.perm AND s.feature = c.feature WHERE s.part = 'test' GROUP BY 1, 2, 3, 4, 5, 6),
pr AS (SELECT spi, resample, perm, sample_id, label, pred FROM (SELECT *, row_number() OVER (PARTITION BY spi, resample, perm, sample_id ORDER BY d, pred) AS rk FROM ds) WHERE rk = 1)"""


def _centroid(spark, sf, n_splits: int, n_perm: int):
    s = _samples(spark, sf)
    perms = resample.permute_labels(s, n_perm) if n_perm else None
    tasks = classify.with_labels(resample.split_stratified(s, n_splits, 0.5, 0.5), perms)
    return classify.centroid_classify(_features(spark, sf), tasks)


@query("centroid_classify", with_(SPI, f", {_centroids(30, 0)} SELECT spi, CAST(resample AS INTEGER) AS resample, perm, sample_id, label, pred FROM pr WHERE perm = 0"))
def _(spark, sf):
    return _centroid(spark, sf, 30, 0)


@query("accuracy_score", with_(SPI, f", {_centroids(30, 0)} SELECT spi, CAST(resample AS INTEGER) AS resample, {r6('avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM pr WHERE perm = 0 GROUP BY 1, 2"))
def _(spark, sf):
    return classify.accuracy_score(_centroid(spark, sf, 30, 0)).withColumn("accuracy", rounded("accuracy"))


@query(
    "null_accuracy",
    with_(SPI, f", {_centroids(5, 3)} SELECT spi, perm, {r6('avg(a)', 'null_accuracy')} FROM (SELECT spi, perm, resample, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS a FROM pr WHERE perm > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2"),
)
def _(spark, sf):
    return classify.null_accuracy(_centroid(spark, sf, 5, 3)).withColumn("null_accuracy", rounded("null_accuracy"))


def _folds(spark, sf, n_splits: int, n_perm: int) -> resample.PackedFolds:
    s = _samples(spark, sf)
    permuted = resample.split_permuted(s, resample.permute_labels(s, n_perm), n_splits, 0.5, 0.5, packed=True)
    return resample.pack_folds(resample.split_stratified(s, n_splits, 0.5, 0.5), permuted=permuted)


@query(
    "split_permuted",
    with_(
        EV,
        f""", {_HALF}, {_perm(100, '')} SELECT CAST(r AS INTEGER) AS resample, perm, sample_id, CASE WHEN place <= qtr THEN 'train' WHEN place <= qtr + qte THEN 'test' ELSE 'unused' END AS part, label
FROM (SELECT r, pm.*, row_number() OVER (PARTITION BY perm, r, label ORDER BY md5(concat_ws('|', '42', perm::VARCHAR, r::VARCHAR, sample_id))) AS place FROM pm, range(1, 31) k(r)) JOIN qh ON qh.grp = label""",
    ),
)
def _(spark, sf):
    s = _samples(spark, sf)
    return resample.split_permuted(s, resample.permute_labels(s, 100), 30, 0.5, 0.5)


@query("svm_fit_many")
def _(spark, sf):
    return classify.svm_fit_folds(_features(spark, sf), _folds(spark, sf, 30, 100))


@query("svm_fit_all_spis")
def _(spark, sf):
    return classify.svm_fit_folds_all_spis(_features(spark, sf), _folds(spark, sf, 30, 100))


@query("svm_fit_products")
def _(spark, sf):
    """Machines from inner products, for features of any number: the true labels and three permutations on the folds of the true ones."""
    s = _samples(spark, sf)
    return classify.svm_fit_many(_features(spark, sf), classify.with_labels(resample.split_stratified(s, 5, 0.5, 0.5), resample.permute_labels(s, 3)))


@query("process_dataset_by_subject")
def _(spark, sf):
    """Every subject is left out once; labels are permuted inside subjects."""
    return process_dataset(fx.spi_fact(spark, sf), fx.spi_info(spark), _samples(spark, sf), leave_out="subject").as_one()


@query("process_dataset")
def _(spark, sf):
    """The whole study: 30 resamples, 100 permutations."""
    return process_dataset(fx.spi_fact(spark, sf), fx.spi_info(spark), _samples(spark, sf)).as_one()
