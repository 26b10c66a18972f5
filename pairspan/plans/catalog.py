"""The catalogue of statistics: families, the settings they accept, and running a chosen list."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairspan.operators.sets import union_many
from pairspan.operators.shared import sharing
from pairspan.session import cut_lineage
from pairspan.spi import barycentre, basic, causal, distance, infotheory, integration, local, misc, multichannel, process, robust, sparse, spectral

Estimator = Callable[[DataFrame], DataFrame]

# family -> (estimator, directed?)
FAMILIES: dict[str, tuple[Estimator, bool]] = {
    "cov": (basic.spi_cov, False),
    "cov_shrunk": (basic.spi_cov_shrunk, False),
    "cov_oas": (basic.spi_cov_oas, False),
    "cov_ledoitwolf": (basic.spi_cov_ledoitwolf, False),
    "prec": (basic.spi_prec, False),
    "graphical_lasso": (sparse.spi_graphical_lasso, False),
    "robust": (robust.spi_robust, False),
    "spearman": (basic.spi_spearman, False),
    "kendall": (basic.spi_kendall, False),
    "xcorr": (basic.spi_xcorr, False),
    "pdist": (distance.spi_pdist, False),
    "bary_euclidean": (distance.spi_bary_euclidean, False),
    "bary_elastic": (barycentre.spi_bary_elastic, False),
    "dcorr": (distance.spi_dcorr, False),
    "dcorrx": (distance.spi_dcorrx, False),
    "hsic": (distance.spi_hsic, False),
    "mgc": (local.spi_mgc, False),
    "mgcx": (local.spi_mgcx, False),
    "hhg": (local.spi_hhg, False),
    "dtw": (distance.spi_dtw, False),
    "softdtw": (distance.spi_softdtw, False),
    "lcss": (distance.spi_lcss, False),
    "anm": (process.spi_anm, True),
    "gpfit": (process.spi_gpfit, True),
    "cds": (causal.spi_cds, True),
    "reci": (causal.spi_reci, True),
    "igci": (causal.spi_igci, True),
    "ccm": (causal.spi_ccm, True),
    "je": (infotheory.spi_je, False),
    "ce": (infotheory.spi_ce, False),
    "cce": (infotheory.spi_cce, True),
    "xme": (infotheory.spi_xme, True),
    "di": (infotheory.spi_di, True),
    "si": (infotheory.spi_si, False),
    "mi": (infotheory.spi_mi, False),
    "tlmi": (infotheory.spi_tlmi, False),
    "te_kraskov": (infotheory.spi_te_kraskov, True),
    "te_kraskov_auto": (infotheory.spi_te_kraskov_auto, True),
    "te_kernel": (infotheory.spi_te_kernel, True),
    "te_symbolic": (infotheory.spi_te_symbolic, True),
    "gc_gaussian": (infotheory.spi_gc_gaussian, True),
    "gc_gaussian_auto": (infotheory.spi_gc_gaussian_auto, True),
    "phi": (integration.spi_phi, False),
    "psi": (spectral.spi_psi, True),
    "psi_wavelet": (spectral.spi_psi_wavelet, True),
    "gd": (spectral.spi_gd, True),
    "sgc_parametric": (spectral.spi_sgc_parametric, True),
    "sgc_nonparametric": (spectral.spi_sgc_nonparametric, True),
    # dtf, dcoh, pdcoh, gpdcoh and ddtf come from one model of each sample
    "directed": (multichannel.spi_directed, True),
    "pec": (spectral.spi_pec, False),
    "lmfit": (misc.spi_lmfit, True),
    "coint_johansen": (misc.spi_coint_johansen, False),
    "coint_aeg": (misc.spi_coint_aeg, False),
    # all nine measures come from one pass over the cross products
    "spectral": (lambda p: spectral.band_stats(spectral.measures(spectral.pair_spectra(p, False)), list(spectral.UNDIRECTED)), False),
}


def spi_all(panel: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Fact table of the chosen families (all, unless a list is given) over all samples.

    The standardised panel is written once, and so is each table that several families read: packed series, pair moments, spectral coefficients. Numpy kernels over the same pair table
    run in one pass over it (see ``operators.shared``).
    """
    ready, names = cut_lineage(panel), families or list(FAMILIES)
    with sharing(ready) as tables:
        parts, waiting = {}, []
        for name in names:
            before = tables.learned()
            parts[name] = FAMILIES[name][0](ready)
            if tables.learned() > before:
                waiting.append(name)
        tables.run()
        for name in waiting:
            parts[name] = FAMILIES[name][0](ready)
    return union_many([parts[name] for name in names])


def config_rows(spark: SparkSession, config: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """Configuration as rows ``spi, family, params``."""
    return spark.createDataFrame(config, "spi string, family string, params map<string, string>")


IN_NAME = ("estimator", "squared")  # parameters that the name of a statistic already says


def _settings(family: str, params: dict[str, str]) -> tuple[tuple[str, str], ...]:
    """Parameters that an estimator takes, by name; others are an error."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family: {family}")
    takes = [p for p in inspect.signature(FAMILIES[family][0]).parameters.values() if p.default is not p.empty]
    unknown = sorted(set(params) - {p.name for p in takes} - set(IN_NAME))
    if unknown:
        raise ValueError(f"{family} takes no {unknown}")
    return tuple((p.name, params[p.name]) for p in takes if p.name in params)


def spi_from_config(panel: DataFrame, config: DataFrame) -> DataFrame:
    """Run the families a configuration names, with its parameters, and keep the statistics it lists.

    A family runs once for each setting. Parameters that are given become part of the name: ``cov_ShrunkCovariance_shrinkage-0.5``. A listed
    statistic that yields no row is an error when the result is read. The configuration is a list of names (hundreds of rows).
    """
    listed = config.select("family", "params").collect()
    runs = sorted({(r.family, _settings(r.family, r.params or {})) for r in listed})
    ready = cut_lineage(panel)
    parts = []
    for family, settings in runs:
        values = FAMILIES[family][0](ready, **{k: float(v) for k, v in settings})
        parts.append(values.withColumn("spi", F.concat_ws("_", "spi", *[F.lit(f"{k}-{v}") for k, v in settings])))
    found = union_many(parts).withColumn("found", F.lit(True))
    met = config.select("spi").distinct().join(found, "spi", "left")
    none = F.raise_error(F.concat(F.lit("no values of statistic "), F.col("spi"))).cast("boolean")
    return met.where(F.when(F.col("found").isNull(), none).otherwise(True)).drop("found")


def canonical_name(name: F.Column) -> F.Column:
    """One spelling for names that differ in how a zero lower bound was written."""
    return F.regexp_replace(name, "fmin-1e-05", "fmin-0")
