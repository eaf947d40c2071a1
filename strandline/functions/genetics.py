"""Allele frequencies, genotypes, variant and mapping qualities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mapping_quality(score) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(60), _c(score))).cast("int")


def allele_frequency(alt, depth) -> Column:
    return F.when(_c(depth) == 0, 0.0).otherwise(_c(alt) / _c(depth))


def genotype(af) -> Column:
    """Below a quarter 0/0, above three quarters 1/1, else 0/1."""
    return F.when(_c(af) < 0.25, "0/0").when(_c(af) > 0.75, "1/1").otherwise("0/1")


def identity(matches, mismatches, gaps) -> Column:
    total = _c(matches) + _c(mismatches) + _c(gaps)
    return F.when(total == 0, 0.0).otherwise(100.0 * _c(matches) / total)


def length_score(length, expected) -> Column:
    """1 - relative difference of lengths."""
    return F.when(_c(expected) == 0, 0.0).otherwise(1 - F.abs(_c(length) - _c(expected)) / _c(expected))


def log_binomial(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Log of the binomial probability; p is kept off 0 and 1 by 1e-10."""
    p = min(max(p, 1e-10), 1 - 1e-10)
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of counts, once for each different one."""
    own, back = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in own.tolist()])[back].reshape(np.shape(x))


def quality_of(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best against second best of the likelihoods at allele frequencies .01, .5 and .99, as PHRED of at most 60."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    if not len(k):
        return np.empty(0, np.int32)
    like = np.sort(np.stack([log_binomial(k, n, p) for p in (0.01, 0.5, 0.99)]), axis=0)
    second, best = like[1], like[2]
    q = np.where(second > math.log(1e-10), 10 * (best - second) / math.log(10), 10 * np.log10(np.maximum(n, 1)))
    return np.where(n > 0, np.clip(q, 0, 60), 0).astype(np.int32)


def variant_quality(alt, depth) -> Column:
    """Variant quality; belongs after the filters, on called positions only."""

    @F.pandas_udf("int")
    def quality(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(quality_of(k.to_numpy(), n.to_numpy()))

    return quality(_c(alt), _c(depth))
