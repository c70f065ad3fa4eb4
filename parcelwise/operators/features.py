"""Extra-feature summaries per property: code sets, counts by code, display text."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.keyed import first_rows


def _known(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def county_a_label() -> Column:
    """Description, else code."""
    return F.coalesce(_known(F.col("feature_description")), _known(F.col("feature_code")), F.lit("Unknown"))


def county_b_label() -> Column:
    """Type with its value in brackets."""
    kind = F.coalesce(_known(F.col("feature_type")), F.lit("Unknown"))
    value = _known(F.col("feature_value"))
    return F.when(value.isNotNull(), F.concat(kind, F.lit(" ("), value, F.lit(")"))).otherwise(kind)


def feature_counts(features: DataFrame, keys: Sequence[str], code: str = "feature_code") -> DataFrame:
    """Count of features by code; blank codes are left out."""
    return (
        features.filter(F.coalesce(F.col(code), F.lit("")) != "")
        .groupBy(*keys, code)
        .agg(F.count(F.lit(1)).alias("feature_count"))
    )


def _listing(entries: Column, limit: int, mark: str) -> Column:
    """``label (n)`` or ``label xn`` in label order, the first ``limit`` of them."""
    shown = F.transform(
        F.slice(F.array_sort(entries), 1, limit),
        lambda e: F.when(
            e["n"] > 1,
            F.concat(e["label"], F.lit(mark[0]), e["n"].cast("string"), F.lit(mark[1])),
        ).otherwise(e["label"]),
    )
    return F.array_join(shown, ", ")


def feature_profile(
    features: DataFrame,
    keys: Sequence[str],
    label: Column,
    code: str,
    mark: tuple[str, str] = (" (", ")"),
    limits: Sequence[int] = (5, 10),
) -> DataFrame:
    """One row per key: ``feature_codes`` (sorted set) and ``features_<limit>`` display texts.

    Labels are counted by key, which combines map-side, and cut to the longest text's number of labels
    before any is collected, so no list grows with the features of a property.
    """
    known = features.select(*keys, label.alias("label"), _known(F.col(code)).alias("code"))
    counted = known.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    shown = first_rows(counted, keys, ["label"], max(limits)).groupBy(*keys).agg(
        F.collect_list(F.struct("label", "n")).alias("entries")
    )
    codes = known.groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("feature_codes"))
    same = [codes[k].eqNullSafe(shown[k]) for k in keys]
    joined = codes.join(shown, functools.reduce(lambda a, b: a & b, same)).select(*[codes[k] for k in keys], "feature_codes", "entries")
    return joined.select(
        *keys, "feature_codes", *[_listing(F.col("entries"), k, mark).alias(f"features_{k}") for k in limits]
    )


def profile_a(features: DataFrame) -> DataFrame:
    return feature_profile(
        features.filter("is_active"), ["account_number"], county_a_label(), "feature_code", (" (", ")")
    )


def profile_b(features: DataFrame) -> DataFrame:
    return feature_profile(features, ["prop_id", "tax_year"], county_b_label(), "feature_type", (" x", ""))
