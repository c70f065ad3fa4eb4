"""Yearly assessment history: change against the prior year and value-cap status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.operators.keyed import first_rows

# Counties whose cap flag names the homestead cap, the flag, the two limits in percent.
TYPED_CAP_COUNTIES = ("harris",)
HOMESTEAD_FLAG = "Y"
HOMESTEAD_LIMIT, CIRCUIT_BREAKER_LIMIT = 10, 20

KEYS = ["county", "account_number"]
DEFAULT_YEARS = 5


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def cap_status(
    county: Column,
    flag: Column,
    assessed: Column,
    appraised: Column,
    market: Column,
    prior_appraised: Column,
    new_construction: Column,
    prior_row_appraised: Column,
    prior_row_assessed: Column,
) -> Column:
    """Cap evaluation of one year as a struct.

    Only counties with a typed flag can tell the 10% homestead cap from the 20% circuit breaker; the
    others get an unknown cap type. The own prior value wins over the prior row's figures.
    """
    dec = lambda c: c.cast("decimal(18,2)")
    prior = dec(F.coalesce(K.nonzero(prior_appraised), prior_row_appraised, prior_row_assessed))
    current = dec(F.coalesce(K.nonzero(appraised), assessed))
    typed = county.isin(*TYPED_CAP_COUNTIES)
    homestead = F.upper(F.trim(F.coalesce(flag, F.lit("")))) == HOMESTEAD_FLAG
    limit = F.when(homestead, F.lit(HOMESTEAD_LIMIT)).otherwise(F.lit(CIRCUIT_BREAKER_LIMIT))
    factor = F.when(homestead, F.lit("1.10").cast("decimal(3,2)")).otherwise(F.lit("1.20").cast("decimal(3,2)"))
    by_cap = prior * factor + dec(F.coalesce(new_construction, F.lit(0)))
    judged = typed & prior.isNotNull() & current.isNotNull()
    allowed = F.when(judged, _money(F.least(by_cap, dec(market))))
    overage = _money(current - allowed)
    status = (
        F.when(~judged, "unknown").when(overage > 0, "over_limit").otherwise("within_limit")
    )
    return F.struct(
        status.alias("status"),
        F.when(status == "unknown", "Needs review")
        .when(status == "over_limit", "Over cap")
        .otherwise("Within cap")
        .alias("label"),
        F.when(~typed, "unknown").when(homestead, "homestead").otherwise("circuit_breaker").alias("cap_type"),
        F.when(typed, limit).alias("limit_percent"),
        F.when(prior > 0, K.percent_change(current, prior)).alias("increase_percent"),
        allowed.alias("allowed_value"),
        overage.alias("overage"),
    )


def history_rows(history: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` years per account (None: all of them), each next to the next older *kept* year.

    The cut comes first: the oldest kept year has no prior even when an older one exists. Both steps
    share one partitioning, and the cut happens before the shuffle.
    """
    newest = F.col("tax_year").desc()
    kept = history if limit is None else first_rows(history, KEYS, [newest], limit)
    older = Window.partitionBy(*KEYS).orderBy(newest)
    paired = kept.withColumn(
        "_prior", F.lead(F.struct("assessed_value", "appraised_value"), 1).over(older)
    )
    return paired.select(
        *KEYS,
        "tax_year",
        "assessed_value",
        "appraised_value",
        "market_value",
        K.percent_change(F.col("assessed_value"), F.col("_prior.assessed_value")).alias("increase_percent"),
        cap_status(
            F.col("county"),
            F.col("cap_account"),
            F.col("assessed_value"),
            F.col("appraised_value"),
            F.col("market_value"),
            F.col("prior_appraised_value"),
            F.col("new_construction_value"),
            F.col("_prior.appraised_value"),
            F.col("_prior.assessed_value"),
        ).alias("cap_status"),
    )


def history_trend(rows: DataFrame) -> DataFrame:
    """Series of (year, amount), oldest first, with the axis range; accounts without amounts are left out.

    ``rows`` come from :func:`history_rows`, so a series is at most its ``limit`` long.
    """
    amount = F.col("assessed_value").cast("double")
    return (
        rows.filter(amount.isNotNull())
        .groupBy(*KEYS)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("tax_year").alias("year"), amount.alias("amount")))).alias(
                "points"
            ),
            F.min(amount).alias("min_amount"),
            F.max(amount).alias("max_amount"),
        )
        .withColumn("amount_span", F.greatest(F.col("max_amount") - F.col("min_amount"), F.lit(1.0)))
    )
