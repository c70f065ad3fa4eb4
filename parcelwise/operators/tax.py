"""Tax impact: what an account owes now and what it would owe at the comparable median value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.columns import nonzero

KEYS = ["county", "account_number"]
AMOUNT = "decimal(28,10)"

# Warning texts.
NO_YEAR = "No assessment year is available for this account."
NO_ROWS = "No jurisdiction/exemption rows were found for this account and year."
NO_MEDIAN = "Median assessed value is missing; median tax scenario was not computed."
NO_RATES = "One or more jurisdiction rates are missing for this tax year."
NO_BASE = "One or more units are missing current taxable/assessed value."
PARTIAL = "Tax impact is partial because one or more required inputs were missing."
UNIT_NO_RATE = "Missing tax-unit rate"
UNIT_NO_BASE = "Missing taxable value"


def resolve_years(subjects: DataFrame, jurisdictions: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``resolved_year``: the requested year, else the newest jurisdiction, else history year."""
    newest = lambda df, name: df.groupBy(*KEYS).agg(F.max("tax_year").alias(name))
    return (
        subjects.join(newest(jurisdictions, "_jur_year"), KEYS, "left")
        .join(newest(history, "_history_year"), KEYS, "left")
        .withColumn(
            "resolved_year",
            F.coalesce(nonzero(F.col("requested_year")), F.col("_jur_year"), F.col("_history_year")),
        )
        .drop("_jur_year", "_history_year")
    )


def _floor0(c: Column) -> Column:
    return F.greatest(F.lit(0).cast(AMOUNT), c.cast(AMOUNT))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a fold every mention of an expression computes it anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _step(value: Column, fixed: Column, percent: Column) -> Column:
    """One exemption: the fixed amount first, then the percentage, never below zero."""
    after_fixed = F.when(fixed.isNotNull() & value.isNotNull(), _floor0(value - fixed)).otherwise(value)
    keep = F.lit(1).cast("decimal(2,0)") - percent / F.lit(100).cast("decimal(3,0)")
    reduced = lambda v: _floor0((v * keep.cast("decimal(10,8)")).cast(AMOUNT))
    return _bind(
        after_fixed.cast(AMOUNT), lambda v: F.when((percent > 0) & v.isNotNull(), reduced(v)).otherwise(v).cast(AMOUNT)
    )


TRAIL_TYPE = (
    "array<struct<exemption_code:string,description:string,fixed_amount:decimal(14,2),percent:decimal(8,4),"
    "before_current:decimal(18,2),after_current:decimal(18,2),before_median:decimal(18,2),"
    "after_median:decimal(18,2)>>"
)


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def apply_exemptions(current: Column, median: Column, records: Column) -> Column:
    """Fold ordered exemption records over both bases; returns ``struct<current, median, trail>``."""
    start = F.struct(
        current.cast(AMOUNT).alias("current"),
        median.cast(AMOUNT).alias("median"),
        F.array().cast(TRAIL_TYPE).alias("trail"),
    )

    def merge(acc: Column, r: Column) -> Column:
        fixed, percent = r["amount"], r["percent"]
        stepped = F.struct(
            _step(acc["current"], fixed, percent).alias("current"), _step(acc["median"], fixed, percent).alias("median")
        )
        return _bind(stepped, lambda after: taken(acc, r, after["current"], after["median"]))

    def taken(acc: Column, r: Column, cur: Column, med: Column) -> Column:
        fixed, percent = r["amount"], r["percent"]
        entry = F.struct(
            r["exemption_code"].alias("exemption_code"),
            r["description"].alias("description"),
            fixed.cast("decimal(14,2)").alias("fixed_amount"),
            percent.cast("decimal(8,4)").alias("percent"),
            _money(acc["current"]).alias("before_current"),
            _money(cur).alias("after_current"),
            _money(acc["median"]).alias("before_median"),
            _money(med).alias("after_median"),
        )
        active = fixed.isNotNull() | percent.isNotNull()
        trail = F.when(active, F.concat(acc["trail"], F.array(entry).cast(TRAIL_TYPE))).otherwise(acc["trail"])
        return F.struct(cur.alias("current"), med.alias("median"), trail.alias("trail"))

    return F.aggregate(records, start, merge)


def unit_breakdown(subjects: DataFrame, jurisdictions: DataFrame, rates: DataFrame, history: DataFrame) -> DataFrame:
    """One row per subject and taxing unit of its resolved year.

    ``subjects``: ``county, account_number, requested_year, median_assessed_value``.
    The blank exemption code sorts first and carries the unit's base. Records are unique per
    (account, year, unit, exemption code), so a unit's record list is as long as its exemption codes.
    """
    asked = resolve_years(subjects, jurisdictions, history)
    rows = jurisdictions.withColumnRenamed("tax_year", "resolved_year").join(
        asked.select(*KEYS, "resolved_year", "median_assessed_value"), [*KEYS, "resolved_year"]
    )
    code = F.coalesce(F.col("exemption_code"), F.lit(""))
    first = F.struct(code)
    per_code = rows.groupBy(*KEYS, "resolved_year", "tax_unit_code").agg(
        F.max("median_assessed_value").alias("median_assessed_value"),
        F.min_by(F.struct("tax_unit_name", "taxable_value"), first).alias("base"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    code.alias("exemption_code"),
                    F.col("exemption_amount").cast("decimal(14,2)").alias("amount"),
                    F.col("exemption_percent").cast("decimal(8,4)").alias("percent"),
                    F.col("exemption_description").alias("description"),
                )
            )
        ).alias("records"),
    )
    rated = per_code.join(
        rates.select(
            "county", F.col("tax_year").alias("resolved_year"), "tax_unit_code",
            F.col("adopted_rate").cast("decimal(12,8)").alias("rate"), F.lit(True).alias("has_rate_row"),
        ),
        ["county", "resolved_year", "tax_unit_code"],
        "left",
    )
    assessed = history.select(
        *KEYS, F.col("tax_year").alias("resolved_year"), F.col("assessed_value").alias("current_assessed_value")
    )
    based = rated.join(assessed, [*KEYS, "resolved_year"], "left")
    start = F.coalesce(F.col("base.taxable_value").cast(AMOUNT), F.col("current_assessed_value").cast(AMOUNT))
    payable = F.col("rate").isNotNull() & start.isNotNull()
    folded = based.withColumn("_start", start).withColumn(
        "_folded",
        F.when(payable, apply_exemptions(F.col("_start"), F.col("median_assessed_value"), F.col("records"))),
    )
    tax = lambda side: (F.col(f"_folded.{side}") * F.col("rate")).cast("decimal(38,14)")
    return folded.select(
        *KEYS,
        "resolved_year",
        "tax_unit_code",
        F.col("base.tax_unit_name").alias("tax_unit_name"),
        F.coalesce("has_rate_row", F.lit(False)).alias("has_rate_row"),
        "rate",
        "median_assessed_value",
        "current_assessed_value",
        F.col("_folded.current").alias("current_taxable"),
        F.col("_folded.median").alias("median_taxable"),
        tax("current").alias("current_tax"),
        F.when(payable, F.coalesce(tax("median"), F.lit(0).cast("decimal(38,14)"))).alias("median_tax"),
        F.col("_folded.trail").alias("trail"),
        F.when(F.col("rate").isNull(), UNIT_NO_RATE).when(F.col("_start").isNull(), UNIT_NO_BASE).alias("warning"),
    )


def _flag_units(coded: DataFrame) -> DataFrame:
    """Mark the rows that stand for a taxing unit: not blank, and of codes that differ only in outer
    blanks the first one.
    """
    year_keys = [*KEYS, "resolved_year"]
    twins = Window.partitionBy(*year_keys, F.trim("tax_unit_code")).orderBy("tax_unit_code")
    return coded.withColumn(
        "is_unit", (F.row_number().over(twins) == 1) & (F.trim("tax_unit_code") != "")
    )


def tax_impact(subjects: DataFrame, jurisdictions: DataFrame, rates: DataFrame, history: DataFrame) -> DataFrame:
    """One row per subject: totals, savings, completeness, warnings, breakdown and exemption trail."""
    asked = resolve_years(subjects, jurisdictions, history)
    units = _flag_units(unit_breakdown(subjects, jurisdictions, rates, history))
    shown = F.struct(
        "tax_unit_code",
        "tax_unit_name",
        "rate",
        _money(F.col("current_taxable")).alias("current_taxable_value"),
        _money(F.col("median_taxable")).alias("median_taxable_value"),
        _money(F.col("current_tax")).alias("current_tax_amount"),
        _money(F.col("median_tax")).alias("median_tax_amount"),
        "warning",
    )
    unit = lambda c: F.when(F.col("is_unit"), F.col(c) if isinstance(c, str) else c)
    # A property lies in a handful of taxing units, so its breakdown is a short list.
    totals = units.groupBy(*KEYS, "resolved_year").agg(
        F.count_if("has_rate_row").alias("rate_rows"),
        F.max("current_assessed_value").alias("current_assessed_value"),
        F.count_if("is_unit").alias("n_units"),
        F.count(unit("rate")).alias("known_units"),
        F.count(unit("warning")).alias("missing_units"),
        F.count_if(F.col("is_unit") & (F.col("warning") == UNIT_NO_BASE)).alias("missing_bases"),
        F.sum(unit("rate")).alias("rate_total"),
        F.sum(unit("current_tax")).alias("current_tax"),
        F.sum(unit("median_tax")).alias("median_tax"),
        F.sum(unit("current_taxable")).alias("taxable"),
        F.array_sort(F.collect_list(unit(shown))).alias("per_unit_breakdown"),
        F.array_sort(
            F.collect_list(unit(F.when(F.size("trail") > 0, F.struct("tax_unit_code", "trail"))))
        ).alias("exemptions_summary"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = F.col("rate_rows").isNotNull()
    rates_missing = count("rate_rows") < count("n_units")
    completeness = (
        F.when(~found | (count("known_units") == 0), "missing")
        .when((count("missing_units") > 0) | rates_missing, "partial")
        .otherwise("complete")
    )
    current = F.coalesce(_money(F.col("current_tax")), zero)
    median = F.coalesce(_money(F.col("median_tax")), zero)
    no_median = F.col("median_assessed_value").isNull() | (F.col("median_assessed_value") < 0)
    notes = F.filter(
        F.concat(
            F.array(F.when(no_median, F.lit(NO_MEDIAN)), F.when(rates_missing, F.lit(NO_RATES))),
            F.array_repeat(F.lit(NO_BASE), count("missing_bases").cast("int")),
            F.array(F.when(completeness != "complete", F.lit(PARTIAL))),
        ),
        lambda w: w.isNotNull(),
    )
    warnings = (
        F.when(F.col("resolved_year").isNull(), F.array(F.lit(NO_YEAR)))
        .when(~found, F.array(F.lit(NO_ROWS)))
        .otherwise(notes)
    )
    mean_rate = F.col("rate_total").cast("decimal(24,12)") / F.greatest(count("known_units"), F.lit(1)).cast("decimal(10,0)")
    year_keys = [*KEYS, "resolved_year"]
    return (
        asked.join(totals, year_keys, "left")
        .select(
            *KEYS,
            F.col("resolved_year").alias("tax_year"),
            current.alias("current_tax_owed"),
            median.alias("median_tax_owed"),
            F.greatest(zero, current - median).cast("decimal(18,2)").alias("estimated_savings"),
            F.coalesce(F.round(mean_rate, 6).cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)")).alias("effective_rate"),
            "current_assessed_value",
            _money(nonzero(F.col("taxable"))).alias("taxable_value_used"),
            completeness.alias("completeness"),
            warnings.alias("warnings"),
            F.coalesce("exemptions_summary", F.array()).alias("exemptions_summary"),
            F.coalesce("per_unit_breakdown", F.array()).alias("per_unit_breakdown"),
        )
    )
