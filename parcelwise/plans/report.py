"""Protest reports for a whole table of subjects: comps, equity, history and tax impact put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.columns import clamp_argument
from parcelwise.operators.comps import (
    PROTEST_MIN_SCORE_BOUNDS, display_rank, ranked_comps, told, with_comp_facts,
)
from parcelwise.operators.equity import PRICE, SUBJECT, comp_deltas, equity_summary
from parcelwise.operators.history import DEFAULT_YEARS, history_rows
from parcelwise.operators.neighbours import LEVELS
from parcelwise.operators.scoring import ScoreSpec
from parcelwise.operators.tax import tax_impact
from parcelwise.session import cut_lineage
from parcelwise.sinks.exports import comps_export, report_lines

# The protest search and the number of comps printed.
PROTEST_MAX_DISTANCE = 10.0
PROTEST_MAX_COMPS = 50
PRINTED_COMPS = 10


@dataclass
class SharedTables:
    """Year-scoped tables shared by the counties."""

    history: DataFrame
    rates: DataFrame
    jurisdictions: DataFrame


def protest_comps(
    subjects: DataFrame, facts: DataFrame, spec: ScoreSpec, min_score: float | None = None,
    max_distance: float = PROTEST_MAX_DISTANCE, max_comps: int = PROTEST_MAX_COMPS,
    candidate_cap: int | None = None,
) -> DataFrame:
    """Display-ranked comps with their facts and the difference to the subject.

    The result feeds several branches of a report, so what the search found is written once to the checkpoint folder: the
    search runs once and a lost executor repeats no part of it. Each branch looks up the facts it reads, for the rows it reads,
    and the breakdown is made where it is read.
    """
    floor = clamp_argument(min_score, *PROTEST_MIN_SCORE_BOUNDS)
    comps = ranked_comps(subjects, facts, spec, max_distance, max_comps, floor, candidate_cap, LEVELS, PRICE, SUBJECT)
    # What came along leaves the rows of a subject together; after a join they would not be.
    together = candidate_cap is None and {*PRICE, *SUBJECT.values()} <= set(comps.columns)
    shown = display_rank(comp_deltas(with_comp_facts(comps, facts, PRICE), subjects), max_comps, together)
    return told(with_comp_facts(cut_lineage(shown), facts), spec)


def county_rows(df: DataFrame, county: str) -> DataFrame:
    """The shared tables hold several counties: every access names one."""
    return df.filter(F.col("county") == county)


def subject_tax(equity: DataFrame, shared: SharedTables, county: str) -> DataFrame:
    """Tax impact of every subject at its equity median, for the newest year that can be costed."""
    asked = equity.select(
        F.lit(county).alias("county"),
        F.col("subject_key").alias("account_number"),
        F.lit(None).cast("int").alias("requested_year"),
        "median_assessed_value",
    )
    return tax_impact(
        asked,
        county_rows(shared.jurisdictions, county),
        county_rows(shared.rates, county),
        county_rows(shared.history, county),
    )


def protest_report(
    subjects: DataFrame, comps: DataFrame, shared: SharedTables, county: str,
    years_shown: int | None = DEFAULT_YEARS, comps_shown: int = PRINTED_COMPS,
) -> dict[str, DataFrame]:
    """``equity``, ``history``, ``tax``, ``comps_csv`` and ``lines`` for all located subjects.

    ``comps`` come from :func:`protest_comps`. The printed lines show the newest ``years_shown`` years and
    the first ``comps_shown`` comps, as the printed report does; the tables beside them hold all comps.
    """
    located = subjects.filter("has_location")
    equity = equity_summary(comps, located)
    history = history_rows(county_rows(shared.history, county), years_shown)
    tax = subject_tax(equity, shared, county)

    years = history.groupBy("account_number").agg(
        F.reverse(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "tax_year", "assessed_value", "increase_percent", F.col("cap_status.label").alias("cap_label")
                    )
                )
            )
        ).alias("history")
    )
    printed = (
        comps.filter(F.col("display_rank") <= comps_shown)
        .groupBy("scope", "subject_key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("display_rank", "address", "similarity_score", "value_per_sqft"))
            ).alias("comps")
        )
    )
    taxes = tax.select(
        F.col("account_number").alias("key"),
        F.struct(
            "tax_year", "completeness", "current_tax_owed", "median_tax_owed", "estimated_savings", "warnings"
        ).alias("tax"),
    )
    address = "subject_address" if "subject_address" in subjects.columns else "address"
    inputs = (
        located.select("scope", "key", F.col(address).alias("address"), "assessed_value", "living_area", "value_per_sqft")
        .join(years.withColumnRenamed("account_number", "key"), "key", "left")
        .join(printed.withColumnRenamed("subject_key", "key"), ["scope", "key"], "left")
        .join(taxes, "key", "left")
        .withColumns({"history": F.coalesce("history", F.array()), "comps": F.coalesce("comps", F.array())})
    )
    return {
        "equity": equity,
        "history": history,
        "tax": tax,
        "comps_csv": comps_export(comps, tax),
        "lines": report_lines(inputs, county),
    }
