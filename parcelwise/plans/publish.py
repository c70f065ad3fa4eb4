"""Whole loads: stage once, pass the gates, publish.

Every staged table is written once to the shared folder; counts, gates and final tables read those
files. Tables are published only after all gates of a load have passed, and all by one manifest
(:mod:`parcelwise.sinks.manifest`), so a refused or killed load leaves every published table as it was. Readers use
``manifest.read``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from parcelwise.operators import jurisdiction as J
from parcelwise.operators.loading import require_valid
from parcelwise.plans import roll_a, roll_b
from parcelwise.session import cut_lineage
from parcelwise.sinks.manifest import commit

COUNTY_YEAR = ("county", "tax_year")


def _publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """All tables by one manifest; of year-scoped ones only the slices of the load are replaced."""
    slices = {name: COUNTY_YEAR for name, rows in tables.items() if set(COUNTY_YEAR) <= set(rows.columns)}
    commit(spark, folder, tables, slices)
    return dict(tables)


def publish_roll_a(spark: SparkSession, root: str, folder: str, max_invalid: int) -> dict[str, DataFrame]:
    """County A's property, building and feature tables; refused from ``max_invalid`` invalid rows of a table on."""
    held = roll_a.load_roll(spark, root, hold=cut_lineage)
    for name in ("staged_building", "staged_feature"):
        require_valid(held[name], max_invalid)
    return _publish(spark, {name: held[name] for name in ("property", "building", "extra_feature")}, folder)


def publish_jurisdictions_a(
    values: DataFrame,
    exemptions: DataFrame,
    descriptions: DataFrame | None,
    rates: DataFrame,
    accounts: DataFrame | None,
    tax_year: int,
    folder: str,
    source: str,
) -> dict[str, DataFrame]:
    """County A's rates and jurisdiction rows of one year; returns them with the gap report.

    Rates are collapsed per district, base and exemption rows staged, the offset rows derived and proven
    against the published net values, and only then are the slices of the year replaced.
    """
    collapsed = cut_lineage(J.collapse_rates(rates))
    base = cut_lineage(J.stage_base(values, accounts))
    itemised = cut_lineage(J.stage_exemptions(exemptions, descriptions, accounts))
    rows = cut_lineage(J.jurisdiction_rows(base, itemised, collapsed, tax_year, roll_a.COUNTY_A, source))
    J.require_proof(rows, base)
    done = {"unit_rate": J.rate_rows(collapsed, tax_year, roll_a.COUNTY_A, source), "jurisdiction": rows}
    return _publish(rows.sparkSession, done, folder) | {"gaps": J.itemisation_gaps(base, itemised)}


def publish_roll_b(spark: SparkSession, root: str, tax_year: int, folder: str, min_share: float) -> dict[str, DataFrame]:
    """County B's tables of one year; refused when too few of its history rows are plausibly ordered."""
    held = {name: cut_lineage(rows) for name, rows in roll_b.load_roll(spark, root, tax_year).items()}
    history = roll_b.history_of(spark, root, tax_year)
    if history is not None:
        held["assessment_history"] = roll_b.require_sane_order(cut_lineage(history), min_share)
    return _publish(spark, held, folder)
