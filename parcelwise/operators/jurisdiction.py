"""Jurisdiction and exemption tables: rates, base rows, exemption rows, proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.operators.keyed import first_per_key, first_value

# Placeholder categories that grant nothing, fallback code and text, length caps.
NO_EXEMPTION = ("", "NONE")
UNITEMISED_CODE = "EXEMPT"
UNITEMISED_TEXT = "Exemption applied by HCAD (category not itemised)"

PAIR = ["account_number", "tax_unit_code"]

#: Columns of the shared jurisdiction table.
JURISDICTION_COLUMNS = {
    "account_number": "string",
    "tax_year": "int",
    "county": "string",
    "tax_unit_code": "string",
    "tax_unit_name": "string",
    "exemption_code": "string",
    "exemption_description": "string",
    "exemption_amount": "decimal(14,2)",
    "exemption_percent": "decimal(8,4)",
    "taxable_value": "decimal(14,2)",
    "assessed_value": "decimal(14,2)",
    "source": "string",
}


def _typed(**values: Column | None) -> list[Column]:
    out = []
    for name, dtype in JURISDICTION_COLUMNS.items():
        value = values.get(name)
        out.append((F.lit(None) if value is None else value).cast(dtype).alias(name))
    return out


# --------------------------------------------------------------------- county A


def collapse_rates(rows: DataFrame, position: str = "pos") -> DataFrame:
    """One row per district: the first name and the first published rate, as a fraction.

    ``rows``: ``RP_TYPE, tax_dist, name, published`` plus a position column. Only ``Real`` rows count.
    """
    code = K.neutralise_controls(F.col("tax_dist"))
    pos = F.col(position)
    return (
        rows.filter(F.lower(K.neutralise_controls(F.col("RP_TYPE"))) == "real")
        .select(
            code.alias("tax_unit_code"),
            K.neutralise_controls(F.col("name")).alias("name"),
            K.to_decimal(F.col("published"), "decimal(18,8)").alias("published"),
            pos.alias("pos"),
        )
        .filter(F.col("tax_unit_code") != "")
        .groupBy("tax_unit_code")
        .agg(
            first_value(F.col("name"), F.col("pos")).alias("tax_unit_name"),
            K.rate_fraction(first_value(F.col("published"), F.col("pos"))).alias("adopted_rate"),
        )
    )


def rate_rows(collapsed: DataFrame, tax_year: int, county: str, source: str) -> DataFrame:
    """Districts with a rate, as rows of the shared rate table."""
    return collapsed.filter(F.col("adopted_rate").isNotNull()).select(
        F.lit(tax_year).alias("tax_year"),
        "tax_unit_code",
        F.lit(county).alias("county"),
        "tax_unit_name",
        "adopted_rate",
        F.lit(source).alias("source"),
    )


def scope_accounts(df: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """Keep rows of already loaded accounts; no account table means all accounts."""
    if accounts is None:
        return df
    return df.join(accounts.select("account_number").distinct(), "account_number", "left_semi")


def stage_base(values: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Gross and net value per (account, unit) row: ``account_number, tax_unit_code, gross, net, pos``."""
    staged = values.select(
        K.neutralise_controls(F.col("acct")).alias("account_number"),
        K.neutralise_controls(F.col("tax_district")).alias("tax_unit_code"),
        K.to_decimal(F.col("appraised_val")).alias("gross"),
        K.to_decimal(F.col("taxable_val")).alias("net"),
        "pos",
    ).filter((F.col("account_number") != "") & (F.col("tax_unit_code") != ""))
    return scope_accounts(staged, accounts)


def stage_exemptions(
    rows: DataFrame, descriptions: DataFrame | None = None, accounts: DataFrame | None = None
) -> DataFrame:
    """Itemised exemptions: placeholder categories and zero amounts dropped, description looked up."""
    staged = rows.select(
        K.neutralise_controls(F.col("acct")).alias("account_number"),
        K.neutralise_controls(F.col("tax_district")).alias("tax_unit_code"),
        F.upper(K.neutralise_controls(F.col("exempt_cat"))).alias("exemption_code"),
        K.to_decimal(F.col("exempt_val")).alias("amount"),
        "pos",
    ).filter(
        ~F.col("exemption_code").isin(*NO_EXEMPTION)
        & (F.col("amount") != 0)
        & (F.col("account_number") != "")
        & (F.col("tax_unit_code") != "")
    )
    staged = scope_accounts(staged, accounts)
    if descriptions is None:
        return staged.withColumn("description", F.lit(""))
    return staged.join(exemption_descriptions(descriptions), "exemption_code", "left").withColumn(
        "description", F.coalesce("description", F.lit(""))
    )


def exemption_descriptions(rows: DataFrame) -> DataFrame:
    """Code to text; of repeated codes the last row stands."""
    return (
        rows.select(
            K.neutralise_controls(F.col("exempt_cat")).alias("exemption_code"),
            K.neutralise_controls(F.col("exemption_dscr")).alias("description"),
            "pos",
        )
        .groupBy("exemption_code")
        .agg(F.max_by("description", "pos").alias("description"))
    )


def itemised_codes(exemptions: DataFrame) -> DataFrame:
    """Distinct codes and descriptions per (account, unit), joined in order, whole.

    The distinct pass comes first, so a list is as long as the number of different codes.
    """
    distinct = exemptions.select(*PAIR, "exemption_code", "description").distinct()
    return distinct.groupBy(*PAIR).agg(
        F.array_join(F.array_sort(F.collect_set("exemption_code")), "+").alias("code"),
        F.array_join(F.array_sort(F.collect_set("description")), " + ").alias("descr"),
    )


def base_pairs(base: DataFrame) -> DataFrame:
    """One staged row per (account, unit)."""
    return first_per_key(base, PAIR, ["pos"])


def jurisdiction_rows(
    base: DataFrame, exemptions: DataFrame, names: DataFrame, tax_year: int, county: str, source: str
) -> DataFrame:
    """Two rows per pair: the gross base, and the offset that brings it to the published net.

    The offset is derived from the net value rather than summed from the itemised exemptions; the
    itemised codes only name it.
    """
    pairs = base_pairs(base).join(names.select("tax_unit_code", "tax_unit_name"), "tax_unit_code", "left")
    common = {
        "account_number": F.col("account_number"),
        "tax_year": F.lit(tax_year),
        "county": F.lit(county),
        "tax_unit_code": F.col("tax_unit_code"),
        "tax_unit_name": F.coalesce("tax_unit_name", F.lit("")),
        "source": F.lit(source),
    }
    gross = pairs.select(
        *_typed(
            **common,
            exemption_code=F.lit(""),
            exemption_description=F.lit(""),
            taxable_value=F.col("gross"),
            assessed_value=F.col("gross"),
        )
    )
    offset = (
        pairs.filter(F.col("gross") > F.col("net"))
        .join(itemised_codes(exemptions), PAIR, "left")
        .select(
            *_typed(
                **common,
                exemption_code=F.coalesce("code", F.lit(UNITEMISED_CODE)),
                exemption_description=F.coalesce("descr", F.lit(UNITEMISED_TEXT)),
                exemption_amount=F.col("gross") - F.col("net"),
            )
        )
    )
    return gross.unionByName(offset)


def itemisation_gaps(base: DataFrame, exemptions: DataFrame) -> DataFrame:
    """One row: pairs checked, pairs itemising more than was applied, pairs itemising less."""
    unique = first_per_key(exemptions, [*PAIR, "exemption_code"], ["pos"])
    itemised = unique.groupBy(*PAIR).agg(F.sum("amount").alias("itemised"))
    applied = F.col("gross") - F.col("net")
    total = F.coalesce("itemised", F.lit(0).cast("decimal(24,2)"))
    return (
        base_pairs(base)
        .filter(applied.isNotNull())
        .join(itemised, PAIR, "left")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(total > applied).alias("itemised_more"),
            F.count_if(total < applied).alias("itemised_less"),
        )
    )


def unproven_pairs(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs whose stored gross minus stored exemptions is not the published net (none when sound)."""
    is_base = F.col("exemption_code") == ""
    stored = rows.groupBy(*PAIR).agg(
        F.max(F.when(is_base, F.col("taxable_value"))).alias("gross"),
        F.coalesce(F.sum(F.when(~is_base, F.col("exemption_amount"))), F.lit(0).cast("decimal(24,2)")).alias("applied"),
    )
    published = base_pairs(base).filter(F.col("net").isNotNull()).select(*PAIR, "net")
    rest = F.greatest(F.col("gross") - F.col("applied"), F.lit(0).cast("decimal(24,2)")).cast("decimal(24,2)")
    return stored.join(published, PAIR).filter(~rest.eqNullSafe(F.col("net").cast("decimal(24,2)")))


class ProofFailed(RuntimeError):
    """A load's own figures do not reproduce the source; nothing may be written."""


def require_proof(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Return ``rows`` unchanged, or raise when any pair fails the proof."""
    wrong = unproven_pairs(rows, base).count()
    if wrong:
        raise ProofFailed(f"{wrong} (account, unit) pairs do not reproduce the published taxable value")
    return rows


# --------------------------------------------------------------------- county B

# Exemption amount columns of an entity row and their codes.
ENTITY_EXEMPTIONS = (("hs_amt", "HS"), ("ov65_amt", "OV65"), ("dp_amt", "DP"))


def entity_rows(entities: DataFrame, tax_year: int, county: str, source: str) -> DataFrame:
    """Each entity row becomes a base row and one row per non-zero exemption amount."""
    amounts = [F.struct(F.lit("").alias("code"), F.lit(None).cast("decimal(14,2)").alias("amount"))]
    amounts += [
        F.struct(F.lit(code).alias("code"), F.col(column).cast("decimal(14,2)").alias("amount"))
        for column, code in ENTITY_EXEMPTIONS
    ]
    kept = F.filter(F.array(*amounts), lambda e: (e["code"] == "") | (e["amount"] != 0))
    return entities.withColumn("_row", F.explode(kept)).select(
        *_typed(
            account_number=F.col("prop_id"),
            tax_year=F.lit(tax_year),
            county=F.lit(county),
            tax_unit_code=F.col("tax_unit_code"),
            tax_unit_name=F.col("tax_unit_name"),
            exemption_code=F.col("_row.code"),
            exemption_description=F.lit(""),
            exemption_amount=F.col("_row.amount"),
            taxable_value=F.col("taxable_value"),
            assessed_value=F.col("assessed_value"),
            source=F.lit(source),
        )
    )


def assessed_rollup(entities: DataFrame) -> DataFrame:
    """First known assessed value per property, in file order."""
    return entities.groupBy("prop_id").agg(
        first_value(F.col("assessed_value"), F.col("pos")).alias("assessed_value")
    )
