"""County A table loads: delimited roll exports to property, building, feature and history tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.operators.keyed import first_per_key
from parcelwise.operators.loading import INVALID, LOADED, SKIPPED, update_from, with_parent
from parcelwise.operators.rooms import KEY as BUILDING_KEY
from parcelwise.operators.rooms import fixture_rows, fixtures_pivot, total_baths
from parcelwise.schemas import ASSESSMENT_HISTORY, BUILDING, COUNTY_A, EXTRA_FEATURE, PROPERTY, conform
from parcelwise.sources import files
from parcelwise.sources.delimited import aliased, pick, read_aliased, read_delimited

# Header names of each column, in order of preference.
PROPERTY_SOURCES = {
    "account_number": ("acct", "account_num", "account"),
    "owner_name": ("mailto", "owner_name", "owner"),
    "street_number": ("str_num", "site_addr_num"),
    "street_name": ("str", "site_addr_street"),
    "street_suffix": ("str_sfx",),
    "site_addr_1": ("site_addr_1", "site_addr"),
    "city": ("site_addr_2", "situs_city", "city"),
    "zipcode": ("site_addr_3", "zip", "zip_code"),
    "state_class": ("state_class",),
    "value": ("tot_appr_val", "mkt_val"),
    "assessed_value": ("assessed_val",),
    "building_area": ("bld_ar", "bldg_ar"),
    "land_area": ("land_ar",),
}
BUILDING_SOURCES = {
    "account_number": ("acct",),
    "building_number": ("bld_num",),
    "building_type": ("imprv_type",),
    "building_style": ("building_style_code",),
    "building_class": ("bldg_class",),
    "quality_code": ("qa_cd",),
    "condition_code": ("cndtn_cd",),
    "year_built": ("date_erected",),
    "year_remodeled": ("yr_remodel",),
    "effective_year": ("eff_yr",),
    "heat_area": ("heat_ar",),
    "base_area": ("base_ar",),
    "gross_area": ("gross_ar",),
    "stories": ("sty",),
    "foundation_type": ("foundation",),
    "exterior_wall": ("exterior_wall",),
    "roof_cover": ("roof_cover",),
    "roof_type": ("roof_typ",),
    "bedrooms": ("bed_rm",),
    "full_baths": ("full_bath",),
    "half_baths": ("half_bath",),
    "fireplaces": ("fireplace",),
}
FEATURE_SOURCES = {
    "account_number": ("acct",),
    "feature_number": ("bld_num",),
    "feature_code": ("cd",),
    "feature_description": ("l_dscr", "dscr"),
    "quantity": ("count", "units"),
    "length": ("length",),
    "width": ("width",),
    "quality_code": ("grade",),
    "condition_code": ("cond_cd",),
    "year_built": ("act_yr",),
    "value": ("uts", "asd_val"),
    "area": ("area",),
}
FIXTURE_SOURCES = {"acct": ("acct",), "bld_num": ("bld_num",), "type": ("type",), "units": ("units",)}

_TEXTS = (
    "building_type", "building_style", "building_class", "quality_code", "condition_code",
    "foundation_type", "exterior_wall", "roof_cover", "roof_type",
)
_BUILDING_INTS = ("year_built", "year_remodeled", "effective_year", "fireplaces")
_BUILDING_DECIMALS = ("heat_area", "base_area", "gross_area", "stories")


def stage_property(raw: DataFrame) -> DataFrame:
    """Property rows with an ``outcome``: rows without account or of a non-residential class are skipped."""
    return stage_property_rows(aliased(raw, PROPERTY_SOURCES))


def stage_property_rows(rows: DataFrame) -> DataFrame:
    """As :func:`stage_property`, from columns that already carry their target names."""
    account = K.clean_text(F.col("account_number"))
    number = K.clean_text(F.col("street_number"))
    street = K.street_with_suffix(F.col("street_name"), F.col("street_suffix"))
    return _property_columns(
        rows,
        account=account,
        address=K.site_address(F.col("site_addr_1"), number, street),
        number=number,
        street=street,
        zipcode=K.clean_text(F.col("zipcode")),
        value=K.to_decimal(F.col("value")),
        assessed=K.to_decimal(F.col("assessed_value")),
        source_url="",
        outcome=F.when((account == "") | ~K.is_residential(F.col("state_class")), SKIPPED).otherwise(LOADED),
    )


def _property_columns(
    rows: DataFrame, *, account: Column, address: Column, number: Column, street: Column, zipcode: Column,
    value: Column, assessed: Column, source_url: str, outcome: Column,
) -> DataFrame:
    return rows.select(
        account.alias("account_number"),
        address.alias("address"),
        K.clean_text(F.col("city")).alias("city"),
        zipcode.alias("zipcode"),
        K.clean_text(F.col("owner_name")).alias("owner_name"),
        value.alias("value"),
        assessed.alias("assessed_value"),
        K.to_decimal(F.col("building_area")).alias("building_area"),
        K.to_decimal(F.col("land_area")).alias("land_area"),
        K.state_class(F.col("state_class")).alias("state_class"),
        K.is_residential(F.col("state_class")).alias("is_residential"),
        F.lit(False).alias("is_data_ready"),
        number.alias("street_number"),
        street.alias("street_name"),
        F.lit(source_url).alias("source_url"),
        F.lit("").alias("parcel_id"),
        outcome.alias("outcome"),
        "pos",
    )


def stage_property_older(raw: DataFrame) -> DataFrame:
    """The older load: address from its parts first, value chain with zeros falling through, 5-digit ZIP,
    and an address or ZIP required."""
    col = lambda *names: K.clean_text(pick(raw, names))
    number = F.concat(col("str_num", "site_addr_num", "situs_addr_num", "address_number"), col("str_num_sfx"))
    street_name = col("str", "site_addr_street", "situs_street", "street_name")
    street = K.join_nonblank(" ", col("str_pfx"), street_name, col("str_sfx"), col("str_sfx_dir"))
    zip_text = col("site_addr_3", "zip", "zip_code", "zipcode")
    value = K.first_nonzero(*[K.to_decimal(pick(raw, [n])) for n in ("tot_appr_val", "mkt_val", "appr_bldg_val")])
    rows = raw.select(
        "pos",
        col("acct", "account", "account_number").alias("account_number"),
        col("mailto", "owner_name", "owner").alias("owner_name"),
        col("site_addr_2", "situs_city", "city").alias("city"),
        pick(raw, ["bld_ar", "bldg_ar", "bld_area"]).alias("building_area"),
        pick(raw, ["land_ar", "land_area"]).alias("land_area"),
        pick(raw, ["state_class"]).alias("state_class"),
        number.alias("_number"),
        street_name.alias("_street"),
        K.component_address(number, street, col("site_addr_1", "site_addr")).alias("_address"),
        F.substring(zip_text, 1, 5).alias("_zip"),  # a five-digit ZIP, the form this load keeps
        value.alias("_value"),
        K.to_decimal(pick(raw, ["assessed_val", "tot_appr_val"])).alias("_assessed"),
    )
    placeless = (F.col("_address") == "") & (F.col("_zip") == "")
    return _property_columns(
        rows,
        account=F.col("account_number"),
        address=F.col("_address"),
        number=F.col("_number"),
        street=F.col("_street"),
        zipcode=F.col("_zip"),
        value=F.col("_value"),
        assessed=F.col("_assessed"),
        source_url="hcad:real_acct",
        outcome=F.when(placeless | ~K.is_residential(F.col("state_class")), SKIPPED).otherwise(LOADED),
    )


def property_table(staged: DataFrame) -> DataFrame:
    """Loaded rows, the first of each account."""
    kept = first_per_key(staged.filter(F.col("outcome") == LOADED), ["account_number"], ["pos"])
    return conform(kept, PROPERTY)


def _child_outcome() -> Column:
    return (
        F.when(F.col("account_number") == "", SKIPPED)
        .when(~F.col("has_parent"), INVALID)
        .otherwise(LOADED)
    )


def stage_buildings(raw: DataFrame, prop: DataFrame, pivot: DataFrame) -> DataFrame:
    """Building rows with fixtures winning over the record's own room counts when above zero.

    ``pivot`` is :func:`fixtures_pivot`'s result; rows of unknown accounts are invalid.
    """
    return stage_building_rows(aliased(raw, BUILDING_SOURCES), prop, pivot)


def stage_building_rows(rows: DataFrame, prop: DataFrame, pivot: DataFrame) -> DataFrame:
    typed = rows.select(
        K.clean_text(F.col("account_number")).alias("account_number"),
        F.coalesce(K.to_int(F.col("building_number")), F.lit(1)).alias("building_number"),
        *[K.clean_text(F.col(c)).alias(c) for c in _TEXTS],
        *[K.to_int(F.col(c)).alias(c) for c in _BUILDING_INTS],
        *[K.to_decimal(F.col(c), BUILDING[c]).alias(c) for c in _BUILDING_DECIMALS],
        K.to_int(F.col("bedrooms")).alias("_rec_bedrooms"),
        K.to_decimal(F.col("full_baths"), "decimal(10,2)").alias("_rec_full"),
        K.to_int(F.col("half_baths")).alias("_rec_half"),
        "pos",
    )
    fx = pivot.select(
        *BUILDING_KEY,
        F.col("bedrooms").alias("_fx_bedrooms"),
        total_baths(F.col("full_baths"), F.col("half_units")).alias("_fx_baths"),
        F.col("half_baths").alias("_fx_half"),
    )
    joined = with_parent(typed, prop.filter("is_residential")).join(fx, BUILDING_KEY, "left")
    own_baths = total_baths(F.col("_rec_full"), F.col("_rec_half").cast("decimal(10,2)"))
    positive = lambda c: F.when(c > 0, c)
    return joined.select(
        *BUILDING_KEY,
        *_TEXTS,
        *_BUILDING_INTS,
        *_BUILDING_DECIMALS,
        F.coalesce(positive(F.col("_fx_bedrooms")), F.col("_rec_bedrooms")).alias("bedrooms"),
        F.coalesce(positive(F.col("_fx_baths")), positive(own_baths)).cast("decimal(4,2)").alias("bathrooms"),
        F.coalesce(positive(F.col("_fx_half")), F.col("_rec_half")).alias("half_baths"),
        F.lit(True).alias("is_active"),
        _child_outcome().alias("outcome"),
        "pos",
    )


def building_table(staged: DataFrame) -> DataFrame:
    return conform(first_per_key(staged.filter(F.col("outcome") == LOADED), BUILDING_KEY, ["pos"]), BUILDING)


def stage_features(raw: DataFrame, prop: DataFrame) -> DataFrame:
    return stage_feature_rows(aliased(raw, FEATURE_SOURCES), prop)


def stage_feature_rows(rows: DataFrame, prop: DataFrame) -> DataFrame:
    typed = rows.select(
        K.clean_text(F.col("account_number")).alias("account_number"),
        K.to_int(F.col("feature_number")).alias("feature_number"),
        K.clean_text(F.col("feature_code")).alias("feature_code"),
        K.clean_text(F.col("feature_description")).alias("feature_description"),
        *[K.to_decimal(F.col(c), EXTRA_FEATURE[c]).alias(c) for c in ("quantity", "area", "length", "width", "value")],
        K.clean_text(F.col("quality_code")).alias("quality_code"),
        K.clean_text(F.col("condition_code")).alias("condition_code"),
        K.to_int(F.col("year_built")).alias("year_built"),
        F.lit(True).alias("is_active"),
        "pos",
    )
    return with_parent(typed, prop.filter("is_residential")).withColumn("outcome", _child_outcome()).drop("has_parent")


def stage_features_older(raw: DataFrame, prop: DataFrame) -> DataFrame:
    """The older load: per cell the first non-blank (text) or readable (number) of several columns."""
    some = lambda *names: [pick(raw, [n]) for n in names]
    typed = raw.select(
        K.clean_text(pick(raw, ["acct"])).alias("account_number"),
        K.to_int(pick(raw, ["bld_num"])).alias("feature_number"),
        K.clean_text(pick(raw, ["cd"])).alias("feature_code"),
        K.first_nonblank(*some("l_dscr", "dscr")).alias("feature_description"),
        K.first_decimal(*some("count", "units"), dtype="decimal(10,2)").alias("quantity"),
        F.lit(None).cast("decimal(10,2)").alias("area"),
        K.to_decimal(pick(raw, ["length"]), "decimal(10,2)").alias("length"),
        K.to_decimal(pick(raw, ["width"]), "decimal(10,2)").alias("width"),
        K.first_decimal(*some("uts", "asd_val")).alias("value"),
        K.clean_text(pick(raw, ["grade"])).alias("quality_code"),
        K.clean_text(pick(raw, ["cond_cd"])).alias("condition_code"),
        K.first_int(*some("act_yr")).alias("year_built"),
        F.lit(True).alias("is_active"),
        "pos",
    )
    return with_parent(typed, prop).withColumn("outcome", _child_outcome()).drop("has_parent")


def feature_table(staged: DataFrame) -> DataFrame:
    """Loaded rows, first of each (account, code, number); a row without a number never collides."""
    rows = staged.filter(F.col("outcome") == LOADED)
    numbered = first_per_key(
        rows.filter(F.col("feature_number").isNotNull()), ["account_number", "feature_code", "feature_number"], ["pos"]
    )
    return conform(numbered.unionByName(rows.filter(F.col("feature_number").isNull())), EXTRA_FEATURE)


def update_coordinates(prop: DataFrame, staged: DataFrame) -> DataFrame:
    """Residential properties take the staged centroid; a blank parcel id keeps the old one."""
    return update_from(
        prop, staged, ["account_number"], ["latitude", "longitude", "parcel_id"],
        where=F.col("is_residential"), keep_blank=["parcel_id"],
    )


# ------------------------------------------------------------------------------- history


def hearing_lookup(raw: DataFrame) -> DataFrame:
    """Last hearing row of each account: ``account_number, hearing_year, final_value``."""
    return (
        raw.select(
            K.clean_text(pick(raw, ["acct"])).alias("account_number"),
            K.to_strict_int(pick(raw, ["Tax_Year"])).alias("hearing_year"),
            K.to_decimal(pick(raw, ["Final_Appraised_Value"])).alias("final_value"),
            "pos",
        )
        .filter(F.col("account_number") != "")
        .groupBy("account_number")
        .agg(F.max_by(F.struct("hearing_year", "final_value"), "pos").alias("_h"))
        .select("account_number", "_h.hearing_year", "_h.final_value")
    )


def history_year(accounts: DataFrame, hearings: DataFrame | None, year: int) -> DataFrame:
    """One snapshot year: certified values, overridden by the hearing's final value where there is one;
    accounts known only from a hearing are added.

    The tax year is the row's own, else the hearing's, else the snapshot's (zero counts as missing).
    A hearing goes to the first row of its account when the roll repeats the account.
    """
    raw = accounts
    roll = raw.select(
        K.clean_text(pick(raw, ["acct"])).alias("account_number"),
        K.to_strict_int(pick(raw, ["yr"])).alias("row_year"),
        K.to_decimal(pick(raw, ["assessed_val"])).alias("certified"),
        K.to_decimal(pick(raw, ["tot_appr_val"])).alias("appraised_value"),
        K.to_decimal(pick(raw, ["tot_mkt_val"])).alias("market_value"),
        K.to_decimal(pick(raw, ["prior_tot_appr_val"])).alias("prior_appraised_value"),
        K.to_decimal(pick(raw, ["prior_tot_mkt_val"])).alias("prior_market_value"),
        K.to_decimal(pick(raw, ["new_construction_val"])).alias("new_construction_value"),
        K.clean_text(pick(raw, ["Cap_acct"])).alias("cap_account"),
        "pos",
    ).filter(F.col("account_number") != "")
    roll = first_per_key(roll, ["account_number"], ["pos"]).drop("pos").withColumn("_on_roll", F.lit(True))
    if hearings is None:
        both = roll.withColumn("hearing_year", F.lit(None).cast("int")).withColumn(
            "final_value", F.lit(None).cast(K.MONEY)
        )
    else:
        both = roll.join(hearings, "account_number", "full_outer")
    on_roll = F.coalesce("_on_roll", F.lit(False))
    out = both.select(
        "account_number",
        F.coalesce(K.nonzero(F.col("row_year")), K.nonzero(F.col("hearing_year")), F.lit(year)).alias("tax_year"),
        F.lit(COUNTY_A).alias("county"),
        F.coalesce("final_value", "certified").alias("assessed_value"),
        F.when(on_roll, F.col("appraised_value")).otherwise(F.col("final_value")).alias("appraised_value"),
        "market_value",
        "prior_appraised_value",
        "prior_market_value",
        "new_construction_value",
        F.coalesce("cap_account", F.lit("")).alias("cap_account"),
    )
    return conform(out, ASSESSMENT_HISTORY)


def history_range(spark: SparkSession, root: str, start_year: int, end_year: int) -> DataFrame:
    """All snapshot years under ``root/<year>/``; a missing account roll fails, missing hearings do not."""
    out = None
    for year, directory in files.year_directories(root, start_year, end_year).items():
        found = files.list_files(spark, directory, ".txt")
        accounts = [p for p in found if files.stem(p) == files.ACCOUNT_STEM]
        hearings = [p for p in found if files.stem(p) == "arb_hearings_real"]
        files.require_files([] if accounts else [f"real_acct.txt ({year})"], directory)
        read = lambda p: read_delimited(spark, p, delimiter="\t")
        one = history_year(read(accounts[0]), hearing_lookup(read(hearings[0])) if hearings else None, year)
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------------------- whole roll


def load_roll(
    spark: SparkSession, root: str, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> dict[str, DataFrame]:
    """Staged and final tables of one roll export directory.

    ``hold`` is applied to every table that others are made from; a load that publishes passes one
    that writes the table and reads it back.
    """
    paths = files.list_files(spark, root, ".txt")
    files.require_files(files.missing_account_files(paths) + files.missing_building_files(paths), root)

    def rows(table: str, sources: dict) -> DataFrame:
        return read_aliased(spark, files.table_files(paths, table), sources, delimiter="\t", encoding="latin-1")

    staged_property = hold(stage_property_rows(rows(files.ACCOUNT_STEM, PROPERTY_SOURCES)))
    prop = hold(property_table(staged_property))
    pivot = hold(fixtures_pivot(fixture_rows(rows(files.FIXTURE_STEM, FIXTURE_SOURCES))))
    staged_building = hold(stage_building_rows(rows(files.BUILDING_STEM, BUILDING_SOURCES), prop, pivot))
    staged_feature = hold(stage_feature_rows(rows(files.FEATURE_STEM, FEATURE_SOURCES), prop))
    return {
        "staged_property": staged_property,
        "staged_building": staged_building,
        "staged_feature": staged_feature,
        "property": prop,
        "building": building_table(staged_building),
        "extra_feature": feature_table(staged_feature),
        "rooms": pivot,
    }
