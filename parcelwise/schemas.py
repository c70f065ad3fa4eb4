"""Target table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTY_A, COUNTY_B = "harris", "brazos"

_META = {"is_active": "boolean", "import_date": "timestamp", "import_batch_id": "string"}

PROPERTY = {
    "account_number": "string", "address": "string", "city": "string", "zipcode": "string",
    "owner_name": "string", "value": "decimal(14,2)", "assessed_value": "decimal(14,2)",
    "building_area": "decimal(14,2)", "land_area": "decimal(14,2)", "state_class": "string",
    "is_residential": "boolean", "is_data_ready": "boolean", "street_number": "string",
    "street_name": "string", "source_url": "string", "parcel_id": "string",
    "latitude": "decimal(10,7)", "longitude": "decimal(10,7)",
}
BUILDING = {
    "account_number": "string", "building_number": "int", "building_type": "string",
    "building_style": "string", "building_class": "string", "quality_code": "string",
    "condition_code": "string", "year_built": "int", "year_remodeled": "int", "effective_year": "int",
    "heat_area": "decimal(10,2)", "base_area": "decimal(10,2)", "gross_area": "decimal(10,2)",
    "stories": "decimal(4,2)", "foundation_type": "string", "exterior_wall": "string",
    "roof_cover": "string", "roof_type": "string", "bedrooms": "int", "bathrooms": "decimal(4,2)",
    "half_baths": "int", "fireplaces": "int", **_META,
}
EXTRA_FEATURE = {
    "account_number": "string", "feature_number": "int", "feature_code": "string",
    "feature_description": "string", "quantity": "decimal(10,2)", "area": "decimal(10,2)",
    "length": "decimal(10,2)", "width": "decimal(10,2)", "quality_code": "string",
    "condition_code": "string", "year_built": "int", "value": "decimal(14,2)", **_META,
}
ASSESSMENT_HISTORY = {
    "account_number": "string", "tax_year": "int", "county": "string",
    "assessed_value": "decimal(14,2)", "appraised_value": "decimal(14,2)", "market_value": "decimal(14,2)",
    "prior_appraised_value": "decimal(14,2)", "prior_market_value": "decimal(14,2)",
    "new_construction_value": "decimal(14,2)", "cap_account": "string",
}
TAX_UNIT_RATE = {
    "tax_year": "int", "tax_unit_code": "string", "county": "string", "tax_unit_name": "string",
    "adopted_rate": "decimal(12,8)", "source": "string",
}
ACCOUNT = {
    "prop_id": "string", "tax_year": "int", "owner_name": "string", "situs_address": "string",
    "situs_city": "string", "situs_state": "string", "situs_zip": "string", "mailing_address": "string",
    "mailing_city": "string", "mailing_state": "string", "mailing_zip": "string", "state_class": "string",
    "class_code": "string", "total_value": "decimal(14,2)", "land_value": "decimal(14,2)",
    "improvement_value": "decimal(14,2)", "assessed_value": "decimal(14,2)", "latitude": "decimal(10,7)",
    "longitude": "decimal(10,7)", "living_area": "decimal(10,2)", "year_built": "int",
    "is_residential": "boolean", "source_file": "string",
}
LAND = {
    "prop_id": "string", "tax_year": "int", "land_seq": "int", "land_use_code": "string",
    "land_use_description": "string", "acreage": "decimal(12,4)", "land_value": "decimal(14,2)",
    "source_file": "string",
}
IMPROVEMENT = {
    "prop_id": "string", "imp_id": "string", "tax_year": "int", "improvement_type": "string",
    "improvement_description": "string", "improvement_value": "decimal(14,2)",
    "square_feet": "decimal(10,2)", "year_built": "int", "source_file": "string",
}
IMPROVEMENT_DETAIL = {
    "prop_id": "string", "imp_id": "string", "tax_year": "int", "detail_seq": "int",
    "detail_description": "string", "detail_value": "decimal(14,2)", "detail_quantity": "decimal(12,2)",
    "detail_unit": "string", "source_file": "string",
}
CHARACTERISTIC = {
    "prop_id": "string", "imp_id": "string", "tax_year": "int", "bedrooms": "int", "half_baths": "int",
    "room_count": "int", "bathrooms": "decimal(4,2)", "exterior_wall": "string", "foundation": "string",
    "roof_covering": "string", "heating_cooling": "string", "interior_finish": "string",
    "construction_style": "string", "flooring": "string", "source_file": "string",
}
FEATURE_LONG = {
    "prop_id": "string", "imp_id": "string", "tax_year": "int", "detail_seq": "int",
    "feature_type": "string", "feature_value": "string", "source_file": "string",
}


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the schema's columns, typed; absent columns are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(n) if n in have else F.lit(None)).try_cast(t).alias(n) for n, t in schema.items()]
    )


def empty(spark: SparkSession, schema: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in schema.items()))
