"""Readiness, data-quality checks, reconciliation and comparison with a published snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import columns as K
from parcelwise.operators.keyed import duplicate_keys

# Tolerances in percent.
MAX_MISSING_BUILDING = 1.0
MAX_MISSING_ROOMS = 1.0
MAX_NOT_READY = 1.0
MIN_COORDINATE_COVERAGE = 99.0
POPULATED_PASS, POPULATED_WARN = 90.0, 50.0
MIN_PRESENT_COORDINATES = 10.0

CHECK_SCHEMA = "check string, level string, missing bigint, total bigint, pct double"


# ------------------------------------------------------------------------------- readiness


def buildings_with_rooms(building: DataFrame) -> DataFrame:
    """Accounts with an active building whose own row knows bedrooms and bathrooms."""
    known = F.col("is_active") & F.col("bedrooms").isNotNull() & F.col("bathrooms").isNotNull()
    return building.filter(known).select("account_number").distinct()


def _flagged(prop: DataFrame, building: DataFrame) -> DataFrame:
    """Properties with ``has_rooms`` and ``has_building``, from one pass over the buildings."""
    active = building.filter("is_active").groupBy("account_number").agg(
        F.lit(True).alias("has_building"),
        F.bool_or(F.col("bedrooms").isNotNull() & F.col("bathrooms").isNotNull()).alias("has_rooms"),
    )
    return prop.join(active, "account_number", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_building", "has_rooms")}
    )


def _located() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def refresh_readiness(prop: DataFrame, building: DataFrame) -> DataFrame:
    """Recompute ``is_data_ready``: residential, located, and an active building with rooms."""
    ready = F.col("is_residential") & _located() & F.col("has_rooms")
    return _flagged(prop, building).withColumn("is_data_ready", F.coalesce(ready, F.lit(False))).select(*prop.columns)


def ready_properties(prop: DataFrame, building: DataFrame) -> DataFrame:
    """The ready properties only."""
    return prop.filter(F.col("is_residential") & _located()).join(
        buildings_with_rooms(building), "account_number", "left_semi"
    )


def without_building(prop: DataFrame, building: DataFrame) -> DataFrame:
    return prop.filter("is_residential").join(
        building.filter("is_active").select("account_number").distinct(), "account_number", "left_anti"
    )


def without_rooms(prop: DataFrame, building: DataFrame) -> DataFrame:
    return prop.filter("is_residential").join(buildings_with_rooms(building), "account_number", "left_anti")


def orphans(children: DataFrame, prop: DataFrame) -> DataFrame:
    """Children whose account is not in the property table."""
    return children.join(prop.select("account_number").distinct(), "account_number", "left_anti")


def link_counts(children: DataFrame, prop: DataFrame) -> DataFrame:
    """One row: children that have a property by account, and those that have none."""
    known = prop.select("account_number").distinct().withColumn("_hit", F.lit(True))
    return children.join(known, "account_number", "left").agg(
        F.count("_hit").alias("linked"), F.count_if(F.col("_hit").isNull()).alias("orphaned")
    )


# ------------------------------------------------------------------------------- grading


def grade_missing(missing: Column, total: Column, tolerance: float) -> Column:
    """Nothing missing passes, a share within the tolerance warns, more fails."""
    share = F.when(total > 0, missing / total * 100.0).otherwise(F.lit(0.0))
    return F.when(missing == 0, "pass").when(share <= tolerance, "warn").otherwise("fail")


def grade_populated(pct: Column) -> Column:
    return F.when(pct >= POPULATED_PASS, "pass").when(pct >= POPULATED_WARN, "warn").otherwise("fail")


def grade_coverage(pct: Column, floor: float = MIN_COORDINATE_COVERAGE) -> Column:
    return F.when(pct >= 100.0, "pass").when(pct >= floor, "warn").otherwise("fail")


def completeness(df: DataFrame, populated: Mapping[str, Column]) -> DataFrame:
    """Per named column: missing rows, share populated and its grade, in one pass over ``df``."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"m_{i}") for i, c in enumerate(populated.values())],
    )
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"m_{i}").alias("missing"))
        for i, name in enumerate(populated)
    ]
    pct = (F.lit(1.0) - F.col("missing") / F.col("total")) * 100.0
    return (
        totals.filter(F.col("total") > 0)
        .select("total", F.inline(F.array(*entries)))
        .select("column_name", "missing", "total", pct.alias("pct"))
        .withColumn("level", grade_populated(F.col("pct")))
    )


def building_completeness(building: DataFrame, prop: DataFrame) -> DataFrame:
    """Room, quality and area coverage of the active buildings of residential properties."""
    mine = building.filter("is_active").join(
        prop.filter("is_residential").select("account_number").distinct(), "account_number", "left_semi"
    )
    return completeness(
        mine,
        {
            "bedrooms": F.col("bedrooms").isNotNull(),
            "bathrooms": F.col("bathrooms").isNotNull(),
            "quality_code": F.col("quality_code") != "",
            "heat_area": F.col("heat_area").isNotNull(),
        },
    )


def _entries(row: DataFrame, checks: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Turn a one-row frame of counts into one row per check."""
    built = [
        F.struct(
            F.lit(name).alias("check"),
            level.alias("level"),
            missing.cast("bigint").alias("missing"),
            total.cast("bigint").alias("total"),
            F.when(total > 0, missing / total * 100.0).alias("pct"),
        )
        for name, level, missing, total in checks
    ]
    return row.select(F.inline(F.array(*built)))


def validate(prop: DataFrame, building: DataFrame, feature: DataFrame) -> DataFrame:
    """The whole check suite as ``(check, level, missing, total, pct)`` rows.

    Levels: ``info`` counts, ``pass``, ``warn``, ``fail``. Each table is scanned by a few aggregates;
    nothing is collected.
    """
    zero = F.lit(0)
    none = lambda c: F.when(c == 0, "pass").otherwise("fail")
    home = F.col("is_residential")
    counts = _flagged(prop, building).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(home).alias("res"),
        F.count_if("is_data_ready").alias("ready"),
        F.count_if(F.col("state_class") == "").alias("no_class"),
        F.count_if(~home).alias("other"),
        F.count_if(home & ~F.col("is_data_ready")).alias("not_ready"),
        F.count_if(home & ~F.col("has_building")).alias("no_building"),
        F.count_if(home & ~F.col("has_rooms")).alias("no_rooms"),
        F.count_if(home & ~_located()).alias("no_place"),
    )
    c = F.col
    covered = F.when(c("res") > 0, (c("res") - c("no_place")) / c("res") * 100.0).otherwise(F.lit(0.0))
    property_checks = _entries(
        counts,
        [
            ("properties_present", F.when(c("n") > 0, "pass").otherwise("fail"), F.when(c("n") > 0, 0).otherwise(1), c("n")),
            ("residential_properties", F.lit("info"), zero, c("res")),
            ("ready_properties", F.lit("info"), zero, c("ready")),
            ("state_class", none(c("no_class")), c("no_class"), c("n")),
            ("residential_only", none(c("other")), c("other"), c("n")),
            ("active_building", grade_missing(c("no_building"), c("res"), MAX_MISSING_BUILDING), c("no_building"), c("res")),
            ("room_counts", grade_missing(c("no_rooms"), c("res"), MAX_MISSING_ROOMS), c("no_rooms"), c("res")),
            # Coordinates share the building tolerance.
            ("coordinates", grade_missing(c("no_place"), c("res"), MAX_MISSING_BUILDING), c("no_place"), c("res")),
            ("readiness", grade_missing(c("not_ready"), c("res"), MAX_NOT_READY), c("not_ready"), c("res")),
            ("coordinate_coverage", grade_coverage(covered), c("no_place"), c("res")),
        ],
    )

    active_building, active_feature = building.filter("is_active"), feature.filter("is_active")
    out = property_checks
    for name, df, keys in (
        ("duplicate_properties", prop, ["account_number"]),
        ("duplicate_buildings", active_building, ["account_number", "building_number"]),
        ("duplicate_features", active_feature, ["account_number", "feature_code", "feature_number"]),
    ):
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        row = groups.agg(F.count(F.lit(1)).alias("g"), F.count_if(c("copies") > 1).alias("d"))
        out = out.unionByName(_entries(row, [(name, none(c("d")), c("d"), c("g"))]))
    for name, df in (("orphan_buildings", active_building), ("orphan_features", active_feature)):
        level = F.when(c("orphaned") == 0, "pass").otherwise("warn")
        total = c("linked") + c("orphaned")
        out = out.unionByName(_entries(link_counts(df, prop), [(name, level, c("orphaned"), total)]))
    present = active_building.agg(F.count(F.lit(1)).alias("b"))
    level = F.when(c("b") > 0, "pass").otherwise("fail")
    out = out.unionByName(
        _entries(present, [("active_buildings_present", level, F.when(c("b") > 0, 0).otherwise(1), c("b"))])
    )
    filled = building_completeness(building, prop).select(
        F.concat(F.lit("populated_"), "column_name").alias("check"),
        "level",
        c("missing").cast("bigint"),
        c("total").cast("bigint"),
        F.when(c("total") > 0, c("missing") / c("total") * 100.0).alias("pct"),
    )
    return out.unionByName(filled)


def failures(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("level") == "fail")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys occur more than once."""
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("duplicate_groups"))


def presence(prop: DataFrame) -> DataFrame:
    """One row: property count, coordinate coverage, and whether data or coordinates must be imported."""
    located = F.count_if(F.col("latitude").isNotNull())
    return prop.agg(F.count(F.lit(1)).alias("properties"), located.alias("located")).select(
        "properties",
        "located",
        (F.col("properties") == 0).alias("needs_import"),
        (
            (F.col("properties") > 0)
            & (F.col("located") / F.greatest("properties", F.lit(1)) * 100.0 < MIN_PRESENT_COORDINATES)
        ).alias("needs_coordinates"),
    )


# ------------------------------------------------------------------------------- reconciliation


def _reclassified(prop: DataFrame, building: DataFrame) -> DataFrame:
    wanted = K.state_class(F.col("state_class"))
    home = K.is_residential(F.col("state_class"))
    return _flagged(prop, building).withColumns(
        {
            "_class": wanted,
            "_residential": home,
            "_ready": home & F.col("has_rooms") & _located(),
        }
    )


def reconcile_preview(prop: DataFrame, building: DataFrame, feature: DataFrame) -> DataFrame:
    """One row of counts: what a reconciliation would change and remove."""
    c = F.col
    counts = _reclassified(prop, building).agg(
        F.count(F.lit(1)).alias("properties_examined"),
        F.count_if(~c("_class").eqNullSafe(c("state_class"))).alias("state_classes_normalized"),
        F.count_if(~c("_residential").eqNullSafe(c("is_residential"))).alias("residential_flags_synced"),
        F.count_if(c("_residential") & c("_ready")).alias("effective_ready_properties"),
        F.count_if(~c("_residential")).alias("non_residential_properties"),
        F.count_if(c("_residential") & ~c("_ready")).alias("incomplete_properties"),
        F.count_if(c("_class") == "").alias("missing_state_class"),
    )
    orphaned = lambda df, name: link_counts(df, prop).select(
        F.col("orphaned").alias(name), F.lit(1).alias("_one")
    )
    return (
        counts.withColumn("_one", F.lit(1))
        .join(orphaned(building, "orphaned_buildings"), "_one")
        .join(orphaned(feature, "orphaned_features"), "_one")
        .drop("_one")
    )


def reconcile(prop: DataFrame, building: DataFrame, feature: DataFrame) -> dict[str, DataFrame]:
    """The kept tables: classes normalised, only residential and ready properties and their children."""
    kept = (
        _reclassified(prop, building)
        .filter("_ready")
        .withColumns({"state_class": F.col("_class"), "is_residential": F.lit(True), "is_data_ready": F.lit(True)})
        .select(*prop.columns)
    )
    accounts = kept.select("account_number")
    child = lambda df: df.join(accounts, "account_number", "left_semi")
    return {"property": kept, "building": child(building), "extra_feature": child(feature)}


# ------------------------------------------------------------------------------- snapshot


def snapshot_mismatches(snapshot: DataFrame, account: DataFrame, strict: bool = False) -> DataFrame:
    """Differences between published records and loaded accounts, one row per record and field.

    ``snapshot``: ``prop_id, situs_address_full, owner_name, assessed_value`` and ``known_drift``, a map
    from field to reason. A loaded address may be a prefix of the published one. A known drift is
    reported as such unless ``strict``; a record that was not loaded is a failure of its own.
    """
    loaded = account.select(
        "prop_id",
        F.trim(F.coalesce("situs_address", F.lit(""))).alias("our_address"),
        F.trim(F.coalesce("owner_name", F.lit(""))).alias("our_owner"),
        F.col("assessed_value").cast("bigint").alias("our_value"),
        F.lit(True).alias("_found"),
    )
    both = snapshot.join(loaded, "prop_id", "left")
    address = F.coalesce("situs_address_full", F.lit(""))
    owner = F.trim(F.coalesce("owner_name", F.lit("")))
    value = F.col("assessed_value").cast("bigint")
    ours = F.col("our_address")
    wrong_address = F.when(ours != "", ~F.startswith(address, ours)).otherwise(address != "")
    wrong_owner = (owner != "") & (F.col("our_owner") != owner)
    wrong_value = value.isNotNull() & ~F.col("our_value").eqNullSafe(value)

    def entry(field: str, found: Column, expected: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), found.cast("string").alias("loaded"), expected.cast("string").alias("published")
        )

    problems = F.when(
        F.col("_found"),
        F.filter(
            F.array(
                F.when(wrong_address, entry("situs_address", ours, address)),
                F.when(wrong_owner, entry("owner_name", F.col("our_owner"), owner)),
                F.when(wrong_value, entry("assessed_value", F.col("our_value"), value)),
            ),
            lambda e: e.isNotNull(),
        ),
    ).otherwise(F.array(entry("missing", F.lit(None), F.col("prop_id"))))
    reason = F.try_element_at("known_drift", F.col("field"))
    excused = reason.isNotNull() & ~F.lit(strict)
    return (
        both.select("prop_id", "known_drift", F.inline(problems))
        .withColumn("reason", reason)
        .withColumn("verdict", F.when(excused, "known_drift").otherwise("failure"))
        .drop("known_drift")
    )
