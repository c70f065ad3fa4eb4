"""Scalar column functions for cleaning and formatting appraisal-roll fields.

Every function takes and returns a ``Column``; nothing here leaves the JVM.
Spark 4 runs in ANSI mode by default, so all parsing goes through ``try_cast``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# State classes treated as residential.
RESIDENTIAL_CLASSES = ("A1", "A2", "A4", "E1")

# Display names of the single-letter quality grades.
QUALITY_LABELS = {
    "X": "Superior",
    "A": "Excellent",
    "B": "Good",
    "C": "Average",
    "D": "Low",
    "E": "Very Low",
    "F": "Poor",
}

# Accepted spellings of a true flag.
TRUE_WORDS = ("true", "1", "yes", "y", "t")

MONEY = "decimal(14,2)"
#: Wide enough to hold any figure of a roll before it is cut to its column.
WIDE = "decimal(38,18)"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# White space, and control characters that never belong in a text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
CONTROLS = "".join(map(chr, range(32))) + "\x7f\\"


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_text(c: Column) -> Column:
    """Trimmed text, whole; null becomes the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Trim and squeeze inner white-space runs to one blank."""
    blanks = F.trim(F.translate(c, WHITE_SPACE, " " * len(WHITE_SPACE)))
    # Most values hold no run, so the pattern is rarely needed.
    return F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " {2,}", " ")).otherwise(blanks)


def neutralise_controls(c: Column) -> Column:
    """Replace control characters, DEL and backslash by blanks, then trim."""
    return clean_text(F.translate(c, CONTROLS, " " * len(CONTROLS)))


def to_int(c: Column) -> Column:
    """Whole number through a fraction (``"123.90"`` gives 123), null when unparsable.

    A decimal cast, unlike a float cast, takes no type suffixes and no NaN.
    """
    return strip(c).try_cast(WIDE).try_cast("int")


def to_strict_int(c: Column) -> Column:
    """Whole number without the detour (``"123.0"`` is null)."""
    return strip(c).try_cast("int")


def to_decimal(c: Column, dtype: str = MONEY) -> Column:
    """Decimal after dropping ``$`` and thousands commas, null when unparsable."""
    return F.translate(strip(c), "$,", "").try_cast(dtype)


def to_double(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(NUMBER_PATTERN), text).try_cast("double")


def to_bool(c: Column) -> Column:
    return F.lower(strip(c)).isin(*TRUE_WORDS)


def implied_decimal(c: Column, places: int, dtype: str = MONEY) -> Column:
    """Digits with ``places`` implied decimals (``"2833677"`` with 2 is 28336.77)."""
    unit = F.lit(f"{10.0 ** -places:.{places}f}").cast(f"decimal({places + 1},{places})")
    return (strip(c).try_cast("decimal(28,6)") * unit).try_cast(dtype)


def literal_decimal(c: Column, dtype: str = MONEY) -> Column:
    """Digits that carry their own decimal point, or none at all."""
    return strip(c).try_cast(dtype)


def int_or_null(c: Column) -> Column:
    """Integer; blank, all zeros or junk is null."""
    return F.nullif(to_strict_int(c), F.lit(0))


def int_or_zero(c: Column) -> Column:
    return F.coalesce(to_strict_int(c), F.lit(0))


def rate_fraction(per_hundred: Column) -> Column:
    """A published rate per 100 of value as a fraction."""
    return (per_hundred.cast("decimal(18,10)") / F.lit(100).cast("decimal(3,0)")).try_cast("decimal(12,8)")


def nonzero(c: Column) -> Column:
    """The value unless it is zero: a zero counts as missing in every fallback chain."""
    return F.when(c != 0, c)


def first_nonzero(*cols: Column) -> Column:
    return F.coalesce(*[nonzero(c) for c in cols])


def first_nonblank(*cols: Column) -> Column:
    return clean_text(F.coalesce(*[_nonempty(strip(c)) for c in cols]))


def first_int(*cols: Column) -> Column:
    return F.coalesce(*[to_int(c) for c in cols])


def first_decimal(*cols: Column, dtype: str = MONEY) -> Column:
    return F.coalesce(*[to_decimal(c, dtype) for c in cols])


def join_nonblank(sep: str, *cols: Column) -> Column:
    """Join the non-blank parts."""
    return F.concat_ws(sep, *[_nonempty(F.coalesce(c, F.lit(""))) for c in cols])


def state_class(c: Column) -> Column:
    return F.upper(clean_text(c))


def is_residential(c: Column) -> Column:
    return F.upper(clean_text(c)).isin(*RESIDENTIAL_CLASSES)


def street_with_suffix(name: Column, suffix: Column) -> Column:
    return clean_text(join_nonblank(" ", clean_text(name), clean_text(suffix)))


def site_address(full: Column, number: Column, street: Column) -> Column:
    """The full site address, else number and street."""
    return F.coalesce(_nonempty(clean_text(full)), F.trim(F.concat_ws(" ", number, street)))


def component_address(number: Column, street: Column, full: Column) -> Column:
    """The older preference: built from its components, else the full text."""
    return F.coalesce(_nonempty(join_nonblank(" ", number, street)), clean_text(full))


def zip_plus_four(zip5: Column, zip4: Column) -> Column:
    """``zip5-zip4`` only when both parts are present."""
    return F.when((zip5 != "") & (zip4 != ""), F.concat_ws("-", zip5, zip4)).otherwise(zip5)


def parcel_text(c: Column) -> Column:
    """Parcel attribute text; null, NaN and the literal word NULL are blank."""
    text = clean_text(c.cast("string"))
    return F.when(F.upper(text).isin("NULL", "NAN"), F.lit("")).otherwise(text)


def parcel_address(parts: Sequence[Column], unit: Column) -> Column:
    street = join_nonblank(" ", *[parcel_text(p) for p in parts])
    return F.trim(join_nonblank(" ", street, parcel_text(unit)))


def padded_property_id(c: Column, width: int = 12) -> Column:
    """Zero-pad to ``width``; a longer id is kept whole."""
    text = c.cast("decimal(38,0)").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def full_baths(c: Column) -> Column:
    """Full baths out of a free-text plumbing count; null when the text is not understood."""
    return _bath_shape(c, whole=True)


def half_baths(c: Column) -> Column:
    return _bath_shape(c, whole=False)


# The text shapes of a bath count, tried in this order.
BATH_FRACTION = r"(?i)^([0-9]+)[\s,-]+1/2\s*(EA)?$"
BATH_POINT_FIVE = r"^([0-9]+)\.5$"
BATH_SLASH = r"^([0-9]+)[/\\]([0-9]+)$"
BATH_PLAIN = r"^([0-9]+)$"


def _bath_shape(c: Column, whole: bool) -> Column:
    text = strip(c)

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("int")

    one, none = F.lit(1), F.lit(0)
    return (
        F.when(text.rlike(BATH_FRACTION), number(BATH_FRACTION, 1) if whole else one)
        .when(text.rlike(BATH_POINT_FIVE), number(BATH_POINT_FIVE, 1) if whole else one)
        .when(text.rlike(BATH_SLASH), number(BATH_SLASH, 1 if whole else 2))
        .when(text.rlike(BATH_PLAIN), number(BATH_PLAIN, 1) if whole else none)
    )


def quality_digit(class_code: Column) -> Column:
    """First digit of a class code."""
    return _nonempty(F.regexp_extract(F.upper(clean_text(class_code)), "([0-9])", 1)).try_cast("int")


def value_per_area(value: Column, area: Column) -> Column:
    """Value per square foot; null when the value is missing or zero, or the area is not positive."""
    v, a = value.cast("double"), area.cast("double")
    return F.when((v != 0) & (a > 0), v / a)


def quality_label(code: Column) -> Column:
    """Grade letter as words; an unknown code is shown as it is, null as blank."""
    out = F.coalesce(code, F.lit(""))
    labelled = None
    for letter, words in QUALITY_LABELS.items():
        hit = F.upper(out) == letter
        labelled = F.when(hit, words) if labelled is None else labelled.when(hit, words)
    return labelled.otherwise(out)


def csv_safe(c: Column) -> Column:
    """Prefix an apostrophe to text a spreadsheet would run as a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def percent_change(current: Column, prior: Column) -> Column:
    """Change in percent, half-up to two places; null without a usable prior value."""
    cur, pri = current.cast("decimal(18,2)"), nonzero(prior).cast("decimal(18,2)")
    ratio = ((cur - pri) / pri).cast("decimal(30,12)")
    return F.round(ratio * F.lit(100).cast("decimal(3,0)"), 2).cast("decimal(18,2)")


def currency(c: Column) -> Column:
    """Whole dollars with thousands separators."""
    return F.when(c.isNotNull(), F.concat(F.lit("$"), F.format_number(c.cast("double"), 0))).otherwise("")


def grouped(c: Column, places: int = 0) -> Column:
    return F.when(c.isNotNull(), F.format_number(c.cast("double"), places)).otherwise("")


def fixed(c: Column, places: int) -> Column:
    """Fixed-point text without separators, null stays null."""
    return F.round(c.cast("double"), places).cast(f"decimal(30,{places})").cast("string")


def bed_bath(beds: Column, baths: Column) -> Column:
    """``beds / baths`` for display; a dash for a missing side, one dash when both are."""
    left = F.coalesce(nonzero(beds).cast("string"), F.lit("-"))
    right = F.coalesce(fixed(nonzero(baths), 1), F.lit("-"))
    known = nonzero(beds).isNotNull() | nonzero(baths).isNotNull()
    return F.when(known, F.concat_ws(" / ", left, right)).otherwise("-")


def locality_line(city: Column, zip_code: Column, state: str = "TX") -> Column:
    return F.trim(join_nonblank(" ", join_nonblank(", ", city, F.lit(state)), zip_code))


def quick_round(c: Column, places: int) -> Column:
    """``round`` of a double column without a big-decimal detour per row.

    Away from a tie the scaled floor gives the same number; only the rare values near one take the
    exact function. ``c`` should be a plain column, it is used several times.
    """
    scale = F.lit(float(10**places))
    low = F.floor(c * scale + 0.5).cast("double")
    near_tie = F.abs(c * scale - F.floor(c * scale).cast("double") - 0.5) < 1e-6
    return F.when(near_tie, F.round(c, places)).otherwise(low / scale)


def clamp_argument(value: object, default: float, lower: float, upper: float) -> float:
    """A user-supplied number kept inside its bounds; junk falls back to the default."""
    kind = int if isinstance(default, int) else float
    try:
        parsed = kind(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return max(lower, min(upper, parsed))
