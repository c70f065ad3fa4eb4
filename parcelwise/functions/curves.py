"""Piecewise-linear curves and the similarity measures built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = Sequence[tuple[float, float]]

# Rank of the quality and condition letters.
GRADE_RANK = {"X": 7, "A": 6, "B": 5, "C": 4, "D": 3, "E": 2, "F": 1}

# Curve points (difference, similarity).
LIVING_AREA_CURVE = (
    (0.0, 1.0), (0.03, 0.96), (0.05, 0.90), (0.10, 0.78), (0.20, 0.55),
    (0.30, 0.32), (0.40, 0.16), (0.50, 0.06), (0.75, 0.0),
)
BEDROOM_CURVE = ((0.0, 1.0), (1.0, 0.62), (2.0, 0.22), (3.0, 0.06), (4.0, 0.0))
BATHROOM_CURVE = ((0.0, 1.0), (0.5, 0.76), (1.0, 0.40), (1.5, 0.14), (2.5, 0.0))
AGE_CURVE = (
    (0.0, 1.0), (2.0, 0.90), (5.0, 0.76), (10.0, 0.42), (15.0, 0.22), (25.0, 0.08), (40.0, 0.0),
)
STORY_CURVE = ((0.0, 1.0), (0.5, 0.70), (1.0, 0.35), (2.0, 0.0))
LAND_CURVE = (
    (0.0, 1.0), (0.05, 0.90), (0.10, 0.76), (0.20, 0.54), (0.35, 0.28), (0.50, 0.12), (0.80, 0.0),
)
RANK_CURVE = ((0.0, 1.0), (1.0, 0.72), (2.0, 0.42), (3.0, 0.18), (5.0, 0.0))
DISTANCE_CURVE = ((0.0, 1.0), (0.1, 0.93), (0.25, 0.78), (0.5, 0.52), (0.75, 0.24), (1.0, 0.05))

# Lower bound of each match label, best first.
MATCH_LABELS = ((84, "Best match"), (70, "Highly similar"), (52, "Good match"), (36, "OK match"))
LOWEST_LABEL = "Broad match"


def curve(x: Column, points: Curve) -> Column:
    """Piecewise-linear interpolation, flat outside the points; null in, null out."""
    if not points:
        return F.when(x.isNotNull(), F.lit(0.0))
    (first_x, first_y), last_y = points[0], points[-1][1]
    out = F.when(x <= first_x, F.lit(float(first_y)))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 == x0:
            piece = F.lit(float(y1))
        else:
            piece = F.lit(float(y0)) + F.lit(float(y1 - y0)) * ((x - F.lit(float(x0))) / F.lit(float(x1 - x0)))
        out = out.when(x <= x1, piece)
    return out.when(x.isNotNull(), F.lit(float(last_y)))


def percentage_gap(subject: Column, comp: Column) -> Column:
    """Relative difference; null unless the subject value is positive."""
    s, c = subject.cast("double"), comp.cast("double")
    return F.when(s > 0, F.abs(s - c) / s)


def difference_gap(subject: Column, comp: Column) -> Column:
    return F.abs(subject.cast("double") - comp.cast("double"))


def percentage_similarity(subject: Column, comp: Column, points: Curve) -> Column:
    return curve(percentage_gap(subject, comp), points)


def difference_similarity(subject: Column, comp: Column, points: Curve) -> Column:
    return curve(difference_gap(subject, comp), points)


def code(c: Column) -> Column:
    """Normalised code: trimmed and upper-cased, null when blank."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def categorical(s: Column, c: Column) -> Column:
    """Similarity of two normalised codes: equal 1.0, same first two characters 0.65, same first
    character 0.4, else 0; null if either is missing."""
    two = (F.length(s) >= 2) & (F.length(c) >= 2) & (F.substring(s, 1, 2) == F.substring(c, 1, 2))
    return F.when(
        s.isNotNull() & c.isNotNull(),
        F.when(s == c, F.lit(1.0))
        .when(two, F.lit(0.65))
        .when(F.substring(s, 1, 1) == F.substring(c, 1, 1), F.lit(0.4))
        .otherwise(F.lit(0.0)),
    )


def categorical_similarity(subject: Column, comp: Column) -> Column:
    return categorical(code(subject), code(comp))


def rank_of(c: Column, ranks: Mapping[str, int] = GRADE_RANK) -> Column:
    """Rank of a normalised code, null when unranked."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.try_element_at(table, c)


def rank_gap(s: Column, c: Column, s_rank: Column, c_rank: Column) -> Column:
    """Rank difference of two normalised codes; zero for equal codes even when unranked."""
    return F.when(s == c, F.lit(0.0)).otherwise(F.abs(s_rank - c_rank).cast("double"))


def ranked_code_similarity(subject: Column, comp: Column, ranks: Mapping[str, int] = GRADE_RANK) -> Column:
    """Equal codes 1.0, else by rank difference; null if blank, or unranked and different."""
    s, c = code(subject), code(comp)
    return curve(rank_gap(s, c, rank_of(s, ranks), rank_of(c, ranks)), RANK_CURVE)


def condition_similarity(subject: Column, comp: Column) -> Column:
    return F.coalesce(ranked_code_similarity(subject, comp), categorical_similarity(subject, comp))


def distance_ratio(distance: Column, max_distance: float) -> Column:
    """Distance as a share of the search radius, held at one; null without a radius."""
    if max_distance <= 0:
        return F.lit(None).cast("double")
    return F.when(distance.isNotNull(), F.least(F.lit(1.0), distance / F.lit(float(max_distance))))


def distance_similarity(distance: Column, max_distance: float) -> Column:
    return curve(distance_ratio(distance, max_distance), DISTANCE_CURVE)


def jaccard(subject_codes: Column, comp_codes: Column) -> Column:
    """Overlap of two code sets (arrays without duplicates); null when both are empty."""
    shared = F.size(F.array_intersect(subject_codes, comp_codes))
    either = F.size(subject_codes) + F.size(comp_codes) - shared
    return F.when(either > 0, shared / either)


def match_label(score: Column) -> Column:
    out = None
    for floor, label in MATCH_LABELS:
        hit = score >= floor
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(LOWEST_LABEL))
