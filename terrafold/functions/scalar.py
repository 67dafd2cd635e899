"""Coding rules of the attribute tables, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Study types, in the order in which a later rule overrides an earlier one
REGIMES = (
    ("^(NP|)$", "NOT_POPULATED"),
    ("FLOOD RISK", "BLE_RISKCLASS"),
    ("REDELINEATION", "REDELINEATION"),
    ("DIGITAL CONVERSION", "DIGITAL_CONVERSION"),
    ("WITHOUT BFE|UNPUBLISHED BFE", "NO_BFE"),
    ("WITH BFE", "BFE_DETAIL"),
    ("BLE AVAILABLE", "BLE_UNPUBLISHED"),
)
# Flooding frequency classes in order
FLOOD_CODES = {"None": 0, "Very rare": 1, "Rare": 2, "Occasional": 3, "Frequent": 4, "Very frequent": 5}
# Land cover classes
LAND_COVER = {
    11: "Open Water", 12: "Perennial Ice/Snow", 21: "Developed, Open Space", 22: "Developed, Low Intensity", 23: "Developed, Medium Intensity",
    24: "Developed, High Intensity", 31: "Barren Land (Rock/Sand/Clay)", 41: "Deciduous Forest", 42: "Evergreen Forest", 43: "Mixed Forest", 52: "Shrub/Scrub",
    71: "Grassland/Herbaceous", 81: "Pasture/Hay", 82: "Cultivated Crops", 90: "Woody Wetlands", 95: "Emergent Herbaceous Wetlands",
}
SENTINEL = -9999.0
# White space, Unicode's and the separators of ASCII
SPACE = "[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x85]"
WATER_UNIT = "^(Waters?|Dredge channel)\\b"


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def study_regime(study: Column) -> Column:
    """The regime of a study type; of several rules that hold, the last counts."""
    text = F.upper(trimmed(F.coalesce(study, F.lit(""))))
    first, *rest = reversed(REGIMES)
    out = F.when(text.rlike(first[0]), first[1])
    for pattern, name in rest:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("OTHER")


def clean_sentinel(value: Column) -> Column:
    """A number, or null for text that is none and for the sentinel within its tolerance."""
    v = value.try_cast("double")
    return F.when(F.abs(v - SENTINEL) <= 1e-8 + 1e-5 * abs(SENTINEL), None).otherwise(F.when(~F.isnan(v), v))


def block_id(x: Column, y: Column, edge: int) -> Column:
    return F.concat_ws("_", F.floor(x / edge).cast("long").cast("string"), F.floor(y / edge).cast("long").cast("string"))


def tile_of_block(block: Column, factor: int = 5) -> Column:
    """The coarser cell of a block id; floors, so negative blocks go to the cell that holds them."""
    parts = F.split(block, "_")
    return F.concat_ws("_", *[F.floor(parts[i].cast("long") / factor).cast("string") for i in (0, 1)])


def county_fips(dfirm: Column) -> Column:
    """The county code of a map id with a trailing letter, else null."""
    return F.when(F.substring(dfirm, -1, 1).rlike("[A-Za-z]"), F.substring(dfirm, 1, 5))


def coded(value: Column, table: dict[str, int], what: str) -> Column:
    """A strict code: null stays null, an unknown value raises."""
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(value.isNull(), None).otherwise(F.coalesce(F.try_element_at(codes, value), F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)).cast("int")))


def flood_code(value: Column) -> Column:
    return coded(value, FLOOD_CODES, "flooding frequency")


def fluvial_code(subgroup: Column, water: Column) -> Column:
    """1 for a subgroup that names fluvial soils, 0 for others; null for water or no unit."""
    return F.when(water | subgroup.isNull(), None).otherwise(subgroup.rlike("(?i)fluv").cast("double"))


def is_water_unit(name: Column) -> Column:
    return name.rlike(WATER_UNIT)


def log10_floor(value: Column, floor: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.log10(F.greatest(value, F.lit(floor))))


def one_hot(column: str, levels: list[int]) -> dict[str, Column]:
    """Indicator columns by name; null where the feature is null; a level must be whole."""
    out = {f"{column}_{int(v)}": F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("double")) for v in levels}
    if len(out) != len(levels) or any(int(v) != v for v in levels):
        raise ValueError(f"levels of {column} clash or aren't whole: {levels}")
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def class_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LAND_COVER.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit(""))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def spherical(h: Column, nugget: float, psill: float, a: float) -> Column:
    t = F.least(h / a, F.lit(1.0))
    return nugget + psill * (1.5 * t - 0.5 * t * t * t)


def exponential(h: Column, nugget: float, psill: float, a: float) -> Column:
    return nugget + psill * (1 - F.exp(-h / a))


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT(%.9f %.9f)", lon, lat)


def safe_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_]+$")


def first_of(flags: dict[str, Column], none: str = "kept") -> Column:
    """The name of the first flag that holds, in order."""
    items = list(flags.items())
    return reduce(lambda out, item: out.when(item[1], item[0]), items[1:], F.when(items[0][1], items[0][0])).otherwise(none)
