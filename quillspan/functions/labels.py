"""Label maps of other parsers, coarse projections, row predicates and key sets over annotated spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans as S
from . import text as X

# Labels of other parsers, by the label each stands for here.
NEURAL = {"StreetNumber": "house_number", "StreetName": "road", "Orientation": "road", "Unit": "unit", "Municipality": "city", "Province": "state", "PostalCode": "postcode"}
TAGGER = {"PlaceName": "city", "StateName": "state", "ZipCode": "postcode", "ZipPlus4": "postcode", "CountryName": "country", "NotAddress": "unrecognized"}
TAGGED_FILE = {"PlaceName": "city", "StateName": "state", "ZipCode": "postcode"}
TAGGED_FILE_STREET = [
    "StreetName", "AddressNumber", "LandmarkName", "USPSBoxID", "USPSBoxType", "OccupancyIdentifier",
    "OccupancyType", "USPSBoxGroupType", "IntersectionSeparator", "USPSBoxGroupID", "CornerOf",
]
# The field of each fine label, kept apart from ``spans.PROJECTION`` so that one can audit the other.
AUDIT = {
    "house": "street_address", "house_number": "street_address", "road": "street_address", "unit": "street_address", "level": "street_address",
    "staircase": "street_address", "entrance": "street_address", "po_box": "street_address", "near": "street_address",
    "suburb": "locality", "city_district": "locality", "island": "locality", "state_district": "district", "country_region": "state",
}


def lookup(table: dict[str, str], label: Column, otherwise: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), label)
    return found if otherwise is None else F.coalesce(found, otherwise)


def neural(label: Column) -> Column:
    return lookup(NEURAL, label)


def tagger(label: Column) -> Column:
    """Every label that is not a place, state, code or country is part of the street."""
    return lookup(TAGGER, label, F.lit("street_address"))


def tagged_file(label: Column) -> Column:
    return lookup(TAGGED_FILE | dict.fromkeys(TAGGED_FILE_STREET, "street_address"), label)


def audited(label: Column) -> Column:
    """A fine label's field by the audit's own map; others are their own field."""
    return lookup(AUDIT, label, label)


def four_fields(label: Column) -> Column:
    """Localities count as street, districts as state."""
    return lookup({"locality": "street_address", "district": "state"}, label, label)


def relabelled(spans: Column, floor: str, whole: str, blocked: list[tuple[str | None, str]] = ()) -> tuple[Column, Column]:
    """(spans, reason): units that match ``floor`` become levels, and are refused unless they match ``whole`` entirely; so is any span that matches a blocked (label or all, pattern)."""
    hit = lambda s: (s["label"] == "unit") & s["raw"].rlike(floor)
    mixed = F.exists(spans, lambda s: hit(s) & ~s["raw"].rlike(f"^(?:{whole})$"))
    out = F.transform(spans, lambda s: S.span(F.when(hit(s), "level").otherwise(s["label"]), s["start"], s["end"], s["raw"]))
    reason = F.when(mixed, "mixed-floor-unit")
    for label, pattern in blocked:
        reason = reason.when(F.exists(out, lambda s: s["raw"].rlike(pattern) & (F.lit(True) if label is None else s["label"] == label)), "blocked-component")
    return out, reason


def is_english(language: Column, provenance: Column) -> Column:
    """Marked English, or not marked at all and made from fields."""
    code = F.lower(F.coalesce(language, F.lit("")))
    return code.isin("en", "eng") | ((code == "") & F.coalesce(provenance == "generated-from-fields", F.lit(False)))


def has_tag(tags: Column, tag: str = "District") -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def field_set(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))


def has_exactly(spans: Column, fields: list[str], more: list[str] = (), when: Column | None = None) -> Column:
    """The labels are those fields, and those of ``more`` where ``when`` holds."""
    want = lambda names: F.array(*[F.lit(x) for x in sorted(names)])
    need = want(fields) if when is None else F.when(when, want([*fields, *more])).otherwise(want(fields))
    return field_set(spans) == need


def is_natural(text: Column) -> Column:
    """Four characters at least, one of them a letter."""
    return F.coalesce((F.length(text) >= 4) & text.rlike(r"\p{L}"), F.lit(False))


def kind(spans: Column) -> Column:
    """0 with a building part, 1 with a box, 2 a street without a number, 3 with one, 4 neither."""
    labels = F.transform(spans, lambda s: s["label"])
    some = lambda *names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    return F.when(some("unit", "level", "house", "entrance", "staircase"), 0).when(some("po_box"), 1).when(some("road") & ~some("house_number"), 2).when(some("road"), 3).otherwise(4)


def is_unsafe_partial(kind: Column, projected: Column) -> Column:
    """A row of kind 4 with a bare street, or with fewer than two fields besides the country."""
    fields = field_set(projected)
    return (kind == 4) & (F.array_contains(fields, "street_address") | (F.size(F.array_except(fields, F.array(F.lit("country")))) < 2))


def alias_keys(country: Column, spans: Column) -> Column:
    """Digests that protect a row: its street keys, and its street with its city and with its postcode."""
    fine = F.exists(spans, lambda s: s["label"] == "road")
    street = F.when(fine, S.joined(spans, "road", " ")).otherwise(S.joined(spans, "street_address", " "))
    place = lambda n: S.joined(spans, n, " ")
    has = lambda n: F.exists(spans, lambda s: s["label"] == n)
    one = lambda n: F.when((street != "") & has(n), X.digest(F.concat(F.lower(country), F.lit("|entity|"), street, F.lit("|"), place(n))))
    return F.array_sort(F.array_union(S.street_keys(F.lower(country), spans), F.array_compact(F.array(one("city"), one("postcode")))))


def entity_keys(country: Column, spans: Column) -> Column:
    """(country, street, field, value) for the city and for the postcode, from loose keys of the projected fields."""
    value = lambda n: X.key(F.array_join(F.transform(F.filter(spans, lambda s: S.field_of(s["label"]) == n), lambda s: s["raw"]), " "))
    street = value("street_address")
    has = lambda n: F.exists(spans, lambda s: S.field_of(s["label"]) == n)
    one = lambda n: F.when((street != "") & has(n), F.struct(country.alias("country"), street.alias("street"), F.lit(n).alias("field"), value(n).alias("value")))
    return F.array_compact(F.array(one("city"), one("postcode")))


def script(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), "other").otherwise("ascii")


def layout(text: Column) -> Column:
    return F.when(text.contains("\n"), "lines").when(text.contains(","), "commas").otherwise("plain")


def label_mask(labels: Column, names: list[str]) -> Column:
    """A bit for each of ``names`` that the labels hold, and the next one for any other label."""
    place = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)), F.lit(len(names) + 1))
    return F.aggregate(F.array_distinct(labels), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (place(x) - 1).cast("int"))))


def scopes(mask: Column, shared: Column) -> Column:
    """The scopes of a row by the mask of its gold labels: all; shared, if every model has all of its labels; then complete, if it has all that they share, else partial."""
    inside = (mask != 0) & (mask.bitwiseAND(F.bitwise_not(shared)) == 0)
    whole = F.when(inside, F.when(mask == shared, "complete").otherwise("partial"))
    return F.array_compact(F.array(F.lit("all"), F.when(inside, "shared"), whole))
