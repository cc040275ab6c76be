"""Mappers of published record layouts to annotated rows: id, text, components, country, reason (null: accepted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..operators.corpus import first_reason

# Columns of street names, in the order they are read.
CITY_STREET = ["PRE_MODIFIER", "PRE_DIRECTIONAL", "PRE_TYPE", "STREET_NAME", "POST_TYPE", "POST_DIRECTIONAL", "POST_MODIFIER"]
STATE_STREET = ["St_PreMod", "St_PreDir", "St_PreTyp", "St_PreSep", "St_Name", "St_PosTyp", "St_PosDir", "St_PosMod"]
# Regions of England, and postcode areas by nation.
ENGLISH_REGIONS = ["North East", "North West", "Yorkshire and the Humber", "East Midlands", "West Midlands", "East of England", "London", "South East", "South West"]
SCOTTISH_AREAS = ["AB", "DD", "DG", "EH", "FK", "G", "HS", "IV", "KA", "KW", "KY", "ML", "PA", "PH", "TD", "ZE"]
WELSH_AREAS = ["CF", "LL", "NP", "SA", "LD"]
BORDER_AREAS = ["SY", "CH", "HR", "TD"]


def cell(df: DataFrame, name: str) -> Column:
    """A column as trimmed text; empty where it is null or absent."""
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def joined(*cols: Column) -> Column:
    """What is not empty, by single blanks."""
    return F.array_join(F.filter(F.array(*[F.trim(F.regexp_replace(c, r"\s+", " ")) for c in cols]), lambda x: x != ""), " ")


def rows(df: DataFrame, id: Column, country: str, values: list[tuple[str, Column]], sep: str | Column, reason: Column, **more: Column) -> DataFrame:
    text, spans = S.render(S.parts(*values), sep, squeeze=True)
    return df.select(id.alias("id"), text.alias("text"), spans.alias("components"), F.lit(country).alias("country"), reason.alias("reason"), *[c.alias(n) for n, c in more.items()])


def city_points(df: DataFrame) -> DataFrame:
    """A city's address points: number and street by a blank, then the postcode by a comma."""
    street = joined(*[cell(df, c) for c in CITY_STREET])
    number, code = joined(cell(df, "HOUSE_NUMBER")), joined(cell(df, "ZIPCODE"))
    head, spans = S.render(S.parts(("house_number", number), ("road", street)), " ")
    gap = F.when(head == "", F.lit("")).otherwise(F.lit(", "))
    tail = S.span(F.lit("postcode"), F.length(head) + F.length(gap), F.length(head) + F.length(gap) + F.length(code), code)
    text = F.when(code == "", head).otherwise(F.concat(head, gap, code))
    return df.select(
        F.concat(F.lit("city-"), cell(df, "ADDRESSPOINTID")).alias("id"), text.alias("text"), F.when(code == "", spans).otherwise(F.concat(spans, F.array(tail))).alias("components"),
        F.lit("us").alias("country"), first_reason(("no-fields", text == "")).alias("reason"),
    )


def state_points(df: DataFrame, state: str = "TX") -> DataFrame:
    """A state's address points; records without a street name or of another state are refused."""
    c = lambda n: cell(df, n)
    bad = (c("St_Name") == "") | (c("State") != state)
    values = [
        ("house_number", joined(c("Add_Number"), c("AddNum_Suf"))), ("road", joined(*map(c, STATE_STREET))), ("unit", c("Unit")), ("city", c("Post_Comm")), ("state", c("State")), ("postcode", c("Post_Code")),
    ]
    return rows(df, c("id"), "us", values, " ", first_reason(("invalid", bad)))


def bank_branches(df: DataFrame) -> DataFrame:
    """Branches of insured banks: two address lines, city, state, ZIP; territories are refused."""
    c = lambda n: cell(df, n)
    values = [("street_address", joined(c("ADDRESS"), c("ADDRESS2"))), ("city", c("CITY")), ("state", c("STALP")), ("postcode", c("ZIP"))]
    foreign = ~c("STALP").isin(*X.STATES)
    return rows(df, F.concat(F.lit("fdic:"), c("UNINUM")), "us", values, ", ", first_reason(("US_territory_or_foreign", foreign)), stratum=c("STALP"))


def schools(df: DataFrame) -> DataFrame:
    """Schools of England: open ones of a known region, without further address lines."""
    c = lambda n: cell(df, n)
    region = c("GOR (name)")
    reason = first_reason(
        ("England_closed_or_no_region", (c("EstablishmentStatus (name)") != "Open") | ~region.isin(*ENGLISH_REGIONS)),
        ("England_additional_address_lines", (c("Locality") != "") | (c("Address3") != "")),
    )
    return rows(df, F.concat(F.lit("gias:"), c("URN")), "gb", [("street_address", c("Street")), ("city", c("Town")), ("postcode", c("Postcode"))], ", ", reason, stratum=region)


def libraries(df: DataFrame) -> DataFrame:
    """Libraries of Northern Ireland."""
    c = lambda n: cell(df, n)
    values = [("street_address", joined(c("Number"), c("Street"))), ("city", c("Town")), ("postcode", c("Postcode"))]
    return rows(df, F.concat(F.lit("libraries-ni:"), c("_id")), "gb", values, ", ", first_reason(("no-fields", joined(*[v for _, v in values]) == "")), stratum=F.lit("Northern Ireland"))


def nation_of(postcode: Column) -> Column:
    """Nation of a British postcode by its area; null for areas that cross a border."""
    area = F.regexp_replace(F.regexp_extract(F.upper(postcode), r"^\s*(\S+)", 1), r"\d+$", "")
    return F.when(area.isin(*BORDER_AREAS), None).when(area == "BT", "Northern Ireland").when(area.isin(*SCOTTISH_AREAS), "Scotland").when(area.isin(*WELSH_AREAS), "Wales").otherwise("England")


def companies(df: DataFrame, county: bool = False) -> DataFrame:
    """Registered offices: lines of address, town, postcode (and with ``county`` the county before it) and what speaks against them."""
    c = lambda n: cell(df, f"RegAddress.{n}")
    code, town, lines = c("PostCode"), c("PostTown"), [c("POBox"), c("AddressLine1"), c("AddressLine2")]
    full = F.filter(F.array(*lines), lambda x: x != "")
    loose = F.transform(full, lambda x: X.key(x))
    every = F.upper(F.concat_ws(" ", *[c(n) for n in ("CareOf", "POBox", "AddressLine1", "AddressLine2", "PostTown", "County", "Country", "PostCode")]))
    reason = first_reason(
        ("missing_core_field", (code == "") | (town == "") | (lines[1] == "")),
        ("cross_border_postcode_area", nation_of(code).isNull()),
        ("CH_default_registration_address", every.contains("COMPANIES HOUSE DEFAULT ADDRESS")),
        ("CH_invalid_postcode", ~F.upper(code).rlike(r"^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$")),
        ("CH_county_in_town_field", town.rlike(r"(?i)^(co[.\s]|county\s)")),
        ("CH_duplicate_address_line_or_town", (F.size(F.array_distinct(loose)) < F.size(loose)) | F.array_contains(loose, X.key(town))),
        ("CH_postcode_in_address_line", F.exists(loose, lambda x: x.contains(X.key(code)))),
    )
    values = [("street_address", x) for x in lines] + [("city", town)] + ([("state", c("County"))] if county else []) + [("postcode", code)]
    return rows(df, F.concat(F.lit("ch:"), cell(df, "CompanyNumber")), "gb", values, ", ", reason, stratum=nation_of(code), has_county=c("County") != "")


def with_county(df: DataFrame, county: str = "county", sep: str = ", ") -> DataFrame:
    """Annotated rows with their county put back as the state, before the postcode."""
    bare = F.transform("components", lambda s: F.struct(s["label"].alias("label"), s["raw"].alias("raw")))
    added = F.array(F.struct(F.lit("state").alias("label"), F.coalesce(F.col(county), F.lit("")).alias("raw")))
    text, spans = S.render(F.concat(F.filter(bare, lambda p: p["label"] != "postcode"), added, F.filter(bare, lambda p: p["label"] == "postcode")), sep, squeeze=True)
    return df.withColumn("_t", text).withColumn("components", spans).withColumn("text", F.col("_t")).drop("_t").withColumn("has_county", F.coalesce(F.trim(F.col(county)) != "", F.lit(False)))


MAPPERS = {"city_points": city_points, "state_points": state_points, "bank_branches": bank_branches, "schools": schools, "libraries": libraries, "companies": companies}
