"""Annotated spans: schema, rendering, validation, projection, tag paths and offsets, as Column builders.

Rows hold few spans each, so ordered folds are higher-order functions over the row's own array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .edits import rebase  # noqa: F401  (as array expressions)

SPANS = "array<struct<label:string,start:int,end:int,raw:string>>"
ADDRESS_SCHEMA = (
    f"id string, text string, country string, language string, components {SPANS}, source_components {SPANS}, source string, "
    "source_sha256 string, source_row bigint, group_key string, split string, label_provenance string, annotation_status string, "
    "status string, offset_basis string, parent_id string"
)
# The two vocabularies, in model order.
SOURCE_FIELDS = [
    "house", "house_number", "road", "unit", "level", "staircase", "entrance", "po_box", "postcode", "suburb",
    "city_district", "city", "island", "state_district", "state", "country_region", "country", "world_region", "category", "near",
]
FIELDS = ["street_address", "locality", "city", "district", "state", "postcode", "country"]
TAGS = ["O", *(f"{p}-{f}" for f in FIELDS for p in "BI")]
# Output field of each source label that is not its own; none: dropped.
PROJECTION = {
    "house": "street_address", "house_number": "street_address", "road": "street_address", "unit": "street_address", "level": "street_address",
    "staircase": "street_address", "entrance": "street_address", "po_box": "street_address", "near": "street_address",
    "suburb": "locality", "city_district": "locality", "island": "locality", "state_district": "district", "country_region": "state",
    "category": None, "world_region": None,
}


def field_of(label: Column) -> Column:
    """Output field of a label; null for dropped and unknown ones."""
    pairs = {s: f for s, f in PROJECTION.items() if f} | {f: f for f in FIELDS}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), label)


def span(label: Column, start: Column, end: Column, raw: Column) -> Column:
    return F.struct(label.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), raw.alias("raw"))


def parts(*pairs: tuple[str, Column]) -> Column:
    """Ordered (label, value) list for ``render``."""
    return F.array(*[F.struct(F.lit(label).alias("label"), value.cast("string").alias("raw")) for label, value in pairs])


def render(values: Column, sep: str | Column = " ", squeeze: bool = False) -> tuple[Column, Column]:
    """(text, spans) of an ordered list of (label, raw); empty values are left out."""
    sep = F.lit(sep) if isinstance(sep, str) else sep
    if squeeze:
        values = F.transform(values, lambda p: F.struct(p["label"].alias("label"), F.trim(F.regexp_replace(p["raw"], r"\s+", " ")).alias("raw")))
    used = F.filter(values, lambda p: p["raw"].isNotNull() & (p["raw"] != ""))
    text = F.call_function("array_join", F.transform(used, lambda p: p["raw"]), sep)
    start = F.aggregate(used, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), -F.length(sep)) + F.length(sep) + F.length(p["raw"])).cast("int"))))
    spans = F.transform(F.arrays_zip(used.alias("p"), start.alias("e")), lambda z: span(z["p"]["label"], z["e"] - F.length(z["p"]["raw"]), z["e"], z["p"]["raw"]))
    return text, spans


def valid(text: Column, spans: Column) -> Column:
    """Spans lie in order inside the text, are not empty, and quote it."""
    ends = F.transform(spans, lambda s, i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0))
    ok = F.transform(spans, lambda s, i: (F.get(ends, i) <= s["start"]) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["raw"]))
    return F.forall(ok, lambda x: F.coalesce(x, F.lit(False)))


def merge(text: Column, spans: Column, separators: str | None = r"^[\s,;]*$") -> Column:
    """Join neighbours of one label; with ``separators``, only across such gaps."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.substring(text, last["end"] + 1, s["start"] - last["end"])
        joins = (last["label"] == s["label"]) & (gap.rlike(separators) if separators else F.lit(True))
        grown = span(last["label"], last["start"], s["end"], F.substring(text, last["start"] + 1, s["end"] - last["start"]))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS), step)


def project(text: Column, spans: Column) -> Column:
    """Seven-field projection of fine spans."""
    coarse = F.transform(spans, lambda s: span(field_of(s["label"]), s["start"], s["end"], s["raw"]))
    return merge(text, F.filter(coarse, lambda s: s["label"].isNotNull()))


def token_spans(text: Column) -> Column:
    """array<struct<start,end>> of the tokens in code points: blanks and tokens tile the text, so their lengths add up."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(gap: pa.Array, size: pa.Array) -> pa.Array:
        n = gap.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        g, s = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (gap, size))
        at = np.cumsum(np.append(0, g + s))
        end = at[1:] - np.repeat(at[np.cumsum(n) - n], n)
        some = s > 0  # the last piece has no token
        n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
        pairs = pa.StructArray.from_arrays([pa.array((end - s)[some], pa.int32()), pa.array(end[some], pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pairs, mask=gap.is_null())

    return run(*[F.transform(F.regexp_extract_all(text, F.lit(X.TILE), F.lit(i)), lambda x: F.length(x)) for i in (1, 2)])


def bio_to_spans(text: Column, path: Column, offsets: Column) -> Column:
    """Spans of a tag path: I continues only a B or I of its field right before it, else it starts a span."""
    items = F.arrays_zip(path.alias("tag"), offsets.alias("at"))

    def step(acc: Column, z: Column) -> Column:
        field = F.substring(z["tag"], 3, 64)
        out, before = acc["out"], acc["before"]
        last = F.try_element_at(out, F.lit(-1))
        on = z["tag"].startswith("I-") & (F.substring(before, 3, 64) == field)
        start = F.when(on, last["start"]).otherwise(z["at"]["start"])
        new = span(field, start, z["at"]["end"], F.substring(text, start + 1, z["at"]["end"] - start))
        kept = F.when(on, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        return F.struct(F.when(z["tag"] == "O", out).otherwise(F.concat(kept, F.array(new))).alias("out"), z["tag"].alias("before"))

    return F.aggregate(items, F.struct(F.array().cast(SPANS).alias("out"), F.lit("O").alias("before")), step, lambda a: a["out"])


def spans_to_bio(spans: Column, offsets: Column) -> Column:
    """Tag of each token by the first span that touches it; an error if that one's boundary cuts the token."""

    def tag(o: Column) -> Column:
        s = F.get(F.filter(spans, lambda s: (o["start"] < s["end"]) & (s["start"] < o["end"])), 0)
        inside = (s["start"] <= o["start"]) & (o["end"] <= s["end"])
        named = F.concat(F.when(s["start"] == o["start"], "B-").otherwise("I-"), s["label"])
        return F.when(s.isNull(), "O").when(inside, named).otherwise(F.raise_error(F.lit("a field's boundary cuts a token")).cast("string"))

    return F.transform(offsets, tag)


def gap_features(text: Column, offsets: Column) -> Column:
    """Before each token: a line feed if the gap has a line break, a space if it is not empty, else nothing."""

    @F.arrow_udf("array<string>")
    def run(t: pa.Array, o: pa.Array) -> pa.Array:
        none = pc.or_(t.is_null(), o.is_null())
        n = np.where(none.to_numpy(zero_copy_only=False), 0, o.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        pairs = o.filter(pc.invert(none)).flatten()
        start, end = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = np.append(0, np.cumsum(n))
        kind = np.zeros(int(at[-1]), np.int64)
        for i in np.flatnonzero(n).tolist():
            lo, hi = at[i], at[i + 1]
            code = np.frombuffer(t[i].as_py().encode("utf-32-le"), np.uint32)
            breaks = np.append(0, np.cumsum((code == 10) | (code == 13)))
            before = np.append(0, end[lo : hi - 1])
            kind[lo:hi] = np.where(breaks[start[lo:hi]] > breaks[before], 2, start[lo:hi] > before)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(["", " ", "\n"]).take(pa.array(kind)), mask=none)

    return run(text, offsets)


def supported(text: Column, toks: Column, max_tokens: int = 128, max_chars: int = 512, max_bytes: int = 64) -> Column:
    """Within the model's limits."""
    return F.coalesce((F.size(toks) > 0) & (F.size(toks) <= max_tokens) & (F.length(text) <= max_chars) & F.forall(toks, lambda t: F.octet_length(t) <= max_bytes), F.lit(False))


def address_type(spans: Column) -> Column:
    labels = F.transform(spans, lambda s: s["label"])
    some = lambda *x: F.arrays_overlap(labels, F.array(*map(F.lit, x)))
    return (
        F.when(some("unit", "level", "house", "staircase", "entrance"), "building-unit-floor").when(some("po_box"), "po-box")
        .when(some("house_number") & some("road"), "number-and-road").when(some("road"), "road-without-number")
        .when(some("house_number", "near", "category"), "other-partial").otherwise("administrative-only")
    )


def joined(spans: Column, label: str, sep: str = "") -> Column:
    """Identities of a label's spans, joined."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: X.identity(s["raw"])), sep)


def group_key(country: Column, text: Column, spans: Column) -> Column:
    """Street within city (or postcode), else the whole text."""
    road, city, code = (joined(spans, x, " ") for x in ("road", "city", "postcode"))
    place = F.when(city != "", city).otherwise(code)
    return X.digest(F.when((road != "") & (place != ""), F.concat_ws("|", country, road, place)).otherwise(F.concat_ws("|", country, X.identity(text))))


def street_keys(country: Column, spans: Column) -> Column:
    road = joined(spans, "road")
    one = lambda k: F.when((road != "") & (joined(spans, k) != ""), X.digest(F.concat_ws("|", country, road, F.lit(k), joined(spans, k))))
    return F.array_compact(F.array(one("city"), one("postcode")))


def signature(spans: Column) -> Column:
    """Sorted (label, joined identities)."""
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    return F.transform(labels, lambda n: F.struct(n.alias("label"), F.array_join(F.transform(F.filter(spans, lambda s: s["label"] == n), lambda s: X.identity(s["raw"])), "").alias("value")))


def utf16(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: span(s["label"], X.utf16_offset(text, s["start"]), X.utf16_offset(text, s["end"]), s["raw"]))


def rebased(spans: list[dict] | None, a: str, b: str | None) -> list[dict] | None:
    """What ``rebase`` must give, character by character. Spans carried over an edit from a to b: those before it stay, those after it move, those it touches go."""
    if spans is None or b is None or not b.strip():
        return None
    n, m = len(a), len(b)
    head = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - head)
    out = []
    for s in spans:
        shift = 0 if s["end"] <= head else m - n if s["start"] >= n - tail else None
        if shift is not None:
            lo, hi = s["start"] + shift, s["end"] + shift
            out.append({"label": s["label"], "start": lo, "end": hi, "raw": b[lo:hi]})
    return out
