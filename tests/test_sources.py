"""Readers and record mappers on small inputs."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.sources import readers as R

MARKS = f"id string, text string, components {S.SPANS}"


def test_jsonl_and_write_once(spark, tmp_path):
    df = spark.createDataFrame([("1", "a b", [("city", 0, 1, "a")])], MARKS)
    R.write_jsonl(df, str(tmp_path / "x"))
    assert R.jsonl(spark, str(tmp_path / "x"), MARKS).collect() == df.collect()
    with pytest.raises(Exception, match="(?i)exists"):
        R.write_jsonl(df, str(tmp_path / "x"))


def test_tagged(spark):
    lines = ["en\tGB\t4/house_number A/B/road |/FSEP London/city", "en\tGB\t1/road ,/SEP 2/road 3/road", "en\tGB\tx/oops"]
    got = R.tagged(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert got[0].text == "4 A/B , London" and [(s.label, s.raw) for s in got[0].components] == [("house_number", "4"), ("road", "A/B"), ("city", "London")]
    assert [s.raw for s in got[1].components] == ["1", "2 3"] and got[2].reason == "unknown-label" and got[0].reason is None


def test_token_tags(spark):
    rows = [("12 Main Street London", ["StreetNumber", "StreetName", "StreetName", "Municipality"]), ("a b", ["Unit"]), ("a", ["Nope"])]
    got = R.token_tags(spark.createDataFrame(rows, "Address string, Tags array<string>"), "gb").collect()
    assert [(s.label, s.raw) for s in got[0].components] == [("house_number", "12"), ("road", "Main Street"), ("city", "London")]
    assert [r.reason for r in got] == [None, "token-label-length", "unknown-tag"]


BASE = dict(confidence=2, alias_principal="P", number_first=12, number_last=None, lot_number=None, lot_number_suffix=None, street_name="MAIN", street_type_code="STREET", street_suffix_type=None, postcode="800", building_name=None, flat_type=None, flat_number=None, flat_number_suffix=None, level_type=None, level_number=None, locality_name="DARWIN", state_abbreviation="NT", address_detail_pid="X1")
KINDS = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in BASE.items()).replace("number_last string", "number_last int")


@pytest.mark.parametrize("change, text, reason", [
    ({}, "12 MAIN STREET DARWIN NT 0800", None),
    ({"number_last": 14}, "12-14 MAIN STREET DARWIN NT 0800", None),
    ({"number_first": None, "lot_number": "7", "lot_number_suffix": "A"}, "LOT 7A MAIN STREET DARWIN NT 0800", None),
    ({"flat_type": "UNIT", "flat_number_suffix": "A"}, "UNIT A 12 MAIN STREET DARWIN NT 0800", None),
    ({"alias_principal": "A"}, None, "retired-or-alias"), ({"confidence": -1}, None, "retired-or-alias"),
    ({"number_first": None, "number_last": 3}, None, "range-end-without-start"), ({"postcode": "08000"}, None, "invalid-postcode"),
    ({"postcode": "80.5"}, None, "noninteger-number"),
])
def test_geocoded(spark, change, text, reason):
    r = R.geocoded_file(spark.createDataFrame([tuple((BASE | change).values())], KINDS)).first()
    assert r.reason == reason and (reason or r.text == text)
    made = {**BASE, **change}
    lots = [n for n in ("lot_number", "lot_number_prefix", "lot_number_suffix") if made.get(n) not in (None, "")]
    assert (r.source_entity_group, r.omitted_source_fields) == (made["address_detail_pid"], lots if r.text.split()[0] != "LOT" and made.get("number_first") else [])


def test_national(spark):
    cols = "id, numero, rep, nom_voie, code_postal, libelle_acheminement, certification_commune"
    rows = [("a", "12", "bis", "Rue X", "75001", "PARIS", "1"), ("b", "0", "", "Rue X", "75001", "PARIS", "1"), ("c", "1", "", "Rue X", "7500", "PARIS", "1"), ("d", "1", "", "R", "75001", "P", "0"), ("e", None, None, None, None, None, "1")]
    got = R.national_file(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split(", ")))).collect()
    assert got[0].text == "12bis Rue X 75001 PARIS" and [r.reason for r in got] == [None, *["missing-or-invalid-core-fields"] * 2, "not-municipality-certified", "missing-or-invalid-core-fields"]


def test_points(spark):
    cols = "OBJECTID AddNo_Full StNam_Full Building Floor Unit Room SubAddress Post_City State Zip_Code".split()
    rows = [("1", "12", "MAIN ST", None, None, "APT 2", None, "x", "BOSTON", "MA", "02110"), ("2", "1", "UNKNOWN", None, None, None, None, None, "B", "MA", "02110"), ("3", "1", "A", None, None, None, None, None, "B", "MA", "2110"), ("4", None, "A", None, None, None, None, None, "B", "MA", "02110")]
    got = R.address_points(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))).collect()
    assert got[0].text == "12 MAIN ST, APT 2, BOSTON, MA, 02110" and [r.reason for r in got] == [None, "placeholder", "invalid-zip", "missing-field"]


def test_quads(spark):
    lines = ['_:a <http://schema.org/streetAddress> "1 Main" <https://x.org/p> .', '_:a <http://schema.org/addressLocality> "Town"@en <https://x.org/p> .', "_:a <http://schema.org/geo> _:b <https://x.org/p> .", "broken"]
    rows, bad = R.quads(spark.createDataFrame([(x,) for x in lines], "value string"), ["streetAddress", "addressLocality", "postalCode"])
    r = rows.collect()
    assert len(r) == 1 and (r[0].streetAddress, r[0].addressLocality, r[0].postalCode, r[0].domain) == ("1 Main", "Town", None, "x.org") and bad.first()[0] == 1


def test_files(spark, tmp_path):
    text = "en\tgb\t1/road\nen\tgb\t2/road\nen\tg"
    (tmp_path / "a.gz").write_bytes(gzip.compress((text * 50).encode())[:-20])
    assert R.prefix_lines(spark, str(tmp_path / "a.gz")).count() >= 1
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        info = tarfile.TarInfo("x.tsv")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "b.tgz").write_bytes(buf.getvalue())
    assert R.prefix_lines(spark, str(tmp_path / "b.tgz"), tar=True).count() == 2
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", "﻿a,b\n1,2\n3\n")
    assert [r.fits for r in R.zipped_csv(spark, str(tmp_path / "c.zip"), "c.csv").collect()] == [True, False]
    (tmp_path / "d.xml").write_text("<r><a>No <n>12</n>, <c>Town</c> end</a></r>")
    r = R.annotated_xml(spark, str(tmp_path / "d.xml"), {"n": "house_number", "c": "city"}, "a").first()
    assert r.text == "No 12, Town end" and [(s.start, s.raw) for s in r.components] == [(3, "12"), (7, "Town")]
    (tmp_path / "e.json").write_text(json.dumps({"features": [{"attributes": {"N": "1"}}, {"attributes": {"N": "2"}}]}))
    assert R.features(spark, str(tmp_path / "e.json"), "N: string").count() == 2
    (tmp_path / "f.json").write_text(json.dumps({"x": [{"label": "city", "raw": "T"}]}))
    assert R.predictions(spark, str(tmp_path / "f.json"), "m").first().components[0].raw == "T"
    (tmp_path / "g.txt").write_text("a B-x\nb I-x\n\nc I-x\nd O\n")
    assert sorted(r.valid for r in R.conll(spark, str(tmp_path / "g.txt")).collect()) == [False, True, True, True]
    assert R.hashes(spark, str(tmp_path / "d.xml")).first().bytes > 0
    (tmp_path / "h.csv").write_bytes("id,city\n1,Orléans\n".encode("cp1252"))
    assert R.csv(spark, str(tmp_path / "h.csv"), "id string, city string", encoding="windows-1252").first().city == "Orléans"


def test_paragraphs_and_unpivot(spark):
    long = "word " * 12
    m = spark.createDataFrame([(f"Subject: {long}\n\n{long}\n\n{long.upper()}\n\nshort",)], "text string")
    assert R.paragraphs(m).count() == 1
    g = R.unpivot_gold(spark.createDataFrame([("1", "x", "GB", "Town", " ")], "record_id string, full_address string, country_code string, city string, road string"), "record_id", "full_address", "country_code").first()
    assert [(c.label, c.start) for c in g.components] == [("city", None)] and g.country == "gb"


def test_mappers_refuse(spark):
    from quillspan.sources import mappers

    c = spark.createDataFrame([("1", "", "High St", "", "Leeds", "", "LS1 1AA"), ("2", None, "Leeds", None, "Leeds", None, "LS1 1AA"), ("3", "", "", "", "", "", "")], ["CompanyNumber", *[f"RegAddress.{n}" for n in ("POBox", "AddressLine1", "AddressLine2", "PostTown", "County", "PostCode")]])
    got = {r.id: (r.text, r.reason, r.stratum) for r in mappers.companies(c).collect()}
    assert got["ch:1"] == ("High St, Leeds, LS1 1AA", None, "England") and got["ch:2"][1] == "CH_duplicate_address_line_or_town" and got["ch:3"][1] == "missing_core_field"
    base = mappers.companies(c).where("id = 'ch:1'").withColumn("county", F.lit("Kent "))
    r = mappers.with_county(base).first()
    assert (r.text, r.has_county, [s.label for s in r.components]) == ("High St, Leeds, Kent, LS1 1AA", True, ["street_address", "city", "state", "postcode"])
    empty = mappers.city_points(spark.createDataFrame([(7, None, None)], "ADDRESSPOINTID long, HOUSE_NUMBER string, ZIPCODE string")).first()
    assert (empty.id, empty.text, empty.components, empty.reason) == ("city-7", "", [], "no-fields")
