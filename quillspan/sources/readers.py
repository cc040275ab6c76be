"""Sources and sinks of annotated rows."""

from __future__ import annotations

import io
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X


def jsonl(spark: SparkSession, path: str, schema: str = S.ADDRESS_SCHEMA) -> DataFrame:
    """Plain or gzip JSON lines of a fixed schema. A gzip file is one task; it is dealt out after."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "gzip").json(path)


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Headered CSV of a fixed schema; rows that don't fit it carry their text in _corrupt.

    Encodings that Spark's reader refuses are decoded file by file; there _corrupt tells the width.
    """
    if encoding.lower() in ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16le", "utf-16be", "utf-32"):
        return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").csv(path)
    rows = _python_csv(spark.read.format("binaryFile").load(path), None, encoding, sep)
    fields = spark.createDataFrame([], schema).schema
    cols = [F.col("fields")[f.name].try_cast(f.dataType).alias(f.name) for f in fields]
    return rows.select(*cols, F.when(~F.col("fits"), "width").alias("_corrupt"))


def zipped_csv(spark: SparkSession, path: str, member: str, encoding: str = "utf-8-sig") -> DataFrame:
    """(fields, whether the width fits the header) of each row of a CSV inside a zip file."""
    return _python_csv(spark.read.format("binaryFile").load(path), member, encoding, ",")


def _python_csv(files: DataFrame, member: str | None, encoding: str, sep: str) -> DataFrame:
    def run(batches):
        import csv as plain

        for pdf in batches:
            for raw in pdf["content"]:
                f = io.BytesIO(raw)
                f = zipfile.ZipFile(f).open(member) if member else f
                rows = plain.reader(io.TextIOWrapper(f, encoding, newline=""), delimiter=sep)
                head = next(rows)
                for chunk in iter(lambda: [x for _, x in zip(range(4096), rows)], []):
                    yield pd.DataFrame({"fields": [dict(zip(head, r)) for r in chunk], "fits": [len(r) == len(head) for r in chunk]})

    return files.select("content").mapInPandas(run, "fields map<string,string>, fits boolean")


def unpivot_gold(df: DataFrame, id: str, text: str, country: str) -> DataFrame:
    """Span-less gold (one column for each label) as components without offsets."""
    cols = [F.struct(F.lit(c).alias("label"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col(c).alias("raw")) for c in S.SOURCE_FIELDS if c in df.columns]
    return df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.lower(country).alias("country"), F.filter(F.array(*cols), lambda s: F.trim(s["raw"]) != "").alias("components"))


def prefix_lines(spark: SparkSession, path: str, tar: bool = False) -> DataFrame:
    """Whole lines of a cut-off gzip file, or of the first member of a cut-off tar.gz."""

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                data = zlib.decompressobj(31).decompress(raw)
                if tar:
                    info = tarfile.TarInfo.frombuf(data[:512], "utf-8", "strict")
                    if not info.name.endswith(".tsv"):
                        raise ValueError(f"unexpected member {info.name}")
                    data = data[512 : 512 + info.size]
                yield pd.DataFrame({"value": data[: data.rfind(b"\n") + 1].decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def tagged(lines: DataFrame) -> DataFrame:
    """``lang<tab>country<tab>token/label ...`` lines as rows; separator tokens become commas without a span."""
    parts = F.split("value", "\t", 3)
    words = F.filter(F.split(F.get(parts, 2), r"\s+"), lambda w: w != "")
    cut = lambda w: F.length(w) - F.length(F.substring_index(w, "/", -1))
    pieces = F.transform(words, lambda w: F.struct(F.substring_index(w, "/", -1).alias("label"), F.substring(w, F.lit(1), (cut(w) - 1).cast("int")).alias("raw")))
    pieces = F.transform(pieces, lambda p: F.struct(p["label"].alias("label"), F.when(p["label"].isin("SEP", "FSEP"), ",").otherwise(p["raw"]).alias("raw")))
    text, spans = S.render(pieces)
    bad = F.exists(pieces, lambda p: ~p["label"].isin("SEP", "FSEP", *S.SOURCE_FIELDS) | (p["raw"] == ""))
    df = lines.select(F.lower(F.get(parts, 1)).alias("country"), F.get(parts, 0).alias("language"), text.alias("text"), spans.alias("all"), bad.alias("bad"))
    # separators break runs, so merge over the full list and drop them after
    merged = S.merge(F.col("text"), F.col("all"), None)
    keep = F.filter(merged, lambda s: ~s["label"].isin("SEP", "FSEP"))
    return df.select("text", keep.alias("components"), "country", "language", F.when(F.coalesce("bad", F.lit(True)), "unknown-label").alias("reason"))


QUAD = r'^(\S+)\s+<([^>]*)>\s+"((?:[^"\\]|\\.)*)"\S*\s+<([^>]*)>\s*\.\s*$'


def quads(lines: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows by page and subject with one column for each literal field, count of lines that are no quads)."""
    m = lambda i: F.regexp_extract("value", QUAD, i)
    ok = lines.where(F.col("value").rlike(QUAD)).select(m(1).alias("subject"), F.regexp_extract(m(2), r"([^/#]+)$", 1).alias("field"), m(3).alias("value"), m(4).alias("page"))
    rows = ok.where(F.col("field").isin(*fields)).groupBy("page", "subject").pivot("field", fields).agg(F.max("value"))
    return rows.withColumn("domain", X.url_host(F.col("page"))), lines.where((F.trim("value") != "") & ~F.col("value").rlike(r"\s\.\s*$")).agg(F.count("*").alias("invalid"))


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(block, position, token, tag, valid) of blank-line separated blocks; an I tag must follow its field."""
    b = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("block"), "value")
    b = b.select("block", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    t = b.where(F.trim("line") != "").select("block", "pos", F.substring_index(F.regexp_replace("line", r"\s+", "\t"), "\t", 1).alias("token"), F.substring_index(F.regexp_replace("line", r"\s+", "\t"), "\t", -1).alias("tag"))
    from pyspark.sql.window import Window

    before = F.lag("tag").over(Window.partitionBy("block").orderBy("pos"))
    ok = ~F.col("tag").startswith("I-") | F.coalesce(F.substring(before, 3, 99) == F.substring("tag", 3, 99), F.lit(False))
    return t.withColumn("valid", ok)


def annotated_xml(spark: SparkSession, path: str, labels: dict[str, str], record: str) -> DataFrame:
    """Mixed content as text and spans, in document order (tails included)."""

    def run(batches):
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                for node in ET.fromstring(raw).iter(record):
                    text, spans = node.text or "", []
                    for child in node:
                        said = "".join(child.itertext())
                        if child.tag in labels and said:
                            spans.append({"label": labels[child.tag], "start": len(text), "end": len(text) + len(said), "raw": said})
                        text += said + (child.tail or "")
                    out.append((text, spans))
            yield pd.DataFrame(out, columns=["text", "components"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"text string, components {S.SPANS}")


def features(spark: SparkSession, path: str, schema: str, key: str = "attributes") -> DataFrame:
    """Feature-collection JSON, one row for each feature."""
    return spark.read.option("multiLine", True).schema(f"features array<struct<{key}: struct<{schema}>>>").json(path).select(F.explode("features").alias("f")).select(f"f.{key}.*")


def predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """{id: [components]} JSON as rows (id, model, components)."""
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", f"map<string,{S.SPANS}>")
    return raw.select(F.explode(m).alias("id", "components")).select("id", F.lit(model).alias("model"), "components")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def paragraphs(mails: DataFrame, limit: int = 500, seed: str = "2026") -> DataFrame:
    """Distinct paragraphs of 40 to 300 characters without header lines, the first ``limit`` by hash."""
    p = mails.select(F.explode(F.split("text", r"\n\s*\n")).alias("p")).select(F.trim(F.regexp_replace("p", r"\s+", " ")).alias("text"))
    p = p.where(F.length("text").between(40, 300) & ~F.col("text").rlike(r"(?i)^(from|to|cc|bcc|subject|date|message-id|received|x-[a-z-]+):"))
    p = p.withColumn("loose", X.identity(F.col("text"))).groupBy("loose").agg(F.min("text").alias("text"))
    return p.orderBy(X.digest(F.concat(F.lit(seed), "loose")), "loose").limit(limit).select("text")


# Source tags and the labels they stand for.
TOKEN_TAGS = {
    "StreetNumber": "house_number", "StreetName": "road", "Unit": "unit", "Suburb": "suburb", "District": "city_district",
    "PostalCode": "postcode", "Municipality": "city", "Province": "state", "County": "state_district", "Country": "country",
}


def token_tags(df: DataFrame, country: str) -> DataFrame:
    """Records (Address, Tags) with one tag for each word, as rows; reason tells why one is refused."""
    words = F.regexp_extract_all("Address", F.lit(r"(?U)\S+"), F.lit(0))
    table = F.create_map(*[F.lit(x) for p in TOKEN_TAGS.items() for x in p])
    d = df.select(F.col("Address").alias("text"), words.alias("w"), F.col("Tags").alias("t"), (F.col("Language") if "Language" in df.columns else F.lit("")).alias("language"))
    d = d.withColumn("reason", F.when((F.size("w") != F.size("t")) | (F.size("w") == 0), "token-label-length").when(F.exists("t", lambda x: F.try_element_at(table, x).isNull()), "unknown-tag"))

    def walk(acc: Column, z: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        start = at + F.position(z["w"], F.substring(F.col("text"), at + 1, F.length("text"))) - 1
        return F.concat(acc, F.array(S.span(F.try_element_at(table, z["t"]), start, start + F.length(z["w"]), z["w"])))

    spans = F.aggregate(F.arrays_zip("w", "t"), F.array().cast(S.SPANS), walk)
    d = d.withColumn("fine", F.when(F.col("reason").isNull(), spans))
    return d.select("text", S.merge(F.col("text"), F.col("fine"), None).alias("components"), F.lit(country).alias("country"), "language", "reason")


def _number(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value.cast("string"), r"\.0+$", ""), F.lit(""))


def _words(*cols: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), lambda x: x != ""), " ")


def national_file(df: DataFrame) -> DataFrame:
    """Address-file records (number, suffix, road, postcode, city) of certified municipalities."""
    c = lambda n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))
    number, road, code, city = c("numero"), c("nom_voie"), c("code_postal"), c("libelle_acheminement")
    bad = ~number.rlike(r"^\d+$") | number.try_cast("bigint").isin(0, 9999) | (road == "") | (city == "") | ~code.rlike(r"^\d{5}$")
    reason = F.when(c("certification_commune") != "1", "not-municipality-certified").when(bad, "missing-or-invalid-core-fields")
    text, spans = S.render(S.parts(("house_number", F.concat(number, c("rep"))), ("road", road), ("postcode", code), ("city", city)))
    return df.select(F.col("id"), text.alias("text"), spans.alias("components"), F.lit("fr").alias("country"), reason.alias("reason"))


def geocoded_file(df: DataFrame) -> DataFrame:
    """Geocoded national records with ranges, lots, flats and levels; retired ones and aliases refused."""
    have = set(df.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    number = lambda p: F.concat(_number(col(f"{p}_prefix")), _number(col(p)), _number(col(f"{p}_suffix")))
    first, last, lot = number("number_first"), number("number_last"), number("lot_number")
    code = _number(col("postcode"))
    code = F.when((code == "") | (F.length(code) > 4), code).otherwise(F.lpad(code, 4, "0"))
    place = F.when(first != "", F.concat(first, F.when(last != "", F.concat(F.lit("-"), last)).otherwise(""))).when(lot != "", F.concat(F.lit("LOT "), lot)).otherwise("")
    reason = (
        F.when((col("confidence").cast("int") < 0) | (F.coalesce(col("alias_principal"), F.lit("")) != "P"), "retired-or-alias")
        .when(F.concat(*[_number(col(n)) for n in ("number_first", "number_last", "lot_number", "flat_number", "level_number", "postcode")]).contains("."), "noninteger-number")
        .when((last != "") & (_number(col("number_last")) == ""), "range-end-designator-without-number")
        .when((last != "") & (first == ""), "range-end-without-start").when((code != "") & ~code.rlike(r"^\d{4}$"), "invalid-postcode")
    )
    values = S.parts(
        ("house", col("building_name")), ("unit", _words(col("flat_type"), number("flat_number"))), ("level", _words(col("level_type"), number("level_number"))), ("house_number", place),
        ("road", _words(col("street_name"), col("street_type_code"), col("street_suffix_type"))), ("city", col("locality_name")), ("state", col("state_abbreviation")), ("postcode", code),
    )
    text, spans = S.render(values)
    # a lot beside a number is not rendered; which of its fields were left out is reported
    lots = ["lot_number", "lot_number_prefix", "lot_number_suffix"]
    omitted = F.array_compact(F.array(*[F.when((first != "") & (F.coalesce(col(n).cast("string"), F.lit("")) != ""), F.lit(n)) for n in lots]))
    groups = [omitted.alias("omitted_source_fields"), col("address_detail_pid").alias("source_entity_group"), col("street_locality_pid").alias("source_street_group")]
    return df.select(col("address_detail_pid").alias("id"), text.alias("text"), spans.alias("components"), F.lit("au").alias("country"), reason.alias("reason"), *groups)


def address_points(df: DataFrame) -> DataFrame:
    """National address points: number, street, building, floor, unit, room, city, state, zip."""
    c = lambda n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))
    fine = F.array_join(F.filter(F.array(c("Building"), c("Floor"), c("Unit"), c("Room")), lambda x: x != ""), ", ")
    sub = F.when(fine != "", fine).otherwise(c("SubAddress"))
    missing = F.exists(F.array(c("AddNo_Full"), c("StNam_Full"), c("Post_City"), c("State"), c("Zip_Code")), lambda x: x == "")
    odd = F.concat_ws(" ", c("StNam_Full"), c("Post_City")).rlike(r"(?i)\b(not stated|unknown|unnamed|unassigned)\b")
    reason = F.when(missing, "missing-field").when(odd, "placeholder").when(~c("Zip_Code").rlike(r"^\d{5}(-\d{4})?$"), "invalid-zip")
    street = F.array_join(F.filter(F.array(_words(c("AddNo_Full"), c("StNam_Full")), sub), lambda x: x != ""), ", ")
    text, spans = S.render(S.parts(("street_address", street), ("city", c("Post_City")), ("state", c("State")), ("postcode", c("Zip_Code"))), ", ", squeeze=True)
    return df.select(F.col("OBJECTID").cast("string").alias("id"), text.alias("text"), spans.alias("components"), F.lit("us").alias("country"), reason.alias("reason"))


MAPPERS = {"national_file": national_file, "geocoded_file": geocoded_file, "address_points": address_points}
