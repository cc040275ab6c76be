"""Registered queries: each operator on the provided tables, with the SQL that must give the same rows.

The tables hold no addresses, so operators run on what has their shape: ``documents`` are
candidate rows, ``benchmark`` the protected set, ``labels`` annotations, and customer, nation and
region the structured records that are rendered into annotated text.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat, edits
from ..functions import labels as L
from ..functions import spans as S
from ..functions import text as X
from ..operators import admit, augment, corpus, evidence, model, protect, score, select, verify
from ..sources import mappers, readers, resumable, spool
from ..sources.shared import TEXTS, Tables, dealt
from . import corpora

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MODEL_SEED = 3


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


def loose(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]', '', 'g')"


TOKEN_SQL = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]|[\p{L}\p{N}\p{M}]+|[^\s]"
SCORER_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s,]"


def records(spark, sf_dir) -> DataFrame:
    """Annotated rows rendered from customers."""
    c = dealt(t(spark, sf_dir, "customer"), "c_custkey").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    text, spans = S.render(S.parts(("house_number", F.col("c_custkey")), ("road", F.col("c_mktsegment")), ("unit", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Unit "), F.col("c_custkey") % 100))), ("city", F.col("n_name")), ("country", F.col("r_name"))), ", ")
    return c.select(F.col("c_custkey").cast("string").alias("id"), "c_custkey", F.col("n_name").alias("nation"), F.lower("r_name").alias("country"), text.alias("text"), spans.alias("components"))


REC = """rec AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, n_name AS nation, lower(r_name) AS country, CAST(c_custkey AS VARCHAR) AS p1, c_mktsegment AS p2,
    CASE WHEN c_custkey % 3 = 0 THEN 'Unit ' || CAST(c_custkey % 100 AS VARCHAR) END AS p3, n_name AS p4, r_name AS p5,
    concat_ws(', ', CAST(c_custkey AS VARCHAR), c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'Unit ' || CAST(c_custkey % 100 AS VARCHAR) END, n_name, r_name) AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), span AS (
  SELECT id, pos, label, raw, CAST(start AS INTEGER) AS s, CAST(start + length(raw) AS INTEGER) AS e FROM (
    SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
      SELECT id, 1 AS pos, 'house_number' AS label, p1 AS raw FROM rec UNION ALL SELECT id, 2, 'road', p2 FROM rec UNION ALL SELECT id, 3, 'unit', p3 FROM rec WHERE p3 IS NOT NULL
      UNION ALL SELECT id, 4, 'city', p4 FROM rec UNION ALL SELECT id, 5, 'country', p5 FROM rec)))"""


def flagship(spark, sf_dir) -> DataFrame:
    """Records rendered, projected, hash-split and counted by split and field."""
    r = records(spark, sf_dir)
    r = r.select(X.hash_split(F.col("id")).alias("split"), F.size(X.tokens(F.col("text"))).alias("n"), F.explode(S.project(F.col("text"), F.col("components"))).alias("c"))
    return r.groupBy("split", F.col("c.label").alias("field")).agg(F.count("*").alias("spans"), F.sum("n").alias("row_tokens"))


# --- scalar functions -------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({ident('text')}) AS identity FROM documents")
def identity_key(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.digest(X.identity(F.col("text"))).alias("identity"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS text_key FROM documents")
def text_key(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.text_key(F.col("text")).alias("text_key"))


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in LETTERS)
# Marks in the wrong order, a ligature, long s, an ellipsis, a dotted capital, a square word, jamo, a iota below, a circled number.
ODD = {
    1: [("e", "ẹ́"), ("a", "Ä"), ("o", "ơ̂")],
    2: [("fi", "ﬁ"), ("s", "ſ"), (".", "…"), ("I", "İ"), ("m", "㌏")],
    3: [("t", "한"), ("n", "ͅ "), ("r", "①_")],
}


def nested(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def strict_sql() -> str:
    """Compatibility decompositions and case foldings as lists, composition by the engine's own NFC; word by word, as blanks join nothing."""
    compatible = {c: unicodedata.normalize("NFKD", c) for c in map(chr, compat.CODES) if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)}
    folds = {c: c.casefold() for c in map(chr, compat.CODES) if c.casefold() != c}
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    listed = lambda d: f"SELECT unnest([{quoted(d)}]) AS c, unnest([{quoted(d.values())}]) AS d"
    each = lambda source: f"SELECT w, string_agg(coalesce(d, c), '' ORDER BY i) AS f FROM (SELECT w, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT w, regexp_extract_all(f, '(?s).') AS x FROM {source})) LEFT JOIN"
    style = f"CASE doc_id % 5 WHEN 0 THEN text WHEN 4 THEN translate(text, '{LETTERS}', '{WIDE}') " + " ".join(f"WHEN {i} THEN {nested('text', x)}" for i, x in ODD.items()) + " END"
    return rf"""WITH compat AS ({listed(compatible)}), folds AS ({listed(folds)}),
styled AS (SELECT doc_id, row_number() OVER () AS n, string_split({style}, ' ') AS ws FROM documents),
words AS (SELECT n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM styled), single AS (SELECT DISTINCT w, w AS f FROM words),
spread AS ({each('single')} compat USING (c) GROUP BY w), whole AS (SELECT w, nfc_normalize(f) AS f FROM spread), done AS ({each('whole')} folds USING (c) GROUP BY w),
texts AS (SELECT n, string_agg(coalesce(f, ''), ' ' ORDER BY i) AS t FROM words LEFT JOIN done USING (w) GROUP BY n)
SELECT doc_id, sha256(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) AS identity, sha256(regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS key,
  sha256(trim(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))) AS canonical
FROM styled LEFT JOIN texts USING (n)"""


@query(strict_sql())
def strict_keys(spark, sf_dir):
    """Strict keys of every document, four fifths of them spelt in ways that only normalisation and full folding undo."""
    text, k = F.col("text"), F.col("doc_id") % 5
    style = F.when(k == 0, text).when(k == 4, F.translate(text, LETTERS, WIDE))
    for i, pairs in ODD.items():
        style = style.when(k == i, reduce(lambda v, p: F.replace(v, *map(F.lit, p)), pairs, text))
    f = F.col("f")
    keys = X.digest(compat.letters(f)).alias("identity"), X.digest(compat.letters(f, "_")).alias("key"), X.digest(compat.single_spaced(f)).alias("canonical")
    return dealt(t(spark, sf_dir, "documents"), "doc_id", rows=TEXTS).select("doc_id", compat.folded(style).alias("f")).select("doc_id", *keys)


@query("""SELECT doc_id, CASE WHEN b < 5 THEN 'dev' WHEN b < 10 THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, CAST(concat('0x', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS b FROM documents)""")
def hash_split(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.hash_split(F.col("doc_id").cast("string")).alias("split"))


@query(f"SELECT doc_id, len(k) AS n_tokens, sha256(array_to_string(k, chr(10))) AS tokens_sha FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS k FROM documents)")
def tokenize(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("n_tokens"), X.digest(F.array_join("k", "\n")).alias("tokens_sha"))


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{SCORER_SQL}')) AS token FROM documents) GROUP BY ALL")
def token_multiset(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.explode(X.scorer_tokens(F.col("text"))).alias("token"))
    return d.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '^[\p{Latin}\p{Common}\p{Inherited}\n]*$')")
def script_filter(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(X.is_latin(F.col("text"))).select("doc_id")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def url_host(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))


@query("""WITH s AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'TX' WHEN s_suppkey % 3 = 0 THEN 'NY' ELSE 'unknown' END AS state FROM s""")
def state_codes(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 2 == 0, "Texas").when(F.col("s_suppkey") % 3 == 0, "new  york").otherwise("Atlantis")
    return s.select("s_suppkey", X.state_code(name).alias("state"))


@query("""SELECT doc_id, CASE WHEN n >= 1000 THEN printf('%.1f kB', round(n / 1000.0, 1)) ELSE printf('%d B', n) END AS size
FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents)""")
def size_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.size_text(F.octet_length("text").cast("long")).alias("size"))


# --- spans ------------------------------------------------------------------------------------------


@query(f"WITH {REC} SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos, label, s AS start, e AS \"end\", raw FROM span JOIN rec USING (id)")
def render_records(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "text", F.posexplode("components").alias("pos", "c"))
    return r.select("id", "text", (F.col("pos") + 1).cast("long").alias("pos"), "c.label", "c.start", "c.end", "c.raw")


@query(f"WITH {REC}" + """, p AS (SELECT id, min(s) AS s, max(e) AS e, 'street_address' AS field FROM span WHERE label IN ('house_number', 'road', 'unit') GROUP BY id
  UNION ALL SELECT id, s, e, label FROM span WHERE label IN ('city', 'country'))
SELECT p.id, field, s AS start, e AS "end", substr(text, s + 1, e - s) AS raw FROM p JOIN rec USING (id)""")
def project_fields(spark, sf_dir):
    r = records(spark, sf_dir).select("id", F.explode(S.project(F.col("text"), F.col("components"))).alias("c"))
    return r.select("id", F.col("c.label").alias("field"), "c.start", "c.end", "c.raw")


@query(f"WITH {REC} SELECT id, c_custkey % 10 NOT IN (1, 2, 3) AS valid FROM rec")
def validate_spans(spark, sf_dir):
    r = records(spark, sf_dir)
    k, c = F.col("c_custkey") % 10, F.col("components")
    broken = F.when(k == 1, F.transform(c, lambda s: S.span(s["label"], s["start"] + 1, s["end"], s["raw"]))).when(k == 2, F.reverse(c)).when(k == 3, F.concat(c, F.slice(c, 1, 1))).otherwise(c)
    return r.select("id", S.valid(F.col("text"), broken).alias("valid"))


@query(f"WITH {REC} SELECT id, CASE WHEN p3 IS NOT NULL THEN 'building-unit-floor' ELSE 'number-and-road' END AS type FROM rec")
def address_types(spark, sf_dir):
    return records(spark, sf_dir).select("id", S.address_type(F.col("components")).alias("type"))


@query(f"""WITH {REC} SELECT id, sha256(country || '|' || {ident('p2')} || '|' || {ident('p4')}) AS group_key,
  sha256(country || '|' || {ident('p2')} || '|city|' || {ident('p4')}) AS street_key FROM rec""")
def group_keys(spark, sf_dir):
    r, c = records(spark, sf_dir), F.col("components")
    return r.select("id", S.group_key(F.col("country"), F.col("text"), c).alias("group_key"), F.get(S.street_keys(F.col("country"), c), 0).alias("street_key"))


@query(rf"""SELECT doc_id, len(k) AS tokens, CAST(len(list_filter(g, lambda x: regexp_matches(x, '[\r\n]'))) AS BIGINT) AS line_breaks, CAST(len(list_filter(g, lambda x: x <> '' AND NOT regexp_matches(x, '[\r\n]'))) AS BIGINT) AS spaces
FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS k, regexp_extract_all(text, '(\s*)({TOKEN_SQL})', 1) AS g FROM documents)""")
def gap_features(spark, sf_dir):
    """Of every document: long, empty and null texts too."""
    d = t(spark, sf_dir, "documents").select("doc_id", "text", S.token_spans(F.col("text")).alias("o"))
    d = d.select("doc_id", F.size("o").cast("long").alias("tokens"), S.gap_features(F.col("text"), F.col("o")).alias("g"))
    count = lambda v: F.size(F.filter("g", lambda x: x == v)).cast("long")
    return d.select("doc_id", "tokens", count("\n").alias("line_breaks"), count(" ").alias("spaces"))


@query(f"""WITH {REC}, k AS (SELECT id, label, s, e, raw FROM span)
SELECT id, field, start, "end" FROM (
  SELECT id, min(s) AS start, max(e) AS "end", 'street_address' AS field FROM k WHERE label IN ('house_number', 'road') GROUP BY id
  UNION ALL SELECT id, s, e, 'city' FROM k WHERE label = 'city')""")
def bio_to_spans(spark, sf_dir):
    """Tags of each token, made from the records' number, road and city spans, and read back as spans."""
    r = records(spark, sf_dir).withColumn("o", S.token_spans(F.col("text")))
    c = F.col("components")
    end = F.filter(c, lambda s: s["label"] == "road")[0]["end"]
    city = F.filter(c, lambda s: s["label"] == "city")[0]
    tag = F.transform("o", lambda o: F.when(o["start"] == 0, "B-street_address").when(o["end"] <= end, "I-street_address").when(o["start"] == city["start"], "B-city").when((o["start"] > city["start"]) & (o["end"] <= city["end"]), "I-city").otherwise("O"))
    s = r.withColumn("tags", tag).select("id", F.explode(S.bio_to_spans(F.col("text"), F.col("tags"), F.col("o"))).alias("c"))
    return s.select("id", F.col("c.label").alias("field"), "c.start", "c.end")


@query(f"WITH {REC} SELECT id, label, CAST(s + 1 AS INTEGER) + CASE WHEN pos > 1 THEN 1 ELSE 0 END AS start16 FROM (SELECT id, label, pos, s FROM span)")
def utf16_offsets(spark, sf_dir):
    """Records with a house sign before the text and one after the first part: offsets in UTF-16 units."""
    r = records(spark, sf_dir).withColumn("sign", F.concat(F.lit("🏠"), "text"))
    c = F.transform("components", lambda s, i: S.span(s["label"], s["start"] + 1, s["end"] + 1, s["raw"]))
    out = r.select("id", F.posexplode(S.utf16(F.col("sign"), c)).alias("pos", "c"))
    return out.select("id", "c.label", (F.col("c.start") - F.when(F.col("pos") > 0, 0).otherwise(1)).cast("int").alias("start16"))


# --- record layouts and labels ----------------------------------------------------------------------


@query("""SELECT 'city-' || k AS id, concat_ws(', ', concat_ws(' ', n, d, seg), z) AS text, CASE WHEN n IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN z IS NULL THEN 0 ELSE 1 END AS spans,
  CASE WHEN z IS NOT NULL THEN length(concat_ws(' ', n, d, seg)) + 2 END AS code_at FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 500 AS VARCHAR) END AS n, CASE WHEN c_custkey % 2 = 0 THEN 'N' END AS d, c_mktsegment AS seg,
    CASE WHEN c_custkey % 7 <> 0 THEN lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS z FROM customer)""")
def city_points(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select(
        k.alias("ADDRESSPOINTID"), F.when(k % 11 != 0, k % 500).alias("HOUSE_NUMBER"), F.when(k % 2 == 0, " N ").alias("PRE_DIRECTIONAL"), F.col("c_mktsegment").alias("STREET_NAME"),
        F.lit(None).cast("string").alias("POST_TYPE"), F.when(k % 7 != 0, F.lpad((k % 100000).cast("string"), 5, "0")).alias("ZIPCODE"),
    )
    m = mappers.city_points(c)
    code = F.try_element_at(F.filter("components", lambda x: x["label"] == "postcode"), F.lit(1))
    return m.select("id", "text", F.size("components").alias("spans"), code["start"].alias("code_at"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 90 AS VARCHAR) || CASE WHEN c_custkey % 4 = 0 THEN ' B' ELSE '' END || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ' ' || c_mktsegment END
  || CASE WHEN c_custkey % 3 = 0 THEN ' Apt 1' ELSE '' END || ' ' || n_name || ' ' || CASE WHEN c_custkey % 5 = 0 THEN 'OK' ELSE 'TX' END AS text,
  CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN 'invalid' END AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def state_points(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    c = c.select(
        k.alias("id"), (k % 90).alias("Add_Number"), F.when(k % 4 == 0, "B").alias("AddNum_Suf"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("St_Name"), F.when(k % 3 == 0, "Apt  1").alias("Unit"),
        F.col("n_name").alias("Post_Comm"), F.when(k % 5 == 0, "OK").otherwise("TX").alias("State"), F.lit("").alias("Post_Code"),
    )
    return mappers.state_points(c).select("id", "text", "reason")


@query("""SELECT 'GA' || c_custkey AS id, concat_ws(' ', CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 90 AS VARCHAR) WHEN c_custkey % 3 = 0 THEN 'LOT A' || (c_custkey % 7) END, c_mktsegment || ' ST', n_name, 'NSW', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) AS text,
  CASE WHEN c_custkey % 17 = 0 THEN 'retired-or-alias' END AS reason, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 = 0 THEN 'lot_number,lot_number_prefix' ELSE '' END AS omitted, 'street ' || c_nationkey AS street
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def geocoded_points(spark, sf_dir):
    """Customers as geocoded national records; a lot beside a number is left out and reported."""
    c = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    lot = lambda x: F.when(k % 3 == 0, x)
    g = c.select(
        F.concat(F.lit("GA"), k).alias("address_detail_pid"), F.when(k % 17 == 0, -1).otherwise(1).alias("confidence"), F.lit("P").alias("alias_principal"), F.when(k % 5 > 0, k % 90).alias("number_first"),
        lot(k % 7).alias("lot_number"), lot(F.lit("A")).alias("lot_number_prefix"), none.alias("building_name"), none.alias("flat_type"), none.alias("level_type"), F.col("c_mktsegment").alias("street_name"),
        F.lit("ST").alias("street_type_code"), none.alias("street_suffix_type"), F.col("n_name").alias("locality_name"), F.lit("NSW").alias("state_abbreviation"), (k % 10000).alias("postcode"), F.concat(F.lit("street "), "c_nationkey").alias("street_locality_pid"),
    )
    return readers.geocoded_file(g).select("id", "text", "reason", F.array_join("omitted_source_fields", ",").alias("omitted"), F.col("source_street_group").alias("street"))


@query("""SELECT 'fdic:' || s_suppkey AS id, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' Floor 2' ELSE '' END || ', ' || n_name || ', ' || CASE WHEN s_suppkey % 6 = 0 THEN 'PR' ELSE 'VT' END || ', 05401' AS text,
  CASE WHEN s_suppkey % 6 = 0 THEN 'PR' ELSE 'VT' END AS stratum, CASE WHEN s_suppkey % 6 = 0 THEN 'US_territory_or_foreign' END AS reason FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'gias:' || s_suppkey, s_name || ', ' || n_name || ', LS1 1AA', CASE WHEN s_suppkey % 4 = 0 THEN 'Wales' ELSE 'North West' END,
  CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 THEN 'England_closed_or_no_region' WHEN s_suppkey % 7 = 0 THEN 'England_additional_address_lines' END FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'libraries-ni:' || s_suppkey, s_suppkey % 30 || ' ' || s_name || ', ' || n_name || ', BT1 1AA', 'Northern Ireland', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def public_registers(spark, sf_dir):
    k = F.col("s_suppkey")
    c = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    bank = c.select(k.alias("UNINUM"), F.col("s_name").alias("ADDRESS"), F.when(k % 3 == 0, " Floor 2 ").alias("ADDRESS2"), F.col("n_name").alias("CITY"), F.when(k % 6 == 0, "PR").otherwise("VT").alias("STALP"), F.lit("05401").alias("ZIP"))
    school = c.select(
        k.alias("URN"), F.col("s_name").alias("Street"), F.col("n_name").alias("Town"), F.lit("LS1 1AA").alias("Postcode"), F.when(k % 7 == 0, "The Green").alias("Locality"), F.lit(None).cast("string").alias("Address3"),
        F.when(k % 5 == 0, "Closed").otherwise("Open").alias("EstablishmentStatus (name)"), F.when(k % 4 == 0, "Wales").otherwise("North West").alias("GOR (name)"),
    )
    library = c.select(k.alias("_id"), (k % 30).alias("Number"), F.col("s_name").alias("Street"), F.col("n_name").alias("Town"), F.lit("BT1 1AA").alias("Postcode"))
    out = mappers.bank_branches(bank).union(mappers.schools(school)).union(mappers.libraries(library))
    return out.select("id", "text", "stratum", "reason")


@query("""SELECT 'ch:' || k AS id, concat_ws(', ', CASE WHEN k % 9 = 0 THEN 'PO Box ' || k END, l, CASE WHEN k % 8 = 0 THEN l END, town, 'Kent', code) AS text, CASE WHEN k % 6 = 3 THEN NULL WHEN k % 6 = 1 THEN 'Scotland' WHEN k % 6 = 2 THEN 'Wales' WHEN k % 6 = 4 THEN 'Northern Ireland' ELSE 'England' END AS stratum,
  CASE WHEN l = '' THEN 'missing_core_field' WHEN k % 6 = 3 THEN 'cross_border_postcode_area' WHEN k % 10 = 7 THEN 'CH_default_registration_address' WHEN k % 6 = 5 THEN 'CH_invalid_postcode' WHEN k % 11 = 0 THEN 'CH_county_in_town_field' WHEN k % 8 = 0 THEN 'CH_duplicate_address_line_or_town' WHEN k % 14 = 0 THEN 'CH_postcode_in_address_line' END AS reason
FROM (SELECT *, CASE WHEN k % 17 = 0 THEN '' WHEN k % 14 = 0 THEN name || ' ' || code ELSE name END AS l FROM (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 7 THEN 'Companies House Default Address' ELSE s_name END AS name, CASE WHEN s_suppkey % 11 = 0 THEN 'Co. Down' ELSE n_name END AS town,
    CASE s_suppkey % 6 WHEN 0 THEN 'ME1 2AB' WHEN 1 THEN 'eh1 1yz' WHEN 2 THEN 'CF10 1AA' WHEN 3 THEN 'SY1 1AA' WHEN 4 THEN 'BT7 3XY' ELSE 'E1' END AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)) WHERE l <> ''
UNION ALL SELECT 'ch:' || s_suppkey, concat_ws(', ', CASE WHEN s_suppkey % 9 = 0 THEN 'PO Box ' || s_suppkey END, CASE WHEN s_suppkey % 11 = 0 THEN 'Co. Down' ELSE n_name END, 'Kent', CASE s_suppkey % 6 WHEN 0 THEN 'ME1 2AB' WHEN 1 THEN 'eh1 1yz' WHEN 2 THEN 'CF10 1AA' WHEN 3 THEN 'SY1 1AA' WHEN 4 THEN 'BT7 3XY' ELSE 'E1' END),
  CASE WHEN s_suppkey % 6 = 3 THEN NULL WHEN s_suppkey % 6 = 1 THEN 'Scotland' WHEN s_suppkey % 6 = 2 THEN 'Wales' WHEN s_suppkey % 6 = 4 THEN 'Northern Ireland' ELSE 'England' END, 'missing_core_field' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 17 = 0""")
def registered_offices(spark, sf_dir):
    """Every reason occurs: suppliers stand for companies."""
    k = F.col("s_suppkey")
    codes = F.array(*[F.lit(x) for x in ("ME1 2AB", "eh1 1yz", "CF10 1AA", "SY1 1AA", "BT7 3XY", "E1")])
    c = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    c = c.withColumn("code", F.get(codes, (k % 6).cast("int"))).withColumn("name", F.when(k % 10 == 7, "Companies House Default Address").otherwise(F.col("s_name")))
    c = c.withColumn("line", F.when(k % 17 == 0, "").when(k % 14 == 0, F.concat_ws(" ", "name", "code")).otherwise(F.col("name")))
    c = c.select(
        k.alias("CompanyNumber"), F.when(k % 9 == 0, F.concat(F.lit("PO Box "), k)).alias("RegAddress.POBox"), F.col("line").alias("RegAddress.AddressLine1"),
        F.when((k % 8 == 0) & (F.col("line") != ""), F.col("line")).alias("RegAddress.AddressLine2"), F.when(k % 11 == 0, "Co. Down").otherwise(F.col("n_name")).alias("RegAddress.PostTown"),
        F.lit("Kent").alias("RegAddress.County"), F.col("code").alias("RegAddress.PostCode"),
    )
    return mappers.companies(c, county=True).select("id", "text", "stratum", "reason")


LABELS = "StreetNumber StreetName Unit Municipality PostalCode PlaceName StateName ZipCode ZipPlus4 CountryName NotAddress Recipient USPSBoxID suburb state_district island country_region near city locality district".split()


@query("""WITH l AS (SELECT DISTINCT p_size % 21 AS k FROM part), n AS (SELECT k, ['StreetNumber', 'StreetName', 'Unit', 'Municipality', 'PostalCode', 'PlaceName', 'StateName', 'ZipCode', 'ZipPlus4', 'CountryName', 'NotAddress', 'Recipient', 'USPSBoxID',
  'suburb', 'state_district', 'island', 'country_region', 'near', 'city', 'locality', 'district'][k + 1] AS label FROM l)
SELECT label, CASE label WHEN 'StreetNumber' THEN 'house_number' WHEN 'StreetName' THEN 'road' WHEN 'Unit' THEN 'unit' WHEN 'Municipality' THEN 'city' WHEN 'PostalCode' THEN 'postcode' END AS neural,
  CASE label WHEN 'PlaceName' THEN 'city' WHEN 'StateName' THEN 'state' WHEN 'ZipCode' THEN 'postcode' WHEN 'ZipPlus4' THEN 'postcode' WHEN 'CountryName' THEN 'country' WHEN 'NotAddress' THEN 'unrecognized' ELSE 'street_address' END AS tagger,
  CASE label WHEN 'PlaceName' THEN 'city' WHEN 'StateName' THEN 'state' WHEN 'ZipCode' THEN 'postcode' WHEN 'StreetName' THEN 'street_address' WHEN 'USPSBoxID' THEN 'street_address' END AS tagged_file,
  CASE WHEN label IN ('suburb', 'island') THEN 'locality' WHEN label = 'state_district' THEN 'district' WHEN label = 'country_region' THEN 'state' WHEN label = 'near' THEN 'street_address' ELSE label END AS audited,
  CASE label WHEN 'locality' THEN 'street_address' WHEN 'district' THEN 'state' ELSE label END AS coarse FROM n""")
def label_maps(spark, sf_dir):
    n = t(spark, sf_dir, "part").select((F.col("p_size") % 21).cast("int").alias("k")).distinct().select(F.get(F.array(*map(F.lit, LABELS)), F.col("k")).alias("label"))
    x = F.col("label")
    return n.select("label", L.neural(x).alias("neural"), L.tagger(x).alias("tagger"), L.tagged_file(x).alias("tagged_file"), L.audited(x).alias("audited"), L.four_fields(x).alias("coarse"))


@query(f"""WITH {REC} SELECT id, CASE WHEN c_custkey % 9 = 0 THEN 'level' WHEN p3 IS NOT NULL THEN 'unit' END AS label, CASE WHEN c_custkey % 9 = 0 AND c_custkey % 2 = 0 THEN 'mixed-floor-unit' WHEN p4 = 'NATION_2' THEN 'blocked-component' END AS reason FROM rec""")
def unit_policy(spark, sf_dir):
    """Units that name a floor: every ninth record's, mixed for every other one of these."""
    k, r = F.col("c_custkey"), records(spark, sf_dir)
    raw = lambda s: F.when((s["label"] == "unit") & (k % 9 == 0), F.when(k % 2 == 0, "Floor 3 Unit 1").otherwise("3rd floor")).otherwise(s["raw"])
    spans = F.transform("components", lambda s: S.span(s["label"], s["start"], s["end"], raw(s)))
    out, reason = L.relabelled(spans, r"(?i)\bfloor\b", r"(?i:(?:\d+\w* floor|floor \d+))", [("city", "^NATION_2$")])
    part = F.try_element_at(F.filter(out, lambda s: s["label"].isin("unit", "level")), F.lit(1))
    return r.select("id", part["label"].alias("label"), reason.alias("reason"))


@query(f"""WITH {REC}, x AS (SELECT *, c_custkey % 6 AS m FROM rec)
SELECT id, m IN (0, 1, 3) AS english, m < 2 AS district, CASE WHEN p3 IS NOT NULL AND m <> 4 THEN 0 WHEN m = 4 THEN 2 ELSE 3 END AS kind, m <> 4 AND p3 IS NULL AS exact_fields, FALSE AS unsafe, m <> 5 AS natural FROM x
UNION ALL SELECT id || ':city', m IN (0, 1, 3), m < 2, 4, FALSE, TRUE, m <> 5 FROM x""")
def row_predicates(spark, sf_dir):
    """Of each record, and of its city and country alone."""
    m, r = F.col("c_custkey") % 6, records(spark, sf_dir)
    spans = F.when(m == 4, F.filter("components", lambda s: ~s["label"].isin("house_number", "unit"))).otherwise(F.col("components"))
    few = F.filter("components", lambda s: s["label"].isin("city", "country"))
    r = r.select(m.alias("m"), F.explode(F.array(F.struct(F.col("id"), spans.alias("c")), F.struct(F.concat("id", F.lit(":city")).alias("id"), few.alias("c")))).alias("x")).select("m", "x.*")
    language = F.when(F.col("m") == 0, "EN").when(F.col("m") == 1, "eng").when(F.col("m") == 2, "de")
    made = F.when(F.col("m") == 3, "generated-from-fields").otherwise("tagged")
    text = F.when(F.col("m") == 5, "1234").otherwise("12 x")
    tags = F.when(F.col("m") < 2, F.array(F.lit("Unit"), F.lit("District"))).when(F.col("m") < 4, F.array(F.lit("Unit")))
    projected = F.transform("c", lambda s: S.span(S.field_of(s["label"]), s["start"], s["end"], s["raw"]))
    return r.select(
        "id", L.is_english(language, made).alias("english"), L.has_tag(tags).alias("district"), L.kind(F.col("c")).alias("kind"), L.has_exactly(F.col("c"), ["house_number", "road"], ["city", "country"], F.col("m") >= 0).alias("exact_fields"),
        L.is_unsafe_partial(L.kind(F.col("c")), projected).alias("unsafe"), L.is_natural(text).alias("natural"),
    )


@query(f"""WITH {REC}, k AS (SELECT id, country, {ident('p2')} AS road, {ident('p4')} AS city, {loose('p1')} || {loose('p2')} || coalesce({loose('p3')}, '') AS street, {loose('p4')} AS town FROM rec)
SELECT id, list_sort([sha256(country || '|' || road || '|city|' || city), sha256(country || '|entity|' || road || '|' || city)]) AS aliases, country || '/' || street || '/city/' || town AS entity FROM k""")
def protection_keys(spark, sf_dir):
    r, c = records(spark, sf_dir), F.col("components")
    e = F.get(L.entity_keys(F.col("country"), c), 0)
    return r.select("id", L.alias_keys(F.col("country"), c).alias("aliases"), F.concat_ws("/", e["country"], e["street"], e["field"], e["value"]).alias("entity"))


# --- keys, conflicts, protection --------------------------------------------------------------------


@query(f"SELECT loose, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT sha256({ident('text')}) AS loose, text FROM documents) GROUP BY loose HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(X.digest(X.identity(F.col("text"))).alias("loose"), X.digest(F.col("text")).alias("text"))
    return d.groupBy("loose").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).where("n > 1")


@query(f"SELECT loose, count(DISTINCT source) AS signatures, count(*) AS rows FROM (SELECT sha256({ident('text')}) AS loose, source FROM documents) GROUP BY loose HAVING count(DISTINCT source) > 1")
def conflicting_keys(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(X.digest(X.identity(F.col("text"))).alias("loose"), "source")
    return protect.conflicting(d, "loose", "source")


def shingles8(df: DataFrame, id: str) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    d = df.select(id, w.alias("w")).where(F.size("w") >= 8)
    return d.select(id, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " ")))).alias("s"))


SHINGLE_SQL = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w)),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT w, unnest(generate_series(1, len(w) - 7)) AS i FROM bw)),
hit AS (SELECT DISTINCT doc_id FROM ds SEMI JOIN bs USING (s))"""


@query(f"WITH {SHINGLE_SQL} SELECT doc_id FROM documents ANTI JOIN hit USING (doc_id)")
def protected_exclusion(spark, sf_dir):
    d, b = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    hit = shingles8(d, "doc_id").join(shingles8(b, "item_id").select("s").distinct(), "s", "left_semi").select("doc_id").distinct()
    return protect.without(d.select("doc_id"), hit, ["doc_id"])


@query(f"""WITH {SHINGLE_SQL}, k AS (SELECT doc_id, source, sha256({ident('text')}) AS loose FROM documents),
c AS (SELECT loose FROM k GROUP BY loose HAVING count(DISTINCT source) > 1)
SELECT coalesce(CASE WHEN hit.doc_id IS NOT NULL THEN 'protected' WHEN c.loose IS NOT NULL THEN 'conflict' END, 'kept') AS reason, count(*) AS rows
FROM k LEFT JOIN hit USING (doc_id) LEFT JOIN c USING (loose) GROUP BY 1""")
def consolidate_reasons(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    hit = shingles8(d, "doc_id").join(shingles8(t(spark, sf_dir, "benchmark"), "item_id").select("s").distinct(), "s", "left_semi").select("doc_id").distinct().withColumn("hit", F.lit(True))
    k = d.select("doc_id", "source", X.digest(X.identity(F.col("text"))).alias("loose"))
    c = protect.conflicting(k, "loose", "source").select("loose", F.lit(True).alias("bad"))
    r = k.join(hit, "doc_id", "left").join(c, "loose", "left")
    return r.groupBy(F.coalesce(corpus.first_reason(("protected", F.col("hit")), ("conflict", F.col("bad"))), F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query(f"""WITH {REC}, r AS (SELECT c_custkey AS id, {ident('text')} AS loose, p2 || '|' || p4 AS m, text, CAST(c_custkey % 5 AS VARCHAR) AS sig FROM rec)
SELECT id, CASE WHEN max(id <= 20) OVER (PARTITION BY m) THEN 'protected' WHEN cm > 1 THEN 'model-input-conflict' END AS reason
FROM r JOIN (SELECT m, count(DISTINCT sig) AS cm FROM r GROUP BY m) USING (m)""")
def consolidate(spark, sf_dir):
    """The whole precedence: the first 20 records are protected, model inputs are road and city."""
    r = records(spark, sf_dir)
    part = lambda n: S.joined(F.col("components"), n)
    rows = r.select(F.col("c_custkey").alias("id"), "text", X.identity(F.col("text")).alias("loose"), F.concat_ws("|", part("road"), part("city")).alias("model_input"), (F.col("c_custkey") % 5).cast("string").alias("signature"), F.array().cast("array<string>").alias("street_keys"))
    guarded = rows.where("id <= 20").select("loose", "street_keys")
    return corpus.consolidate(rows, guarded).select("id", "reason")


@query(f"""WITH k AS (SELECT doc_id, sha256({ident('text')}) AS loose, doc_id % 50 = 0 AS flag FROM documents)
SELECT doc_id, max(flag) OVER (PARTITION BY loose) AS flag FROM k""")
def propagate_protection(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", X.digest(X.identity(F.col("text"))).alias("loose"), (F.col("doc_id") % 50 == 0).alias("flag"))
    return protect.propagate(d, "loose", "flag").select("doc_id", "flag")


@query(f"""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN sha256({ident('text')}) END AS loose, CASE WHEN doc_id % 7 > 0 THEN doc_id % 50 = 1 END AS flag FROM documents)
SELECT doc_id, coalesce(CASE WHEN loose IS NULL THEN flag ELSE max(flag) OVER (PARTITION BY loose) END, FALSE) AS flag FROM k""")
def propagate_without_keys(spark, sf_dir):
    """A third of the rows have no key, a seventh no flag."""
    key = F.when(F.col("doc_id") % 3 > 0, X.digest(X.identity(F.col("text"))))
    d = t(spark, sf_dir, "documents").select("doc_id", key.alias("loose"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 50 == 1).alias("flag"))
    return protect.propagate(d, "loose", "flag").select("doc_id", "flag")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 11 > 0 THEN 'part ' || l_partkey || ' ' || l_linenumber END AS text, CAST(l_orderkey AS VARCHAR) AS loose,
  CASE WHEN l_suppkey % 13 > 0 THEN 'supplier ' || l_suppkey || l_shipdate END AS m, CASE WHEN l_quantity > 2 THEN l_returnflag END AS sign, CAST(l_suppkey AS VARCHAR) || l_returnflag || l_linestatus AS street FROM lineitem),
u AS (SELECT *, coalesce('=' || text, '#' || id) AS unit, coalesce('=' || sign, '') AS s, id % 97 = 0 OR street IN (SELECT street FROM (SELECT street FROM r WHERE id % 9973 = 0)) AS own FROM r),
p AS (SELECT *, max(own) OVER (PARTITION BY unit) AS hit FROM u), q AS (
  SELECT id, CASE WHEN m IS NULL THEN hit ELSE max(hit) OVER (PARTITION BY m) END AS hit, CASE WHEN text IS NOT NULL THEN min(s) OVER (PARTITION BY text) <> max(s) OVER (PARTITION BY text) END AS exact,
    CASE WHEN m IS NOT NULL THEN min(s) OVER (PARTITION BY m) <> max(s) OVER (PARTITION BY m) END AS model, CASE WHEN text IS NOT NULL THEN min(id) OVER (PARTITION BY text, s) END AS first FROM p)
SELECT id, CASE WHEN hit THEN 'protected' WHEN exact THEN 'exact-label-conflict' WHEN model THEN 'model-input-conflict' WHEN id <> first THEN 'duplicate' END AS reason FROM q""")
def consolidate_nulls(spark, sf_dir):
    """Every reason by itself, over all lines; some lack a text, a model input or a signature."""
    some = lambda c, x: F.when(c, x)
    r = t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), some(F.col("l_partkey") % 11 > 0, F.concat_ws(" ", F.lit("part"), "l_partkey", "l_linenumber")).alias("text"),
        F.col("l_orderkey").cast("string").alias("order"), some(F.col("l_suppkey") % 13 > 0, F.concat(F.lit("supplier "), "l_suppkey", "l_shipdate")).alias("model_input"),
        some(F.col("l_quantity") > 2, F.col("l_returnflag")).alias("signature"), F.array(F.concat("l_suppkey", "l_returnflag", "l_linestatus")).alias("street_keys"),
    )
    r = r.withColumn("loose", F.when(F.col("id") % 97 == 0, F.lit("guarded")).otherwise(F.col("order")))
    guarded = r.where("id % 9973 = 0").select(F.lit("guarded").alias("loose"), "street_keys").union(spark.createDataFrame([("guarded", [])], "loose string, street_keys array<string>"))
    return corpus.consolidate(r.drop("order"), guarded).select("id", "reason")


@query(f"WITH k AS (SELECT doc_id, sha256({ident('text')}) AS loose FROM documents) SELECT loose, min(doc_id) AS doc_id FROM k GROUP BY loose")
def first_admission(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", X.digest(X.identity(F.col("text"))).alias("loose"))
    return protect.first_wins(d, ["loose"], ["doc_id"]).select("loose", "doc_id")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3""")
def matching_any_key(spark, sf_dir):
    """Ids that match on either of two keys: a union of semi joins."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
    c = t(spark, sf_dir, "customer")
    low = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    seg = spark.createDataFrame([("BUILDING", 3)], "c_mktsegment string, c_nationkey int")
    keys = low.withColumns({"c_mktsegment": F.lit(None).cast("string"), "c_nationkey": F.lit(None).cast("int")}).unionByName(seg.withColumn("o_custkey", F.lit(None).cast("long")))
    return protect.matching(o, keys, "o_orderkey", ["o_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey + 1000000000 IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def key_set_overlap(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.col("l_partkey"), F.col("l_suppkey") + 1000000000).alias("keys"))
    bad = t(spark, sf_dir, "part").where("p_size = 1").select(F.array("p_partkey").alias("keys"))
    return protect.overlapping(rows, bad, "l_orderkey", "keys")


@query("""SELECT o_orderkey AS id, list_sort(list_distinct(list(s))) AS splits FROM (
  SELECT o_orderkey, CASE WHEN l_suppkey % 3 = 0 THEN 'dev' WHEN l_suppkey % 3 = 1 THEN 'test' ELSE 'train' END AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def alias_splits(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("aliases")).join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    k = F.col("s_suppkey") % 3
    known = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("alias"), F.when(k == 0, "dev").when(k == 1, "test").otherwise("train").alias("split"))
    return protect.alias_splits(rows, known)


@query("""SELECT o_orderkey AS id, o_custkey AS key, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0""")
def entity_enrichment(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("text"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.lit("even").alias("text"))
    raw = o.select("key", "id").join(c, "key")
    return protect.enrich(o, raw, "key").select("id", "key", "c_name")


@query("""SELECT n_name AS country, coalesce(c.n, 0) AS files, CAST(coalesce(c.b, 0) AS BIGINT) AS bytes, coalesce(s.n, 0) AS audited FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n, sum(strlen(c_name)) AS b FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def coverage(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    names = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country"))
    files = t(spark, sf_dir, "customer").join(F.broadcast(names), F.col("c_nationkey") == F.col("k")).select("country", F.octet_length("c_name").cast("long").alias("bytes"))
    reports = t(spark, sf_dir, "supplier").join(F.broadcast(names), F.col("s_nationkey") == F.col("k")).select("country", F.lit(1).cast("long").alias("rows"))
    return corpus.coverage(names.select("country"), files, reports)


@query(f"""WITH {REC}, x AS (SELECT id, CASE c_custkey % 10 WHEN 1 THEN 'invalid-spans' WHEN 2 THEN 'replacement-character' WHEN 3 THEN 'missing-text' WHEN 4 THEN 'non-latin' WHEN 5 THEN 'known-geographic-contamination:Pasir-Gudang-is-in-Johor'
  WHEN 6 THEN 'placeholder-road' WHEN 7 THEN 'unsupported' ELSE 'ok' END AS reason, CASE WHEN p3 IS NOT NULL THEN 'building-unit-floor' ELSE 'number-and-road' END AS type FROM rec) SELECT reason, type, count(*) AS n FROM x GROUP BY ALL""")
def audit_reasons(spark, sf_dir):
    """Each of ten records breaks one rule, the contaminated ones that of the placeholder road too."""
    r, k = records(spark, sf_dir), F.col("c_custkey") % 10
    text = F.when(k == 1, F.concat(F.lit("x"), "text")).when(k == 2, F.concat("text", F.lit("�"))).when(k == 3, F.lit(" ")).when(k == 4, F.concat("text", F.lit(" Москва"))).when(k == 5, F.concat("text", F.lit(" Pasir Gudang"))).when(k == 7, F.concat("text", F.lit("y" * 65)))
    r = r.withColumn("text", F.coalesce(text, "text")).withColumn("country", F.when(k == 5, "sg").otherwise(F.col("country")))
    named = lambda c: F.transform(c, lambda s: F.struct(s["label"].alias("label"), F.when(s["label"] == "road", "unknown").otherwise(s["raw"]).alias("raw")))
    t2, s2 = S.render(named(F.col("components")), ", ")
    twist = k.isin(5, 6)
    r = r.withColumn("t2", t2).withColumn("s2", s2).withColumn("text", F.when(twist, F.concat("t2", F.when(k == 5, F.lit(" Pasir Gudang")).otherwise(""))).otherwise(F.col("text"))).withColumn("components", F.when(twist, F.col("s2")).otherwise(F.col("components")))
    a = corpus.audit(r.select("id", "text", "components", "country"))
    return a.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), "type").agg(F.count("*").alias("n"))


@query(f"""WITH {REC}, x AS (SELECT p2 || ' ' || CASE WHEN c_custkey % 2 = 0 THEN p4 ELSE lower(p4) END AS text, p2, lower(p4) AS c, CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS sig FROM rec),
b AS (SELECT text, count(*) AS n, count(DISTINCT sig) AS sigs, {ident('min(text)')} AS loose FROM x GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS texts, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (sigs > 1) AS conflicting,
  (SELECT count(*) FROM (SELECT loose FROM b GROUP BY loose HAVING count(*) > 1)) AS loose_collisions FROM b""")
def audit_summary(spark, sf_dir):
    r = records(spark, sf_dir)
    part = lambda n: F.filter("components", lambda s: s["label"] == n)[0]["raw"]
    city = F.when(F.col("c_custkey") % 2 == 0, part("city")).otherwise(F.lower(part("city")))
    kind = F.when(F.col("c_custkey") % 50 == 0, "road").otherwise("house")
    text, _ = S.render(S.parts(("road", part("road")), ("city", city)))
    spans = F.array(S.span(kind, F.lit(0), F.length(part("road")), part("road")))
    return corpus.summary(r.select(text.alias("text"), spans.alias("components")))


# --- whole corpora and reports ----------------------------------------------------------------------


@query(f"""WITH {REC}, r AS (SELECT *, c_custkey % 12 AS m, CASE WHEN c_custkey % 12 = 6 THEN text || repeat('y', 65) ELSE text END AS x, concat_ws('|', country, {ident('p2')}, {ident('p4')}) AS street FROM rec),
s AS (SELECT DISTINCT street FROM r WHERE c_custkey < 5)
SELECT CASE WHEN m = 1 THEN 'other-country' WHEN m = 2 THEN 'not-english' WHEN (street IN (FROM s) AND NOT (twin AND m IN (3, 4))) OR c_custkey < 5 OR c_custkey BETWEEN 40 AND 59 THEN 'protected' WHEN m = 6 THEN 'unrepresentable' WHEN m IN (3, 4) AND street NOT IN (FROM s) THEN 'label-conflict' WHEN twin AND m = 5 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS rows
FROM (SELECT r.*, FALSE AS twin FROM r UNION ALL SELECT r.*, TRUE FROM r WHERE m IN (3, 4, 5)) GROUP BY 1""")
def national_corpus(spark, sf_dir):
    """Records, some of them twice: with another label of the road, or as they are."""
    r, m = records(spark, sf_dir), F.col("c_custkey") % 12
    r = r.withColumn("text", F.when(m == 6, F.concat("text", F.lit("y" * 65))).otherwise(F.col("text"))).withColumns({"language": F.when(m == 2, "de").when(m == 7, "EN"), "provenance": F.lit("generated-from-fields")})
    other = F.transform("components", lambda s: S.span(F.when((s["label"] == "city") & m.isin(3, 4), "state").otherwise(s["label"]), s["start"], s["end"], s["raw"]))
    again = r.where(m.isin(3, 4, 5)).withColumn("components", other).withColumn("id", F.concat("id", F.lit("-again")))
    land = F.when(m == 1, "zz").otherwise(F.upper("country"))
    both = r.unionByName(again)
    rows = both.withColumn("country", land)
    guarded = r.where("c_custkey < 5").select("text", "country", "components").union(r.where("c_custkey between 40 and 59").select("text", F.lit("none").alias("country"), "components"))
    lands = [x.r for x in t(spark, sf_dir, "region").select(F.lower("r_name").alias("r")).collect()]  # five
    out = corpora.national_corpus(rows, guarded, lands, "seed")
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query(f"""WITH {REC}, g AS (SELECT *, c_custkey % 10 AS m, sha256(country || '|' || {ident('p2')} || '|' || {ident('p4')}) AS grp FROM rec),
h AS (SELECT DISTINCT grp FROM g WHERE p4 = 'NATION_3'), k AS (
  SELECT id, m, grp, 0 AS copy FROM g UNION ALL SELECT id, m, grp, 1 FROM g WHERE m IN (4, 5))
SELECT CASE WHEN m = 1 THEN 'unrepresentable' WHEN m = 2 THEN 'existing-or-protected' WHEN grp IN (FROM h) THEN 'heldout-group' WHEN m = 4 THEN 'label-conflict' WHEN m = 5 THEN 'twice' ELSE 'kept' END AS reason, count(*) AS rows FROM k GROUP BY 1""")
def expansion(spark, sf_dir):
    """Candidates against a corpus that holds one nation's streets out; of two equal rows one is a duplicate ('twice' counts both)."""
    r, m = records(spark, sf_dir), F.col("c_custkey") % 10
    r = r.withColumn("text", F.when(m == 1, F.concat("text", F.lit("y" * 65))).otherwise(F.col("text")))
    other = F.transform("components", lambda s: S.span(F.when((s["label"] == "unit") | ((s["label"] == "house_number") & (m == 4)), "house").otherwise(s["label"]), s["start"], s["end"], s["raw"]))
    kind = F.transform("components", lambda s: S.span(F.when((s["label"] == "country") & (m == 4), "state").otherwise(s["label"]), s["start"], s["end"], s["raw"]))
    again = r.where(m.isin(4, 5)).withColumn("components", kind).withColumn("id", F.concat("id", F.lit("-again")))
    c = F.col("components")
    known = r.where("nation = 'NATION_3'").select(S.group_key(F.col("country"), F.col("text"), c).alias("alias")).distinct().withColumn("split", F.lit("test"))
    out = corpora.expansion(r.unionByName(again).select("id", "text", "country", "components"), known, r.where(m == 2).select("text"), "seed")
    five = F.substring_index("id", "-", 1).cast("long") % 10 == 5
    reason = F.when(five & (F.col("reason").isNull() | (F.col("reason") == "duplicate")), "twice").otherwise(F.coalesce("reason", F.lit("kept")))
    return out.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


@query(f"""WITH {REC}, c AS (SELECT id, p2 AS source, country, c_custkey AS k, sha256(concat_ws('|', country, {ident('p2')}, {ident('p4')})) AS grp FROM rec),
every AS (SELECT * FROM c UNION ALL SELECT id || 'd', source, country, k, grp FROM c WHERE k % 13 = 0 UNION ALL SELECT id || 'x', source, country, k, grp FROM c WHERE k % 17 = 0),
judged AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'conflicting-candidate-labels' WHEN k % 50 = 0 THEN 'existing-training-duplicate' WHEN grp IN (SELECT grp FROM c WHERE k % 501 = 7) THEN 'protected-evaluation-overlap' END AS r0 FROM every),
once AS (SELECT *, coalesce(r0, CASE WHEN sha256(id) > min(sha256(id)) FILTER (r0 IS NULL) OVER (PARTITION BY k) THEN 'new-source-duplicate' END) AS r1 FROM judged),
capped AS (SELECT *, coalesce(r1, CASE WHEN row_number() OVER (PARTITION BY source, country, r1 IS NULL ORDER BY sha256(id)) > 30 THEN 'mixture-or-street-cap' END) AS reason FROM once)
SELECT id, CASE WHEN reason IS NULL THEN CASE WHEN grp IN (SELECT grp FROM c WHERE k % 50 = 0) OR CAST(concat('0x', substr(grp, 1, 8)) AS BIGINT) % 10 > 0 THEN 'train' ELSE 'source-dev' END END AS split, reason FROM capped""")
def expanded_build(spark, sf_dir):
    """Records as candidates, some twice and some under other labels; every fiftieth is in train already, and the groups of a few are protected. Quotas of 30 bind, groups have room."""
    r = records(spark, sf_dir).withColumn("source", F.col("components")[1]["raw"])
    k, wanted = F.col("c_custkey"), ["id", "source", "country", "text", "components"]
    other = F.transform("components", lambda s: S.span(F.when(s["label"] == "city", "suburb").otherwise(s["label"]), s["start"], s["end"], s["raw"]))
    again = r.where(k % 13 == 0).withColumn("id", F.concat("id", F.lit("d"))).select(wanted)
    differs = r.where(k % 17 == 0).withColumn("id", F.concat("id", F.lit("x"))).withColumn("components", other).select(wanted)
    decided, _ = corpora.expanded_build(r.select(wanted).union(again).union(differs), r.where(k % 50 == 0), r.where(k % 501 == 7), (30, 30), 1_000_000)
    return decided.select("id", "split", "reason")


@query("""WITH e AS (SELECT s_suppkey AS k, 'fdic:' || s_suppkey AS id, s_suppkey % 4 = 1 AS bare, CASE WHEN s_suppkey % 3 = 0 THEN 'VT' ELSE 'NY' END AS stratum, sha256('f|fdic:' || s_suppkey) AS rank, s_nationkey AS n FROM supplier),
x AS (SELECT *, CASE WHEN bare THEN 'missing-required-field' WHEN n = 3 THEN 'blocked-entity' END AS r FROM e),
y AS (SELECT *, coalesce(r, CASE WHEN k % 10 IN (4, 8) AND rank > min(rank) FILTER (r IS NULL) OVER (PARTITION BY k % 10 IN (4, 8), n) THEN 'duplicate-entity' END) AS r2 FROM x),
z AS (SELECT *, CASE WHEN r2 IS NULL THEN row_number() OVER (PARTITION BY stratum, r2 IS NULL ORDER BY rank, id) END AS rn FROM y)
SELECT coalesce(r2, CASE WHEN rn > 5 THEN 'not-drawn' END, 'kept') AS reason, count(*) AS rows FROM z GROUP BY 1""")
def frozen_benchmark(spark, sf_dir):
    """All suppliers as bank branches: some lack a field, one nation's are blocked, and a fifth share their nation's one street."""
    k = F.col("s_suppkey")
    c = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    raw = c.select(k.alias("UNINUM"), F.when((k % 10).isin(4, 8), "Shared Road").otherwise(F.col("s_name")).alias("ADDRESS"), F.when(k % 4 != 1, F.col("n_name")).alias("CITY"), F.when(k % 3 == 0, "VT").otherwise("NY").alias("STALP"), k.cast("string").alias("ZIP"), "n_nationkey")
    blocked = mappers.bank_branches(raw.where("n_nationkey = 3")).select("country", "components")
    out = corpora.frozen_benchmark(mappers.bank_branches(raw), blocked, 5, "f")
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS id, sha256('a|' || o_orderkey) AS rank, list_concat(['c' || o_custkey], (SELECT list(DISTINCT 's' || l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey)) AS keys FROM orders),
w AS (
  SELECT '' AS rank, CAST([] AS VARCHAR[]) AS used
  UNION ALL SELECT n.rank, list_concat(w.used, n.keys) FROM w, LATERAL (SELECT min_by(e.rank, e.rank) AS rank, min_by(e.keys, e.rank) AS keys FROM e WHERE e.rank > w.rank AND NOT list_has_any(e.keys, w.used)) n WHERE n.rank IS NOT NULL)
SELECT id AS o_orderkey, rank IN (SELECT rank FROM w) AS admitted FROM e""")
def arrival_admission(spark, sf_dir):
    """Orders in hash order, each admitted unless an earlier admitted one has its customer or one of its suppliers."""
    suppliers = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("suppliers"))
    o = t(spark, sf_dir, "orders").join(suppliers, "o_orderkey", "left")
    o = o.select("o_orderkey", F.unhex(select.hash_rank("o_orderkey", seed="a")).alias("rank"), F.array_append(F.coalesce("suppliers", F.array().cast("array<string>")), F.concat(F.lit("c"), "o_custkey")).alias("keys"))
    return admit.in_order(o, "rank", "keys").select("o_orderkey", (F.col("outcome") == "admitted").alias("admitted"))


@query("""WITH e AS (SELECT s_suppkey AS k, s_suppkey // 3 AS street, s_suppkey % 3 AS r, s_nationkey AS city, s_suppkey % 2 AS post, CASE WHEN s_suppkey % 3 = 0 THEN 'VT' ELSE 'NY' END AS stratum, s_nationkey = 3 AS blocked,
  'fdic:' || s_suppkey AS id, sha256('f|fdic:' || s_suppkey) AS rank FROM supplier),
b AS (SELECT DISTINCT street, city, post FROM e WHERE blocked),
x AS (SELECT *, street IN (SELECT street FROM b WHERE b.city = e.city) OR (street, post) IN (SELECT (street, post) FROM b) AS hit FROM e),
f AS (SELECT x.*, EXISTS (SELECT 1 FROM x a WHERE a.street = x.street AND a.r = 0 AND NOT a.hit AND (a.city = x.city OR a.post = x.post)) AS meets0,
  EXISTS (SELECT 1 FROM x a WHERE a.street = x.street AND a.r = 1 AND NOT a.hit AND (a.city = x.city OR a.post = x.post)) AS meets1 FROM x),
g AS (SELECT f.*, CASE r WHEN 0 THEN FALSE WHEN 1 THEN meets0 ELSE meets0 OR (meets1 AND NOT EXISTS (SELECT 1 FROM f a WHERE a.street = f.street AND a.r = 1 AND a.meets0)) END AS later FROM f),
z AS (SELECT *, CASE WHEN hit THEN 'blocked-entity' WHEN later THEN 'duplicate-entity' END AS reason FROM g),
y AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY stratum, reason IS NULL ORDER BY rank, id) END AS rn FROM z)
SELECT k, coalesce(reason, CASE WHEN rn > 5 THEN 'not-drawn' END, 'kept') AS reason FROM y""")
def frozen_arrival(spark, sf_dir):
    """All suppliers as bank branches, three on each street, in the order of their numbers; one may stand because the one that it clashes with fell to an earlier one."""
    k = F.col("s_suppkey")
    c = t(spark, sf_dir, "supplier").join(F.broadcast(t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    raw = c.select(k.alias("UNINUM"), F.concat(F.lit("Road "), F.floor(k / 3)).alias("ADDRESS"), F.col("n_name").alias("CITY"), F.when(k % 3 == 0, "VT").otherwise("NY").alias("STALP"), F.concat(F.lit("1000"), k % 2).alias("ZIP"), "n_nationkey", k)
    rows = mappers.bank_branches(raw).withColumn("arrival", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))
    out = corpora.frozen_benchmark(rows.select("id", "country", "stratum", "text", "components", "reason", "arrival"), mappers.bank_branches(raw.where("n_nationkey = 3")).select("country", "components"), 5, "f", "arrival")
    return out.select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("k"), F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("""SELECT source, reason, count(*) AS rows FROM (SELECT 'state' AS source, CASE WHEN c_custkey % 13 = 0 THEN 'invalid' ELSE 'ok' END AS reason FROM customer UNION ALL SELECT 'bank', CASE WHEN s_suppkey % 6 = 0 THEN 'US_territory_or_foreign' ELSE 'ok' END FROM supplier) GROUP BY ALL""")
def source_audit(spark, sf_dir):
    k, b = F.col("c_custkey"), F.col("s_suppkey")
    state = t(spark, sf_dir, "customer").select(k.alias("id"), k.alias("Add_Number"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("St_Name"), F.lit("TX").alias("State"))
    bank = t(spark, sf_dir, "supplier").select(b.alias("UNINUM"), F.col("s_name").alias("ADDRESS"), F.lit("Town").alias("CITY"), F.when(b % 6 == 0, "PR").otherwise("VT").alias("STALP"), F.lit("05401").alias("ZIP"))
    a = corpora.multi_source_audit({"state": (state, mappers.state_points), "bank": (bank, mappers.bank_branches)})
    return a.groupBy("source", "reason").agg(F.sum("rows").alias("rows"))


@query("""SELECT source, reason, type, count(*) AS rows FROM (
  SELECT 'a' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'spoiled' WHEN c_custkey % 4 = 0 THEN 'missing-text' WHEN c_custkey % 5 = 0 THEN 'replacement-character' ELSE 'ok' END AS reason FROM customer
  UNION ALL SELECT 'b', CASE WHEN o_orderkey % 4 = 0 THEN 'missing-text' ELSE 'ok' END FROM orders), (VALUES ('administrative-only')) v(type) GROUP BY ALL""")
def source_audit_repeats(spark, sf_dir):
    """Ids repeat a thousandfold or are null; both the mapper and the audit reject rows."""
    def rows(df, key, reason):
        k = F.col(key)
        text = F.when(k % 4 > 0, F.when((k % 5 == 0) & (key == "c_custkey"), F.lit("Town \ufffd")).otherwise("Town"))
        spans = F.array(S.span(F.lit("city"), F.lit(0), F.lit(4), F.lit("Town")))
        return df.select(F.when(k % 2 == 0, (k % 7).cast("string")).alias("id"), text.alias("text"), spans.alias("components"), F.lit("us").alias("country"), reason.alias("reason"))

    spoiled = F.when(F.col("c_custkey") % 3 == 0, "spoiled")
    sources = {"a": (t(spark, sf_dir, "customer"), lambda d: rows(d, "c_custkey", spoiled)), "b": (t(spark, sf_dir, "orders"), lambda d: rows(d, "o_orderkey", F.lit(None).cast("string")))}
    return corpora.multi_source_audit(sources)


# --- selection --------------------------------------------------------------------------------------


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('top|' || CAST(doc_id AS VARCHAR))) AS rn FROM documents) WHERE rn <= 5")
def hash_topn(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("source", "doc_id")
    return select.top_n(d, ["source"], [select.hash_rank("doc_id", seed="top")], 5).select("source", "doc_id")


@query("""SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('2026|' || CAST(doc_id AS VARCHAR))) AS rn FROM documents) WHERE rn <= 20""")
def reservoir_by_stratum(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return select.top_n(d, ["lang", "source"], [select.hash_rank("doc_id", seed="2026")], 20).select("lang", "source", "doc_id")


ROUND = """WITH a AS (SELECT o_orderkey, o_orderpriority AS split, o_orderstatus AS kind, CAST(o_custkey % 7 AS VARCHAR) AS state, o_custkey % 50 AS grp, o_orderkey AS rank FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY split, state, kind, grp ORDER BY rank) AS gr FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY split, state, kind ORDER BY gr, rank) AS tr FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY split, state ORDER BY tr, kind, rank) AS sr FROM c)"""


@query(ROUND + " SELECT o_orderkey, split, state, kind, gr, tr, sr FROM d ORDER BY split, sr, state LIMIT 500")
def round_robin_select(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 7).cast("string").alias("state"), (F.col("o_custkey") % 50).alias("grp"), F.col("o_orderkey").alias("rank"))
    r = select.round_robin(o, "split", "state", "kind", "grp", "rank", limit=500)
    return r.select("o_orderkey", "split", "state", "kind", *[F.col(c).cast("long").alias(c) for c in ("gr", "tr", "sr")])


@query("""SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, n_chars >= 1000 AS complete, row_number() OVER (PARTITION BY n_chars >= 1000, lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
ORDER BY complete DESC, rn, lang, source LIMIT 250""")
def review_queue(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") >= 1000).alias("complete"))
    return select.review_queue(d, ["lang", "source"], "complete", "doc_id", 250).select("doc_id", "lang", "source")


@query("SELECT source, arg_min(doc_id, sha256(CAST(doc_id AS VARCHAR))) AS doc_id FROM documents GROUP BY source")
def arg_min_representative(spark, sf_dir):
    return select.arg_min(t(spark, sf_dir, "documents"), ["source"], X.digest(F.col("doc_id").cast("string")), ["doc_id"])


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS g, 2 * dense_rank() OVER (ORDER BY o_orderpriority) - CAST(o_orderstatus = 'F' AS INT) AS q, o_orderstatus = 'F' AS f, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
w AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS kept, list_transform(range((SELECT max(q) FROM o)), lambda x: 0) AS used, list_transform(range((SELECT max(g) FROM o)), lambda x: 0) AS seen
  UNION ALL SELECT s.n, CASE WHEN ok THEN o_orderkey END, CASE WHEN ok THEN used[:q - 1] || [used[q] + 1] || used[q + 1:] ELSE used END, CASE WHEN ok THEN seen[:g - 1] || [seen[g] + 1] || seen[g + 1:] ELSE seen END
  FROM (SELECT o.*, used, seen, used[q] < CASE WHEN f THEN 500 ELSE 100 END AND seen[g] < 8 AS ok FROM w JOIN o ON o.n = w.n + 1) s)
SELECT o_orderkey, o_orderpriority, o_custkey, o_orderstatus = 'F' AS "full" FROM orders WHERE o_orderkey IN (SELECT kept FROM w)""")
def joint_caps(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "F").alias("full"))
    return select.joint_caps(o, "o_orderkey", "o_orderpriority", "o_custkey", "full", (500, 100), 8)


# --- evaluation -------------------------------------------------------------------------------------


def gold_and_predictions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Gold records and two models' predictions: fixed corruptions of them."""
    g = records(spark, sf_dir)
    k, c = F.col("c_custkey"), F.col("components")
    drop = lambda n: F.filter(c, lambda s: s["label"] != n)
    a = F.when(k % 7 == 0, drop("city")).when(k % 5 == 0, drop("house_number")).otherwise(c)
    swap = F.transform(c, lambda s: S.span(s["label"], s["start"], s["end"], F.when(s["label"] == "country", F.lit("nowhere")).otherwise(F.upper(s["raw"]))))
    more = F.concat(c, F.array(S.span(F.lit("state"), F.lit(0), F.lit(1), F.lit("X"))))
    b = F.when(k % 9 == 0, swap).when(k % 4 == 0, more).otherwise(c)
    p = g.select("id", "c_custkey", "country", F.explode(F.array(F.struct(F.lit("a").alias("model"), a.alias("components")), F.struct(F.lit("b").alias("model"), b.alias("components")))).alias("x"))
    return g, p.select("id", "c_custkey", "country", "x.*")


OUT = f"WITH {REC}" + """, o AS (
  SELECT c_custkey, id, country, 'a' AS model, f AS field, TRUE AS in_gold, NOT (f = 'city' AND c_custkey % 7 = 0) AS in_pred,
    NOT (f = 'city' AND c_custkey % 7 = 0) AND NOT (f = 'street_address' AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0) AS correct FROM rec, (VALUES ('street_address'), ('city'), ('country')) v(f)
  UNION ALL SELECT c_custkey, id, country, 'b', f, f <> 'state', f <> 'state' OR (c_custkey % 9 <> 0 AND c_custkey % 4 = 0), f <> 'state' AND NOT (f = 'country' AND c_custkey % 9 = 0)
  FROM rec, (VALUES ('street_address'), ('city'), ('country'), ('state')) v(f) WHERE f <> 'state' OR (c_custkey % 9 <> 0 AND c_custkey % 4 = 0)),
x AS (SELECT c_custkey, id, country, model, min(correct) AS exact FROM o GROUP BY ALL)"""
F1_SQL = "CAST(sum(correct::INT) AS BIGINT) AS correct, CAST(sum(in_pred::INT) AS BIGINT) AS predicted, CAST(sum(in_gold::INT) AS BIGINT) AS gold, 2.0 * sum(correct::INT) / nullif(sum(in_pred::INT) + sum(in_gold::INT), 0) AS f1"


def outcomes(spark, sf_dir) -> DataFrame:
    return score.field_outcomes(*gold_and_predictions(spark, sf_dir))


@query(OUT + f" SELECT model, field, {F1_SQL} FROM o GROUP BY ALL")
def field_f1(spark, sf_dir):
    return score.field_report(outcomes(spark, sf_dir))


@query(OUT + f" SELECT model, {F1_SQL} FROM o GROUP BY ALL")
def micro_f1(spark, sf_dir):
    return score.field_report(outcomes(spark, sf_dir), ["model"])


@query(OUT + " SELECT avg(r) AS macro, count(*) AS groups FROM (SELECT country, avg(exact::INT) AS r FROM x WHERE model = 'a' GROUP BY country)")
def country_macro(spark, sf_dir):
    x = score.row_outcomes(outcomes(spark, sf_dir)).where("model = 'a'").join(records(spark, sf_dir).select("id", "country"), "id")
    return score.macro(x, "country")


@query(OUT + """ SELECT count(*) FILTER (a.exact AND b.exact) AS "both", count(*) FILTER (a.exact AND NOT b.exact) AS only_a, count(*) FILTER (NOT a.exact AND b.exact) AS only_b,
  count(*) FILTER (NOT a.exact AND NOT b.exact) AS neither, CAST(0 AS BIGINT) AS unmatched FROM x a JOIN x b USING (id) WHERE a.model = 'a' AND b.model = 'b'""")
def paired_flips(spark, sf_dir):
    x = score.row_outcomes(outcomes(spark, sf_dir))
    return score.paired(x.where("model = 'a'"), x.where("model = 'b'"))


@query(OUT + " SELECT CASE WHEN NOT in_gold THEN 'extra' WHEN NOT in_pred THEN 'missing' ELSE 'changed' END AS kind, field, count(*) AS n FROM o WHERE NOT correct AND model = 'b' GROUP BY ALL")
def confusions(spark, sf_dir):
    g, p = gold_and_predictions(spark, sf_dir)
    return score.confusions(g, p.where("model = 'b'"))


@query(f"WITH {REC}" + """ SELECT label, count(*) FILTER (NOT gone) AS tp, CAST(0 AS BIGINT) AS fp, count(*) FILTER (gone) AS fn FROM (
  SELECT label, (label = 'city' AND c_custkey % 7 = 0) OR (label = 'house_number' AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0) AS gone FROM span JOIN rec USING (id)) GROUP BY label""")
def span_prf(spark, sf_dir):
    g, p = gold_and_predictions(spark, sf_dir)
    return score.span_prf(g.select("id", F.col("components").alias("gold")).join(p.where("model = 'a'").select("id", F.col("components").alias("pred")), "id"))


@query(f"WITH {REC}" + """, e AS (SELECT kind, field FROM rec, (VALUES ('changed', 'city'), ('changed', 'country'), ('swap', 'city->country'), ('swap', 'country->city')) v(kind, field) WHERE c_custkey % 6 = 0
  UNION ALL SELECT 'extra', 'state' FROM rec WHERE c_custkey % 6 > 0 AND c_custkey % 5 = 0 UNION ALL SELECT 'missing', 'city' FROM rec WHERE c_custkey % 6 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 = 0)
SELECT kind, field, count(*) AS n FROM e GROUP BY ALL""")
def swapped_fields(spark, sf_dir):
    """A model that exchanges city and country in some rows, and adds or drops a field in others."""
    g = records(spark, sf_dir)
    k, c = F.col("c_custkey"), F.col("components")
    turned = F.transform(c, lambda s: S.span(F.when(s["label"] == "city", "country").when(s["label"] == "country", "city").otherwise(s["label"]), s["start"], s["end"], s["raw"]))
    more = F.concat(c, F.array(S.span(F.lit("state"), F.lit(0), F.lit(1), F.lit("X"))))
    pred = F.when(k % 6 == 0, turned).when(k % 5 == 0, more).when(k % 7 == 0, F.filter(c, lambda s: s["label"] != "city")).otherwise(c)
    return score.confusions(g.select("id", "components"), g.select("id", F.lit("m").alias("model"), pred.alias("components")))


@query(f"WITH {REC}" + """, p AS (SELECT id, label, s + CAST(label = 'road' AND c_custkey % 9 = 0 AS INTEGER) AS s, e FROM span JOIN rec USING (id) WHERE NOT (label = 'city' AND c_custkey % 7 = 0)
  UNION ALL SELECT id, 'state', 0, 1 FROM rec WHERE c_custkey % 4 = 0)
SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count(*) FILTER (g.id IS NULL) AS fp, count(*) FILTER (p.id IS NULL) AS fn
FROM span g FULL JOIN p ON g.id = p.id AND g.label = p.label AND g.s = p.s AND g.e = p.e GROUP BY 1""")
def span_prf_moved(spark, sf_dir):
    """Spans that are moved, added and left out."""
    r = records(spark, sf_dir)
    k, c = F.col("c_custkey"), F.filter("components", lambda s: ~((s["label"] == "city") & (F.col("c_custkey") % 7 == 0)))
    moved = F.transform(c, lambda s: S.span(s["label"], s["start"] + ((s["label"] == "road") & (k % 9 == 0)).cast("int"), s["end"], s["raw"]))
    pred = F.when(k % 4 == 0, F.concat(moved, F.array(S.span(F.lit("state"), F.lit(0), F.lit(1), F.lit("X"))))).otherwise(moved)
    return score.span_prf(r.select("id", F.col("components").alias("gold"), pred.alias("pred")))


@query(OUT + """ SELECT country, scope, count(*) AS rows, count(*) FILTER (exact) AS exact FROM (
  SELECT c.country, s.scope, exact FROM x, (VALUES ('all'), ('third')) s(scope), LATERAL (VALUES (x.country), ('all')) c(country) WHERE model = 'a' AND (s.scope = 'all' OR c_custkey % 3 = 0)) GROUP BY ALL""")
def scope_rollup(spark, sf_dir):
    x = score.row_outcomes(outcomes(spark, sf_dir)).where("model = 'a'").join(records(spark, sf_dir).select("id", "c_custkey", "country"), "id")
    return score.scope_rollup(x, "country", {"all": F.lit(True), "third": F.col("c_custkey") % 3 == 0}, "exact")


Z2 = "1.95996398454 * 1.95996398454"


@query(OUT + f""", y AS (SELECT c.country, model, exact FROM x, LATERAL (VALUES (x.country), (NULL)) c(country)), r AS (SELECT country, model, count(*) AS rows, count(*) FILTER (exact) AS exact FROM y GROUP BY ALL),
f AS (SELECT c.country, model, 2.0 * sum(correct::INT) / (sum(in_pred::INT) + sum(in_gold::INT)) AS field_f1 FROM o, LATERAL (VALUES (o.country), (NULL)) c(country) GROUP BY ALL),
w AS (SELECT *, CAST(exact AS DOUBLE) / rows AS p FROM r), h AS (SELECT *, 1.95996398454 * sqrt(p * (1 - p) / rows + {Z2} / (4.0 * rows * rows)) / (1 + {Z2} / rows) AS half, (p + {Z2} / (2 * rows)) / (1 + {Z2} / rows) AS mid FROM w)
SELECT h.country, h.model, rows, exact, 100 * p AS percent, 100 * (mid - half) AS low, 100 * (mid + half) AS high, field_f1 FROM h JOIN f ON h.country IS NOT DISTINCT FROM f.country AND h.model = f.model""")
def score_report(spark, sf_dir):
    """Both models by country and over all."""
    g, p = gold_and_predictions(spark, sf_dir)
    return corpora.score_report(g, p.select("id", "model", "components")).drop("every")


@query(OUT.replace("id, country, 'a'", "id, CASE WHEN c_custkey % 5 > 0 THEN country END AS country, 'a'").replace("id, country, 'b'", "id, CASE WHEN c_custkey % 5 > 0 THEN country END, 'b'") + """,
y AS (SELECT x.country, model, exact, e.every FROM x, (VALUES (TRUE), (FALSE)) e(every)), r AS (SELECT CASE WHEN NOT every THEN country END AS country, every, model, count(*) AS rows, count(*) FILTER (exact) AS exact FROM y GROUP BY ALL),
z AS (SELECT o.*, e.every FROM o, (VALUES (TRUE), (FALSE)) e(every)), f AS (SELECT CASE WHEN NOT every THEN country END AS country, every, model, 2.0 * sum(correct::INT) / (sum(in_pred::INT) + sum(in_gold::INT)) AS field_f1 FROM z GROUP BY ALL)
SELECT r.country, r.every, r.model, rows, exact, field_f1 FROM r JOIN f ON r.country IS NOT DISTINCT FROM f.country AND r.every = f.every AND r.model = f.model""")
def score_report_nulls(spark, sf_dir):
    """A fifth of the gold rows have no country."""
    g, p = gold_and_predictions(spark, sf_dir)
    g = g.withColumn("country", F.when(F.col("c_custkey") % 5 > 0, F.col("country")))
    return corpora.score_report(g, p.select("id", "model", "components")).select("country", "every", "model", "rows", "exact", "field_f1")


@query(f"""WITH {REC}, r AS (SELECT *, len(regexp_extract_all(p4, '{TOKEN_SQL}')) AS city, len(regexp_extract_all(text, '{TOKEN_SQL}')) AS n FROM rec),
w AS (SELECT n, CASE WHEN c_custkey % 7 = 0 THEN city WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS wrong FROM r)
SELECT count(*) AS rows, count(*) FILTER (wrong = 0) AS exact, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n - wrong) AS BIGINT) AS correct_tokens,
  count(*) FILTER (wrong = 0) / count(*) AS supported_accuracy, count(*) FILTER (wrong = 0) / (count(*) + 40) AS all_inputs_accuracy, sum(n - wrong) / sum(n) AS token_accuracy FROM w""")
def accuracy_denominators(spark, sf_dir):
    """The first model's spans and the tags of its tokens, with forty inputs that could not be held."""
    g, p = gold_and_predictions(spark, sf_dir)
    df = g.select("id", "text", F.col("components").alias("gold")).join(p.where("model = 'a'").select("id", F.col("components").alias("pred")), "id").withColumn("o", S.token_spans(F.col("text")))
    return score.accuracies(df.select("gold", "pred", S.spans_to_bio(F.col("gold"), F.col("o")).alias("gold_tags"), S.spans_to_bio(F.col("pred"), F.col("o")).alias("pred_tags")), 40)


@query(OUT + """, v AS (SELECT a.exact AS b, kind, b.exact AND (kind = 'upper' OR a.c_custkey % 6 > 0) AS v FROM x a JOIN x b USING (id), (VALUES ('upper'), ('lower')) k(kind) WHERE a.model = 'a' AND b.model = 'b' AND (kind = 'upper' OR a.c_custkey % 2 = 0))
SELECT kind, count(*) FILTER (b AND v) AS "both", count(*) FILTER (b AND NOT v) AS only_base, count(*) FILTER (NOT b AND v) AS only_variant, count(*) FILTER (NOT b AND NOT v) AS neither FROM v GROUP BY kind""")
def variant_flips(spark, sf_dir):
    """Rows that the first model has right against two kinds of variants, the lower one of every other row, as the second model has them."""
    x, k = score.row_outcomes(outcomes(spark, sf_dir)), F.col("id").cast("long")
    kinds = F.explode(F.when(k % 2 == 0, F.array(F.lit("upper"), F.lit("lower"))).otherwise(F.array(F.lit("upper")))).alias("kind")
    v = x.where("model = 'b'").select("id", "exact", kinds)
    v = v.select(F.concat_ws(":", "id", "kind").alias("id"), (F.col("exact") & ((F.col("kind") == "upper") | (k % 6 > 0))).alias("exact"))
    return score.variant_outcomes(v, x.where("model = 'a'"))


@query("""WITH a AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'train' ELSE 'dev' END AS split, 0 AS n FROM customer),
b AS (SELECT o_custkey + 5 AS key, CASE WHEN max(o_totalprice) > 300000 THEN 'train' ELSE 'dev' END AS split, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, split = 'train' AS best, 0 AS late FROM a UNION ALL SELECT *, split = 'train', 1 FROM b)
SELECT key, split, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY best DESC, late DESC) AS rn FROM p) WHERE rn = 1""")
def alias_upsert(spark, sf_dir):
    """Keys with a split, upserted by others, of which a few are new: train goes before any other split, and what is new before what was there."""
    old = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "train").otherwise("dev").alias("split"), F.lit(0).cast("long").alias("n"))
    new = t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 5).alias("key")).agg(F.when(F.max("o_totalprice") > 300000, "train").otherwise("dev").alias("split"), F.count("*").alias("n"))
    return protect.upsert(old, new, ["key"], F.when(F.col("split") == "train", 1).otherwise(0))


@query(f"""WITH {REC}, r AS (SELECT *, row_number() OVER (PARTITION BY country, p3 IS NULL ORDER BY sha256('2026|' || id), id) AS rn FROM rec WHERE country IN ('asia', 'europe'))
SELECT id, country, (SELECT count(*) FROM r WHERE rn <= 12 AND (c_custkey % 3 = 0 OR c_custkey % 10 = 4)) AS overlap FROM r WHERE rn <= 12""")
def country_pilot(spark, sf_dir):
    """Twelve rows of each kind in two countries, and how many of them a previous set holds in other case or twice."""
    r = records(spark, sf_dir)
    k = F.col("c_custkey")
    some, counts = corpora.country_pilot(r, r.where(k % 3 == 0).withColumn("text", F.upper("text")).union(r.where(k % 10 == 4)), ["asia", "europe"], 12)
    return some.select("id", "country").crossJoin(F.broadcast(counts.select("overlap")))  # one row


# Panels are thirds of the records. A prediction that moves, drops or adds a part has other spans; one that changes case too.
PANELS = OUT + """, v AS (SELECT x.*, 'p' || CAST(c_custkey % 3 AS VARCHAR) AS panel, CASE model WHEN 'a' THEN c_custkey % 7 > 0 AND c_custkey % 5 > 0 ELSE c_custkey % 9 > 0 AND c_custkey % 4 > 0 END AS spans FROM x)"""


def panelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    g, p = gold_and_predictions(spark, sf_dir)
    return g.withColumn("panel", F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string"))), p.select("id", "model", "components")


@query(PANELS + """ SELECT panel, model, count(*) AS rows, count(*) FILTER (exact) AS fields, count(*) FILTER (spans) AS spans, round(100.0 * count(*) FILTER (exact) / count(*), 3) AS fields_percent, round(100.0 * count(*) FILTER (spans) / count(*), 3) AS spans_percent FROM v GROUP BY ALL""")
def evidence_panels(spark, sf_dir):
    return evidence.panels(evidence.outcomes(*panelled(spark, sf_dir)))


@query(PANELS + """ SELECT a.panel, a.model AS a, b.model AS b, count(*) AS rows, count(*) FILTER (a.exact AND NOT b.exact) AS wins, count(*) FILTER (b.exact AND NOT a.exact) AS losses FROM v a JOIN v b USING (id) WHERE a.model <> b.model GROUP BY ALL""")
def evidence_flips(spark, sf_dir):
    return evidence.flips(evidence.outcomes(*panelled(spark, sf_dir)), [("a", "b"), ("b", "a")])


@query(PANELS + """ SELECT panel, model, id, rec.text, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY panel, model ORDER BY c_custkey) AS INTEGER) AS rn FROM v WHERE NOT spans) q JOIN rec USING (id) WHERE rn <= 50""")
def evidence_failures(spark, sf_dir):
    """The first fifty failing rows of each panel and model, as the report lists them."""
    return evidence.failures(evidence.outcomes(*panelled(spark, sf_dir)), order=F.col("id").cast("long")).select("panel", "model", "id", "text", "rn")


@query(OUT + """ SELECT c.country, c.country IS NULL AS every, count(*) AS rows, count(*) FILTER (ok) AS exact_field_map, avg(ok::INT) AS accuracy
FROM (SELECT country, c_custkey % 9 > 0 AND c_custkey % 4 > 0 AS ok FROM rec), LATERAL (VALUES (country), (NULL)) c(country) GROUP BY ALL""")
def teacher_scores(spark, sf_dir):
    """The second model as a teacher: other case and width are no error, another country or field is."""
    g, p = gold_and_predictions(spark, sf_dir)
    wide = F.transform("components", lambda s: S.span(s["label"], s["start"], s["end"], F.translate(s["raw"], LETTERS, WIDE)))
    return evidence.teacher_report(g, p.where("model = 'b'").select("id", wide.alias("components")))


@query(OUT + """ SELECT a.country, count(*) FILTER (a.exact AND b.exact) AS "both", count(*) FILTER (a.exact AND NOT b.exact) AS only_a, count(*) FILTER (NOT a.exact AND b.exact) AS only_b,
  count(*) FILTER (NOT a.exact AND NOT b.exact) AS neither FROM x a JOIN x b USING (id) WHERE a.model = 'a' AND b.model = 'b' GROUP BY a.country""")
def model_comparison(spark, sf_dir):
    g, p = gold_and_predictions(spark, sf_dir)
    return corpora.model_comparison(g, p.select("id", "model", "components"), "a", "b")


@query(f"""SELECT source, k AS correct, n AS total, 100 * ((p + {Z2} / (2 * n)) / (1 + {Z2} / n) - h) AS low, 100 * ((p + {Z2} / (2 * n)) / (1 + {Z2} / n) + h) AS high FROM (
  SELECT source, k, n, p, 1.95996398454 * sqrt(p * (1 - p) / n + {Z2} / (4.0 * n * n)) / (1 + {Z2} / n) AS h FROM (
    SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n, sum(quality) / CAST(count(*) AS DOUBLE) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source))""")
def wilson_by_source(spark, sf_dir):
    g = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("correct"), F.count("*").alias("total"))
    low, high = score.wilson(F.col("correct"), F.col("total"))
    return g.select("source", "correct", "total", low.alias("low"), high.alias("high"))


@query("""SELECT count(*) AS rows, count(*) FILTER (r <= 1) AS top1, count(*) FILTER (r <= 2) AS top2, count(*) FILTER (r <= 4) AS top4, count(*) FILTER (r <= 8) AS top8
FROM (SELECT CASE WHEN o_orderkey % 10 < 8 THEN o_orderkey % 10 + 1 END AS r FROM orders)""")
def topk_recall(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    c = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("k") - F.col("k") % 10 + i)
    return score.topk_recall(o.select(F.col("k").alias("gold"), c.alias("candidates")))


@query("SELECT source, n, (sum(n) OVER ()) / (CAST(count(*) OVER () AS DOUBLE) * n) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def inverse_freq_weights(spark, sf_dir):
    return score.inverse_frequency(t(spark, sf_dir, "documents"), "source")


@query("SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    return score.nearest_rank(t(spark, sf_dir, "events"), "value", {"median": 0.5, "p95": 0.95}, ["event_type"])


@query("""SELECT lang, source, (sum(n) OVER w - n) / (sum(n) OVER (PARTITION BY lang)) AS lower, sum(n) OVER w / (sum(n) OVER (PARTITION BY lang)) AS upper
FROM (SELECT lang, source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY ALL) WINDOW w AS (PARTITION BY lang ORDER BY source ROWS UNBOUNDED PRECEDING)""")
def percent_stack(spark, sf_dir):
    g = t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").cast("double").alias("n"))
    return score.percent_stack(g, "source", "n", "lang")


@query(f"WITH {REC}" + """, v(cohort) AS (VALUES ('complete'), ('no-postcode'), ('no-city'), ('no-street'), ('lowercase'), ('multiline'), ('no-commas'))
SELECT id || ':' || cohort AS id, cohort, CASE WHEN cohort = 'no-city' THEN concat_ws(', ', p1, p2, p3, p5) WHEN cohort = 'lowercase' THEN lower(text)
  WHEN cohort = 'multiline' THEN replace(text, ', ', chr(10)) WHEN cohort = 'no-commas' THEN replace(text, ',', '') ELSE text END AS text FROM rec, v""")
def cohort_variants(spark, sf_dir):
    return augment.cohorts(records(spark, sf_dir)).select("id", "cohort", "text")


def coarse(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("id", "text", S.project(F.col("text"), F.col("components")).alias("components"), F.col("components").alias("source_components"))


STREET = "CASE WHEN p3 IS NULL THEN p1 || ', ' || p2 ELSE p1 || ', ' || p2 || ', ' || p3 END"


@query(f"""WITH {REC}, x AS (SELECT *, {STREET} AS street FROM rec)
SELECT id, street || ' ' || p4 AS text FROM x UNION ALL SELECT id, street FROM x UNION ALL SELECT id, concat_ws(' ', p1, p2, p4, p5) FROM x WHERE p3 IS NOT NULL
UNION ALL SELECT id, concat_ws(' ', p2, p3, p4, p5) FROM x""")
def partial_variants(spark, sf_dir):
    """No country, the street alone, no unit, no number."""
    return augment.partials(coarse(spark, sf_dir)).select(F.substring_index("id", ":", 1).alias("id"), "text")


@query()
def structural_variants(spark, sf_dir):
    return augment.structurals(coarse(spark, sf_dir))


@query(f"""WITH {REC} SELECT id || ':lower' AS id, 'lower' AS kind, lower(text) AS text FROM rec UNION ALL SELECT id || ':upper', 'upper', upper(text) FROM rec
UNION ALL SELECT id || ':title', 'title', array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') FROM rec""")
def case_variants(spark, sf_dir):
    return augment.cases(coarse(spark, sf_dir))


@query()
def layout_variants(spark, sf_dir):
    return augment.layouts(coarse(spark, sf_dir))


@query(f"""WITH {REC}, x AS (SELECT id, unnest([{STREET}, p4, p5]) AS raw, unnest([1, 2, 3]) AS n FROM rec)
SELECT a.id, 'permutations' AS mode, a.raw || ', ' || b.raw || ', ' || c.raw AS text FROM x a JOIN x b ON a.id = b.id AND a.n <> b.n JOIN x c ON a.id = c.id AND c.n NOT IN (a.n, b.n)
UNION ALL SELECT id, 'partial', raw FROM x UNION ALL SELECT a.id, 'partial', a.raw || ', ' || b.raw FROM x a JOIN x b ON a.id = b.id AND a.n < b.n
UNION ALL SELECT id, 'partial', {STREET} || ', ' || p4 || ', ' || p5 FROM rec UNION ALL SELECT id, 'formatting', {STREET} || s || p4 || s || p5 FROM rec, (VALUES (chr(10)), (' , '), (' ; '), (chr(9))) v(s)""")
def stress_variants(spark, sf_dir):
    return augment.stress(coarse(spark, sf_dir)).select(F.substring_index("id", ":", 1).alias("id"), "mode", "text")


@query(f"""WITH {REC}, k AS (SELECT array_to_string(list_sort([{ident('p4')}, {ident('p5')}]), '","') AS key, c_custkey % 2 AS odd FROM rec)
SELECT sha256('["' || key || '"]') AS blocked_key FROM k GROUP BY key HAVING count(DISTINCT odd) > 1""")
def ambiguity_index(spark, sf_dir):
    """Keys that the records' cities and countries, with every other one's labels exchanged, reach with different labels."""
    c = coarse(spark, sf_dir)
    left = F.filter("components", lambda s: s["label"] != "street_address")
    turned = F.transform(left, lambda s: S.span(F.when(s["label"] == "city", "country").otherwise("city"), s["start"], s["end"], s["raw"]))
    odd = F.col("id").cast("long") % 2 == 1
    return augment.ambiguous_keys(c.withColumns({"components": F.when(odd, turned).otherwise(left), "source_components": F.array().cast(S.SPANS)}))


@query()
def parse(spark, sf_dir):
    """Parses by a tagger of seeded random weights: the operators, not a trained model."""
    data, _, _ = model.write_model(model.random_weights(MODEL_SEED), gap=True, bits=5)
    return model.parse(records(spark, sf_dir).select("id", "text"), data).select("id", "parse.status", "parse.components")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def newest_request(spark, sf_dir):
    from ..streaming.latest import newest

    return newest(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")




# --- exact samples, spools, resumable sinks, verification --------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.01) AS p1, quantile_disc(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY ALL""")
def price_quantiles(spark, sf_dir):
    return score.nearest_rank(t(spark, sf_dir, "lineitem"), "l_extendedprice", {"p1": 0.01, "median": 0.5, "p999": 0.999}, ["l_returnflag", "l_linestatus"])


@query("""SELECT l_returnflag, quantile_disc(l_quantity, 0.25) AS low, quantile_disc(l_quantity, 0.75) AS high FROM lineitem GROUP BY ALL""")
def quantity_quantiles(spark, sf_dir):
    """Fifty values, each thousands of times."""
    return score.nearest_rank(t(spark, sf_dir, "lineitem"), "l_quantity", {"low": 0.25, "high": 0.75}, ["l_returnflag"])


@query("""SELECT count(*) // 7 AS rows, count(*) // 7 AS keys, count(*) // 7 AS members FROM orders""")
def exact_sample(spark, sf_dir):
    """A seventh of the orders, drawn exactly: how many rows, keys, and keys of the table it has."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    some = select.sample_rows(o, "o_orderkey", o.count() // 7, 2026)
    return some.join(o.select("o_orderkey", F.lit(1).alias("there")), "o_orderkey", "left").agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys"), F.sum("there").alias("members"))


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS idx, * FROM documents) SELECT idx, d.doc_id, lang, sha256(text) AS digest FROM d JOIN labels l ON d.idx = l.doc_id""")
def spool_rows(spark, sf_dir):
    """Documents in hash order as a spool; the row numbers that ``labels`` names are read back, from their row groups alone."""
    d = t(spark, sf_dir, "documents").withColumn("rank", X.digest(F.col("doc_id").cast("string")))
    path = f"{Tables(spark).root}/spool"
    spool.write_spool(d, path, ["rank"], 8, 1000)
    got = spool.read_rows(spark, path, t(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx")))
    return got.select("idx", "doc_id", "lang", X.digest(F.col("text")).alias("digest"))


@query("""SELECT source, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(length(text)) AS BIGINT) AS length, bit_xor(doc_id) AS ids FROM documents GROUP BY source""")
def resumed_units(spark, sf_dir):
    """Documents by source as a sink whose first run ended after some sources; the second adds the others."""
    d, path = t(spark, sf_dir, "documents"), f"{Tables(spark).root}/units"
    resumable.write_units(d.where("source < 'src15'"), "source", ["doc_id", "text"], path, parts=2)
    resumable.write_units(d, "source", ["doc_id", "text"], path, parts=2)
    back = resumable.read_units(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return back.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.sum(F.length("text")).alias("length"), F.bit_xor("doc_id").alias("ids"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1019 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 2003 = 5 THEN NULL ELSE l_returnflag END AS l_returnflag
  FROM a, range(CASE WHEN l_orderkey % 1013 = 1 THEN 2 WHEN l_orderkey % 1009 = 2 THEN 0 ELSE 1 END) UNION ALL SELECT -l_orderkey, l_linenumber, l_quantity, l_returnflag FROM a WHERE l_orderkey % 4001 = 3),
g AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, count(*) FILTER (s = 1) AS n1, count(*) FILTER (s = 2) AS n2 FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN sum(n2) = 0 THEN 'lost' WHEN sum(n1) = 0 THEN 'added' WHEN bool_or(n1 = 0 OR n2 = 0) THEN 'changed' ELSE 'doubled' END AS kind, CAST(sum(n1) AS BIGINT) AS n_a, CAST(sum(n2) AS BIGINT) AS n_b
FROM g GROUP BY l_orderkey, l_linenumber HAVING bool_or(n1 <> n2)""")
def result_differences(spark, sf_dir):
    """All lines against a copy with lost, added, doubled and changed ones."""
    a = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    k = F.col("l_orderkey")
    b = a.withColumn("times", F.when(k % 1013 == 1, 2).when(k % 1009 == 2, 0).otherwise(1)).withColumn("l_quantity", F.when(k % 1019 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    b = b.withColumn("l_returnflag", F.when(k % 2003 != 5, F.col("l_returnflag"))).withColumn("x", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*a.columns)
    more = a.where("l_orderkey % 4001 = 3").withColumn("l_orderkey", -k)
    return verify.differences(a, b.union(more), ["l_orderkey", "l_linenumber"])


@query(r"""WITH s AS (SELECT doc_id, text, regexp_replace(text, '[ \n\t]+', '', 'g') AS bare, i, CAST(length(text) * i // 9 AS INTEGER) AS a, CAST(length(text) * (i + 1) // 9 AS INTEGER) AS b FROM documents, range(9) r(i)),
m AS (SELECT *, CAST(length(regexp_replace(text[:a], '[ \n\t]+', '', 'g')) AS INTEGER) AS s, CAST(length(regexp_replace(text[:b], '[ \n\t]+', '', 'g')) AS INTEGER) AS e FROM s)
SELECT doc_id, i, s AS "start", e AS "end", bare[s + 1:e] AS raw FROM m WHERE e > s""")
def compacted_spans(spark, sf_dir):
    """Ninths of every document as spans, moved to the text without its white space."""
    n = F.length("text")
    part = lambda i: F.floor(n * i / 9).cast("int")
    spans = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: S.span(i.cast("string"), part(i), part(i + 1), F.lit("")))
    d = dealt(t(spark, sf_dir, "documents"), "doc_id", rows=TEXTS).where("text is not null").select("doc_id", edits.without(F.col("text"), spans, r"[ \n\t]+").alias("m"))
    return d.select("doc_id", F.explode("m.spans").alias("s")).select("doc_id", F.col("s.label").cast("long").alias("i"), "s.start", "s.end", "s.raw")


@query(f"""WITH {REC}, g AS (SELECT id, list(DISTINCT f) AS fields FROM (SELECT id, CASE label WHEN 'city' THEN 'city' WHEN 'country' THEN 'country' ELSE 'street_address' END AS f, c_custkey FROM span JOIN rec USING (id)
  WHERE NOT (label = 'country' AND c_custkey % 3 > 0) AND NOT (label IN ('city') AND c_custkey % 5 = 0) AND NOT (label IN ('house_number', 'road', 'unit') AND c_custkey % 7 = 0)) GROUP BY id),
x AS (SELECT fields, list_has_all(['city', 'street_address', 'state'], fields) AND list_has_all(['postcode', 'street_address', 'city'], fields) AS inside FROM g)
SELECT scope, count(*) AS rows FROM x, (VALUES ('all'), ('shared'), ('complete'), ('partial')) v(scope)
WHERE scope = 'all' OR (inside AND (scope = 'shared' OR (scope = 'complete') = (len(fields) = 2))) GROUP BY scope""")
def label_scopes(spark, sf_dir):
    """Records without some fields; two models share street and city."""
    fields, k = ["street_address", "city", "state", "postcode", "country"], F.col("c_custkey")
    models = spark.createDataFrame([("a", ["city", "street_address", "state"]), ("b", ["postcode", "street_address", "city"])], "model string, labels array<string>")
    shared = models.agg(F.bit_and(L.label_mask(F.col("labels"), fields)).alias("shared"))
    drop = lambda s: ((s["label"] == "country") & (k % 3 > 0)) | ((s["label"] == "city") & (k % 5 == 0)) | (s["label"].isin("house_number", "road", "unit") & (k % 7 == 0))
    r = records(spark, sf_dir).withColumn("left", F.filter("components", lambda s: ~drop(s))).where(F.size("left") > 0)
    mask = L.label_mask(F.transform("left", lambda s: S.field_of(s["label"])), fields)
    return r.select(mask.alias("mask")).crossJoin(F.broadcast(shared)).select(F.explode(L.scopes(F.col("mask"), F.col("shared"))).alias("scope")).groupBy("scope").agg(F.count("*").alias("rows"))  # one row
