"""Queries of the harmonisation operators over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contexts as ctx
from ..operators import ids, reshape, rules, taxonomy
from ..operators.reshape import TraitMap
from ..sources import program as prog
from ..sources import scratch, suggest
from ..sources import tables as src
from ..sources import triples as tri
from . import database as db
from . import reports

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (table reader) -> DataFrame under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scalar functions, scans, projections

@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def scan_csv_char(t):
    part = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    path = scratch.new_path(part.sparkSession)
    part.write.option("header", True).csv(path)
    return src.read_csv_text(part.sparkSession, path, multi_line=False).drop("_row")


@query("SELECT p_partkey, printf('%.15g', p_retailprice) AS price_text, printf('%.15g', p_retailprice / 7) AS seventh_text FROM part")
def cast_all_string(t):
    return t("part").select("p_partkey", tx.number_text(F.col("p_retailprice")).alias("price_text"), tx.number_text(F.col("p_retailprice") / 7).alias("seventh_text"))


@query("""SELECT o_orderkey, CASE WHEN x = 0 THEN '0' WHEN x >= 100000 AND x % 100000 = 0 THEN
            CAST(CAST(x / pow(10, floor(log10(x))) AS BIGINT) AS VARCHAR) || 'e+' || lpad(CAST(CAST(floor(log10(x)) AS BIGINT) AS VARCHAR), 2, '0')
            ELSE CAST(x AS VARCHAR) END AS number
          FROM (SELECT o_orderkey, (o_orderkey % 10) * CAST(pow(10, o_orderkey % 8) AS BIGINT) AS x FROM orders)""")
def number_text_notation(t):
    x = (F.col("o_orderkey") % 10) * F.pow(F.lit(10.0), F.col("o_orderkey") % 8)
    return t("orders").select("o_orderkey", tx.number_text(x).alias("number"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS error FROM region")
def conform_schema(t):
    return reshape.conform(t("region"), ["r_regionkey", "r_name", "description", "error"])


@query("SELECT c_custkey, upper(substr(x, 1, 1)) || substr(x, 2) AS name FROM (SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS x FROM customer)")
def capitalise_first(t):
    x = F.lower(F.replace("c_name", F.lit("#"), F.lit(" ")))
    return t("customer").select("c_custkey", F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000)).alias("name"))


_NAME_TEXT = ["x {n} sp", "{n} spp.", "{n} ssp minor", "{n} subsp  alba", "{n} var nana", "{n} affn major", "{n} aff rubra", "{n} forma alta", "{n} ms", "{n} sl", "{n} s.l. x", "{n} ss alba", "{n} s.s.", "{n} sub sp. parva", "{n} affin x", "{n} spp"]


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 16 """ + " ".join(f"WHEN {k} THEN '{x.split('{n}')[0]}' || p_name || '{x.split('{n}')[1]}'" for k, x in enumerate(_NAME_TEXT)) + r""" END AS s FROM part),
a AS (SELECT p_partkey, CASE WHEN regexp_matches(s, '^[a-z]') THEN upper(substr(s, 1, 1)) || substr(s, 2) ELSE s END AS s FROM n),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^[Xx]\s', 'x ', 'g'), '\ssp(\s|$)', ' sp.\1', 'g'), '\sspp.(\s|$)', ' sp.\1', 'g'), '\sspp(\s|$)', ' sp.\1', 'g'), '\sspp(\s|$)', ' sp.\1', 'g') AS s FROM a),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\sssp(\s|$)', ' subsp.\1', 'g'), '\sssp.(\s|$)', ' subsp.\1', 'g'), '\ssubsp(\s|$)', ' subsp.\1', 'g'), '\ssub sp.(\s|$)', ' subsp.\1', 'g'), '\svar(\s|$)', ' var.\1', 'g') AS s FROM b),
d AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\saffin(\s|$)', ' aff.\1', 'g'), '\saff(\s|$)', ' aff.\1', 'g'), '\saffn(\s|$)', ' aff.\1', 'g'), '\sforma(\s|$)', ' f.\1', 'g'), '\sms(\s|$)', '\1', 'g') AS s FROM c),
e AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\ssl(\s|$)', '\1', 'g'), '\ss\.l\.(\s|$)', '\1', 'g'), '\sss(\s|$)', '', 'g'), '\ss\.s\.(\s|$)', '\1', 'g') AS s FROM d)
SELECT p_partkey, trim(regexp_replace(s, '\s+', ' ', 'g')) AS name FROM e""")
def standardise_names(t):
    text = None
    for k, x in enumerate(_NAME_TEXT):
        before, after = x.split("{n}")
        whole = F.concat(F.lit(before), F.col("p_name"), F.lit(after))
        text = F.when(F.col("p_partkey") % 16 == k, whole) if text is None else text.when(F.col("p_partkey") % 16 == k, whole)
    return t("part").select("p_partkey", tx.standardise_name(text).alias("name"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || lower(p_brand) || ' ' || p_name, ' '))), ' ') AS tokens FROM part")
def separate_and_sort(t):
    return t("part").select("p_partkey", tx.separate_and_sort(F.concat_ws(" ", "p_name", F.lower("p_brand"), "p_name")).alias("tokens"))


@query("SELECT o_orderkey, regexp_replace(CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'http://doi.org/' WHEN 2 THEN 'doi.org/' ELSE '' END || '10.1/' || o_orderkey, '^(https?://)?doi\\.org/', '') AS doi FROM orders".replace("\\\\", "\\"))
def standardise_doi(t):
    k = F.col("o_orderkey") % 4
    before = F.when(k == 0, "https://doi.org/").when(k == 1, "http://doi.org/").when(k == 2, "doi.org/").otherwise("")
    return t("orders").select("o_orderkey", tx.standardise_doi(F.concat(before, F.lit("10.1/"), F.col("o_orderkey").cast("string"))).alias("doi"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END, 'unknown') AS priority FROM orders")
def coalesce_default(t):
    return t("orders").select("o_orderkey", tx.replace_null(F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")), "unknown").alias("priority"))


@query("SELECT o_orderkey, coalesce(s, 'NA') || '-' || o_orderstatus AS pasted, CASE WHEN s IS NULL THEN NULL WHEN s = '1-URGENT' THEN 'first' ELSE 'later' END AS chosen FROM (SELECT *, CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS s FROM orders)")
def null_rules(t):
    df = t("orders").withColumn("s", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")))
    return df.select("o_orderkey", tx.paste(["s", "o_orderstatus"], "-").alias("pasted"), tx.if_else(F.col("s") == "1-URGENT", "first", "later").alias("chosen"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS genus, CASE WHEN p_size % 2 = 0 AND len(string_split(p_name, ' ')) >= 2 THEN split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) END AS binomial FROM part")
def derived_names(t):
    rank = F.when(F.col("p_size") % 2 == 0, "species").otherwise("genus")
    return t("part").select("p_partkey", taxonomy.genus(F.col("p_name")).alias("genus"), taxonomy.binomial(F.col("p_name"), rank).alias("binomial"))


@query("""SELECT n_nationkey, CASE WHEN k = 0 THEN 'native' WHEN k IN (1, 2) THEN 'native and naturalised' ELSE 'naturalised' END AS means
          FROM (SELECT n_nationkey, n_nationkey % 4 AS k FROM nation)""")
def establishment_means(t):
    k = F.col("n_nationkey") % 4
    places = F.when(k == 0, "NSW, Qld").when(k == 1, "NSW (native and naturalised), Qld (naturalised)").when(k == 2, "NSW, Qld (naturalised)").otherwise("NSW (naturalised), Qld (naturalised)")
    return t("nation").select("n_nationkey", taxonomy.establishment_means(places).alias("means"))


# --- reshaping

_MEASURES = [TraitMap("l_quantity", "quantity", "t"), TraitMap("l_extendedprice", "price", "usd"), TraitMap("l_discount", "discount", "ratio"), TraitMap("l_tax", "tax", "ratio", None, {"source_id": "l_returnflag"}), TraitMap("l_quantity", "pieces", "n", None, {"source_id": "fixed"})]


@query("""SELECT l_orderkey, l_linenumber, trait_name, unit_in, source_id, value FROM (
  SELECT l_orderkey, l_linenumber, 'quantity' AS trait_name, 't' AS unit_in, CAST(NULL AS VARCHAR) AS source_id, printf('%.15g', l_quantity) AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'price', 'usd', NULL, printf('%.15g', l_extendedprice) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', 'ratio', NULL, CASE WHEN l_discount <> 0 THEN printf('%.15g', l_discount) END FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'tax', 'ratio', l_returnflag, printf('%.15g', l_tax) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'pieces', 'n', 'fixed', printf('%.15g', l_quantity) FROM lineitem)""")
def wide_to_long(t):
    return reshape.wide_to_long(_text_lineitem(t), _MEASURES, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "trait_name", "unit_in", "source_id", "value")


def _text_lineitem(t):
    df = t("lineitem").withColumn("l_discount", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return df.withColumns({c: tx.printf_text(F.col(c)) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})


_EVENTS = [TraitMap("click", "clicks", "n"), TraitMap("purchase", "spend", "usd", None, {"life_stage": "adult"}), TraitMap("view", "views", "n", None, {"life_stage": "props"})]


@query("""SELECT event_id, v.trait_name, v.unit_in, CASE v.trait_name WHEN 'spend' THEN 'adult' WHEN 'views' THEN props END AS life_stage, value FROM events
          JOIN (VALUES ('click', 'clicks', 'n'), ('purchase', 'spend', 'usd'), ('view', 'views', 'n')) v(var_in, trait_name, unit_in) ON event_type = v.var_in""")
def long_filter_map(t):
    return reshape.map_long(t("events"), _EVENTS, "event_type").select("event_id", "trait_name", "unit_in", "life_stage", "value")


@query("""SELECT o_orderkey, trait_name, basis FROM (SELECT o_orderkey, 'price' AS trait_name, 'model' AS basis FROM orders
          UNION ALL SELECT o_orderkey, 'status', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'customer', 'measurement' FROM orders)""")
def trait_level_override(t):
    df = t("orders").withColumn("basis", F.lit("measurement"))
    maps = [TraitMap("o_totalprice", "price", overrides={"basis": "model"}), TraitMap("o_orderstatus", "status", overrides={"basis": "o_orderpriority"}), TraitMap("o_custkey", "customer")]
    return reshape.wide_to_long(df, maps, ["o_orderkey"]).select("o_orderkey", "trait_name", "basis")


@query("SELECT n_nationkey, 'n_name' AS property, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def to_eav(t):
    return reshape.to_eav(t("nation"), ["n_nationkey"], ["n_name", "n_regionkey"])


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS O FROM orders GROUP BY o_custkey")
def eav_to_wide(t):
    df = t("orders").select("o_custkey", F.col("o_orderstatus").alias("property"), F.col("o_orderpriority").alias("value"))
    return reshape.from_eav(df, ["o_custkey"], ["F", "O"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey > 0 THEN n_name END AS value FROM nation")
def list_to_key_value(t):
    items = {r["n_nationkey"]: r["n_name"] if r["n_regionkey"] > 0 else None for r in reshape.rows_to_records(t("nation"))}
    return reshape.list_to_rows(t("region").sparkSession, items)


@query("SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part")
def split_to_rows(t):
    return t("part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("token"))


@query("SELECT s_suppkey AS key, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(t):
    return db.bind_frames([t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


# --- dictionary, flags, rules, units

def _dictionary(t):
    rows = [("PROMO BRUSHED", "numeric", "kg", 5.0, 30.0, None), ("ECONOMY", "categorical", None, None, None, ["small", "large", "steel"])]
    return t("part").sparkSession.createDataFrame(rows, rules.DICTIONARY)


@query("""SELECT o_orderkey, v.type AS kind, v.units AS units, v.name IS NOT NULL AS known FROM orders
          LEFT JOIN (VALUES ('1-URGENT', 'numeric', 'kg'), ('5-LOW', 'categorical', NULL)) v(name, type, units) ON v.name = o_orderpriority""")
def dictionary_lookup(t):
    spark = t("region").sparkSession
    table = spark.createDataFrame([("1-URGENT", "numeric", "kg", None, None, None), ("5-LOW", "categorical", None, None, None, None)], rules.DICTIONARY)
    df = rules.with_dictionary(t("orders").withColumn("trait_name", F.col("o_orderpriority")), table)
    return df.select("o_orderkey", F.col("_type").alias("kind"), F.col("_units").alias("units"), F.col("_known").alias("known"))


@query("SELECT * FROM (VALUES ('1-URGENT', 'numeric'), ('5-LOW', 'categorical'), ('none', 'numeric')) v(trait_name, type) WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = v.trait_name)")
def semi_join_dictionary(t):
    table = t("region").sparkSession.createDataFrame([("1-URGENT", "numeric"), ("5-LOW", "categorical"), ("none", "numeric")], "trait_name string, type string")
    return table.join(t("orders").select(F.col("o_orderpriority").alias("trait_name")), "trait_name", "left_semi")


@query("SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7E]') AS flagged, regexp_matches(text, '[^\\x00-\\x7Eäöüß]') AS flagged_german FROM documents".replace("\\\\", "\\"))
def flag_non_ascii(t):
    return t("documents").select("doc_id", tx.has_unsupported_characters(F.col("text")).alias("flagged"), tx.has_unsupported_characters(F.col("text"), "äöüß").alias("flagged_german"))


@query("""SELECT doc_id, lang IN ('de', 'fr') OR (source = 'src1' AND lang = 'en') OR (CASE WHEN lang = 'es' THEN coalesce(source IN ('src2', 'src3'), false) ELSE false END) AS excluded
          FROM (SELECT doc_id, coalesce(lang, '') AS lang, source FROM documents)""")
def flag_excluded(t):
    df = t("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("trait_name"), F.col("source").alias("value"), F.coalesce("lang", F.lit("")).alias("lang"))
    test = rules.flag_excluded(df, [("lang", "de,  fr".replace(",  ", ", "), "x"), ("en", "src1", "x"), ("es", "src2, src3", "x")], {"en", "es"})
    return df.select("doc_id", test.alias("excluded"))


_LATTICE_SPARK = "case when event_id % 29 = 0 then null when event_id % 7 = 0 then 'café' when event_id % 7 = 1 then 'small steel' when event_id % 7 = 2 then 'YYNN' when event_id % 7 = 3 then 'yyyynnnnyyyy' when event_id % 7 = 4 then '12x' else cast(user_id as string) end"


@query("""SELECT event_id, CASE WHEN taxon IS NULL THEN 'Missing species name' WHEN value IS NULL THEN 'Missing value'
  WHEN user_id % 50 = 1 THEN 'Observation excluded in metadata' WHEN trait = 'other' THEN 'Trait name not in trait dictionary'
  WHEN regexp_matches(value, '[^\\x00-\\x7E]') THEN 'Value contains unsupported characters'
  WHEN trait = 'habit' AND value NOT IN ('small steel', 'small', 'steel') THEN 'Unsupported trait value'
  WHEN trait = 'flowering_time' AND NOT regexp_full_match(value, '[YyNn]+') THEN 'Time can only contain Y & Ns'
  WHEN trait = 'flowering_time' AND length(value) <> 12 THEN 'Times must be length 12'
  WHEN trait = 'mass' AND kind <> 'range' AND TRY_CAST(value AS DOUBLE) IS NULL THEN 'Value does not convert to numeric'
  WHEN trait = 'mass' AND kind <> 'range' AND (CAST(value AS DOUBLE) < 20 OR CAST(value AS DOUBLE) > 80) THEN 'Value out of allowable range' END AS error
  FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'habit' WHEN 'view' THEN 'flowering_time' WHEN 'purchase' THEN 'mass' ELSE 'other' END AS trait,
          CASE WHEN event_id % 31 <> 0 THEN 'x' END AS taxon, CASE WHEN event_id % 3 = 0 THEN 'range' ELSE 'raw' END AS kind,
          CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'café' WHEN event_id % 7 = 1 THEN 'small steel' WHEN event_id % 7 = 2 THEN 'YYNN'
               WHEN event_id % 7 = 3 THEN 'yyyynnnnyyyy' WHEN event_id % 7 = 4 THEN '12x' ELSE CAST(user_id AS VARCHAR) END AS value FROM events)""".replace("\\\\", "\\"))
def error_lattice(t):
    return _lattice(t).select("event_id", "error")


def _lattice(t):
    kind = F.col("event_type")
    spark = t("region").sparkSession
    table = spark.createDataFrame([("habit", "categorical", None, None, None, ["small", "steel"]), ("flowering_time", "character", None, None, None, None), ("mass", "numeric", "kg", 20.0, 80.0, None)], rules.DICTIONARY)
    df = t("events").withColumns({
        "trait_name": F.when(kind == "click", "habit").when(kind == "view", "flowering_time").when(kind == "purchase", "mass").otherwise("other"),
        "taxon_name": F.when(F.col("event_id") % 31 != 0, "x"), "value_type": F.when(F.col("event_id") % 3 == 0, "range").otherwise("raw"), "value": F.expr(_LATTICE_SPARK)})
    df = rules.with_dictionary(df, table)
    return df.withColumn("error", rules.range_error(rules.value_error(F.col("user_id") % 50 == 1)))


def _flag(name: str, message: str):
    inner = _SQL["error_lattice"]

    @query(f"SELECT event_id FROM ({inner}) WHERE error = '{message}'")
    def flag(t):
        return _lattice(t).filter(F.col("error") == message).select("event_id")

    _QUERIES[name], _SQL[name] = _QUERIES.pop("flag"), _SQL.pop("flag")


for _name, _message in {"flag_unsupported_trait": rules.UNKNOWN_TRAIT, "flag_missing": rules.MISSING_VALUE, "flag_unsupported_value": rules.UNSUPPORTED_VALUE, "flag_time_string": rules.TIME_LETTERS, "flag_time_length": rules.TIME_LENGTH, "flag_not_numeric": rules.NOT_NUMERIC, "flag_out_of_range": rules.OUT_OF_RANGE}.items():
    _flag(_name, _message)


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'gone' WHEN 'AUTOMOBILE' THEN 'car' WHEN 'MACHINERY' THEN NULL ELSE lower(c_mktsegment) END AS value FROM customer""")
def substitutions(t):
    df = t("customer").select("c_custkey", F.lit("segment").alias("trait_name"), F.lower("c_mktsegment").alias("value"))
    chain = [("segment", "BUILDING", "house"), ("segment", "house", "gone"), ("segment", "Automobile", "car"), ("segment", "machinery", None), ("other", "car", "x")]
    return rules.substitute(df, chain).select("c_custkey", "value")


@query("""SELECT p_partkey, p_brand AS original_name, CASE p_brand WHEN 'Brand#11' THEN 'brand c' WHEN 'Brand#12' THEN 'brand c' ELSE trim(regexp_replace(p_brand, '\\s+', ' ', 'g')) END AS taxon_name,
          CASE p_brand WHEN 'Brand#11' THEN 'r3' WHEN 'Brand#12' THEN 'r3' END AS taxonomic_resolution FROM part""".replace("\\\\", "\\"))
def taxonomic_updates(t):
    df = t("part").select("p_partkey", F.col("p_brand").alias("taxon_name"))
    out = taxonomy.update_names(df, [("Brand#11", "brand b", "r1"), ("Brand#12", "brand b", "r2"), ("brand b", "brand c", "r3")])
    return out.select("p_partkey", "original_name", "taxon_name", "taxonomic_resolution")


_CONVERSIONS = {k: rules.parse_conversion(v) for k, v in {"t-kg": "x*1000", "g-kg": "x/1000", "1/kg-kg": "1/x", "lb-kg": "x*0.5/2"}.items()}


def _converted(t, kinds):
    spark = t("region").sparkSession
    table = spark.createDataFrame([("mass", "numeric", "kg", None, None, None), ("habit", "categorical", None, None, None, None)], rules.DICTIONARY)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("t", "g", "1/kg", "lb", "kg", "stone")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    size = tx.number_text(F.col("l_quantity"))
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, "habit").otherwise("mass").alias("trait_name"), unit.alias("unit_in"), F.lit(kinds).alias("value_type"), (F.concat(size, F.lit("--"), tx.number_text(F.col("l_quantity") * 2)) if kinds == "range" else size).alias("value"), F.lit(None).cast("string").alias("error"))
    return rules.convert_units(rules.with_dictionary(df, table), _CONVERSIONS).select("l_orderkey", "l_linenumber", "value", "unit", "error")


_UNIT_CASE = "CASE l_orderkey % 6 WHEN 0 THEN 't' WHEN 1 THEN 'g' WHEN 2 THEN '1/kg' WHEN 3 THEN 'lb' WHEN 4 THEN 'kg' ELSE 'stone' END"
_APPLY = "CASE u WHEN 't' THEN {x} * 1000 WHEN 'g' THEN {x} / 1000 WHEN '1/kg' THEN 1 / {x} WHEN 'lb' THEN {x} * 0.5 / 2 ELSE {x} END"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 OR u IN ('kg', 'stone') THEN printf('%.15g', q) ELSE printf('%.15g', {_APPLY.format(x='q')}) END AS value,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN u = 'stone' THEN 'stone' ELSE 'kg' END AS unit, CASE WHEN l_linenumber < 7 AND u = 'stone' THEN 'Missing unit conversion' END AS error
  FROM (SELECT *, l_quantity AS q, {_UNIT_CASE} AS u FROM lineitem)""")
def unit_conversion(t):
    return _converted(t, "raw")


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 OR u IN ('kg', 'stone') THEN printf('%.15g', q) || '--' || printf('%.15g', q * 2) ELSE printf('%.15g', {_APPLY.format(x='q')}) || regexp_replace('--' || printf('%.15g', {_APPLY.format(x='(q * 2)')}), '^--100000$', '--1e+05') END AS value,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN u = 'stone' THEN 'stone' ELSE 'kg' END AS unit, CASE WHEN l_linenumber < 7 AND u = 'stone' THEN 'Missing unit conversion' END AS error
  FROM (SELECT *, l_quantity AS q, {_UNIT_CASE} AS u FROM lineitem)""")
def unit_conversion_range(t):
    return _converted(t, "range")


#: Formulas of units, and what they are in SQL.
_FORMULAS = {
    "x*10": "x * 10", "x*1/1000": "x * 1 / 1000", "x*.01": "x * 0.01", "x*-1": "x * -1", "x*-1000": "x * -1000", "1/x": "1 / x", "1000/x": "1000 / x", "1/x*1000": "1 / x * 1000", "x/14.0067": "x / 14.0067",
    "x*1000/30.973761": "x * 1000 / 30.973761", "x*1/4.3": "x * 1 / 4.3", "(x-32)/1.8": "(x - 32) / 1.8", "x*1.8+32": "x * 1.8 + 32", "100-x": "100 - x", "(1/1000)*x": "(CAST(1 AS DOUBLE) / 1000) * x", "-x/2": "-x / 2", "x*1e-06": "x * CAST(1e-06 AS DOUBLE)",
}


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.15g', CASE l_orderkey % " + str(len(_FORMULAS)) + " " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMULAS.values())) + """ END) AS DOUBLE) AS value, 'kg' AS unit
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x FROM lineitem) WHERE l_linenumber < 6""")
def unit_formulas(t):
    """Every form of a formula, over all measurements; formulas that can't be read are left out, and told."""
    rows = [{"unit_from": f"u{k}", "unit_to": "kg", "function": f} for k, f in enumerate(_FORMULAS)] + [{"unit_from": "bad", "unit_to": "kg", "function": "x*x"}]
    table = t("region").sparkSession.createDataFrame([("mass", "numeric", "kg", None, None, None)], rules.DICTIONARY)
    unit = F.when(F.col("l_linenumber") < 6, F.concat(F.lit("u"), (F.col("l_orderkey") % len(_FORMULAS)).cast("string"))).otherwise("bad")
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.lit("mass").alias("trait_name"), unit.alias("unit_in"), F.lit("raw").alias("value_type"), tx.number_text(F.col("l_quantity")).alias("value"), F.lit(None).cast("string").alias("error"))
    out = rules.convert_units(rules.with_dictionary(df, table), rules.read_conversions(rows))
    return out.filter("error is null").select("l_orderkey", "l_linenumber", tx.to_number(F.col("value")).alias("value"), "unit")


@query("""SELECT l_orderkey, l_linenumber, trait_name, CASE WHEN u = 't' THEN printf('%.15g', x * 1000) ELSE printf('%.15g', x) END AS value, CASE WHEN trait_name = 'price' THEN 'usd' WHEN u IN ('kg', 't') THEN 'kg' ELSE u END AS unit,
  CASE WHEN trait_name = 'mass' AND (u IS NULL OR u NOT IN ('kg', 't')) THEN 'Missing unit conversion' END AS error
  FROM (SELECT l_orderkey, l_linenumber, 'mass' AS trait_name, CAST(l_quantity AS DOUBLE) AS x, CASE l_orderkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 't' WHEN 2 THEN 'stone' END AS u FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'price', CAST(l_extendedprice AS DOUBLE), 'usd' FROM lineitem)""")
def unit_columns(t):
    """Units that a column of the data gives, row by row."""
    k = F.col("l_orderkey") % 4
    df = t("lineitem").withColumns({"l_quantity": tx.number_text(F.col("l_quantity")), "l_extendedprice": tx.number_text(F.col("l_extendedprice")), "measured in": F.when(k == 0, "kg").when(k == 1, "t").when(k == 2, "stone")})
    table = t("region").sparkSession.createDataFrame([("mass", "numeric", "kg", None, None, None), ("price", "numeric", "usd", None, None, None)], rules.DICTIONARY)
    long = reshape.wide_to_long(df, [TraitMap("l_quantity", "mass", "measured in"), TraitMap("l_extendedprice", "price", "usd")], ["l_orderkey", "l_linenumber"])
    long = rules.with_dictionary(long.withColumns({"value_type": F.lit("raw"), "error": F.lit(None).cast("string")}), table)
    return rules.convert_units(long, _CONVERSIONS).select("l_orderkey", "l_linenumber", "trait_name", tx.printf_notation(F.col("value")).alias("value"), "unit", "error")


# --- identifiers

_PAD = "lpad(CAST(r AS VARCHAR), CAST(greatest(2, ceil(log10(n)), length(CAST(r AS VARCHAR))) AS INTEGER), '0')"


@query(f"SELECT p_partkey, {_PAD} AS brand_id FROM (SELECT p_partkey, r, max(r) OVER (PARTITION BY p_size) AS n FROM (SELECT p_partkey, p_size, dense_rank() OVER (PARTITION BY p_size ORDER BY p_brand) AS r FROM part))")
def dense_id_sorted(t):
    return ids.dense_id(t("part"), F.col("p_brand"), "brand_id", ["p_size"]).select("p_partkey", "brand_id")


@query(f"""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY f) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM f)
SELECT o_orderkey, {_PAD} AS priority_id FROM orders JOIN g USING (o_custkey, o_orderpriority)""")
def dense_id_first_seen(t):
    return ids.dense_id(t("orders"), F.col("o_orderpriority"), "priority_id", ["o_custkey"], "o_orderkey").select("o_orderkey", "priority_id")


@query(f"""SELECT o_orderkey, 'g' || {_PAD} AS group_id FROM (SELECT o_orderkey, r, max(r) OVER () AS n FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus || '|' || o_orderpriority) AS r FROM orders))""")
def group_id(t):
    return ids.dense_id(t("orders"), tx.paste(["o_orderstatus", "o_orderpriority"], "|"), "group_id", [], prefix="g").select("o_orderkey", "group_id")


def _observations(t):
    """Orders as records of customers (taxa) at priorities (locations) with a few missing parts."""
    k = F.col("o_orderkey")
    nothing = F.lit(None).cast("string")
    return t("orders").select(
        F.concat(F.lit("d"), (F.col("o_custkey") % 3).cast("string")).alias("dataset_id"), k.alias("_row"), k.alias("parsing_row"),
        F.concat(F.lit("taxon "), (F.col("o_custkey") % 40).cast("string")).alias("taxon_name"),
        F.when(k % 4 != 0, F.col("o_orderpriority")).alias("location_name"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("plot_context_id"), nothing.alias("treatment_context_id"),
        F.when(k % 11 == 0, None).when(k % 5 == 0, "species").when(k % 5 == 1, "population").otherwise("individual").alias("entity_type"),
        F.when(k % 13 != 0, F.lit("1")).alias("value"), F.concat(F.lit("p"), k.cast("string")).alias("parsing_id"), F.when(k % 2 == 0, F.concat(F.lit("i"), (k % 50).cast("string"))).alias("individual_id"),
        *[nothing.alias(c) for c in ("temporal_context_id", "life_stage", "source_id", "entity_context_id", "collection_date", "original_name", "method_id", "method_context_id", "repeat_measurements_id")],
        F.lit("field").alias("basis_of_record"), F.lit("raw").alias("value_type"), F.concat(F.lit("trait"), (F.col("o_custkey") % 2).cast("string")).alias("trait_name"))


_OBS = """o AS (SELECT 'd' || (o_custkey % 3) AS d, o_orderkey AS k, 'taxon ' || (o_custkey % 40) AS taxon, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS loc,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS plot, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'species' WHEN o_orderkey % 5 = 1 THEN 'population' ELSE 'individual' END AS entity,
  CASE WHEN o_orderkey % 13 <> 0 THEN '1' END AS value, 'p' || o_orderkey AS parsing, CASE WHEN o_orderkey % 2 = 0 THEN 'i' || (o_orderkey % 50) END AS ind, 'trait' || (o_custkey % 2) AS trait FROM orders),
pk AS (SELECT *, coalesce(loc, 'NA') || coalesce(plot, 'NA') || 'NA' AS pkey FROM o),
pf AS (SELECT d, pkey, row_number() OVER (PARTITION BY d ORDER BY min(k)) AS r, count(*) OVER (PARTITION BY d) AS n FROM pk GROUP BY d, pkey),
p AS (SELECT pk.*, CASE WHEN entity IN ('individual', 'population') THEN CASE WHEN loc IS NOT NULL OR plot IS NOT NULL THEN """ + _PAD + """ ELSE 'pop_unk' END END AS pop FROM pk JOIN pf USING (d, pkey)),
i0 AS (SELECT *, CASE WHEN ind IS NULL AND entity = 'individual' THEN parsing ELSE ind END AS ikey FROM p),
fi AS (SELECT d, taxon, pop, ikey, row_number() OVER (PARTITION BY d, taxon, pop ORDER BY min(k)) AS r, count(*) OVER (PARTITION BY d, taxon, pop) AS n FROM i0 WHERE ikey IS NOT NULL GROUP BY d, taxon, pop, ikey),
i AS (SELECT i0.*, CASE WHEN entity = 'individual' THEN """ + _PAD + """ WHEN entity IS NULL THEN 'entity_unk' || """ + _PAD + """ END AS individual_id
      FROM i0 LEFT JOIN fi ON i0.d = fi.d AND i0.taxon = fi.taxon AND i0.pop IS NOT DISTINCT FROM fi.pop AND i0.ikey = fi.ikey),
ok AS (SELECT *, concat_ws('-', taxon, coalesce(pop, 'NA'), coalesce(individual_id, 'NA'), 'NA', coalesce(entity, 'NA'), 'NA', 'NA', 'NA', 'field', 'NA', 'NA') AS okey FROM i),
ob AS (SELECT *, CASE WHEN value IS NOT NULL THEN dense_rank() OVER (PARTITION BY d, value IS NULL ORDER BY okey) END AS r FROM ok),
oc AS (SELECT *, max(r) OVER (PARTITION BY d) AS n FROM ob),
od AS (SELECT *, CASE WHEN r IS NOT NULL THEN """ + _PAD + """ END AS observation_id FROM oc)"""


@query(f"WITH {_OBS} SELECT k AS o_orderkey, pop AS population_id FROM p")
def population_id(t):
    return ids.population_ids(_observations(t)).select(F.col("_row").alias("o_orderkey"), "population_id")


@query(f"WITH {_OBS} SELECT k AS o_orderkey, individual_id FROM i")
def individual_id(t):
    return ids.individual_ids(ids.population_ids(_observations(t))).select(F.col("_row").alias("o_orderkey"), "individual_id")


def _with_observations(t):
    return ids.observation_ids(ids.individual_ids(ids.population_ids(_observations(t))))


@query(f"WITH {_OBS} SELECT k AS o_orderkey, observation_id FROM od")
def observation_id(t):
    return _with_observations(t).select(F.col("_row").alias("o_orderkey"), "observation_id")


@query(f"""WITH {_OBS}, rr AS (SELECT k, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY d, observation_id, trait, value IS NULL) AS n FROM od WINDOW w AS (PARTITION BY d, observation_id, trait, value IS NULL ORDER BY k))
SELECT k AS o_orderkey, CASE WHEN value IS NOT NULL THEN {_PAD} END AS repeat_measurements_id FROM rr""")
def repeat_measurements_id(t):
    return ids.repeat_measurement_ids(_with_observations(t), F.lit(True)).select(F.col("_row").alias("o_orderkey"), "repeat_measurements_id")


@query(f"""WITH k AS (SELECT o_orderkey, 'd' AS d, replace('taxon ' || (o_custkey % 40), ' ', '-') || '_' || o_orderpriority AS key FROM orders),
f AS (SELECT key, row_number() OVER (ORDER BY min(o_orderkey)) AS r, count(*) OVER () AS n FROM k GROUP BY key)
SELECT o_orderkey, 'd_' || {_PAD} AS parsing_id FROM k JOIN f USING (key)""")
def parsing_id(t):
    df = t("orders").select(F.lit("d").alias("dataset_id"), F.col("o_orderkey").alias("_row"), F.concat(F.lit("taxon "), (F.col("o_custkey") % 40).cast("string")).alias("taxon_name"), F.col("o_orderpriority").alias("location_name"))
    return ids.parsing_ids(df, None, True).select(F.col("_row").alias("o_orderkey"), "parsing_id")


@query(f"""WITH f AS (SELECT p_size, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL),
r AS (SELECT p_size, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY k) AS r, count(*) OVER (PARTITION BY p_size) AS n FROM f)
SELECT 'd' AS dataset_id, CAST(p_size AS VARCHAR) AS trait_name, p_brand AS methods, {_PAD} AS method_id FROM r""")
def method_id(t):
    return ids.method_ids(t("part").select(F.lit("d").alias("dataset_id"), F.col("p_size").cast("string").alias("trait_name"), F.col("p_brand").alias("methods"), F.col("p_partkey").alias("_row")))


# --- contexts and locations

def _contexts(t):
    spark = t("region").sparkSession
    values = [("o_orderpriority", "priority", [("1-URGENT", "high"), ("2-HIGH", "high"), ("5-LOW", "low"), ("3-MEDIUM", None)]), ("o_orderstatus", "status", [("F", "finished"), ("O", "open")])]
    table = spark.createDataFrame([("d", p, "entity_context", v, f, x, f"about {x}", n) for v, p, vs in values for n, (f, x) in enumerate(vs)], ctx.CONTEXT_COLUMNS)
    df = t("orders").select(F.lit("d").alias("dataset_id"), F.col("o_orderkey").alias("_row"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    df = ctx.map_contexts(df, table, ["o_orderpriority", "o_orderstatus"])
    return table, ctx.context_ids(df, "entity_context", ["o_orderpriority_mapped", "o_orderstatus_mapped"])


_CTX = f"""m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS a, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS b FROM orders),
k AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 'NA') || '_' || coalesce(b, 'NA') END AS key FROM m),
r AS (SELECT key, row_number() OVER (ORDER BY key) AS r, count(*) OVER () AS n FROM k WHERE key IS NOT NULL GROUP BY key),
c AS (SELECT k.*, CASE WHEN r IS NOT NULL THEN {_PAD} END AS id FROM k LEFT JOIN r USING (key))"""


@query(f"WITH {_CTX} SELECT o_orderkey, id AS entity_context_id FROM c")
def context_ids(t):
    return _contexts(t)[1].select("o_orderkey", "entity_context_id")


@query(f"""WITH {_CTX}, l AS (SELECT 'priority' AS p, a AS v, id, min(o_orderkey) AS f FROM c WHERE a IS NOT NULL AND id IS NOT NULL GROUP BY a, id UNION ALL SELECT 'status', b, id, min(o_orderkey) FROM c WHERE b IS NOT NULL AND id IS NOT NULL GROUP BY b, id)
SELECT 'd' AS dataset_id, p AS context_property, 'entity_context' AS category, v AS value, 'about ' || v AS description, 'entity_context_id' AS link_id, string_agg(id, ', ' ORDER BY f) AS link_vals FROM l GROUP BY p, v""")
def context_links(t):
    table, df = _contexts(t)
    return ctx.contexts_table(table, ctx.context_links(df, "entity_context", {"o_orderpriority_mapped": "priority", "o_orderstatus_mapped": "status"}))


@query("SELECT o_orderpriority AS value, min(o_orderkey) AS first FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def context_values_from_data(t):
    return ctx.values_from_data(t("orders"), "o_orderpriority", "o_orderkey")


def _locations(t):
    nation = t("nation").select(F.lit("d").alias("dataset_id"), F.col("n_name").alias("location_name"), F.col("n_nationkey").cast("string").alias("latitude (deg)"), F.when(F.col("n_regionkey") == 1, "adult").alias("life_stage"))
    return ctx.locations_table(reshape.to_eav(nation, ["dataset_id", "location_name"], ["latitude (deg)", "life_stage"], "location_property"))


_LOC = f"l AS (SELECT n_name, n_nationkey, n_regionkey, {_PAD} AS id FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS r, count(*) OVER () AS n FROM nation))"


@query(f"WITH {_LOC} SELECT 'd' AS dataset_id, id AS location_id, n_name AS location_name, 'latitude (deg)' AS location_property, CAST(n_nationkey AS VARCHAR) AS value FROM l UNION ALL SELECT 'd', id, n_name, 'life_stage', CASE WHEN n_regionkey = 1 THEN 'adult' END FROM l")
def locations_eav(t):
    return _locations(t)


def _placed(t):
    df = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    df = df.select(F.lit("d").alias("dataset_id"), "s_suppkey", F.col("n_name").alias("location_name"), F.when(F.col("s_suppkey") % 4 == 0, "species").when(F.col("s_suppkey") % 4 != 1, "individual").alias("entity_type"), F.lit("seedling").alias("life_stage"))
    return ctx.attach_locations(df, _locations(t))


@query(f"WITH {_LOC} SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 1 THEN id END AS location_id FROM supplier JOIN l ON s_nationkey = n_nationkey")
def location_join(t):
    return _placed(t).select("s_suppkey", "location_id")


@query(f"WITH {_LOC} SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 1 AND n_regionkey = 1 THEN 'adult' ELSE 'seedling' END AS life_stage FROM supplier JOIN l ON s_nationkey = n_nationkey")
def location_override(t):
    return ctx.override_by_location(_placed(t), _locations(t), ["life_stage"]).select("s_suppkey", "life_stage")


# --- identifiers, methods, taxonomy

@query("SELECT DISTINCT * FROM (SELECT s_suppkey AS observation_id, 'name' AS identifier_type, s_name AS identifier_value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier)")
def identifiers_melt(t):
    from .build import identifier_rows

    df = t("supplier").select(F.lit("d").alias("dataset_id"), F.col("s_suppkey").alias("observation_id"), "s_name", "s_nationkey")
    return identifier_rows(df, [{"var_in": "s_name", "identifier_type": "name"}, {"var_in": "s_nationkey", "identifier_type": "nation"}]).select("observation_id", "identifier_type", "identifier_value")


_METHODS = {
    "dataset": {"description": "market survey", "sampling_strategy": "all customers"},
    "source": {"primary": {"key": "Doe_2020", "bibtype": "Article", "author": "J. Doe and A. Roe", "year": "2020", "title": "Markets", "journal": "Trade", "volume": "3", "pages": "1-2"}},
    "contributors": {"data_collectors": [{"last_name": "Doe", "given_name": "J"}, {"last_name": "Roe", "given_name": "A"}], "dataset_curators": "Poe"},
}


@query(f"""WITH f AS (SELECT c_mktsegment AS trait_name, 'method ' || (c_nationkey % 3) AS methods, min(c_custkey) AS f FROM customer GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY trait_name ORDER BY f) AS r, count(*) OVER (PARTITION BY trait_name) AS n FROM f)
SELECT 'd' AS dataset_id, trait_name, methods, {_PAD} AS method_id, 'market survey' AS description, 'all customers' AS sampling_strategy, 'Doe_2020' AS source_primary_key,
  'J. Doe and A. Roe. "Markets".   _Trade_ 3 (2020), pp. 1-2.' AS source_primary_citation, NULL AS source_secondary_key, 'J Doe, A Roe' AS data_collectors, 'Poe' AS dataset_curators FROM g""")
def methods_full_join(t):
    from .build import methods_table

    listed = t("customer").select(F.lit("d").alias("dataset_id"), F.col("c_mktsegment").alias("trait_name"), F.concat(F.lit("method "), (F.col("c_nationkey") % 3).cast("string")).alias("methods"), F.col("c_custkey").alias("_row"))
    out = methods_table(listed.sparkSession, ids.method_ids(listed), _METHODS, "d")
    return out.select("dataset_id", "trait_name", "methods", "method_id", "description", "sampling_strategy", "source_primary_key", "source_primary_citation", "source_secondary_key", "data_collectors", "dataset_curators")


def _taxa(t):
    return t("nation").select(F.col("n_name").alias("aligned_name"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("accepted "), "n_name")).otherwise(F.col("n_name")).alias("taxon_name"), F.col("n_regionkey").cast("string").alias("family"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unlisted' WHEN n_regionkey > 1 THEN 'accepted ' || n_name ELSE n_name END AS taxon_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def taxonomy_join(t):
    df = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "unlisted").otherwise(F.col("n_name")).alias("taxon_name"))
    return taxonomy.accept_names(df, _taxa(t)).select("c_custkey", "taxon_name")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def taxa_dedupe(t):
    return reshape.first_per_key(t("part").select("p_brand", "p_partkey", "p_name").withColumn("o", F.col("p_partkey")), ["p_brand"], "o").drop("o")


@query("SELECT DISTINCT x.taxon_name, n.family FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'unlisted' ELSE n_name END AS taxon_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) x LEFT JOIN (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS family FROM nation) n ON n.n_name = x.taxon_name")
def taxa_table(t):
    names = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(F.col("s_suppkey") % 5 == 0, "unlisted").otherwise(F.col("n_name")).alias("taxon_name"))
    listed = t("nation").select(F.col("n_name").alias("taxon_name"), F.col("n_regionkey").cast("string").alias("family"), F.col("n_nationkey").alias("order"))
    return taxonomy.taxa_table(names, listed, "order").select("taxon_name", "family")


# --- databases and queries

@query("SELECT n_nationkey AS key, n_name AS name, 'a' AS dataset_id FROM nation UNION ALL SELECT r_regionkey, r_name, 'b' FROM region")
def bind_databases(t):
    one = db.Database({"taxa": t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("a").alias("dataset_id"))})
    two = db.Database({"taxa": t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("b").alias("dataset_id"))})
    return db.bind_databases([one, two])["taxa"]


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS observation_id, 'taxon ' || (o_custkey % 7) AS taxon_name, o_orderpriority AS trait_name, c_name AS location_name,
  CASE WHEN c_custkey IS NOT NULL THEN 'balance=''' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '''; nation=''' || n_name || '''' END AS location_properties,
  CASE o_orderstatus WHEN 'F' THEN 'delay=''none''; state=''done''' WHEN 'O' THEN 'state=''done''' END AS treatment_context_properties,
  CASE WHEN o_orderpriority <> '5-LOW' THEN 'by ' || o_orderpriority END AS methods, CASE WHEN o_custkey % 7 < 5 THEN 'family ' || (o_custkey % 7) END AS family
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def flatten_database(t):
    orders, spark = t("orders"), t("region").sparkSession
    taxon = F.concat(F.lit("taxon "), (F.col("o_custkey") % 7).cast("string"))
    traits = orders.select(F.lit("d").alias("dataset_id"), taxon.alias("taxon_name"), F.col("o_orderkey").alias("observation_id"), F.col("o_orderpriority").alias("trait_name"), F.col("o_custkey").alias("location_id"), F.col("o_orderstatus").alias("treatment_context_id"), F.lit("01").alias("method_id"))
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("d").alias("dataset_id"), F.col("c_custkey").alias("location_id"), F.col("c_name").alias("location_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("balance"), F.col("n_name").alias("nation"))
    states = spark.createDataFrame([("d", "state", "treatment_context", "done", None, "treatment_context_id", "F, O"), ("d", "delay", "treatment_context", "none", None, "treatment_context_id", "F"), ("d", "plot", "plot_context", "x", None, "plot_context_id", "01")], ", ".join(f"{c} string" for c in db.TABLES["contexts"]))
    methods = orders.filter("o_orderpriority <> '5-LOW'").select(F.lit("d").alias("dataset_id"), F.col("o_orderpriority").alias("trait_name"), F.concat(F.lit("by "), "o_orderpriority").alias("methods"), F.lit("01").alias("method_id")).distinct()
    taxa = orders.filter("o_custkey % 7 < 5").select(taxon.alias("taxon_name"), F.concat(F.lit("family "), (F.col("o_custkey") % 7).cast("string")).alias("family")).distinct()
    tables = {"traits": traits, "locations": reshape.to_eav(places, ["dataset_id", "location_id", "location_name"], ["balance", "nation"], "location_property"), "contexts": states, "methods": methods, "taxa": taxa}
    flat = db.flatten_database(db.Database({n: reshape.conform(x, db.TABLES[n]) for n, x in tables.items()}))
    return flat.select("observation_id", "taxon_name", "trait_name", "location_name", "location_properties", "treatment_context_properties", "methods", "family")


@query("SELECT o_orderpriority AS dataset_id, CAST(o_orderkey AS VARCHAR) AS observation_id, CAST(o_custkey AS VARCHAR) AS taxon_name, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS value FROM orders")
def sink_roundtrip(t):
    orders = t("orders")
    traits = orders.select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("taxon_name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("value"))
    path = scratch.new_path(orders.sparkSession)
    src.write_database(db.Database({"traits": reshape.conform(traits, db.TABLES["traits"])}), path)
    return src.read_database(orders.sparkSession, path)["traits"].select("dataset_id", "observation_id", "taxon_name", "value")


@query("SELECT DISTINCT l_partkey AS taxon_name, l_suppkey AS dataset_id FROM lineitem WHERE l_partkey IN (1, 5, 9, 42)")
def find_taxon(t):
    return db.find_taxon(t("lineitem").select(F.col("l_partkey").alias("taxon_name"), F.col("l_suppkey").alias("dataset_id")), [1, 5, 9, 42])


@query("SELECT l_partkey, l_suppkey, l_returnflag AS trait_name, count(*) AS number_of_duplicates FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pivot_duplicates(t):
    return db.pivot_duplicates(t("lineitem").withColumnRenamed("l_returnflag", "trait_name"), ["l_partkey", "l_suppkey"])


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(t):
    return suggest.rows_of(t("customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def distinct_values(t):
    return suggest.values_of(t("events"), "event_type")


@query("""SELECT o_orderkey, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 12 END AS position FROM (SELECT o_orderkey, o_orderkey % 3 AS k FROM orders)""")
def levels_sort(t):
    df = t("orders").withColumn("value_type", F.when(F.col("o_orderkey") % 3 == 0, "mean").when(F.col("o_orderkey") % 3 == 1, "raw").otherwise("other"))
    return df.select("o_orderkey", db.value_type_order().cast("int").alias("position")).orderBy("position", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'")
def custom_transform(t):
    from .hooks import apply_steps

    steps = [{"filter": "o_orderstatus = 'F'"}, {"with": {"doubled": "o_totalprice * 2"}}, {"group_row_number": {"by": ["o_custkey"], "order": ["o_orderkey"], "name": "place"}}, {"select": ["o_orderkey", "doubled", "place"]}]
    return apply_steps(t("orders"), steps)


# --- reports

@query("SELECT event_type, count(DISTINCT user_id) AS taxa, count(*) AS records, round_even(count(*) / count(DISTINCT user_id), 2) AS records_per_taxon FROM events GROUP BY 1")
def report_trait_counts(t):
    return reports.trait_counts(t("events"), "event_type", "user_id")


@query("SELECT median(records_per_taxon) AS median_records_per_taxon FROM (SELECT round_even(count(*) / count(DISTINCT user_id), 2) AS records_per_taxon FROM events GROUP BY event_type)")
def report_records_per_taxon_median(t):
    return reports.median_records_per_taxon(t("events"), "event_type", "user_id")


@query("SELECT coalesce(k, n_nationkey) AS nationkey, records, n_name FROM (SELECT CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE c_nationkey + 100 END AS k, count(*) AS records FROM customer GROUP BY 1) FULL JOIN nation ON k = n_nationkey")
def report_location_counts(t):
    key = F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 100)
    return reports.location_counts(t("customer").withColumn("nationkey", key), t("nation").select(F.col("n_nationkey").alias("nationkey"), "n_name"), "nationkey")


@query(f"SELECT event_type, error, count(*) AS records FROM ({_SQL['error_lattice']}) JOIN events USING (event_id) WHERE error IS NOT NULL GROUP BY ALL")
def report_excluded_counts(t):
    return reports.excluded_counts(_lattice(t), "event_type", "error")


@query("SELECT o_orderpriority, count(*) AS records, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def report_share(t):
    return reports.shares(t("orders"), "o_orderpriority")


@query("SELECT b.o_orderpriority, coalesce(a.n, 0) AS study, b.n AS total FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey = 1 GROUP BY 1) a RIGHT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) b USING (o_orderpriority)")
def report_value_counts(t):
    return reports.compare_counts(t("orders").filter("o_custkey = 1"), t("orders"), "o_orderpriority")


@query("SELECT * FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER w / count(*) OVER (PARTITION BY o_orderpriority) * 100 AS percentile FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)) WHERE percentile < 2.5 OR percentile > 97.5")
def report_outliers(t):
    return reports.outliers(t("orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_orderpriority", "percentile")


@query("SELECT l_returnflag, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, count(l_extendedprice) AS records FROM lineitem GROUP BY 1")
def report_minmax(t):
    return reports.limits(t("lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT DISTINCT p_brand, p_type, levenshtein(p_brand, p_type) AS distance FROM part WHERE p_brand <> p_type")
def report_edit_distance(t):
    return reports.name_changes(t("part"), "p_brand", "p_type")


@query(f"SELECT DISTINCT CASE event_type WHEN 'click' THEN 'habit' END AS trait_name, CASE WHEN event_id % 7 = 0 THEN 'café' WHEN event_id % 7 = 1 THEN 'small steel' WHEN event_id % 7 = 2 THEN 'YYNN' WHEN event_id % 7 = 3 THEN 'yyyynnnnyyyy' WHEN event_id % 7 = 4 THEN '12x' ELSE CAST(user_id AS VARCHAR) END AS value FROM ({_SQL['error_lattice']}) JOIN events USING (event_id) WHERE error = 'Unsupported trait value'")
def report_unaligned(t):
    return reports.unaligned_values(_lattice(t))


@query("SELECT c_custkey AS location_id, c_name AS location_name, c_mktsegment AS soil, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS rain FROM customer")
def report_more_properties(t):
    wide = t("customer").select(F.col("c_custkey").alias("location_id"), F.col("c_name").alias("location_name"), F.col("c_acctbal").alias("latitude (deg)"), F.col("c_mktsegment").alias("soil"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("rain"))
    long = reshape.to_eav(wide, ["location_id", "location_name"], ["latitude (deg)", "soil", "rain"], "location_property")
    return reports.more_properties(long, ["latitude (deg)", "longitude (deg)", "description"], ["latitude (deg)", "soil", "rain"])


@query("""SELECT 'd' || n_regionkey AS dataset_id, 'letter' AS context_property, 'plot_context' AS category, string_agg(n_name || '=' || lower(n_name) || ':' || (n_nationkey % 3 + 1), '; ' ORDER BY n_name) AS listed, CAST(count(*) AS INTEGER) AS n_values FROM nation GROUP BY n_regionkey""")
def report_contexts(t):
    ids_used = F.when(F.col("n_nationkey") % 3 == 0, "01").when(F.col("n_nationkey") % 3 == 1, "01, 02").otherwise("01, 02, 05")
    rows = t("nation").select(F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("dataset_id"), F.lit("letter").alias("context_property"), F.lit("plot_context").alias("category"), F.col("n_name").alias("value"), F.lower("n_name").alias("description"), ids_used.alias("link_vals"))
    listed = F.array_join(F.transform("values", lambda v: F.concat(v["value"], F.lit("="), v["description"], F.lit(":"), v["n_ids"].cast("string"))), "; ")
    return reports.contexts_by_property(rows).select("dataset_id", "context_property", "category", listed.alias("listed"), "n_values")


# --- validation, triples, pipeline

@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def validate_membership(t):
    from .validate import not_members

    return not_members(t("customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def validate_unique(t):
    from .validate import repeated

    return repeated(t("lineitem"), "l_partkey")


@query("""SELECT * FROM (SELECT 'tokens allowed' AS rule, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS failures
  UNION ALL SELECT 'name present', (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL) UNION ALL SELECT 'key unique', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)))""")
def validate_dataset(t):
    from .validate import findings

    return findings(t("orders"), {"tokens allowed": ("member", "o_orderpriority", ["1-URGENT", "2-HIGH"]), "name present": ("present", "o_orderstatus", None), "key unique": ("unique", "o_custkey", None)})


_PROGRAM = {
    "source": {"primary": {"key": "a", "bibtype": "Article", "author": "x", "title": "y"}}, "contributors": {"data_collectors": [], "dataset_curators": "x"},
    "dataset": {"data_is_long_format": True, "taxon_name": "o_custkey", "location_name": "o_orderstatus", "trait_name": "o_orderpriority", "value": "o_totalprice", "basis_of_record": "o_orderstatus"},
    "identifiers": None, "locations": {"F": {"latitude (deg)": "1", "longitude (deg)": "2"}, "X": {"latitude (deg)": "1"}}, "contexts": None,
    "traits": [{"var_in": v, "unit_in": "u", "trait_name": "size", "value_type": w, "basis_of_value": "measurement"} for v, w in (("1-URGENT", "raw"), ("2-HIGH", "guess"))],
    "substitutions": None, "taxonomic_updates": [{"find": "nobody", "replace": "x", "reason": "r", "taxonomic_resolution": "genus"}], "exclude_observations": [{"variable": "taxon_name", "find": "no one, somebody", "reason": "r"}], "questions": None,
}


@query("""SELECT DISTINCT 'traits: all of the data mapped' AS rule, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT DISTINCT 'locations: all of the data described', o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT DISTINCT 'vocabulary: basis_of_record in data', o_orderstatus FROM orders
  UNION ALL SELECT * FROM (VALUES ('locations: all described in the data', 'X'), ('locations: coordinates or ranges', 'X'), ('source: fields', 'primary.year'), ('traits: value types', 'guess'),
    ('taxonomic_updates: find in data', 'nobody'), ('exclude_observations: taxon_name in data', 'no one'), ('exclude_observations: taxon_name in data', 'somebody'))""")
def validate_program(t):
    from .validate import failures

    return failures(_PROGRAM, t("orders").select([F.col(c).cast("string").alias(c) for c in t("orders").columns]), {"size": {"type": "numeric"}})


@query("""SELECT o_orderkey || ',' || o_orderpriority AS record FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || ',more' FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey % 97 <> 0""")
def corrupt_records(t):
    """Rows of CSV files that are shorter or longer than their header, over many files."""
    k, spark, path = F.col("o_orderkey"), t("region").sparkSession, scratch.new_path(t("region").sparkSession)
    line = F.when(k % 97 == 0, F.concat_ws(",", k, "o_orderpriority")).when(k % 101 == 0, F.concat_ws(",", k, "o_orderpriority", "o_orderstatus", F.lit("more"))).otherwise(F.concat_ws(",", k, "o_orderpriority", "o_orderstatus"))
    # each file starts with its header
    lines = t("orders").select((F.col("o_custkey") % 8).alias("file"), k.alias("row"), line.alias("value"))
    lines = lines.unionByName(spark.range(8).select(F.col("id").alias("file"), F.lit(-1).cast("long").alias("row"), F.lit("order,priority,status").alias("value")))
    lines.repartitionByRange(8, "file").sortWithinPartitions("file", "row").select("file", "value").write.partitionBy("file").text(path)
    return src.corrupt_rows(spark, [f"{path}/file={n}" for n in range(8)]).select("record")


@query("""SELECT * FROM (VALUES ('price', '12345678'), ('taxon_name', 'taxon 99')) v(variable, value) UNION ALL SELECT 'state', 'x' UNION ALL SELECT 'location_name', 'nowhere'""")
def validate_exclusions(t):
    """Texts that a program excludes but the parsed rows lack."""
    from .build import parse_dataset
    from .validate import parsed_exclusions

    data = t("orders").select(F.col("o_orderkey").alias("_row"), F.concat(F.lit("taxon "), (F.col("o_custkey") % 40).cast("string")).alias("taxon"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), tx.number_text(F.col("o_totalprice")).alias("total"))
    wrong = [("price", "12345678"), ("state", "f, x"), ("taxon_name", "taxon 3, taxon 99"), ("location_name", "5-LOW, nowhere")]
    program = {**_DATASET, "exclude_observations": [{"variable": v, "find": f, "reason": "r"} for v, f in wrong]}
    return parsed_exclusions(parse_dataset(data.sparkSession, "orders", data, program).long, program)


@query("""SELECT DISTINCT 'https://x/' || n_nationkey AS subject, p AS predicate, o AS object FROM (SELECT n_nationkey, 'https://p/name' AS p, '"' || n_name || '"' AS o FROM nation UNION ALL SELECT n_nationkey, 'https://p/region', '<https://r/' || n_regionkey || '>' FROM nation)""")
def triples(t):
    df = t("nation").withColumn("region", F.concat(F.lit("https://r/"), F.col("n_regionkey").cast("string")))
    return tri.triples(df, F.concat(F.lit("https://x/"), F.col("n_nationkey").cast("string")), {"n_name": "https://p/name", "region": "https://p/region"})


_TERMS = [("prefLabel", "p_name"), ("comment", "concat('about ', p_name)"), ("broader", "concat('size', p_size)"), ("exactMatch", "concat('brand:', p_brand)"), ("datatype", "'xsd:double'"), ("inScheme", "'any'"), ("created", "concat('2020-01-', lpad(cast(p_size % 28 + 1 as string), 2, '0'))")]


@query("""SELECT DISTINCT CASE WHEN p_partkey = 1 THEN '<https://v>' ELSE '<https://v#' || p_partkey || '>' END AS subject, '<https://p#' || p || '>' AS predicate, o AS object FROM (
  SELECT p_partkey, 'prefLabel' AS p, '"' || trim(unnest(string_split(p_name, ' '))) || '"@en' AS o FROM part UNION ALL SELECT p_partkey, 'comment', '"about ' || p_name || '"@en' FROM part
  UNION ALL SELECT p_partkey, 'broader', '<https://v#size' || p_size || '>' FROM part UNION ALL SELECT p_partkey, 'exactMatch', CASE WHEN p_brand LIKE '%1' THEN '<NA>' ELSE '<https://b/' || p_brand || '>' END FROM part
  UNION ALL SELECT p_partkey, 'datatype', '<xsd:double>' FROM part UNION ALL SELECT p_partkey, 'inScheme', '<https://v>' FROM part
  UNION ALL SELECT p_partkey, 'created', '"2020-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '"^^<xsd:date>' FROM part)""")
def triples_typed(t):
    """All six kinds of objects, names looked up in a table of identifiers."""
    part = t("part")
    pairs = F.explode(F.array(*[F.struct(F.lit(f"https://p#{p}").alias("predicate"), (F.replace("p_name", F.lit(" "), F.lit("; ")) if p == "prefLabel" else F.expr(x)).alias("value")) for p, x in _TERMS]))
    rows = part.select(F.when(F.col("p_partkey") == 1, "v").otherwise(F.col("p_partkey").cast("string")).alias("subject"), pairs.alias("e")).select("subject", "e.*")
    known = part.filter("p_brand not like '%1'").select(F.concat(F.lit("brand:"), "p_brand").alias("identifier"), F.concat(F.lit("https://b/"), "p_brand").alias("entity"))
    return tri.typed_triples(rows, known, "https://v", "v")


@query("""WITH u AS (SELECT p_partkey AS k, p_size, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS w2 FROM part),
n AS (SELECT w2 AS aligned, min(CASE p_size % 4 WHEN 0 THEN 'genus' WHEN 1 THEN 'species' END) AS res FROM u GROUP BY 1),
one AS (SELECT w2 AS name, 'A' || min(k) AS id, CASE WHEN min(k) % 2 = 0 THEN 'synonym' ELSE 'accepted' END AS status, min(k) AS k FROM u WHERE k % 3 = 0 GROUP BY 1),
two AS (SELECT w1 AS name, 'B' || min(k) AS id FROM u GROUP BY 1), two2 AS (SELECT w2 AS name, 'C' || min(k) AS id FROM u WHERE k % 3 = 1 GROUP BY 1),
m AS (SELECT n.aligned, n.res, split_part(aligned, ' ', 1) AS g, CASE WHEN res = 'genus' THEN split_part(aligned, ' ', 1) ELSE aligned END AS key FROM n)
SELECT m.aligned AS aligned_name, m.aligned AS taxon_name, coalesce(CASE WHEN one.name IS NOT NULL THEN 'species' END, CASE WHEN two.name IS NOT NULL THEN 'genus' WHEN two2.name IS NOT NULL THEN 'species' END, m.res) AS taxon_rank,
  CASE WHEN one.name IS NOT NULL THEN 'one' WHEN two.name IS NOT NULL OR two2.name IS NOT NULL THEN 'two' END AS taxonomic_dataset, coalesce(one.status, 'unknown') AS taxonomic_status,
  CASE WHEN m.res = 'genus' THEN NULL WHEN one.name IS NOT NULL THEN one.id ELSE two2.id END AS taxon_id, m.g AS genus, 'B' || g.k AS taxon_id_genus, al.id AS aligned_name_taxon_id,
  CASE WHEN m.res = 'genus' THEN NULL ELSE m.aligned END AS binomial
FROM m LEFT JOIN one ON one.name = m.key LEFT JOIN two ON two.name = m.key LEFT JOIN two2 ON two2.name = m.key LEFT JOIN one al ON al.name = m.aligned LEFT JOIN (SELECT w1, min(k) AS k FROM u GROUP BY 1) g ON g.w1 = m.g
WHERE coalesce(m.res, one.name, two.name, two2.name) IS NOT NULL""")
def taxon_list(t):
    """A list of names built from two reference lists, in order of priority."""
    from ..operators.taxon_list import build_taxon_list

    k, w1, w2 = F.col("p_partkey"), F.split("p_name", " ")[0], tx.word(F.col("p_name"), 1, 2)
    part = t("part").select(k.alias("k"), "p_size", w1.alias("w1"), w2.alias("w2"))
    updates = part.select(F.col("k").cast("string").alias("original_name"), F.col("w2").alias("aligned_name"), F.when(F.col("p_size") % 4 == 0, "genus").when(F.col("p_size") % 4 == 1, "species").alias("taxonomic_resolution"))
    first = lambda df, name: df.groupBy(F.col(name).alias("canonical_name")).agg(F.min("k").alias("k"))
    listed = lambda df, mark, rank, status: df.select("canonical_name", F.lit(rank).alias("taxon_rank"), F.col("canonical_name").alias("accepted_name"), F.concat(F.lit(mark), F.col("k").cast("string")).alias("taxon_id"), status.alias("taxonomic_status"), "k")
    one = listed(first(part.filter("k % 3 = 0"), "w2"), "A", "species", F.when(F.col("k") % 2 == 0, "synonym").otherwise("accepted"))
    none = F.lit(None).cast("string")
    two = listed(first(part, "w1"), "B", "genus", none).unionByName(listed(first(part.filter("k % 3 = 1"), "w2"), "C", "species", none))
    genera = first(part, "w1").select(F.col("canonical_name").alias("genus"), F.concat(F.lit("B"), F.col("k").cast("string")).alias("taxon_id"))
    nothing = t("region").limit(0).select(none.alias("family"), none.alias("taxon_id"))
    ranks = t("region").limit(0).select(none.alias("taxon_name"), none.alias("taxon_rank"))
    out = build_taxon_list(updates, ranks, [("one", one), ("two", two)], genera, nothing, order="k")
    return out.select("aligned_name", "taxon_name", "taxon_rank", "taxonomic_dataset", "taxonomic_status", "taxon_id", "genus", "taxon_id_genus", "aligned_name_taxon_id", "binomial")


_FLAGSHIP_MAPS = [TraitMap("l_quantity", "quantity", "t"), TraitMap("l_extendedprice", "price", "usd"), TraitMap("l_discount", "discount", "ratio"), TraitMap("l_tax", "unlisted", "ratio")]


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, 'quantity' AS trait_name, l_quantity AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'unlisted', l_tax FROM lineitem),
c AS (SELECT *, CASE trait_name WHEN 'quantity' THEN x * 1000 WHEN 'discount' THEN x * 100 ELSE x END AS v FROM m)
SELECT l_orderkey, l_linenumber, trait_name, CASE WHEN trait_name = 'unlisted' THEN printf('%.15g', x) ELSE printf('%.15g', v) END AS value,
  CASE trait_name WHEN 'quantity' THEN 'kg' WHEN 'price' THEN 'usd' WHEN 'discount' THEN '%' ELSE 'ratio' END AS unit,
  CASE WHEN trait_name = 'unlisted' THEN 'Trait name not in trait dictionary' WHEN trait_name = 'quantity' AND v > 45000 THEN 'Value out of allowable range' WHEN trait_name = 'price' AND v < 2000 THEN 'Value out of allowable range' END AS error FROM c""")
def pipeline_end_to_end(t):
    spark = t("region").sparkSession
    table = spark.createDataFrame([("quantity", "numeric", "kg", 0.0, 45000.0, None), ("price", "numeric", "usd", 2000.0, 1e9, None), ("discount", "numeric", "%", 0.0, 100.0, None)], rules.DICTIONARY)
    text = t("lineitem").withColumns({m.var_in: tx.number_text(F.col(m.var_in)) for m in _FLAGSHIP_MAPS})
    df = reshape.wide_to_long(text, _FLAGSHIP_MAPS, ["l_orderkey", "l_linenumber"]).withColumns({"taxon_name": F.lit("x"), "value_type": F.lit("raw")})
    df = rules.with_dictionary(df, table).withColumn("error", rules.value_error())
    df = rules.convert_units(df, {k: rules.parse_conversion(v) for k, v in {"t-kg": "x*1000", "ratio-%": "x*100"}.items()})
    return df.withColumn("error", rules.range_error(F.col("error"))).select("l_orderkey", "l_linenumber", "trait_name", tx.printf_notation(F.col("value")).alias("value"), "unit", "error")


_DATASET = {
    "source": {"primary": {"key": "Doe_2020", "bibtype": "Article", "author": "J. Doe", "year": "2020", "title": "Orders"}}, "contributors": {"data_collectors": [{"last_name": "Doe", "given_name": "J"}], "dataset_curators": "Roe"},
    "dataset": {"data_is_long_format": False, "taxon_name": "taxon", "location_name": "priority", "basis_of_record": "field"},
    "locations": {"1-URGENT": {"latitude (deg)": "1", "longitude (deg)": "2"}, "2-HIGH": {"latitude (deg)": "3", "longitude (deg)": "4", "life_stage": "adult"}, "5-LOW": {"latitude (deg)": "5", "longitude (deg)": "6", "unit": "none"}},
    "contexts": [{"context_property": "progress", "category": "treatment_context", "var_in": "status", "values": [{"find": "F", "value": "finished"}, {"find": "O", "value": "open"}]}],
    "traits": [{"var_in": "total", "unit_in": "cents", "trait_name": "price", "entity_type": "individual", "value_type": "raw", "basis_of_value": "measurement", "methods": "ledger"}, {"var_in": "status", "unit_in": "none", "trait_name": "state", "entity_type": "species", "value_type": "mode", "basis_of_value": "expert_score", "methods": "asked"}],
    "substitutions": [{"trait_name": "state", "find": "O", "replace": "open"}],
    "taxonomic_updates": [{"find": "taxon 1", "replace": "Taxon one", "reason": "x", "taxonomic_resolution": "species"}],
    "exclude_observations": [{"variable": "taxon_name", "find": "taxon 3", "reason": "x"}],
}


@query(f"""WITH o AS (SELECT o_orderkey AS k, 'taxon ' || (o_custkey % 40) AS taxon, o_orderpriority AS loc, o_orderstatus AS st, o_totalprice AS x, CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '02' END AS ctx FROM orders),
pk AS (SELECT *, loc || 'NA' || coalesce(ctx, 'NA') AS pkey FROM o),
pf AS (SELECT pkey, row_number() OVER (ORDER BY min(k)) AS r, count(*) OVER () AS n FROM pk GROUP BY pkey),
p AS (SELECT pk.*, {_PAD} AS pop FROM pk JOIN pf USING (pkey)),
i AS (SELECT *, row_number() OVER (PARTITION BY taxon, pop ORDER BY k) AS r, count(*) OVER (PARTITION BY taxon, pop) AS n FROM p),
j AS (SELECT k, taxon, loc, st, x, ctx, pop, {_PAD} AS ind, CASE loc WHEN '2-HIGH' THEN 'adult' END AS stage FROM i),
l AS (SELECT k, taxon, ctx, pop, ind, stage, CASE loc WHEN '1-URGENT' THEN '01' WHEN '2-HIGH' THEN '02' WHEN '5-LOW' THEN '03' END AS location_id, 'price' AS trait_name, 'individual' AS entity_type, 'raw' AS value_type,
    CASE WHEN taxon = 'taxon 3' THEN 'Observation excluded in metadata' WHEN x / 100 NOT BETWEEN 20 AND 3000 THEN 'Value out of allowable range' END AS error,
    printf('%.15g', CASE WHEN taxon = 'taxon 3' THEN x ELSE x / 100 END) AS value, CASE WHEN taxon = 'taxon 3' THEN 'cents' ELSE 'usd' END AS unit,
    concat_ws('-', taxon, pop, ind, 'NA', 'individual', coalesce(stage, 'NA'), 'NA', 'NA', 'field', 'NA', 'NA') AS okey FROM j
  UNION ALL SELECT k, taxon, ctx, NULL, NULL, NULL, NULL, 'state', 'species', 'mode', CASE WHEN taxon = 'taxon 3' THEN 'Observation excluded in metadata' WHEN st = 'P' THEN 'Unsupported trait value' END,
    CASE st WHEN 'O' THEN 'open' ELSE lower(st) END, NULL, concat_ws('-', taxon, 'NA', 'NA', 'NA', 'species', 'NA', 'NA', 'NA', 'field', 'NA', 'NA') FROM j),
d AS (SELECT *, dense_rank() OVER (ORDER BY okey) AS r FROM l),
e AS (SELECT *, max(r) OVER () AS n FROM d)
SELECT error, CASE WHEN taxon = 'taxon 1' THEN 'Taxon one' ELSE 'T' || substr(taxon, 2) END AS taxon_name, taxon AS original_name, {_PAD} AS observation_id, trait_name, value, unit, entity_type, value_type, stage AS life_stage,
  pop AS population_id, ind AS individual_id, location_id, ctx AS treatment_context_id, '01' AS method_id FROM e""")
def process_dataset(t):
    built = _built(t)
    out = built["traits"].withColumn("error", F.lit(None).cast("string")).unionByName(built["excluded_data"])
    return out.select("error", "taxon_name", "original_name", "observation_id", "trait_name", tx.printf_notation(F.col("value")).alias("value"), "unit", "entity_type", "value_type", "life_stage", "population_id", "individual_id", "location_id", "treatment_context_id", "method_id")


def _built(t) -> db.Database:
    """All orders as a dataset."""
    from .build import process_dataset as process

    data = t("orders").select(F.col("o_orderkey").alias("_row"), F.concat(F.lit("taxon "), (F.col("o_custkey") % 40).cast("string")).alias("taxon"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), tx.number_text(F.col("o_totalprice")).alias("total"))
    definitions = {"price": {"type": "numeric", "units": "usd", "allowed_values_min": 20, "allowed_values_max": 3000}, "state": {"type": "categorical", "allowed_values_levels": {"f": "", "open": ""}}}
    return process(data.sparkSession, "orders", data, _DATASET, definitions, {"cents-usd": rules.parse_conversion("x/100")})


_MANY_SQL = f"""WITH o AS (SELECT 'set' || (o_custkey % 3) AS d, o_orderkey AS k, 'taxon ' || (o_custkey % 40) AS taxon, o_orderpriority AS loc, o_orderstatus AS st, CAST(o_totalprice AS DOUBLE) AS x FROM orders),
c AS (SELECT *, CASE WHEN d = 'set0' THEN CASE st WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END WHEN d = 'set1' THEN st END AS cv FROM o),
cr AS (SELECT d, cv, row_number() OVER (PARTITION BY d ORDER BY cv) AS r, count(*) OVER (PARTITION BY d) AS n FROM (SELECT DISTINCT d, cv FROM c WHERE cv IS NOT NULL)),
ci AS (SELECT c.*, CASE WHEN cr.r IS NOT NULL THEN {_PAD} END AS ctx FROM c LEFT JOIN cr ON c.d = cr.d AND c.cv = cr.cv),
pk AS (SELECT *, loc || 'NA' || coalesce(ctx, 'NA') AS pkey FROM ci),
pf AS (SELECT d, pkey, row_number() OVER (PARTITION BY d ORDER BY min(k)) AS r, count(*) OVER (PARTITION BY d) AS n FROM pk GROUP BY d, pkey),
p AS (SELECT pk.*, {_PAD} AS pop FROM pk JOIN pf USING (d, pkey)),
i AS (SELECT *, row_number() OVER (PARTITION BY d, taxon, pop ORDER BY k) AS r, count(*) OVER (PARTITION BY d, taxon, pop) AS n FROM p),
j AS (SELECT d, k, taxon, loc, st, x, ctx, pop, {_PAD} AS ind FROM i),
l AS (SELECT d, k, taxon, loc, ctx, pop, ind, 'price' AS trait_name, CASE WHEN d = 'set2' AND taxon = 'taxon 5' THEN 'Observation excluded in metadata' WHEN d = 'set1' THEN CASE WHEN st = 'P' THEN 'Missing unit conversion' END END AS error, x, st,
    concat_ws('-', taxon, pop, ind, 'NA', 'individual', CASE WHEN d = 'set0' AND loc = '2-HIGH' THEN 'adult' ELSE 'NA' END, 'NA', 'NA', 'field', 'NA', 'NA') AS okey FROM j),
q AS (SELECT *, dense_rank() OVER (PARTITION BY d ORDER BY okey) AS r FROM l),
e AS (SELECT *, max(r) OVER (PARTITION BY d) AS n FROM q)
SELECT d AS dataset_id, k AS o_orderkey, error, CASE WHEN d = 'set0' THEN CASE WHEN taxon = 'taxon 3' THEN 'Taxon three' ELSE 'T' || substr(taxon, 2) END ELSE taxon END AS taxon_name, {_PAD} AS observation_id,
  printf('%.15g', CASE WHEN d = 'set0' THEN x / 100 WHEN d = 'set1' AND st = 'F' THEN x / 100 ELSE x END) AS value, CASE WHEN d = 'set2' AND taxon <> 'taxon 5' THEN 'usd' WHEN d = 'set2' THEN 'usd' WHEN d = 'set0' OR st <> 'P' THEN 'usd' ELSE 'pounds' END AS unit,
  pop AS population_id, ind AS individual_id, ctx AS plot_context_id, CASE WHEN d = 'set0' AND loc IN ('1-URGENT', '2-HIGH') THEN CASE loc WHEN '1-URGENT' THEN '01' ELSE '02' END END AS location_id FROM e"""


def _many(t) -> db.Database:
    """All orders as three datasets of different programs, built in one plan."""
    from . import compilation

    status = F.col("o_orderstatus")
    rows = t("orders").select(
        F.concat(F.lit("set"), (F.col("o_custkey") % 3).cast("string")).alias("set"), F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("order_key"), F.concat(F.lit("taxon "), (F.col("o_custkey") % 40).cast("string")).alias("taxon"),
        F.col("o_orderpriority").alias("priority"), status.alias("status"), tx.number_text(F.col("o_totalprice")).alias("total"), F.when(status == "F", "cents").when(status == "O", "usd").otherwise("pounds").alias("currency"))
    price = lambda unit: [{"var_in": "total", "unit_in": unit, "trait_name": "price", "entity_type": "individual", "value_type": "raw", "basis_of_value": "measurement", "methods": "ledger", "measurement_remarks": "order_key"}]
    plot = {"context_property": "progress", "category": "plot_context", "var_in": "status"}
    base = {"dataset": {"data_is_long_format": False, "taxon_name": "taxon", "location_name": "priority", "basis_of_record": "field"}, "source": _DATASET["source"], "contributors": _DATASET["contributors"]}
    programs = {
        "set0": {**base, "traits": price("cents"), "contexts": [{**plot, "values": [{"find": "F", "value": "finished"}, {"find": "O", "value": "open"}]}], "locations": {"1-URGENT": {"latitude (deg)": 1}, "2-HIGH": {"latitude (deg)": 3, "life_stage": "adult"}}, "taxonomic_updates": [{"find": "taxon 3", "replace": "Taxon three", "reason": "x"}]},
        "set1": {**base, "traits": price("currency"), "contexts": [plot]},
        "set2": {**base, "traits": price("usd"), "exclude_observations": [{"variable": "taxon_name", "find": "taxon 5", "reason": "x"}]},
    }
    columns = {d: [c for c in rows.columns if c not in ("set", "_row")] for d in programs}
    return compilation.compile_datasets(rows.sparkSession, compilation.cells_of(rows, "set"), columns, programs, {"price": {"type": "numeric", "units": "usd"}}, {"cents-usd": rules.parse_conversion("x/100")})


@query(_MANY_SQL)
def build_many(t):
    built = _many(t)
    out = built["traits"].withColumn("error", F.lit(None).cast("string")).unionByName(built["excluded_data"])
    return out.select("dataset_id", F.col("measurement_remarks").cast("long").alias("o_orderkey"), "error", "taxon_name", "observation_id", "value", "unit", "population_id", "individual_id", "plot_context_id", "location_id")


@query("""SELECT 'set' || (o_custkey % 5) AS dataset_id, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_custkey % 5 = 1 THEN printf('%.15g', CAST(o_totalprice AS DOUBLE) / 100) ELSE printf('%.15g', CAST(o_totalprice AS DOUBLE)) END AS value,
  CASE o_custkey % 5 WHEN 1 THEN 'built again' WHEN 3 THEN 'built again' ELSE 'kept' END AS change FROM orders WHERE o_custkey % 5 <> 4 AND NOT (o_custkey % 5 = 3 AND o_orderkey % 7 = 0)""")
def incremental_build(t):
    """A database of five datasets, updated after one program and one dataset's rows changed, and one dataset went."""
    from . import compilation, incremental

    orders = t("orders").select(F.concat(F.lit("set"), (F.col("o_custkey") % 5).cast("string")).alias("set"), F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("taxon"), tx.number_text(F.col("o_totalprice")).alias("total"))
    spark, path = orders.sparkSession, scratch.new_path(orders.sparkSession)
    program = lambda unit: {"dataset": {"data_is_long_format": False, "taxon_name": "taxon", "measurement_remarks": "order_key"}, "traits": [{"var_in": "total", "unit_in": unit, "trait_name": "price", "entity_type": "species", "value_type": "raw"}]}
    now = lambda rows, programs: incremental.update(compilation.cells_of(rows, "set"), dict.fromkeys(programs, ["order_key", "taxon", "total"]), programs, path, {"price": {"type": "numeric", "units": "usd"}}, {"cents-usd": rules.parse_conversion("x/100")})
    now(orders, {f"set{k}": program("usd") for k in range(5)})
    changes = now(orders.filter("not (set = 'set3' and order_key % 7 = 0) and set <> 'set4'"), {f"set{k}": program("cents" if k == 1 else "usd") for k in range(4)})
    told = reshape.records_to_rows(spark, [{"dataset_id": d, "change": "built again"} for d in changes.built] + [{"dataset_id": d, "change": "kept"} for d in changes.kept])
    return src.read_database(spark, path)["traits"].join(told, "dataset_id", "left").select("dataset_id", F.col("measurement_remarks").alias("o_orderkey"), tx.printf_notation(F.col("value")).alias("value"), "change")


@query("""SELECT 'set' || (o_custkey % 3) AS dataset_id, CAST(o_orderkey AS VARCHAR) AS o_orderkey, printf('%.15g', CAST(o_totalprice AS DOUBLE) / 100) AS value, lpad(CAST(r AS VARCHAR), CAST(greatest(2, ceil(log10(n))) AS INTEGER), '0') AS observation_id
  FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderpriority) AS r FROM orders) JOIN (SELECT o_custkey % 3 AS d, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) ON d = o_custkey % 3""")
def streaming_build(t):
    """Three datasets whose rows arrive in micro-batches, each batch building those that it touches."""
    from ..streaming import ingest
    from . import compilation

    orders = t("orders").select(F.concat(F.lit("set"), (F.col("o_custkey") % 3).cast("string")).alias("set"), F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("taxon"), tx.number_text(F.col("o_totalprice")).alias("total"))
    spark, path = orders.sparkSession, scratch.new_path(orders.sparkSession)
    rows = compilation.cells_of(orders, "set")
    rows.repartition(2, "_row").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    program = {"dataset": {"data_is_long_format": False, "taxon_name": "taxon", "measurement_remarks": "order_key"}, "traits": [{"var_in": "total", "unit_in": "cents", "trait_name": "price", "entity_type": "species", "value_type": "raw"}]}
    names = [f"set{k}" for k in range(3)]
    ingest.build_batches(stream, dict.fromkeys(names, ["order_key", "taxon", "total"]), dict.fromkeys(names, program), f"{path}/db", f"{path}/state", {"price": {"type": "numeric", "units": "usd"}}, {"cents-usd": rules.parse_conversion("x/100")}).awaitTermination()
    return src.read_database(spark, f"{path}/db")["traits"].select("dataset_id", F.col("measurement_remarks").alias("o_orderkey"), "value", "observation_id")


@query("""SELECT * FROM (VALUES ('contributors', 1), ('methods', 2), ('contexts', 2), ('identifiers', 0)) v(name, n) UNION ALL SELECT 'locations', 7
  UNION ALL SELECT 'taxonomic_updates', count(DISTINCT o_custkey % 40) - 1 FROM orders UNION ALL SELECT 'traits', count(*) FILTER (o_custkey % 40 <> 3 AND o_totalprice / 100 BETWEEN 20 AND 3000) + count(*) FILTER (o_custkey % 40 <> 3 AND o_orderstatus <> 'P') FROM orders""")
def process_dataset_tables(t):
    built = _built(t)
    counts = [built[n].agg(F.count("*").cast("int").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("contributors", "methods", "contexts", "identifiers", "locations", "taxonomic_updates", "traits")]
    return db.bind_frames(counts)


@query("""SELECT 'contributors' AS part, 'Doe' AS a, 'J' AS b, NULL AS c UNION ALL SELECT 'contexts', 'progress', 'finished', '01' UNION ALL SELECT 'contexts', 'progress', 'open', '02'
  UNION ALL SELECT 'methods', 'price', 'ledger', 'J. Doe. "Orders".   (2020).' UNION ALL SELECT 'methods', 'state', 'asked', 'J. Doe. "Orders".   (2020).'
  UNION ALL SELECT 'locations', n, 'latitude (deg)', v FROM (VALUES ('1-URGENT', '1'), ('2-HIGH', '3'), ('5-LOW', '5')) x(n, v) UNION ALL SELECT 'locations', n, 'longitude (deg)', v FROM (VALUES ('1-URGENT', '2'), ('2-HIGH', '4'), ('5-LOW', '6')) x(n, v)
  UNION ALL SELECT 'locations', '5-LOW', 'unit', 'none'""")
def process_dataset_details(t):
    built = _built(t)
    part = lambda n, *columns: built[n].select(F.lit(n).alias("part"), *[F.col(c).alias(x) for c, x in zip(columns, "abc")])
    return db.bind_frames([part("contributors", "last_name", "given_name", "affiliation"), part("contexts", "context_property", "value", "link_vals"), part("methods", "trait_name", "methods", "source_primary_citation"), part("locations", "location_name", "location_property", "value")])


@query("""SELECT DISTINCT o_orderpriority AS var_in, 'unknown' AS trait_name, 'unknown' AS unit_in FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT '5-LOW', 'kept', NULL""")
def metadata_add_traits(t):
    program = suggest.add_traits_from({"traits": [{"var_in": "5-LOW", "trait_name": "kept"}]}, t("orders"), long_column="o_orderpriority")
    return reshape.records_to_rows(t("region").sparkSession, program["traits"]).select("var_in", "trait_name", "unit_in")


@query("SELECT n_name AS location_name, 'n_regionkey' AS location_property, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_name, 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation")
def metadata_add_locations(t):
    program = suggest.add_locations_from({}, t("nation"), "n_name", ["n_regionkey", "n_nationkey"])
    rows = [{"location_name": n, "location_property": p, "value": v} for n, ps in program["locations"].items() for p, v in ps.items()]
    return reshape.records_to_rows(t("region").sparkSession, rows)


@query("""SELECT 'old' AS var_in, 'x' AS find, 'y' AS value UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus, 'unknown' FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority, 'unknown' FROM orders""")
def metadata_add_contexts(t):
    program = suggest.add_contexts_from({"contexts": [{"context_property": "p", "category": "c", "var_in": "old", "values": [{"find": "x", "value": "y"}]}]}, t("orders"), ["o_orderstatus", "o_orderpriority"])
    rows = [{"var_in": c["var_in"], "find": v["find"], "value": v["value"]} for c in program["contexts"] for v in c["values"]]
    return reshape.records_to_rows(t("region").sparkSession, rows)


@query("""SELECT n_name AS find, CASE WHEN n_nationkey % 4 = 0 THEN 'again' ELSE 'r' || n_regionkey END AS replace, 'genus' AS taxonomic_resolution FROM nation WHERE n_nationkey % 3 <> 0""")
def metadata_taxonomic_changes(t):
    program: dict = {}
    nations = reshape.rows_to_records(t("nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"))
    program = prog.add_taxonomic_changes(program, [{"find": r["n_name"], "replace": f"r{r['n_regionkey']}", "reason": "x", "taxonomic_resolution": "genus"} for r in nations])
    for r in nations:
        if r["n_nationkey"] % 4 == 0:
            program = prog.update_taxonomic_change(program, r["n_name"], "again", "y", "genus")
        if r["n_nationkey"] % 3 == 0:
            program = prog.remove_taxonomic_change(program, r["n_name"])
    return reshape.records_to_rows(t("region").sparkSession, program["taxonomic_updates"]).select("find", "replace", "taxonomic_resolution")


@query("""SELECT 'substitution' AS part, r_name AS a, 'x' AS b, 'y' AS c FROM region UNION ALL SELECT 'substitution', r_name, 'p', 'q' FROM region UNION ALL SELECT 'substitution', r_name, 'x', 'z' FROM region
  UNION ALL SELECT 'exclusion', 'taxon_name', r_name, 'r' FROM region UNION ALL SELECT 'identifier', r_name, 'unknown', NULL FROM region""")
def metadata_edits(t):
    names = [r["r_name"] for r in reshape.rows_to_records(t("region").select("r_name").orderBy("r_name"))]
    program: dict = {}
    for n in names:
        program = prog.add_substitution(prog.add_substitution(program, n, "x", "y"), n, "x", "ignored")
        program = prog.exclude_observations(prog.exclude_observations(program, "taxon_name", n, "r"), "taxon_name", n, "r")
    table = [{"d": "one", "t": n, "f": f, "r": r} for n in names for f, r in (("p", "q"), ("x", "z"))]
    edited = prog.add_identifiers(prog.add_substitutions_table({"one": program}, table, "d", "t", "f", "r")[0]["one"], names)
    rows = [{"part": "substitution", "a": s["trait_name"], "b": s["find"], "c": s["replace"]} for s in edited["substitutions"]]
    rows += [{"part": "exclusion", "a": e["variable"], "b": e["find"], "c": e["reason"]} for e in edited["exclude_observations"]]
    rows += [{"part": "identifier", "a": i["var_in"], "b": i["identifier_type"], "c": i["institution_code"]} for i in edited["identifiers"]]
    return reshape.records_to_rows(t("region").sparkSession, rows)


@query("SELECT 'N' || n_nationkey AS key, 'Misc' AS bibtype, 'A. ' || n_name || ' and B. Other' AS author, 'On ' || n_name AS title, CAST(1900 + n_nationkey AS VARCHAR) AS year FROM nation")
def bibtex_roundtrip(t):
    rows = reshape.rows_to_records(t("nation").select("n_nationkey", "n_name"))
    text = "\n".join(prog.to_bibtex({"key": f"N{r['n_nationkey']}", "bibtype": "Misc", "author": f"A. {r['n_name']}, B. Other", "title": f"On {r['n_name']}", "year": 1900 + r["n_nationkey"]}) for r in rows)
    return reshape.records_to_rows(t("region").sparkSession, prog.read_bibtex_entries(text)).select("key", "bibtype", "author", "title", "year")


@query(f"SELECT l_orderkey, l_linenumber, unit, error, value FROM ({_SQL['pipeline_end_to_end']}) WHERE trait_name = 'quantity'")
def streaming_ingest(t):
    from ..streaming import ingest

    spark = t("region").sparkSession
    table = spark.createDataFrame([("quantity", "numeric", "kg", 0.0, 45000.0, None)], rules.DICTIONARY)
    path = scratch.new_path(spark)
    t("lineitem").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(t("lineitem").schema).parquet(f"{path}/in")
    text = {"dataset_id": F.lit("d"), "taxon_name": F.concat_ws(" ", "l_orderkey", "l_linenumber"), "trait_name": F.lit("quantity"), "unit_in": F.lit("t"), "value_type": F.lit("raw"), "value": tx.number_text(F.col("l_quantity"))}
    rows = ingest.harmonise_rows(stream.select(*[c.alias(n) for n, c in text.items()]), table, {"t-kg": rules.parse_conversion("x*1000")})
    ingest.ingest(rows, f"{path}/rows", f"{path}/state").awaitTermination()
    key = F.split("taxon_name", " ")
    return spark.read.parquet(f"{path}/rows").select(key[0].cast("long").alias("l_orderkey"), key[1].cast("long").alias("l_linenumber"), "unit", "error", "value")


# the text's last letter has the bytes E4 B8 AD, of which letters that may stand have the last two
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [4] WHEN o_orderkey % 3 = 1 THEN [] END AS places FROM orders")
def unsupported_positions(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "abc中").when(F.col("o_orderkey") % 3 == 1, "café")
    return t("orders").select("o_orderkey", tx.unsupported_bytes(text).alias("places"))


@query("SELECT c_name AS location_name, CAST(c_nationkey AS DOUBLE) AS latitude, CAST(c_custkey AS DOUBLE) AS longitude FROM customer WHERE c_custkey % 3 > 0 AND c_nationkey % 2 = 0")
def report_located(t):
    df = t("customer").select("c_name", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("latitude (deg)"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("longitude (deg)"), F.lit("x").alias("soil"))
    long = reshape.to_eav(df, ["c_name"], ["latitude (deg)", "longitude (deg)", "soil"], "location_property").withColumnRenamed("c_name", "location_name")
    return reports.located(long, ["location_name"])


@query(f"SELECT o_orderpriority, count(*) FILTER (percentile < 2.5 OR percentile > 97.5) / count(*) * 100 AS outlier_share FROM (SELECT o_orderpriority, row_number() OVER w / count(*) OVER (PARTITION BY o_orderpriority) * 100 AS percentile FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)) GROUP BY 1")
def report_outlier_share(t):
    return reports.outlier_share(t("orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"])


@query("SELECT DISTINCT 'taxon ' || (o_custkey % 40) AS taxon_name, CASE WHEN o_custkey % 40 < 25 THEN (SELECT any_value(n_name) FROM nation WHERE n_nationkey = o_custkey % 40) ELSE '' END AS family FROM orders")
def report_taxa(t):
    names = t("orders").select(F.concat(F.lit("taxon "), (F.col("o_custkey") % 40).cast("string")).alias("taxon_name"))
    taxa = t("nation").select(F.concat(F.lit("taxon "), F.col("n_nationkey").cast("string")).alias("taxon_name"), F.col("n_name").alias("family"))
    return reports.unmatched_taxa(names, taxa, ["family"])


@query("SELECT 'field' || n_nationkey AS key, 'unknown' AS value FROM nation WHERE n_regionkey = 2")
def report_undescribed(t):
    items = {f"field{r['n_nationkey']}": "unknown" if r["n_regionkey"] == 2 else r["n_name"] for r in reshape.rows_to_records(t("nation"))}
    return reports.undescribed(reshape.list_to_rows(t("region").sparkSession, items))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def canonical_types(t):
    text = t("nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".00")).alias("n_nationkey"), "n_name", F.when(F.col("n_regionkey") != 0, F.concat(F.lit("0"), F.col("n_regionkey").cast("string"))).alias("n_regionkey"))
    return src.canonical_text(text)
