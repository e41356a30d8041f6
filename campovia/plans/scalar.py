"""Queries of the scalar functions: text, ids, dates, mathematics, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions import dates, geo, ids, nested, text
from campovia.plans.base import ADDRESSES, BASE, CENTRES_SQL, LINE, POINTS, TIDY, address_line, address_parts, centres, points, query
from campovia.session import table


def _base(x: str) -> str:
    return BASE.format(x=x)


def _tidy(x: str) -> str:
    return TIDY.format(x=x)


def _initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


CACHE = _tidy(f"regexp_replace(upper({_base('line')}), '[^A-Z0-9 ,\\-]', '', 'g')")
STREET = "trim(regexp_replace(" + "".join("regexp_replace(" for _ in text.STREET_PREFIXES) + "upper(trim(street))" + "".join(f", '^{a}\\.?\\s+', '{b} ')" for a, b in text.STREET_PREFIXES.items()) + ", '\\s+', ' ', 'g'))"


@query("str01_without_controls", f"WITH {ADDRESSES} SELECT id, trim(regexp_replace(' ' || chr(9) || street || chr(1) || city || ' ', '[\\x00-\\x1f]', '', 'g')) AS clean FROM addresses")
def str01(spark, sf_dir):
    dirty = F.concat(F.lit(" \t"), "street", F.lit("\x01"), "city", F.lit(" "))
    return address_parts(spark, sf_dir).select("id", text.without_controls(dirty).alias("clean"))


@query("str01_fix_encoding", f"WITH {ADDRESSES} SELECT id, city || ' São' AS fixed FROM addresses")
def str01_exact(spark, sf_dir):
    """Text whose UTF-8 was read as Latin-1 comes back right."""
    return address_parts(spark, sf_dir).select("id", text.fix_encoding(F.concat(F.lit(" "), "city", F.lit(" SÃ£o\x02 "))).alias("fixed"))


@query("str02_unaccented", f"WITH {ADDRESSES} SELECT id, strip_accents('Ação ' || city || ' ÉÜñ') AS plain FROM addresses")
def str02(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.unaccented(F.concat(F.lit("Ação "), "city", F.lit(" ÉÜñ"))).alias("plain"))


@query("str03_base_address", f"WITH {ADDRESSES}, l AS (SELECT id, {LINE} AS line FROM addresses) SELECT id, {_base('line')} AS base FROM l")
def str03(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.base_address(address_line()).alias("base"))


_KEY = f"regexp_replace(upper({_base('line')}), '[^A-Z0-9 ,\\-]', '', 'g')"
_KEY_CEP = _tidy(_KEY + " || ' | CEP:' || cep")


@query("str04_cache_address", f"WITH {ADDRESSES}, l AS (SELECT id, cep, {LINE} AS line FROM addresses) SELECT id, {CACHE} AS key, {_KEY_CEP} AS key_with_cep FROM l")
def str04(spark, sf_dir):
    line = address_line()
    return address_parts(spark, sf_dir).select("id", text.cache_address(line).alias("key"), text.cache_address(line, F.col("cep")).alias("key_with_cep"))


_GEO = _initcap(f"trim(regexp_replace(replace(replace(lower({_base('line')}), 'nogue', 'nogueira'), 'verg', 'vergueiro'), '\\s+', ' ', 'g'))")
_GEO = _tidy(f"regexp_replace(regexp_replace(regexp_replace({_GEO}, '\\bSta\\b', 'Santa', 'g'), '\\bSto\\b', 'Santo', 'g'), '(?i)\\b({text.COMPLEMENTS})\\s*\\w*', '', 'g')")


@query("str05_str06_geocoding_address", f"WITH {ADDRESSES}, l AS (SELECT id, {LINE} AS line FROM addresses) SELECT id, {_GEO} AS shown FROM l")
def str05(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.geocoding_address(address_line()).alias("shown"))


@query("str05_local_geocoding_address")
def str05_local(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.local_geocoding_address(address_line()).alias("shown"))


@query("str07_untruncated", f"WITH {ADDRESSES} SELECT id, replace(replace(lower('Nogueira ' || city || ' Verg'), 'nogue', 'nogueira'), 'verg', 'vergueiro') AS full_text FROM addresses")
def str07(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.untruncated(F.concat(F.lit("Nogueira "), "city", F.lit(" Verg"))).alias("full_text"))


_ABBR = "".join("regexp_replace(" for _ in text.ABBREVIATIONS) + "lower(street || ' dr bl ' || district)" + "".join(f", '{a}', '{b}', 'g')" for a, b in text.ABBREVIATIONS.items())


@query("str08_expanded", f"WITH {ADDRESSES} SELECT id, {_ABBR} AS full_text FROM addresses")
def str08(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.expanded(F.lower(F.concat("street", F.lit(" dr bl "), "district"))).alias("full_text"))


@query("str09_street", f"WITH {ADDRESSES} SELECT id, {STREET} AS street_name FROM addresses")
def str09(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.street(F.col("street")).alias("street_name"))


_CANON = f"trim(regexp_replace(replace({STREET} || ' ' || trim(number) || ', ' || upper(trim(city)) || ' - ' || upper(trim(uf)), ' ,', ','), '\\s+', ' ', 'g'))"


@query("str10_cache_key", f"WITH {ADDRESSES}, c AS (SELECT id, {_CANON} AS line FROM addresses) SELECT id, line AS canonical, {CACHE} AS cache_key FROM c")
def str10(spark, sf_dir):
    cells = [F.col(c) for c in ("street", "number", "city", "uf")]
    return address_parts(spark, sf_dir).select("id", text.canonical_address(*cells).alias("canonical"), text.cache_key(*cells).alias("cache_key"))


@query("str11_city_name", f"WITH {ADDRESSES} SELECT id, trim(regexp_replace(regexp_replace(upper(strip_accents('São-' || city || '. (x)')), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS city_norm FROM addresses")
def str11(spark, sf_dir):
    return address_parts(spark, sf_dir).select("id", text.city_name(F.concat(F.lit("São-"), "city", F.lit(". (x)"))).alias("city_norm"))


@query(
    "str12_city_key",
    f"""WITH {ADDRESSES}, n AS (SELECT id, uf, trim(upper(regexp_replace(regexp_replace(replace(replace(replace(trim(city || '/' || uf || ' - Sul-' || uf || '.'), '/', ' '), ' - ', ' '), '-', ' '), '[.,;:]+$', ''), '\\s+', ' ', 'g'))) AS name FROM addresses)
SELECT id, uf AS state_key, CASE uf WHEN 'SP' THEN trim(regexp_replace(trim(regexp_replace(name, '\\bSP\\b', '', 'g')), '\\s+', ' ', 'g')) WHEN 'RJ' THEN trim(regexp_replace(trim(regexp_replace(name, '\\bRJ\\b', '', 'g')), '\\s+', ' ', 'g'))
 WHEN 'BA' THEN trim(regexp_replace(trim(regexp_replace(name, '\\bBA\\b', '', 'g')), '\\s+', ' ', 'g')) WHEN 'MG' THEN trim(regexp_replace(trim(regexp_replace(name, '\\bMG\\b', '', 'g')), '\\s+', ' ', 'g'))
 ELSE trim(regexp_replace(trim(regexp_replace(name, '\\bXX\\b', '', 'g')), '\\s+', ' ', 'g')) END AS city_key FROM n""",
)
def str12(spark, sf_dir):
    cell = F.concat("city", F.lit("/"), "uf", F.lit(" - Sul-"), "uf", F.lit("."))
    return address_parts(spark, sf_dir).select("id", text.state_key(F.col("uf")).alias("state_key"), text.city_key(cell, F.col("uf")).alias("city_key"))


@query(
    "str13_street_and_number",
    f"""WITH {ADDRESSES}, s AS (SELECT id, trim(CASE WHEN id % 3 = 0 THEN street ELSE street || ', ' || number END) AS s FROM addresses)
SELECT id, CASE WHEN regexp_matches(s, '^(.*?)(?:\\s*,?\\s*)(\\d{{1,6}})$') THEN trim(regexp_extract(s, '^(.*?)(?:\\s*,?\\s*)(\\d{{1,6}})$', 1)) ELSE s END AS street_part,
 CASE WHEN regexp_matches(s, '^(.*?)(?:\\s*,?\\s*)(\\d{{1,6}})$') THEN regexp_extract(s, '^(.*?)(?:\\s*,?\\s*)(\\d{{1,6}})$', 2) END AS number_part FROM s""",
)
def str13(spark, sf_dir):
    a = address_parts(spark, sf_dir)
    street, number = text.street_and_number(F.when(F.col("id") % 3 == 0, F.col("street")).otherwise(F.concat("street", F.lit(", "), "number")))
    return a.select("id", street.alias("street_part"), number.alias("number_part"))


@query("str14_house_number", f"WITH {ADDRESSES} SELECT id, CASE WHEN id % 4 < 3 OR number = '0' THEN '' ELSE number END AS house_number FROM addresses")
def str14(spark, sf_dir):
    cell = F.element_at(F.array(F.lit(" s/n "), F.lit("sem numero"), F.lit("0"), F.col("number")), (F.col("id") % 4 + 1).cast("int"))
    return address_parts(spark, sf_dir).select("id", text.house_number(cell).alias("house_number"))


@query("str15_district", f"WITH {ADDRESSES} SELECT id, CASE WHEN id % 2 = 0 THEN 'Centro' ELSE 'Centro' || city END AS district_name FROM addresses")
def str15(spark, sf_dir):
    cell = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Centro "), F.lower("city"))).otherwise(F.concat(F.lit("Centro"), "city"))
    return address_parts(spark, sf_dir).select("id", text.district(cell, F.col("city")).alias("district_name"))


@query("str16_city_and_state", f"WITH {ADDRESSES} SELECT id, city, CASE WHEN id % 2 = 0 THEN lower(uf) ELSE uf END AS state FROM addresses")
def str16(spark, sf_dir):
    line = F.when(F.col("id") % 2 == 0, F.concat("street", F.lit(", "), "city", F.lit(" - "), F.lower("uf"))).otherwise(F.concat("city", F.lit(", "), "uf"))
    a = address_parts(spark, sf_dir)
    city, state = text.city_and_state(line)
    return a.select("id", city.alias("city"), state.alias("state"))


_DIGITS = "lpad(CAST(c_custkey * 7919 AS VARCHAR), 14, '0')"


@query("str17_cnpj", f"""WITH c AS (SELECT c_custkey AS id, {_DIGITS} AS d FROM customer)
SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE d END AS cnpj, CASE WHEN id % 3 = 0 THEN d[1:12] ELSE d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:12] || '-' || d[13:14] END AS mask FROM c""")
def str17(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 14, "0").alias("d"))
    cell = F.when(F.col("id") % 3 == 0, F.substring("d", 1, 12)).otherwise(F.col("d"))
    return c.select("id", ids.cnpj_14(cell).alias("cnpj"), ids.cnpj_mask(cell).alias("mask"))


@query("str17_cnpj_from_cell", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '12345678000100' WHEN 1 THEN NULL ELSE CAST(c_custkey AS VARCHAR) || '01' END AS cnpj FROM customer")
def str17_cell(spark, sf_dir):
    cell = F.when(F.col("c_custkey") % 3 == 0, F.lit("1,23456780001E+13")).when(F.col("c_custkey") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("-01")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.cnpj_from_cell(cell).alias("cnpj"))


_D = lambda n, ws: " + ".join(f"CAST({n}[{i + 1}] AS INTEGER) * {w}" for i, w in enumerate(ws))


@query("str18_synthetic_cnpj", f"""WITH b AS (SELECT c_custkey AS id, CAST(10000000 + (c_custkey * 7368787) % 90000000 AS VARCHAR) || '0001' AS b FROM customer),
d AS (SELECT id, b, 11 - ({_D('b', ids.CNPJ_WEIGHTS)}) % 11 AS x FROM b), e AS (SELECT id, b || CAST(CASE WHEN x < 10 THEN x ELSE 0 END AS VARCHAR) AS b FROM d),
f AS (SELECT id, b, 11 - ({_D('b', (6, *ids.CNPJ_WEIGHTS))}) % 11 AS x FROM e) SELECT id, b || CAST(CASE WHEN x < 10 THEN x ELSE 0 END AS VARCHAR) AS cnpj FROM f""")
def str18(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.synthetic_cnpj(F.col("c_custkey")).alias("cnpj"))


@query("str19_cep", """WITH c AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 AS VARCHAR) AS d FROM customer)
SELECT id, CASE WHEN len(d) IN (5, 8) THEN lpad(d, 8, '0') END AS strict_cep, CASE WHEN len(d) BETWEEN 5 AND 8 THEN lpad(d, 8, '0') END AS loose_cep FROM c""")
def str19(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919).cast("string").alias("d"))
    return c.select("id", ids.cep_strict(F.concat(F.lit("- "), "d")).alias("strict_cep"), ids.cep_loose(F.concat("d", F.lit(".0"))).alias("loose_cep"))


@query("str20_money", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS brazilian, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END AS plain FROM orders")
def str20(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    written = F.concat(F.lit("R$ "), ids.number_br(F.round("o_totalprice", 2), 2))
    plain = F.when(F.col("o_orderkey") % 2 == 0, F.round("o_totalprice", 2).cast("string")).otherwise(F.lit("2e9"))
    return o.select(F.col("o_orderkey").alias("id"), ids.money(written).alias("brazilian"), ids.money(plain).alias("plain"))


@query("str21_flag", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS flag FROM customer")
def str21(spark, sf_dir):
    cell = F.element_at(F.array(F.lit(" Sim"), F.lit("NAO"), F.lit("x"), F.lit("?")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.flag(cell).alias("flag"))


@query("str22_number_br", "SELECT o_orderkey AS id, translate(format('{:,.1f}', CAST(o_orderkey AS DOUBLE)), ',.', '.,') AS shown FROM orders")
def str22(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ids.number_br(F.col("o_orderkey").cast("double"), 1).alias("shown"))


@query("str23_phone", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '55119' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '55119' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone FROM customer""")
def str23(spark, sf_dir):
    tail = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    cell = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("(11) "), tail)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("11 9"), tail)).otherwise(tail)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.phone_e164(cell).alias("phone"))


@query("str24_itinerary_message")
def str24(spark, sf_dir):
    """One message an order: its lines are the visits."""
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("seq"), F.concat(F.lit("Cliente "), F.col("l_partkey").cast("string")).alias("name"), F.lit("Rua A, 1").alias("address")).alias("v"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity")
    g = v.groupBy("l_orderkey").agg(F.collect_list("v").alias("visits"), F.min("d").alias("d"), F.sum("l_quantity").alias("km"))
    return g.select("l_orderkey", dates.itinerary_message(F.lit("maria silva"), F.col("d"), F.col("visits"), F.col("km")).alias("message"))


@query("str25_reason_labels", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Coordenada fora do municipio informado; x' WHEN 1 THEN 'CNPJ duplicado no arquivo' END AS label FROM customer")
def str25(spark, sf_dir):
    cell = F.when(F.col("c_custkey") % 3 == 0, "fora_municipio | x|").when(F.col("c_custkey") % 3 == 1, "cnpj_duplicado_arquivo").otherwise(" ")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.reason_labels(cell).alias("label"))


@query("str26_display_address", f"""WITH {ADDRESSES} SELECT id, CASE WHEN id % 3 = 0 THEN 'Endereco nao informado' ELSE trim(street) END || ', ' || CASE WHEN id % 2 = 0 THEN 'S/N' ELSE number END || ' | ' || trim(district) || ' | ' || city || ' - ' || uf
 || CASE WHEN id % 5 = 0 THEN '' ELSE ' | ' || cep END AS shown FROM addresses""")
def str26(spark, sf_dir):
    c, key = F.col, F.col("id")
    return address_parts(spark, sf_dir).select(
        "id", text.display_address(F.when(key % 3 != 0, c("street")), F.when(key % 2 == 0, " ").otherwise(c("number")), c("district"), c("city"), c("uf"), F.when(key % 5 != 0, c("cep"))).alias("shown")
    )


@query("dt01_minutes_of_day", "SELECT c_custkey AS id, CAST(CASE c_custkey % 4 WHEN 0 THEN c_custkey % 1440 WHEN 1 THEN 545 WHEN 2 THEN NULL ELSE 480 END AS INTEGER) AS minutes FROM customer")
def dt01(spark, sf_dir):
    key = F.col("c_custkey")
    clock = F.concat(F.floor(key % 1440 / 60).cast("string"), F.lit(":"), F.lpad((key % 1440 % 60).cast("string"), 2, "0"), F.lit(":00"))
    cell = F.when(key % 4 == 0, clock).when(key % 4 == 1, "9:05").when(key % 4 == 2, "24:00").otherwise("480,0")
    return table(spark, sf_dir, "customer").select(key.alias("id"), dates.minutes_of_day(cell).alias("minutes"))


_Y = "(1990 + c_custkey % 110)"
_EASTER = f"""years AS (SELECT DISTINCT CAST({_Y} AS INTEGER) AS y FROM customer), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS t FROM e3), easter AS (SELECT y, make_date(y, t // 31, t % 31 + 1) AS easter FROM e4)"""


@query("dt02_holidays", f"""WITH {_EASTER} SELECT CAST(y AS INTEGER) AS year, unnest([make_date(y, 1, 1), make_date(y, 4, 21), make_date(y, 5, 1), make_date(y, 9, 7), make_date(y, 10, 12), make_date(y, 11, 2), make_date(y, 11, 15), make_date(y, 11, 20), make_date(y, 12, 25)]) AS holiday FROM easter
UNION SELECT CAST(y AS INTEGER), unnest([CAST(easter - INTERVAL 48 DAY AS DATE), CAST(easter - INTERVAL 47 DAY AS DATE), CAST(easter - INTERVAL 2 DAY AS DATE)]) FROM easter""")
def dt02(spark, sf_dir):
    years = table(spark, sf_dir, "customer").select((1990 + F.col("c_custkey") % 110).cast("int").alias("year")).distinct()
    return years.select("year", F.explode(dates.holidays_of(F.col("year"))).alias("holiday"))


@query("dt03_working_days", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-12-20', DATE '2025-05-05', INTERVAL 1 DAY)) AS DATE) AS day),
o AS (SELECT day FROM d WHERE isodow(day) < 6 AND day NOT IN (DATE '2024-12-25', DATE '2025-01-01', DATE '2025-03-03', DATE '2025-03-04', DATE '2025-04-18', DATE '2025-04-21', DATE '2025-05-01'))
SELECT day, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS nth FROM o""")
def dt03(spark, sf_dir):
    return dates.working_days(spark, "2024-12-20", "2025-05-05")


@query("dt04_effective_status", """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linestatus <> 'O' THEN l_linestatus WHEN CAST(l_shipdate AS DATE) < DATE '1995-06-17' THEN 'vencida' ELSE 'a_realizar' END AS status FROM lineitem""")
def dt04(spark, sf_dir):
    stored = F.when(F.col("l_linestatus") == "O", "pendente").otherwise(F.col("l_linestatus"))
    day = dates.effective_date(F.lit(None).cast("date"), F.col("l_shipdate").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day.alias("day"), dates.effective_status(stored, day, F.lit("1995-06-17").cast("date")).alias("status"))


@query("dt05_duration", "SELECT event_id, CAST(round(epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 1e6) AS BIGINT) AS seconds FROM events")
def dt05(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.seconds_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("seconds"))


_PC = f"WITH {POINTS}, {CENTRES_SQL}, c AS (SELECT * FROM centres WHERE cid = 1)"


def _with_centre(spark, sf_dir):
    return points(spark, sf_dir).crossJoin(F.broadcast(centres(spark, sf_dir).where("cid = 1")))


@query("math01_haversine", f"{_PC} SELECT id, round({geo.haversine_sql('lat', 'lon', 'clat', 'clon')}, 6) AS km FROM points, c")
def math01(spark, sf_dir):
    return _with_centre(spark, sf_dir).select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 6).alias("km"))


@query("math02_bearing", f"""{_PC}, a AS (SELECT id, atan2(sin(radians(lon - clon)) * cos(radians(lat)), cos(radians(clat)) * sin(radians(lat)) - sin(radians(clat)) * cos(radians(lat)) * cos(radians(lon - clon))) AS x FROM points, c)
SELECT id, round(CASE WHEN x < 0 THEN x + 2 * pi() ELSE x END, 9) AS angle FROM a""")
def math02(spark, sf_dir):
    return _with_centre(spark, sf_dir).select("id", F.round(geo.bearing(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 9).alias("angle"))


@query("math03_planar", f"{_PC} SELECT id, round((lat - clat) * (lat - clat) + (lon - clon) * (lon - clon), 8) AS d2 FROM points, c")
def math03(spark, sf_dir):
    return _with_centre(spark, sf_dir).select("id", F.round(geo.planar_sq(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 8).alias("d2"))


@query("math04_travel_time", f"{_PC} SELECT id, round({geo.haversine_sql('lat', 'lon', 'clat', 'clon')} * 1.4::DOUBLE / 35 * 60 + 3 * 30, 4) AS minutes FROM points, c")
def math04(spark, sf_dir):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) * 1.4
    return _with_centre(spark, sf_dir).select("id", F.round(geo.travel_minutes(km, 35.0, 3, 30.0), 4).alias("minutes"))


@query("math05_repaired_degree", f"WITH {POINTS} SELECT id, round(CASE WHEN id % 2 = 0 THEN lat ELSE round(lat * 1000000) / 1000000 END, 6) AS fixed FROM points")
def math05(spark, sf_dir):
    cell = F.when(F.col("id") % 2 == 0, F.replace(F.format_string("%.6f", "lat"), F.lit("."), F.lit(","))).otherwise(F.round(F.col("lat") * 1e6).cast("long").cast("string"))
    return points(spark, sf_dir).select("id", F.round(geo.repaired_degree(cell), 6).alias("fixed"))


@query("math06_jitter")
def math06(spark, sf_dir):
    return points(spark, sf_dir).select("id", geo.jittered(F.col("lat"), F.col("id"), 0.002).alias("lat"), geo.jittered(F.col("lon"), -F.col("id"), 0.002).alias("lon"))


@query("math07_k_from_box", f"""WITH {POINTS}, b AS (SELECT state, count(*) AS n, {geo.haversine_sql('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')} AS km FROM points GROUP BY state)
SELECT state, CAST(CASE WHEN least(greatest(1, CAST(floor(pi() * pow(km / 2, 2) / (pi() * pow(35 * 60 / 60::DOUBLE, 2))) AS BIGINT)), n // 3) = 0 THEN 1 ELSE least(greatest(1, CAST(floor(pi() * pow(km / 2, 2) / (pi() * pow(35 * 60 / 60::DOUBLE, 2))) AS BIGINT)), n // 3) END AS BIGINT) AS k FROM b""")
def math07(spark, sf_dir):
    """Clusters that the bounding box's circle needs at 35 km/h for an hour, at most a third of the points."""
    b = points(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("a", F.min), ("b", F.max))])
    km = geo.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    area = F.floor(F.pi() * F.pow(km / 2, 2) / (F.pi() * F.pow(F.lit(35.0), 2)))
    k = F.least(F.greatest(F.lit(1), area), F.floor(F.col("n") / 3))
    return b.select("state", F.when(k == 0, F.lit(1)).otherwise(k).cast("long").alias("k"))


@query("json01_text", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json01(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", nested.json_text(F.col("props"), "k").alias("k"))


@query("json02_coordinates", f"WITH {POINTS} SELECT id, 2 AS n, round(lat, 4) AS lat0, round(lon, 4) AS lon0 FROM points")
def json02(spark, sf_dir):
    cell = F.when(F.col("id") % 2 == 0, F.format_string("[{'lat': %.4f, 'lon': %.4f}, {'lat': 1, 'lon': 2}]", "lat", "lon")).otherwise(F.format_string("[[%.4f, %.4f], [1, 2]]", "lat", "lon"))
    got = points(spark, sf_dir).select("id", nested.coordinates(cell).alias("p"))
    return got.select("id", F.size("p").alias("n"), F.get("p.lat", F.lit(0)).alias("lat0"), F.get("p.lon", F.lit(0)).alias("lon0"))


@query("json03_build", f"""WITH {POINTS} SELECT state, '{{"n":' || count(*) || ',"first":' || min(id) || '}}' AS metrics FROM points GROUP BY state""")
def json03(spark, sf_dir):
    g = points(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return g.select("state", nested.as_json(n=F.col("n"), first=F.col("first")).alias("metrics"))


@query("arr01_without_repeats", """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big, lag(l_quantity > 25) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity > 25) AS prior FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE prior IS NULL OR prior <> big) AS n FROM l GROUP BY l_orderkey""")
def arr01(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") > 25).alias("big")))).alias("p"))
    return g.select("l_orderkey", F.size(nested.without_repeats(F.transform("p", lambda x: F.struct(x["big"].alias("big"))))).cast("long").alias("n"))


@query("arr02_joined_segments", "SELECT l_orderkey, count(*) + 1 AS n FROM lineitem GROUP BY l_orderkey")
def arr02(spark, sf_dir):
    """Each line is a segment from its number to the next; shared ends count once."""
    seg = F.array(F.struct(F.col("nth").alias("x")), F.struct((F.col("nth") + 1).alias("x")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("nth"))
    g = rows.select("l_orderkey", "nth", seg.alias("seg")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", "seg"))).alias("s"))
    return g.select("l_orderkey", F.size(nested.joined_segments(F.col("s.seg"))).cast("long").alias("n"))


@query("arr03_polyline", "SELECT r_regionkey, 3 AS n, 38.5::DOUBLE AS lat0, -120.2::DOUBLE AS lon0, 43.252::DOUBLE AS lat2, -126.453::DOUBLE AS lon2 FROM region")
def arr03(spark, sf_dir):
    got = table(spark, sf_dir, "region").select("r_regionkey", nested.polyline_decoded(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")).alias("p"))
    return got.select("r_regionkey", F.size("p").alias("n"), *[F.get(f"p.{c}", F.lit(i)).alias(f"{c}{i}") for i in (0, 2) for c in ("lat", "lon")])


@query("arr04_chunks", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT c_nationkey, pos // 10 AS chunk, count(*) AS n FROM r GROUP BY ALL")
def arr04(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return table(spark, sf_dir, "customer").select("c_nationkey", nested.chunk_of(pos, 10).alias("chunk")).groupBy("c_nationkey", "chunk").agg(F.count("*").alias("n"))


@query("map01_source_rank", "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 50 END AS INTEGER) AS rank FROM events")
def map01(spark, sf_dir):
    source = F.when(F.col("event_type") == "click", "cache").when(F.col("event_type") == "view", "google").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", ids.source_rank(source).alias("rank"))
