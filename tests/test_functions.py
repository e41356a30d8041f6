"""Scalar functions on hand-made cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from campovia.functions import dates, geo, ids, nested, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


BASE = "ARNAUD GUEDES AMORIM 145, COELHO DA ROCHA, SAO JOAO DE MERITI - RJ, 25550-570"


def test_published_address_case(spark):
    line = F.lit(BASE + ", Brasil")
    assert value(spark, text.base_address(line)) == BASE
    assert value(spark, text.geocoding_address(F.lit(BASE))) == "Arnaud Guedes Amorim 145, Coelho Da Rocha, Sao Joao De Meriti - Rj, 25550-570"
    assert value(spark, text.cache_address(F.lit(BASE))) == BASE


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: text.null_sentinels(F.lit(" NaN ")), None),
        (lambda: text.null_sentinels(F.lit("<NA>")), None),
        (lambda: text.null_sentinels(F.lit("x")), "x"),
        (lambda: text.base_address(F.lit(None).cast("string")), ""),
        (lambda: text.base_address(F.lit("a​b ,c")), "ab, c"),
        (lambda: text.cache_address(F.lit("Rua São João, 5"), F.lit("01310-100")), "RUA SAO JOAO, 5 | CEP:01310100"),
        (lambda: text.cache_address(F.lit("Rua A"), F.lit("123")), "RUA A"),
        (lambda: text.geocoding_address(F.lit("rua sta rita bloco 3, x")), "Rua Santa Rita , X"),
        (lambda: text.local_geocoding_address(F.lit("Rua s. joão apto 4, centro")), "São. João"),
        (lambda: text.untruncated(F.lit("Nogueira")), "nogueiraira"),
        (lambda: text.expanded(F.lit("r dr prof km 3")), "rua doutor professor quilometro 3"),
        (lambda: text.street(F.lit(" av.  paulista ")), "AVENIDA PAULISTA"),
        (lambda: text.street(F.lit("pca da se")), "PRACA DA SE"),
        (lambda: text.canonical_address(F.lit("R Augusta"), F.lit(None), F.lit("São Paulo"), F.lit("sp")), "RUA AUGUSTA, SÃO PAULO - SP"),
        (lambda: text.city_name(F.lit("Mogi-Mirim (sede)")), "MOGI MIRIM SEDE"),
        (lambda: text.city_key(F.lit("Santana de Parnaí-SP"), F.lit("SP")), "SANTANA DE PARNAIBA"),
        (lambda: text.city_key(F.lit("São Paulo/SP"), F.lit("sp")), "SAO PAULO"),
        (lambda: text.city_key(F.lit(" "), F.lit("SP")), None),
        (lambda: text.state_key(F.lit("Estado SP")), "SP"),
        (lambda: text.house_number(F.lit("s/n")), ""),
        (lambda: text.district(F.lit("Centro Santos"), F.lit("santos")), "Centro"),
        (lambda: text.fix_encoding(F.lit("SÃ£o\x01 ")), "São"),
        (lambda: text.ascii_only(F.lit("Ação № ½")), "Acao No 12"),
        (lambda: text.without_marks(F.lit("é€")), "e€"),
        (lambda: text.display_address(F.lit(None).cast("string"), F.lit(""), F.lit("B"), F.lit("C"), F.lit("SP"), F.lit(" ")), "Endereco nao informado, S/N | B | C - SP"),
        (lambda: ids.cnpj_from_cell(F.lit("1,23E+3")), "1230"),
        (lambda: ids.cnpj_from_cell(F.lit(" ")), None),
        (lambda: ids.cnpj_14(F.lit("11.222.333/0001-81")), "11222333000181"),
        (lambda: ids.cnpj_14(F.lit("123")), None),
        (lambda: ids.with_check_digits(F.lit("112223330001")), "11222333000181"),
        (lambda: ids.cnpj_mask(F.lit("11222333000181")), "11.222.333/0001-81"),
        (lambda: ids.cep_strict(F.lit("01310")), "00001310"),
        (lambda: ids.cep_strict(F.lit("0131010")), None),
        (lambda: ids.cep_loose(F.lit("0131010.0")), "00131010"),
        (lambda: ids.cep_loose(F.lit("1.31e6")), "01310000"),
        (lambda: ids.cep_loose(F.lit("123456789")), None),
        (lambda: ids.cep_valid(F.lit("00000000")), False),
        (lambda: ids.cep_fits_state(F.lit("40000000"), F.lit("BA")), False),
        (lambda: ids.cep_fits_state(F.lit("01000000"), F.lit(" sp ")), True),
        (lambda: ids.states_of_cep(F.lit("72900000")), ["DF", "GO"]),
        (lambda: ids.money(F.lit("R$ 1.234,56")), 1234.56),
        (lambda: ids.money(F.lit("2000000000")), None),
        (lambda: ids.money(F.lit("abc")), None),
        (lambda: ids.flag(F.lit("Não")), None),
        (lambda: ids.flag(F.lit(" NAO ")), False),
        (lambda: ids.number_br(F.lit(1234.56), 1), "1.234,6"),
        (lambda: ids.phone_e164(F.lit("(11) 3333-4444")), "5511933334444"),
        (lambda: ids.phone_e164(F.lit("123")), None),
        (lambda: ids.reason_labels(F.lit("cidade_invalida|novo")), "Cidade ou UF nao encontrada na base de referencia; novo"),
        (lambda: ids.geocoding_reason(F.lit(None).cast("string")), "falha_geocoding"),
        (lambda: dates.minutes_of_day(F.lit("23:59:59")), 1439),
        (lambda: dates.minutes_of_day(F.lit("24:00")), None),
        (lambda: dates.minutes_of_day(F.lit("480.0")), 480),
        (lambda: dates.minutes_of_day(F.lit("nan")), None),
        (lambda: dates.easter(F.lit(2025)), dt.date(2025, 4, 20)),
        (lambda: dates.weekday_label(F.lit(dt.date(2025, 1, 6))), "Seg"),
        (lambda: geo.point_status(F.lit(-23.5), F.lit(-46.6), F.lit("sp")), "ok"),
        (lambda: geo.point_status(F.lit(0.0), F.lit(0.0), F.lit("SP")), "fora_uf"),
        (lambda: geo.point_status(F.lit(0.0), F.lit(0.0), F.lit("ZZ")), "ok"),
        (lambda: geo.point_status(F.lit(-25.51), F.lit(-53.26), F.lit("SP")), "ok"),
        (lambda: geo.audit_reason(F.lit(0.0), F.lit(0.0), F.lit("ZZ")), "uf_invalida"),
        (lambda: geo.generic(F.lit(-22.563), F.lit(-47.401)), True),
        (lambda: geo.generic(F.lit(None).cast("double"), F.lit(1.0)), True),
        (lambda: geo.repaired_degree(F.lit("-23,5")), -23.5),
        (lambda: geo.repaired_degree(F.lit("-23500000")), -23.5),
        (lambda: nested.polyline_decoded(F.lit("")), []),
    ],
)
def test_cells(spark, column, expected):
    assert value(spark, column()) == expected


def test_working_days_cross_the_year(spark):
    days = [r.day for r in dates.working_days(spark, "2024-12-31", "2025-01-03").orderBy("nth").collect()]
    assert days == [dt.date(2024, 12, 31), dt.date(2025, 1, 2), dt.date(2025, 1, 3)]
    assert dates.working_days(spark, "2025-01-02", "2025-01-01").count() == 0


def test_swapped_coordinates(spark):
    lat, lon = geo.unswapped(F.lit(-46.6), F.lit(-23.5))
    assert tuple(spark.range(1).select(lat, lon).first()) == (-23.5, -46.6)
