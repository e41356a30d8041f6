"""Values of queries without SQL, by plain Python over the supplied tables."""

import math
from collections import Counter, defaultdict

import pandas as pd
import pytest

from campovia.plans import catalogue
from campovia.plans.base import points
from campovia.session import table

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def result(spark, name) -> pd.DataFrame:
    return QUERIES[name](spark, FOLDER).toPandas()


@pytest.fixture(scope="module")
def customers(spark):
    return table(spark, FOLDER, "customer").toPandas()


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b - d) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_jitter_moves_every_point_a_little(spark):
    p = points(spark, FOLDER).toPandas().set_index("id")
    got = result(spark, "math06_jitter").set_index("id")
    for c in ("lat", "lon"):
        off = got[c] - p.loc[got.index, c]
        assert len(off) == len(p) and off.abs().max() <= 0.002 + 1e-12 and off.abs().min() < off.abs().max() and (off > 0).any() and (off < 0).any()
        assert off.nunique() > 0.9 * len(off)


def test_itinerary_messages(spark):
    lines = table(spark, FOLDER, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate").toPandas()
    got = result(spark, "str24_itinerary_message").set_index("l_orderkey").message
    assert sorted(got.index) == sorted(lines.l_orderkey.unique())
    for order, own in lines.groupby("l_orderkey"):
        own = own.assign(l_partkey=own.l_partkey.astype(str)).sort_values(["l_linenumber", "l_partkey"])  # equal numbers by name
        day = pd.Timestamp(own.l_shipdate.min())
        text = got[order]
        assert text.startswith(f"*Roteiro - {day:%d/%m/%Y} (") and "Olá, Maria!\n\n" in text
        visits = "\n\n".join(f"*{n}.* Cliente {p}\nRua A, 1" for n, p in zip(own.l_linenumber, own.l_partkey))
        assert text.split("Olá, Maria!\n\n")[1] == f"{visits}\n\n---\n*{len(own)} visita(s) | ~{math.floor(own.l_quantity.sum() + 0.5)} km*"


def test_manual_rows_added(spark, customers):
    """Of each company id the first good row, unless it is stored."""
    good, stored = {}, set()
    for key in sorted(customers.c_custkey):
        cnpj = "123" if key % 10 == 0 else str(key - key % 10).rjust(14, "1") if key % 10 < 3 else str(key).rjust(14, "2")
        if key % 10 == 5:
            stored.add(cnpj)
        if key % 10 and key % 7 and cnpj not in good:
            good[cnpj] = key
    got = result(spark, "ing01_manual_added")
    assert dict(zip(got.cnpj, got.row)) == {c: k for c, k in good.items() if c not in stored} and set(got.status_geolocalizacao) == {"manual_insert"}


def test_market_rows_and_their_reasons(spark, customers):
    got = dict(result(spark, "geo21_clean_market").itertuples(index=False))
    assert sorted(got) == sorted(customers.c_custkey)
    for key, why in got.items():
        assert ("campo_obrigatorio_clientes_total" in why.split("|")) == (key % 4 == 0)
        state, cep = ("SP", "RJ", "BA", "MG", "XX")[key % 5], f"{key * 7919 % 10**8:08}"
        if state == "SP" and cep != "00000000":
            assert ("cep_incompativel_uf" in why.split("|")) == (not "01000000" <= cep <= "19999999")
        assert "campo_obrigatorio_cidade" not in why and "campo_obrigatorio_uf" not in why


def test_cache_rows_are_the_geocoded_ones(spark, customers):
    """Each address that a source placed and that has a house number; the customers' names make every key different."""
    got = result(spark, "geo14_cache_rows")
    source = {0: "cache", 1: "nominatim", 2: "google"}
    want = Counter(source[k % 4] for k in customers.c_custkey if k % 11 and k % 4 < 3)
    assert Counter(got.origem) == want and got.key.is_unique and got.lat.notna().all()
    assert (got.key.str.len() >= 10).all() and not got.key.str.contains("NAN").any()
    inside = {"SP": -22.0, "RJ": -22.0, "BA": -12.0, "MG": -18.0, "XX": -22.1}
    assert all(lat == inside[key.split()[-1].upper()[-2:]] for key, lat in zip(got.key, got.lat))


def test_local_addresses_lose_type_and_complement(spark, customers):
    got = result(spark, "str05_local_geocoding_address").set_index("id").shown
    names = dict(zip(customers.c_custkey, customers.c_name))
    assert sorted(got.index) == sorted(names)
    for key, shown in got.items():
        assert names[key].split("#")[1] in shown and "bloco" not in shown.lower() and "brasil" not in shown.lower() and "  " not in shown
        assert not shown.lower().startswith(("rua ", "av ", "avenida ", "r "))


def test_operational_refinement_ends_when_all_days_hold(spark):
    got = result(spark, "cl16_cl17_refined")
    size = Counter(points(spark, FOLDER).toPandas().state)
    for state, own in got.groupby("state"):
        assert own.points.sum() == size[state]
        assert (own.ok == ((own.minutes <= 900) & (own.km <= 600))).all()
        clusters = own.cluster.nunique()
        assert own.ok.all() or clusters >= min(2 + 4 - 1, size[state])  # all days hold, or the last try was made


def test_passive_centres_are_weighted_means(spark):
    p = points(spark, FOLDER).toPandas().set_index("id")
    got = result(spark, "cl20_passive_clusters")
    assert sorted(got.id) == sorted(p.index[p.sales != 0])
    reach = 35.0 * 120 / 60
    tries = defaultdict(set)
    for (state, label), own in got.groupby(["state", "label"]):
        w, xy = p.loc[own.id].sales.abs().to_numpy(), p.loc[own.id][["lat", "lon"]].to_numpy()
        assert abs((w @ xy / w.sum()) - own[["clat", "clon"]].iloc[0].to_numpy(float)).max() < 1e-9
        for i, r in zip(own.id, own.itertuples()):
            away = km(*p.loc[i, ["lat", "lon"]], r.clat, r.clon)
            assert abs(away - r.distancia_km) < 1e-6 and r.is_outlier == (away > reach) and abs(r.tempo_min - away / 35 * 60) < 1e-4
        tries[state].add(label)
    for labels in tries.values():
        assert labels == set(range(len(labels)))
