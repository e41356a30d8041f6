"""Coordinates: distances, bearings, bounds and repairs as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from campovia.functions.ids import mapped

EARTH_KM = 6371.0
# Bounding boxes by state (south, north, west, east), the country's box, generic points and a regional box.
STATE_BOXES = {
    "AC": (-11.30, -6.96, -74.14, -66.47), "AL": (-10.65, -8.66, -38.39, -35.00), "AM": (-9.97, 2.39, -73.95, -55.94), "AP": (-1.39, 4.65, -55.03, -49.73),
    "BA": (-18.50, -8.38, -46.73, -37.19), "CE": (-8.01, -2.63, -41.57, -37.10), "DF": (-16.20, -15.35, -48.44, -47.16), "ES": (-21.45, -17.74, -42.03, -28.70),
    "GO": (-19.65, -12.24, -53.40, -45.76), "MA": (-10.41, -0.90, -48.91, -41.65), "MG": (-23.07, -14.08, -51.20, -39.71), "MS": (-24.22, -17.02, -58.32, -50.77),
    "MT": (-18.19, -7.20, -61.78, -50.07), "PA": (-9.99, 2.78, -59.05, -45.91), "PB": (-8.45, -5.88, -38.92, -34.64), "PE": (-9.63, -3.65, -41.51, -32.23),
    "PI": (-11.08, -2.60, -46.18, -40.22), "PR": (-26.87, -22.37, -54.77, -47.87), "RJ": (-23.52, -20.61, -45.04, -40.81), "RN": (-7.13, -4.67, -38.73, -34.82),
    "RO": (-13.84, -7.83, -66.96, -59.62), "RR": (-1.73, 5.42, -64.98, -58.74), "RS": (-33.90, -26.93, -57.80, -49.54), "SC": (-29.51, -25.81, -53.99, -48.18),
    "SE": (-11.72, -9.37, -38.40, -36.25), "SP": (-25.51, -19.63, -53.26, -44.01), "TO": (-13.62, -5.02, -50.89, -45.55),
}
COUNTRY_BOX = (-34.0, 5.5, -74.5, -28.0)
GENERIC_POINTS = ((-22.563, -47.401, 5.0), (-14.235004, -51.92528, 10.0))  # latitude, longitude, km around
CITY_CENTRES = ((-23.5506507, -46.6333824), (-22.908333, -43.196388), (-15.7801, -47.9292), (-19.9167, -43.9345))
REGION_BOX = (-25.0, -22.0, -47.5, -45.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


HAVERSINE_SQL = (
    "(2 * 6371.0::DOUBLE * atan2(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)), "
    "sqrt(1 - (pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
)


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    """The same distance as SQL text for an independent engine."""
    return HAVERSINE_SQL.format(a=a, b=b, c=c, d=d)


def bearing(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """The initial course from the reference point, 0 to 2 pi."""
    d = F.radians(lon - lon0)
    y = F.sin(d) * F.cos(F.radians(lat))
    x = F.cos(F.radians(lat0)) * F.sin(F.radians(lat)) - F.sin(F.radians(lat0)) * F.cos(F.radians(lat)) * F.cos(d)
    angle = F.atan2(y, x)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def planar_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def travel_minutes(km: Column, kmh: float, stops: Column | int = 0, service: float = 0.0) -> Column:
    """Driving time and a service time for each stop."""
    return km / max(kmh, 1e-6) * 60 + (F.lit(stops) if isinstance(stops, int) else stops) * service


def repaired_degree(c: Column) -> Column:
    """Decimal commas read, and whole millionths of a degree scaled down."""
    value = F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.abs(value) > 90, value / 1e6).otherwise(value)


def jittered(c: Column, key: Column, width: float) -> Column:
    """Moved by up to width either way, by a hash of key: the same key always moves alike."""
    return c + ((F.pmod(F.xxhash64(key), F.lit(2_000_001)) - 1_000_000) / 1_000_000) * width


def box(lat: Column, lon: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inside or on the bounds (south, north, west, east); nulls are outside."""
    south, north, west, east = bounds
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def sane(lat: Column, lon: Column) -> Column:
    """Both given, numbers, and on the globe."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def state_box_holds(lat: Column, lon: Column, uf: Column) -> Column:
    """Inside the state's box; null for an unknown state."""
    edge = [mapped(uf, {k: v[i] for k, v in STATE_BOXES.items()}, F.lit(None).cast("double")) for i in range(4)]
    return (lat >= edge[0]) & (lat <= edge[1]) & (lon >= edge[2]) & (lon <= edge[3])


def point_status(lat: Column, lon: Column, uf: Column) -> Column:
    """falha without a coordinate, fora_uf outside the state's box, else ok; unknown states pass."""
    return F.when(lat.isNull() | lon.isNull(), "falha").when(F.coalesce(state_box_holds(lat, lon, F.upper(F.trim(uf))), F.lit(True)), "ok").otherwise("fora_uf")


def audit_reason(lat: Column, lon: Column, uf: Column) -> Column:
    """falha_geolocalizacao, uf_invalida or coordenadas_fora_limites, else null."""
    inside = state_box_holds(lat, lon, uf)
    return F.when(lat.isNull() | lon.isNull(), "falha_geolocalizacao").when(inside.isNull(), "uf_invalida").when(~inside, "coordenadas_fora_limites")


def unswapped(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Latitude and longitude, exchanged where only the exchange lies in the country's box."""
    swap = ~box(lat, lon, COUNTRY_BOX) & box(lon, lat, COUNTRY_BOX)
    return F.when(swap, lon).otherwise(lat), F.when(swap, lat).otherwise(lon)


def generic(lat: Column, lon: Column, with_points: bool = True) -> Column:
    """Missing, off the globe, at (0, 0), or (with_points) near a point that geocoders answer when they know nothing."""
    near = [haversine_km(lat, lon, F.lit(a), F.lit(b)) < km for a, b, km in GENERIC_POINTS] if with_points else []
    found = ~sane(lat, lon) | ((F.abs(lat) < 0.0001) & (F.abs(lon) < 0.0001))
    for hit in near:
        found = found | hit
    return F.coalesce(found, F.lit(True))


def at_city_centre(lat: Column, lon: Column) -> Column:
    """Within 0.0005 degrees of one of the centres that stand for whole cities."""
    hit = F.lit(False)
    for a, b in CITY_CENTRES:
        hit = hit | ((F.abs(lat - a) < 0.0005) & (F.abs(lon - b) < 0.0005))
    return F.coalesce(hit, F.lit(False))
