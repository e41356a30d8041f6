"""The library's functions for use in SQL text: scalar functions, and group operators as table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from campovia.functions import text
from campovia.operators import dispatch
from campovia.operators import heuristics as h

# Expressions in SQL: Spark puts their text into the query's plan, so nothing leaves the JVM.
SCALARS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": """2 * 6371.0D * atan2(
        sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)),
        sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))""",
    "travel_minutes(km DOUBLE, kmh DOUBLE, stops INT, service DOUBLE) RETURNS DOUBLE": "km / greatest(kmh, 1e-6D) * 60 + stops * service",
    "coordinate_sane(lat DOUBLE, lon DOUBLE) RETURNS BOOLEAN": "coalesce(NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 180, false)",
    "repaired_degree(x DOUBLE) RETURNS DOUBLE": "CASE WHEN abs(x) > 90 THEN x / 1e6D ELSE x END",
    "cep_valid(cep STRING) RETURNS BOOLEAN": "coalesce(trim(replace(cep, '-', '')) RLIKE '^[0-9]{8}$' AND trim(replace(cep, '-', '')) <> '00000000', false)",
    "only_digits(x STRING) RETURNS STRING": "regexp_replace(x, '[^0-9]', '')",
}
#: Functions over Arrow batches, for what SQL has no expression of.
BATCHED = {"fix_encoding": text.fix_encoding, "ascii_only": text.ascii_only, "without_marks": text.without_marks, "title_after_any_break": text.title_after_any_break}


class _Group:
    """Gathers a partition's rows (id, lat, lon), in order of id; rows without coordinates are left out."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.given = "{}"

    def eval(self, row: Row, given: str = "{}") -> None:
        """One row; given: settings as JSON."""
        if row["lat"] is not None and row["lon"] is not None:
            self.rows.append((row["id"], float(row["lat"]), float(row["lon"]), str(row["grupo"])))
        self.given = given

    def sorted(self) -> tuple[list, np.ndarray]:
        """Ids with their groups, and coordinates."""
        rows = sorted(self.rows)
        return [(r[3], r[0]) for r in rows], np.array([r[1:3] for r in rows], float).reshape(-1, 2)


class Territories(_Group):
    """territories(TABLE(t) PARTITION BY (grupo), settings): (grupo, id, label, consultor, banda_status) of t's (grupo, id, lat, lon)."""

    def terminate(self) -> Iterator[tuple]:
        """The group's rows."""
        names, xy = self.sorted()
        if names:
            labels, owners, status = dispatch.labels_of(xy, dispatch.settings(json.loads(self.given)))
            yield from ((g, i, int(x), o, str(b)) for (g, i), x, o, b in zip(names, labels, owners, status))


class Tours(_Group):
    """tours(TABLE(t) PARTITION BY (grupo), settings): (grupo, id, ordem, km_rota, min_rota), each group's closed tour from its mean point, improved by 2-opt."""

    def terminate(self) -> Iterator[tuple]:
        """The group's rows."""
        names, xy = self.sorted()
        if names:
            s = dispatch.settings(json.loads(self.given))
            r = h.route(xy, xy.mean(axis=0), s.v_kmh, s.service_min, s.alpha_path, improve=True)
            yield from ((*names[i], n, float(r["km"]), float(r["minutes"])) for n, i in enumerate(r["order"], 1))


TABLE_FUNCTIONS = {
    "territories": (Territories, "grupo string, id long, label long, consultor string, banda_status string"),
    "tours": (Tours, "grupo string, id long, ordem int, km_rota double, min_rota double"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session, under their own names; those that are there already are replaced.

    Table functions take TABLE(...) PARTITION BY grupo and settings as JSON by their public names: Spark brings each group to one task, so a group is
    a territory or a route, not a table.
    """
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in BATCHED.items():
        spark.udf.register(name, function)
    for name, (handler, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=kind))
    return [*(head.partition("(")[0] for head in SCALARS), *BATCHED, *TABLE_FUNCTIONS]
