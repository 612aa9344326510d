"""Geodesy and scalar feature functions as native Columns.

Fixed values: Earth radius 6371.0 km, 111.0 km a degree, UTM on the WGS84 ellipsoid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_PER_DEGREE = 6371.0, 111.0
GRID_PX, PIXEL_M, HALF_SCENE_M = 2048, 10.0, 10_240.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def offset(lat, lon, km, angle) -> tuple[Column, Column]:
    """Point at a planar offset of ``km`` at ``angle`` (radians from north, clockwise)."""
    lat, lon, km, angle = map(col, (lat, lon, km, angle))
    return lat + km * F.cos(angle) / KM_PER_DEGREE, lon + km * F.sin(angle) / (KM_PER_DEGREE * F.cos(F.radians(lat)))


def utm_epsg(lat, lon) -> Column:
    """326zz north of (and on) the equator, 327zz south; no polar or Norwegian exceptions, longitude 180 is zone 61."""
    zone = F.floor((col(lon) + 180) / 6) + 1
    return (F.when(col(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


# WGS84 and the third flattening; series coefficients of the transverse Mercator in powers of n (Krueger).
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def to_utm(lat, lon, epsg) -> tuple[Column, Column]:
    """(easting, northing) in metres in the zone of the EPSG code."""
    lat, lon, epsg = map(col, (lat, lon, epsg))
    phi, lam = F.radians(lat), F.radians(lon - ((epsg % 100) * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = F.when(epsg >= 32700, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
    return F.lit(500_000.0) + F.lit(_K0 * _RECT) * x, north + F.lit(_K0 * _RECT) * y


def to_utm_powers(lat, lon, epsg) -> tuple[Column, Column]:
    """(easting, northing) by the older series in powers of the distance from the middle of the zone; within a millimetre of
    :func:`to_utm` inside a zone, and term by term what ``utm_zone``'s SQL states."""
    lat, lon, epsg = map(col, (lat, lon, epsg))
    p, dl = F.radians(lat), F.radians(lon - ((epsg % 100) * 6 - 183))
    e2, a = 0.00669437999014132, _A
    ep, sin, cos, tan = e2 / (1 - e2), F.sin(p), F.cos(p), F.tan(p)
    nn, t, c, aa = F.lit(a) / F.sqrt(1 - F.lit(e2) * sin * sin), tan * tan, F.lit(ep) * cos * cos, cos * dl
    mm = F.lit(a) * (
        F.lit(1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * p - F.lit(3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * F.sin(2 * p)
        + F.lit(15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * F.sin(4 * p) - F.lit(35 * e2 * e2 * e2 / 3072) * F.sin(6 * p)
    )
    x = aa + (1 - t + c) * F.pow(aa, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * c - F.lit(58 * ep)) * F.pow(aa, F.lit(5)) / 120
    y = aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - F.lit(330 * ep)) * F.pow(aa, F.lit(6)) / 720
    north = F.when(epsg >= 32700, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
    return F.lit(500_000.0) + F.lit(_K0) * nn * x, north + F.lit(_K0) * (mm + nn * tan * y)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def from_utm(x, y, epsg) -> Column:
    """Struct (lat, lon) in degrees of a UTM point."""
    x, y, epsg = map(col, (x, y, epsg))
    north = F.when(epsg >= 32700, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
    start = F.struct(((y - north) / (_K0 * _RECT)).alias("xi"), ((x - 500_000.0) / (_K0 * _RECT)).alias("eta"), ((epsg % 100) * 6 - 183).alias("mid"))

    def unroll(v):
        xp, ep = v["xi"], v["eta"]
        for j, b in enumerate(_BETA, 1):
            xp = xp - F.lit(b) * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            ep = ep - F.lit(b) * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return let(F.struct(F.asin(F.sin(xp) / F.cosh(ep)).alias("chi"), (F.degrees(F.atan2(F.sinh(ep), F.cos(xp))) + v["mid"]).alias("lon")), finish)

    def finish(v):
        phi = v["chi"]
        for j, d in enumerate(_DELTA, 1):
            phi = phi + F.lit(d) * F.sin(2 * j * v["chi"])
        return F.struct(F.degrees(phi).alias("lat"), v["lon"].alias("lon"))

    return let(start, unroll)


def master_grid(lat, lon, half_m: float = HALF_SCENE_M, buffer_m: float = 0.0, pixel_m: float = PIXEL_M) -> Column:
    """Struct of a scene's grid: centre, epsg, bounds, affine (six doubles, north up), shape and WGS84 bounding box
    (the envelope of the four projected corners, rounded to 5 decimals)."""
    half = half_m + buffer_m
    px = round(2 * half / pixel_m)
    res = F.lit(2 * half / px)
    epsg = utm_epsg(lat, lon)
    x, y = to_utm(lat, lon, epsg)
    centre = F.struct(col(lat).alias("lat"), col(lon).alias("lon"), epsg.alias("epsg"), (x - half).alias("x0"), (x + half).alias("x1"), (y - half).alias("y0"), (y + half).alias("y1"))

    def body(v):
        corners = F.array(*(from_utm(v[a], v[b], v["epsg"]) for a in ("x0", "x1") for b in ("y0", "y1")))
        lats, lons = F.transform(corners, lambda c: c["lat"]), F.transform(corners, lambda c: c["lon"])
        return F.struct(
            v["lat"].alias("lat"), v["lon"].alias("lon"), v["epsg"].alias("epsg"), v["x0"].alias("min_x"), v["y0"].alias("min_y"), v["x1"].alias("max_x"), v["y1"].alias("max_y"),
            F.array(res, F.lit(0.0), v["x0"], F.lit(0.0), -res, v["y1"]).alias("transform"), F.lit(px).alias("rows"), F.lit(px).alias("cols"),
            F.array(*(F.round(e, 5) for e in (F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)))).alias("bbox"),
        )

    return let(centre, body)


def in_ring(lat, lon, ring: list[tuple[float, float]] | None) -> Column:
    """Even-odd test of a literal ring of (lon, lat); always true without one. Stays in generated code."""
    if not ring:
        return F.lit(True)
    lat, lon = col(lat), col(lon)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)) & (lon < (lat - float(y1)) * ((x2 - x1) / (y2 - y1)) + float(x1))
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def in_rings(lat, lon, rings) -> Column:
    """The same for a column of rings, ``array<array<struct<lon,lat>>>`` (a broadcast country row); null: true."""
    lat, lon = col(lat), col(lon)

    def crossings(ring):
        nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        edges = F.arrays_zip(ring.alias("a"), nxt.alias("b"))
        hit = lambda e: (((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"])).cast("int")
        return F.aggregate(F.transform(edges, lambda e: F.coalesce(hit(e), F.lit(0))), F.lit(0), lambda a, v: a + v)

    total = F.aggregate(F.transform(col(rings), crossings), F.lit(0), lambda a, v: a + v)
    return F.coalesce(total % 2 == 1, F.lit(True))


def clip(x, lo: float | None, hi: float | None) -> Column:
    """numpy's clip: NaN stays NaN, although Spark orders it above every number."""
    x = col(x)
    y = x if lo is None else F.greatest(x, F.lit(lo))
    y = y if hi is None else F.least(y, F.lit(hi))
    return F.when(F.isnan(x), x).otherwise(y)


def fill(x, value: float) -> Column:
    """NaN and null become the layer's default."""
    return F.coalesce(F.nanvl(col(x), F.lit(float(value))), F.lit(float(value)))


def capped_time(hours, cap: float = 12.0) -> Column:
    """Unreachable (infinite) becomes the cap; the rest is clipped to it."""
    h = col(hours)
    return F.when(h == float("inf"), F.lit(cap)).otherwise(clip(h, 0.0, cap))


def rgb_stretch(x, top: float = 3000.0) -> Column:
    return fill(clip(col(x) / top, 0.0, 1.0), 0.0)


def log_anchor(x, reference: float = 1e6) -> Column:
    return F.log1p(col(x)) / F.lit(math.log1p(reference))


def slope_degrees(dz_east, dz_south) -> Column:
    return F.degrees(F.atan(F.sqrt(col(dz_east) * col(dz_east) + col(dz_south) * col(dz_south))))


def facing(dz_east, dz_south) -> tuple[Column, Column]:
    """(northness, eastness) of the downslope direction; 0 on ground flatter than 0.1 degrees."""
    aspect = F.pmod(F.atan2(-col(dz_east), col(dz_south)), F.lit(2 * math.pi))
    flat = slope_degrees(dz_east, dz_south) < 0.1
    return F.when(flat, 0.0).otherwise(F.cos(aspect)), F.when(flat, 0.0).otherwise(F.sin(aspect))


def step_hours(dx_m, dh_m, on_network) -> Column:
    """Walking time of one lattice step; null where it is too steep or too slow."""
    dx, dh = col(dx_m), col(dh_m)
    slope = dh / dx
    speed = 6.0 * F.exp(-3.5 * F.abs(slope + 0.05))
    t = dx / 1000.0 / speed + F.when(dh > 0, dh / 600.0).otherwise(0.0)
    t = t * F.when(col(on_network), 1.0).otherwise(2.5)
    return F.when((slope <= 0.7813) & (slope >= -0.7002) & (speed > 0.01), t)


def unit_hash(*parts, seed: int = 0) -> Column:
    """A number in [0, 1) from the content: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(*(col(p) for p in parts), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
