"""Scalar functions as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Biomass in kg is a * DBH**b, DBH in cm.
MODELS = {
    "tropical_chave": (0.0673, 2.616),
    "temperate_jenkins": (0.0346, 2.9451),
    "urban_generic": (0.1066, 2.4572),
}


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def lst_celsius(dn: Column) -> Column:
    return dn * 0.00341802 + 149.0 - 273.15


def ndvi_class(x: Column, hi: float = 0.35, lo: float = 0.10) -> Column:
    return F.when(x >= hi, 0).when(x < lo, 1).when(x.isNotNull(), 2)


def clip(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def pop_density(people: Column, area_m2: Column) -> Column:
    return people / F.greatest(area_m2 / 10000, F.lit(0.01))


def block_id_index(x: Column, y: Column, x0: int, y0: int, size: int = 250) -> Column:
    return F.concat(F.lit("PN_"), F.floor((x - x0) / size).cast("string"), F.lit("_"), F.floor((y - y0) / size).cast("string"))


def block_id_corner(x: Column, y: Column, size: int = 250) -> Column:
    return F.concat(F.lit("PN_"), (F.floor(x / size) * size).cast("string"), F.lit("_"), (F.floor(y / size) * size).cast("string"))


def pilot_id(row: Column, col: Column) -> Column:
    return F.concat(F.lit("R"), F.lpad(row.cast("string"), 2, "0"), F.lit("_C"), F.lpad(col.cast("string"), 2, "0"))


def bounds_from_point(lon: Column, lat: Column, metres: float) -> list[Column]:
    dy = F.lit(metres / 111320.0)
    dx = F.lit(metres) / (F.lit(111320.0) * F.cos(F.radians(lat)))
    return [lon - dx, lat - dy, lon + dx, lat + dy]


# Fixed values of the projection: WGS84 ellipsoid, zone 43 north (central meridian 75 E).
A, FLATTENING, K0, MERIDIAN, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 75.0, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def utm43n(lon: Column, lat: Column) -> list[Column]:
    """Easting and northing by the Krueger series to the fourth order."""
    phi, lam = F.radians(lat), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return [EASTING + K0 * _R * x, K0 * _R * y]


def wgs84(x: Column, y: Column) -> list[Column]:
    """Longitude and latitude of zone 43 north coordinates."""
    xi, eta = y / (K0 * _R), (x - EASTING) / (K0 * _R)
    u, w = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        w = w - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(w))  # conformal latitude; the series leads back to the geographic one
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return [MERIDIAN + F.degrees(F.atan2(F.sinh(w), F.cos(u))), F.degrees(lat)]


def tile_xy(lon: Column, lat: Column, z: int) -> list[Column]:
    n = float(1 << z)
    y = (1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n
    return [F.floor((lon + 180) / 360 * n), F.floor(y)]


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of points; holes run the other way and subtract."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def ring_centroid(ring: Column) -> list[Column]:
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    part = lambda c: F.aggregate(F.zip_with(ring, nxt, lambda a, b: (a[c] + b[c]) * (a["x"] * b["y"] - b["x"] * a["y"])), F.lit(0.0), lambda s, v: s + v)
    return [F.try_divide(part(c), 6 * ring_area(ring)) for c in ("x", "y")]


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast; points on the edge may fall on either side."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(cross, F.lit(0), lambda s, v: s + v) % 2 == 1


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(minx, miny), p(maxx, miny), p(maxx, maxy), p(minx, maxy))


def circle(x: Column, y: Column, r: float, n: int = 32) -> Column:
    point = lambda k: F.struct((x + r * F.cos(2 * math.pi * k / n)).alias("x"), (y + r * F.sin(2 * math.pi * k / n)).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def geom_hash(ring: Column) -> Column:
    """SHA-256 of the well-known text with three decimals."""
    text = F.transform(ring, lambda p: F.format_string("%.3f %.3f", p["x"], p["y"]))
    return F.sha2(F.concat(F.lit("POLYGON (("), F.array_join(F.concat(text, F.slice(text, 1, 1)), ", "), F.lit("))")), 256)


def uuid5(namespace: str, name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.element_at(F.split(variant, ""), nibble + 1), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def cache_key(lat: Column, lon: Column) -> Column:
    return F.md5(F.format_string("%.4f,%.4f", lat, lon))


def dbh_from_crown(crown_m: Column, ratio: float = 20.0) -> Column:
    return crown_m * 100 / ratio


def dbh_from_volume(volume: Column, height: float = 8.0, shape: str = "sphere", ratio: float = 20.0) -> Column:
    """Crown diameter of a sphere, cone or ellipsoid of this volume, as stem diameter in cm."""
    if shape == "sphere":
        d = F.cbrt(6 * volume / math.pi)
    elif shape == "cone":
        d = 2 * F.sqrt(3 * volume / (math.pi * height))
    else:
        d = 2 * F.sqrt(3 * volume / (4 * math.pi * (height / 2)))
    return dbh_from_crown(d, ratio)


def agb(dbh: Column, model: str | tuple[float, float] = "urban_generic") -> Column:
    """Biomass by a named model or by (a, b)."""
    a, b = MODELS[model] if isinstance(model, str) else model
    return F.when(dbh > 0, a * F.pow(dbh, F.lit(b))).otherwise(0.0)


def co2(agb_kg: Column) -> Column:
    return agb_kg * 0.47 * (44.0 / 12.0) / 1000


def height_fallback(fraction: Column) -> Column:
    return F.when(fraction <= 0.0001, 0.0).otherwise(clip(3 + 12 * fraction, 0.0, 15.0))


def density_per_ha(stock: Column, area_m2: Column) -> Column:
    return F.try_divide(stock, area_m2 / 10000)


def need_tier(score: Column) -> Column:
    return F.when(score < 25, "Critical").when(score < 50, "High").when(score < 75, "Moderate").when(score.isNotNull(), "Low").otherwise("Unscored")


def need_text(score: Column, impervious: Column, temperature: Column, tree_density: Column, population: Column, canopy_m2: Column, stock_t: Column) -> Column:
    """The sentence of a score's band; a missing indicator has a word instead."""
    text = lambda form, x, word: F.when(x.isNotNull(), F.format_string(form, x)).otherwise(word)
    one = F.format_string("%.1f", score)
    # The sentences of the four bands and of blocks without a score.
    return (
        F.when(score.isNull(), "Unscored block — excluded from baseline evaluation (e.g. water body, quarry, or data gap).")
        .when(score < 25, F.concat(F.lit("Critical Ecological Need: Score "), one, F.lit(" reflects severe vegetative deficit with "), text("%.0f%%", impervious * 100, "High"), F.lit(" impervious cover and "), text("%.1f°C", temperature, "Elevated"), F.lit(" surface temperature.")))
        .when(score < 50, F.concat(F.lit("High Intervention Need: Score "), one, F.lit(" indicates high thermal and vegetative vulnerability (tree density: "), text("%.2f", tree_density, "Low"), F.lit(", population heat exposure: "), F.format_string("%.2f", F.coalesce(population, F.lit(0.0))), F.lit(").")))
        .when(score < 75, F.concat(F.lit("Moderate Stress: Score "), one, F.lit(" with canopy baseline of "), text("%.0f m²", canopy_m2, "Moderate"), F.lit(". Secondary candidate for selective canopy infill.")))
        .otherwise(F.concat(F.lit("Low Need / Stable: Score "), one, F.lit(" indicates preserved vegetation ("), text("%.1f t CO₂e", stock_t, "Substantial"), F.lit(" standing carbon). Priority is canopy conservation.")))
    )


# Display labels of candidate classes, and the tags that make a class.
CLASS_LABELS = {
    "candidate_other_open_space": "Other open space",
    "candidate_public_like": "Public-like open space",
    "candidate_context_dependent": "Context-dependent",
    "other_open_space": "Other open space",
    "public_like": "Public-like open space",
    "context_dependent": "Context-dependent",
}
PUBLIC_LIKE = ("park", "garden", "recreation_ground", "pitch", "village_green")
CONTEXT = "farmland cemetery school college university hospital graveyard institutional education residential commercial industrial allotments retail".split()


def class_display(c: Column) -> Column:
    """The label of a known class, else its words in title case."""
    known = F.lit(None).cast("string")
    for k, label in CLASS_LABELS.items():
        known = F.when(c == k, label).otherwise(known)
    words = F.initcap(F.replace(F.replace(c, F.lit("candidate_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return F.coalesce(known, words)


def candidate_class(landuse: Column, leisure: Column, amenity: Column) -> Column:
    return F.when(leisure.isin(*PUBLIC_LIKE) | landuse.isin(*PUBLIC_LIKE), "candidate_public_like_open_space").when(landuse.isin(*CONTEXT) | amenity.isin(*CONTEXT), "context_dependent").otherwise("candidate_other_open_space")


def source_landuse(landuse: Column, leisure: Column, amenity: Column) -> Column:
    return F.concat_ws(";", *(F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c)) for n, c in (("landuse", landuse), ("leisure", leisure), ("amenity", amenity))))


def allowed_keys(text: Column, keys: list[str], longest: int = 40) -> Column:
    """A map of the allowed keys of a JSON object whose values are not too long."""
    return F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: k.isin(*keys) & (F.length(v) <= longest))


def parse_point(text: Column) -> Column:
    """struct(x, y) of a WKT, EWKT or GeoJSON point in zone 43 north; NULL for others."""
    wkt = r"^\s*(?:SRID=(\d+);)?\s*POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)\s*$"
    srid = F.regexp_extract(text, wkt, 1)
    x = F.coalesce(F.regexp_extract(text, wkt, 2).try_cast("double"), F.get_json_object(text, "$.coordinates[0]").try_cast("double"))
    y = F.coalesce(F.regexp_extract(text, wkt, 3).try_cast("double"), F.get_json_object(text, "$.coordinates[1]").try_cast("double"))
    ok = (srid.isin("", "32643") | srid.isNull()) & x.between(166000, 834000) & y.between(0, 10000000)
    return F.when(ok, F.struct(x.alias("x"), y.alias("y")))


def patch_corner(name: Column) -> list[Column]:
    return [F.regexp_extract(name, r"^patch_(\d+)_(\d+)", i).try_cast("int") for i in (1, 2)]
