"""Column expressions shared by operators."""

import math

from pyspark.sql import functions as F


def nan_to_null(c):
    return F.when(~F.isnan(c), c)


def wind_from(u, v):
    """Bearing the wind blows from, in degrees [0, 360)."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def confidence_label(c):
    """Letter or 0-100 number to low/nominal/high; anything else is unknown."""
    n = c.try_cast("double")
    return (F.when(F.lower(c) == "l", "low").when(F.lower(c) == "n", "nominal").when(F.lower(c) == "h", "high")
            .when((n > -1) & (n <= 30), "low").when((n > 30) & (n <= 80), "nominal").when((n > 80) & (n <= 101), "high").otherwise("unknown"))


def prior_corrected(p, fraction):
    """Probability after undoing negative sampling at the given fraction."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + F.log(F.lit(float(fraction))))))


def draw_sql(a, b, c, seed):
    """A number in [0, 1) from three small non-negative integers and a seed, as SQL text that gives equal numbers in any engine with 64-bit integers."""
    h = f"((CAST({a} AS BIGINT) * 73856093 + CAST({b} AS BIGINT) * 19349663 + CAST({c} AS BIGINT) * 83492791 + {seed * 2654435}) % 999983)"
    for k in (12345, 67891, 24681):
        h = f"(({h} * {h} % 999983 * {h} + {k}) % 999983)"
    return f"(CAST({h} AS DOUBLE) / 999983)"


def albers_sql(lon, lat, parallels=(34, 40.5), origin=(0, -120), false_northing=-4e6):
    """x and y in metres of an Albers equal-area conic on GRS80 (Snyder 1987), as SQL text; the defaults are EPSG:3310."""
    a, e2 = 6378137.0, 0.00669438002290
    e = math.sqrt(e2)

    def q(s):
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    (s1, m1), (s2, m2) = ((math.sin(p), math.cos(p) ** 2 / (1 - e2 * math.sin(p) ** 2)) for p in map(math.radians, parallels))
    n = (m1 - m2) / (q(s2) - q(s1))
    c = m1 + n * q(s1)
    base = a * math.sqrt(c - n * q(math.sin(math.radians(origin[0])))) / n
    s = f"sin(radians({lat}))"
    qs = f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    rho, theta = f"({a} * sqrt({c!r} - {n!r} * {qs}) / {n!r})", f"({n!r} * radians({lon} - ({origin[1]})))"
    return f"{rho} * sin({theta})", f"{base!r} - {rho} * cos({theta}) + ({false_northing})"


def lonlat_sql(x, y, parallels=(34, 40.5), origin=(0, -120), false_northing=-4e6):
    """Longitude and latitude of the same projection's x and y (Snyder 1987, with three terms of the series), as SQL text."""
    a, e2 = 6378137.0, 0.00669438002290
    e = math.sqrt(e2)

    def q(s):
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    (s1, m1), (s2, m2) = ((math.sin(p), math.cos(p) ** 2 / (1 - e2 * math.sin(p) ** 2)) for p in map(math.radians, parallels))
    n = (m1 - m2) / (q(s2) - q(s1))
    c = m1 + n * q(s1)
    base = a * math.sqrt(c - n * q(math.sin(math.radians(origin[0])))) / n
    down = f"({base!r} - ({y} - ({false_northing})))"
    rho2 = f"(({x}) * ({x}) + {down} * {down})"
    beta = f"asin(({c!r} - {rho2} * {(n / a) ** 2!r}) / {n * q(1.0)!r})"
    terms = ((2, e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040), (4, 23 * e2**2 / 360 + 251 * e2**3 / 3780), (6, 761 * e2**3 / 45360))
    lat = f"degrees({beta}" + "".join(f" + {v!r} * sin({k} * {beta})" for k, v in terms) + ")"
    return f"({origin[1]} + degrees(atan2({x}, {down})) / {n!r})", lat
