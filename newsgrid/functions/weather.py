"""Weather arithmetic and condition names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgrid import vocab

KPH_TO_MPH, MPH_TO_KPH = 0.621371, 1.60934


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.rint(x)


def bucket_key(lat: Column, lon: Column) -> Column:
    """The 0.1 degree bucket as text."""
    return F.format_string("%.1f,%.1f", half_up(lat * 10) / 10, half_up(lon * 10) / 10)


def c_to_f(c: Column) -> Column:
    return c * 9 / 5 + 32


def f_to_c(f: Column) -> Column:
    return (f - 32) * 5 / 9


def heat_index_f(t: Column, r: Column) -> Column:
    """X2, with the corrections for dry and for damp air."""
    terms = (F.lit(1.0), t, r, t * r, t * t, r * r, t * t * r, t * r * r, t * t * r * r)
    base = sum((k * x for k, x in zip(vocab.HEAT_INDEX[1:], terms[1:])), F.lit(vocab.HEAT_INDEX[0]))
    dry = (13 - r) / 4 * F.sqrt((17 - F.abs(t - 95)) / 17)
    damp = (r - 85) / 10 * ((87 - t) / 5)
    return F.when((r < 13) & t.between(80, 112), base - dry).when((r > 85) & t.between(80, 87), base + damp).otherwise(base)


def wind_chill_f(t: Column, mph: Column) -> Column:
    return 35.74 + 0.6215 * t - 35.75 * F.pow(mph, 0.16) + 0.4275 * t * F.pow(mph, 0.16)


def feels_like_c(temp: Column, humidity: Column, wind_kph: Column) -> Column:
    """Heat index from 80 F with a humidity, wind chill up to 50 F with more than 3 mph, else the temperature."""
    f, mph = c_to_f(temp), wind_kph * KPH_TO_MPH
    return F.when(humidity.isNotNull() & (f >= 80), f_to_c(heat_index_f(f, humidity))).when(wind_kph.isNotNull() & (f <= 50) & (mph > 3), f_to_c(wind_chill_f(f, mph))).otherwise(temp)


def display_temp(temp: Column, country: Column) -> Column:
    """X3."""
    return F.when(F.upper(country) == "US", F.concat(half_up(c_to_f(temp)).cast("int").cast("string"), F.lit("°F"))).otherwise(F.concat(half_up(temp).cast("int").cast("string"), F.lit("°C")))


def parse_wind_kph(text: Column) -> Column:
    """X4: "5 to 10 mph" is its middle; miles unless it says km/h; null without a number."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    base = F.when(F.size(n) >= 2, (n[0] + n[1]) / 2).when(F.size(n) == 1, n[0])
    return F.when(F.lower(text).contains("km/h"), base).otherwise(base * MPH_TO_KPH)


def compass(degrees: Column) -> Column:
    """One of eight points."""
    points = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(points, (F.pmod(F.floor(F.pmod(degrees, F.lit(360.0)) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def condition(text: Column, icon: Column) -> Column:
    """By the icon's code, else by the first keyword of the text."""
    code = F.lower(F.regexp_extract(F.coalesce(icon, F.lit("")), r"([^/?,]*)(?:[,?][^/]*)?$", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, codes in vocab.ICON_CONDITIONS.items():
        out = out.when(code.isin(*codes), name)
    t = F.lower(F.coalesce(text, F.lit("")))
    for name, words in vocab.TEXT_CONDITIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = out.when(hit, name)
    return out.otherwise("UNKNOWN")


def symbol_condition(symbol: Column) -> Column:
    """By the symbol code, its time of day and strength aside."""
    base = F.regexp_replace(F.lower(F.coalesce(symbol, F.lit(""))), "_(day|night|polartwilight)$", "")
    out = F.when(base.contains("thunder"), "THUNDERSTORM")
    bare = F.regexp_replace(base, "^(light)?(heavy)?", "")
    for start, name in vocab.SYMBOL_CONDITIONS:
        out = out.when(bare.startswith(start), name)
    return out.otherwise("UNKNOWN")
