"""Lengths and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units in an inch.
TWIPS, EMU = 1440.0, 914400.0
#: Highlight names.
HIGHLIGHTS = {
    "yellow": "#FFFF00",
    "green": "#00FF00",
    "cyan": "#00FFFF",
    "magenta": "#FF00FF",
    "blue": "#0000FF",
    "red": "#FF0000",
    "darkBlue": "#00008B",
    "darkCyan": "#008B8B",
    "darkGreen": "#006400",
    "darkMagenta": "#8B008B",
    "darkRed": "#8B0000",
    "darkYellow": "#B8860B",
    "darkGray": "#A9A9A9",
    "lightGray": "#D3D3D3",
    "black": "#000000",
}
#: Theme colour aliases.
THEME_COLORS = {"background1": "lt1", "text1": "dk1", "background2": "lt2", "text2": "dk2", "hyperlink": "hlink", "followedHyperlink": "folHlink"}
#: Colours that a system names.
SYSTEM_COLORS = {"AUTO": "black", "WINDOWTEXT": "black", "WINDOW": "white"}


def number(value: Column) -> Column:
    """A length as single precision prints it: at most 4 decimals, half to even, no trailing zeros."""
    rounded = F.bround(value.cast("float").cast("double").cast("decimal(38,18)"), 4).cast("decimal(38,4)").cast("string")
    return F.regexp_replace(rounded, r"\.?0+$", "")


def inches(value: Column) -> Column:
    return F.concat(number(value), F.lit("in"))


def twips(value: Column) -> Column:
    return inches(value / F.lit(TWIPS))


def emu(value: Column) -> Column:
    return inches(value / F.lit(EMU))


def points(value: Column, parts: int) -> Column:
    """A number of parts of a point, 2 for half-points or 8 for eighths."""
    return F.concat(number(value / F.lit(float(parts))), F.lit("pt"))


def hex_color(value: Column) -> Column:
    return F.concat(F.lit("#"), F.upper(F.regexp_replace(F.trim(value), "^#+", "")))


def render_color(value: Column) -> Column:
    """A colour as markup writes it."""
    trimmed = F.trim(value)
    bare = F.regexp_replace(trimmed, "^#+", "")
    out = F.when(bare.rlike("^([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.concat(F.lit('rgb("#'), bare, F.lit('")')))
    for name, color in SYSTEM_COLORS.items():
        out = out.when(bare == name, F.lit(color))
    from quire.functions.text import escape_string

    return out.otherwise(F.concat(F.lit('rgb("'), escape_string(trimmed), F.lit('")')))


def highlight(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in HIGHLIGHTS.items() for x in pair]), name)


def let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.transform(F.array(value), then)[0]


def theme_shade(color: Column, tint: Column, shade: Column) -> Column:
    """`#RRGGBB` with its lightness multiplied by shade/255 and then moved to white by 1 - tint/255; in single precision."""
    f = lambda x: x.cast("float")
    one, none, two, six = (f(F.lit(x)) for x in (1.0, 0.0, 2.0, 6.0))
    bare = F.regexp_replace(F.trim(color), "^#+", "")
    part = lambda i: f(f(F.conv(F.substring(bare, i, 2), 16, 10)) / 255)
    given = F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), tint.alias("tint"), shade.alias("shade"))

    def spread(s):
        top, low = F.greatest(s["r"], s["g"], s["b"]), F.least(s["r"], s["g"], s["b"])
        return F.struct(s["r"].alias("r"), s["g"].alias("g"), s["b"].alias("b"), s["tint"].alias("tint"), s["shade"].alias("shade"), top.alias("top"), f(top - low).alias("delta"), f(f(top + low) / 2).alias("light"))

    def hue(s):
        turn = f(f(s["g"] - s["b"]) / s["delta"])
        sector = F.when(s["delta"] == 0, none).when(s["top"] == s["r"], F.when(turn < 0, f(turn + six)).otherwise(turn))
        sector = sector.when(s["top"] == s["g"], f(f(f(s["b"] - s["r"]) / s["delta"]) + two)).otherwise(f(f(f(s["r"] - s["g"]) / s["delta"]) + f(F.lit(4.0))))
        shaded = F.when(s["shade"].isNotNull(), f(s["light"] * f(f(s["shade"]) / 255))).otherwise(s["light"])
        share = f(f(s["tint"]) / 255)
        tinted = F.when(s["tint"].isNotNull(), f(f(shaded * share) + f(one - share))).otherwise(shaded)
        saturation = F.when(s["delta"] == 0, none).otherwise(f(s["delta"] / f(one - F.abs(f(f(two * s["light"]) - one)))))
        return F.struct(f(sector / 6).alias("h"), saturation.alias("s"), F.least(F.greatest(tinted, none), one).alias("l"))

    def mixed(s):
        q = F.when(s["l"] < 0.5, f(s["l"] * f(one + s["s"]))).otherwise(f(f(s["l"] + s["s"]) - f(s["l"] * s["s"])))
        return let(F.struct(q.alias("q"), s["h"].alias("h"), s["s"].alias("s"), s["l"].alias("l")), rgb)

    def rgb(s):
        p, third = f(f(two * s["l"]) - s["q"]), f(one / 3)
        places = F.array(f(s["h"] + third), s["h"], f(s["h"] - third))
        turned = F.transform(places, lambda v: F.when(v < 0, f(v + one)).when(v > 1, f(v - one)).otherwise(v))
        step = f(s["q"] - p)

        def channel(v):
            rising = f(p + f(f(step * six) * v))
            falling = f(p + f(f(step * f(f(two / 3) - v)) * six))
            return F.when(s["s"] == 0, s["l"]).when(v < f(one / 6), rising).when(v < 0.5, s["q"]).when(v < f(two / 3), falling).otherwise(p)

        codes = F.transform(F.transform(turned, channel), lambda v: F.lpad(F.hex(F.floor(f(F.least(F.greatest(v, none), one) * f(F.lit(255.0)))).cast("long")), 2, "0"))
        return F.concat(F.lit("#"), F.array_join(codes, ""))

    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), let(let(let(given, spread), hue), mixed))
