"""Colour as column expressions: sRGB, linear light, OKLab, luminance, photo sliders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the OKLab transform.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _mul(matrix: tuple, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix)


def to_linear(byte: Column) -> Column:
    """An sRGB byte in linear light, 0 to 1."""
    v = byte / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_byte(linear: Column) -> Column:
    """Linear light as an sRGB byte, clipped."""
    c = F.least(F.greatest(linear, F.lit(0.0)), F.lit(1.0))
    v = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return F.floor(v * 255 + 0.5).cast("int")


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) of sRGB bytes."""
    lms = _mul(TO_LMS, (to_linear(r), to_linear(g), to_linear(b)))
    return _mul(TO_LAB, tuple(F.cbrt(x) for x in lms))


def with_oklab(rows: DataFrame, names: tuple[str, str, str] = ("ok_l", "ok_a", "ok_b")) -> DataFrame:
    """``rows`` with the OKLab of r, g, b.  Each step is a column of its own, so that no expression holds another several times."""
    linear = rows.withColumns({f"_{c}": to_linear(F.col(c)) for c in "rgb"})
    lms = _mul(TO_LMS, tuple(F.col(f"_{c}") for c in "rgb"))
    rooted = linear.withColumns({f"_m{i}": F.cbrt(x) for i, x in enumerate(lms)})
    lab = _mul(TO_LAB, tuple(F.col(f"_m{i}") for i in range(3)))
    return rooted.withColumns(dict(zip(names, lab, strict=True))).drop("_r", "_g", "_b", "_m0", "_m1", "_m2")


def with_rgb(rows: DataFrame, lab: tuple[Column, Column, Column], names: tuple[str, str, str]) -> DataFrame:
    """``rows`` with sRGB bytes of OKLab columns, channels clipped, step by step."""
    cubed = rows.withColumns({f"_l{i}": F.pow(x, F.lit(3.0)) for i, x in enumerate(_mul(FROM_LAB, lab))})
    linear = cubed.withColumns({f"_c{i}": x for i, x in enumerate(_mul(FROM_LMS, tuple(F.col(f"_l{i}") for i in range(3))))})
    return linear.withColumns({n: to_byte(F.col(f"_c{i}")) for i, n in enumerate(names)}).drop(*(f"_{x}{i}" for x in "lc" for i in range(3)))


def linear_of_oklab(lab: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return _mul(FROM_LMS, tuple(F.pow(x, F.lit(3.0)) for x in _mul(FROM_LAB, lab)))


def rgb_of_oklab(lab: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """sRGB bytes, channels clipped."""
    return tuple(to_byte(x) for x in linear_of_oklab(lab))


def distance_sq(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.2126 * r + 0.7152 * g + 0.0722 * b + 0.5).cast("int")


def hue_bin(a: Column, b: Column, bins: int = 12) -> Column:
    turn = F.pmod(F.atan2(b, a) / (2 * 3.141592653589793) + 1, F.lit(1.0))
    return F.least(F.floor(turn * bins), F.lit(bins - 1)).cast("int")


#: Fixed values of the photo sliders: lightness of mid grey, reach of each slider at its end.
MID_L, BRIGHTNESS_REACH, CONTRAST_REACH, WARM_A, WARM_B = 0.5999, 0.6, 0.8, 0.018, 0.055


def adjust_oklab(lab: tuple[Column, Column, Column], brightness: int = 0, contrast: int = 0, saturation: int = 0, temperature: int = 0) -> tuple[Column, Column, Column]:
    """Sliders from -100 to 100; all at 0 leave the columns as they are, so no work is planned.

    Brightness pulls L towards white or black, contrast turns it about mid grey, saturation scales chroma, temperature adds amber or blue.
    """
    if not (brightness or contrast or saturation or temperature):
        return lab
    light, a, b = lab
    pull = brightness / 100 * BRIGHTNESS_REACH
    light = light + pull * (1.0 - light) if brightness >= 0 else light * (1.0 + pull)
    light = MID_L + (light - MID_L) * (1.0 + contrast / 100 * CONTRAST_REACH)
    scale = 1.0 + saturation / 100
    return F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)), a * scale + temperature / 100 * WARM_A, b * scale + temperature / 100 * WARM_B
