"""Reasons as text, and what they say read back from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|inf|nan)"
# fixed values: the texts of the reasons; m is what was measured, t the limit, lo and hi the range allowed, band the number of the band
TEXTS = {
    "skew": "skewed transform (skew={m:.3f} > {t:.3f})",
    "area": "abnormal area (area={m:.3g}, allowed=[{lo:.3g}, {hi:.3g}])",
    "aspect": "abnormal aspect ratio (ar={m:.2f} > {t:.2f})",
    "valid": "mostly nodata in centre (valid={m:.2f} < {t:.2f})",
    "saturation": "saturated centre (sat={m:.2f} > {t:.2f})",
    "std": "low variance centre (std={m:.2f} < {t:.2f})",
    "outlier": "area outlier vs MAD band (area={m:.3g}, allowed=[{lo:.3g}, {hi:.3g}])",
    "dropout": "band {band} dropout (frac={m:.2f}, allowed=[0, {t:.2f}])",
    "stripe": "band {band} striping (ratio={m:.2f}, allowed=[0, {t:.2f}])",
}


def _special(x: Column, text: Column) -> Column:
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.when(x < 0, F.lit("-inf")).otherwise(F.lit("inf"))).otherwise(text)


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, half to even; inf, -inf or nan."""
    return _special(x, F.regexp_replace(F.format_number(x, places), ",", ""))


def significant(x: Column, digits: int = 3) -> Column:
    """A number with so many significant digits at most, no trailing zeros, and an exponent where that is below -4 or not below digits."""
    size = F.floor(F.log10(F.abs(x)))
    scaled = lambda e: F.rint(F.abs(x) / F.pow(F.lit(10.0), e - (digits - 1)))
    # 999.6 has four digits once it is rounded
    size = F.when(scaled(size) >= 10**digits, size + 1).otherwise(size)
    whole = scaled(size)
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.concat(F.when(size < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(size).cast("string"), 2, "0"))
    scientific = F.concat(trimmed(fixed(whole / 10 ** (digits - 1), digits - 1)), power)
    plain = trimmed(F.coalesce(*(F.when(size == k, fixed(F.abs(x), digits - 1 - k)) for k in range(-4, digits))))
    text = F.when((size < -4) | (size >= digits), scientific).otherwise(plain)
    return _special(x, F.when(x == 0, F.lit("0")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)))


def reason_text(reason: Column, measured: Column, threshold: Column, low: Column | None = None, high: Column | None = None, band: Column | None = None) -> Column:
    """The sentence of a rejection, NULL without a reason."""
    nothing = F.lit(None).cast("double")
    values = {"m": measured, "t": threshold, "lo": nothing if low is None else low, "hi": nothing if high is None else high, "band": F.lit(None) if band is None else band}
    forms = sorted({tuple(x.split("}")[0].split(":")) for text in TEXTS.values() for x in text.split("{")[1:] if ":" in x})
    written = F.array(*(F.coalesce(significant(values[k]) if form.endswith("g") else fixed(values[k], int(form[1])), F.lit("")) for k, form in forms))
    # one number is written in several sentences: it is worked out once
    return F.get(F.transform(F.array(written), lambda numbers: _sentence(reason, values["band"], dict(zip(forms, (F.get(numbers, F.lit(i)) for i in range(len(forms))), strict=True)))), F.lit(0))


def _sentence(reason: Column, band: Column, numbers: dict[tuple[str, str], Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, text in TEXTS.items():
        parts = []
        for piece in text.replace("}", "{").split("{"):
            key, _, form = piece.partition(":")
            parts.append(numbers.get((key, form), F.coalesce(band.cast("string"), F.lit("")) if key == "band" else F.lit(piece)))
        out = F.when(reason == name, F.concat(*parts)).otherwise(out)
    return out


def parse_reason(text: Column) -> tuple[Column, Column]:
    """(measured, threshold) as text from a reason's text, the threshold of a range being [low, high]; empty where the text has another form."""
    one = rf"\([A-Za-z_]+=({NUMBER}) [<>] ({NUMBER})\)"
    span = rf"\([A-Za-z_]+=({NUMBER}), allowed=(\[{NUMBER}, {NUMBER}\])\)"
    return tuple(F.coalesce(F.concat(F.regexp_extract(text, one, k), F.regexp_extract(text, span, k)), F.lit("")) for k in (1, 2))
