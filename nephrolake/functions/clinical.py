"""Scalar functions of the clinical pipeline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CREATININE_ITEMS = (50912, 51081, 52024, 52546)
URINE_ITEMS = (226559, 226560, 226561, 226567, 226627, 226631, 227489)
TOPICS = {
    "aki.labs.events": ("creatinine", "bmp", "electrolytes", "lab"),
    "aki.vitals.events": ("heart_rate", "blood_pressure", "spo2", "temperature", "vital"),
    "aki.fluids.events": ("urine", "urine_output", "fluid", "iv_total"),
}
AGE_BINS = ((18, "<18"), (30, "18-30"), (40, "30-40"), (50, "40-50"), (60, "50-60"), (70, "60-70"), (80, "70-80"), (120, "80+"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """NaN as NULL: NaN would pass every ``>=`` test."""
    return F.when(~F.isnan(col(c)), col(c))


def hour_bucket(c: Column | str) -> Column:
    return F.date_trunc("HOUR", col(c)).cast("timestamp_ntz")


def hour_boundaries(a: Column | str, b: Column | str) -> Column:
    """How many full hours begin between two times (00:59 to 01:01: one)."""
    at = lambda c: F.unix_timestamp(F.date_trunc("HOUR", col(c)))
    return ((at(b) - at(a)) / 3600).cast("long")


def fractional_hours(a: Column | str, b: Column | str) -> Column:
    at = lambda c: F.unix_timestamp(col(c).cast("timestamp"))
    return (at(b) - at(a)) / 3600.0


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """NULL where the divisor is 0 or NULL."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def age_group(age: Column | str) -> Column:
    """Two groups; an unknown age counts as the older one."""
    return F.when(col(age) < 65, "<65").otherwise(">=65")


def generalize_age(age: Column | str) -> Column:
    c, out = col(age), F.when(no_nan(col(age).cast("double")).isNull(), "unknown").when(col(age) < 40, "<40")
    for decade in (40, 50, 60, 70):
        out = out.when(c < decade + 10, f"{decade}-{decade + 9}")
    return out.otherwise("80+")


def generalize_care_unit(unit: Column | str) -> Column:
    """The first word that fits decides."""
    low = F.lower(col(unit))
    return (
        F.when(low.contains("med"), "medical").when(low.contains("surg") | low.contains("sicu"), "surgical")
        .when(low.contains("card") | low.contains("ccu"), "cardiac").otherwise("other")
    )


def age_bin(age: Column | str) -> Column:
    """Bins closed on the right; NULL outside (0, 120]."""
    out = F.when(col(age) <= 0, None)
    for top, name in AGE_BINS:
        out = out.when(col(age) <= top, name)
    return out


def event_key(subject: Column | str, charttime: Column | str, kind: Column | str, value: Column | str) -> Column:
    """The four fields as text; a missing one is written 'None', so that keys
    with different missing fields differ."""
    parts = col(subject).cast("string"), F.date_format(col(charttime), "yyyy-MM-dd HH:mm:ss"), col(kind).cast("string"), col(value).cast("string")
    return F.concat_ws("|", *(F.coalesce(p, F.lit("None")) for p in parts))


def topic_for(event_type: Column | str) -> Column:
    kind, out = F.lower(F.trim(col(event_type))), F.lit(None).cast("string")
    for topic, kinds in TOPICS.items():
        out = F.when(kind.isin(*kinds), topic).otherwise(out)
    return out


def dialysis_flag(drug: Column | str) -> Column:
    return F.coalesce(F.lower(col(drug)).rlike("dialysis|crrt").cast("int"), F.lit(0))


def parse_time(text: Column | str) -> Column:
    """A time with a space or T, with or without fraction, Z or offset (which
    is dropped, not applied); NULL if it can't be read."""
    bare = F.regexp_replace(F.trim(col(text)), r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return F.try_to_timestamp(F.replace(bare, F.lit("T"), F.lit(" "))).cast("timestamp_ntz")


def to_number(text: Column | str) -> Column:
    return col(text).try_cast("double")


def trailing_zeros(c: Column | str) -> Column:
    """Trailing zero bits, 0 for 0."""
    x = col(c).cast("long")
    return F.when(x == 0, 0).otherwise(F.bit_count(x.bitwiseAND(-x) - F.lit(1)))


def hash32(c: Column) -> Column:
    """The first four bytes of SHA-1."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("long")


def percent_text(name: Column | str, share: Column | str) -> Column:
    return F.format_string("%s: %.2f%%", col(name), col(share) * 100)


def null_tokens(c: Column | str, tokens: tuple[str, ...] = ("", "NULL", "null")) -> Column:
    return F.when(~col(c).isin(*tokens), col(c))
