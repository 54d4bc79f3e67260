"""Fields of registers: places, codes, times, vocabularies and text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
# Words of source systems and the canonical ones.
HEALTH_WORDS = {
    "online": "online", "up": "online", "ok": "online",
    "offline": "offline", "down": "offline", "unavailable": "offline",
    "degraded": "degraded", "maintenance": "degraded",
}


def folded(word: Column, words: dict[str, str], default: str) -> Column:
    """The canonical word for a source's, by its lower-case trimmed form."""
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(word))), F.lit(default))


def wall_clock_utc(text: Column, pattern: str = "dd-MM-yyyy HH:mm:ss") -> Column:
    """A local wall-clock text as a UTC time; null if it can't be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), ZONE)


def epoch_utc(millis: Column) -> Column:
    """Milliseconds since 1970 (number or text) as a time; null if they can't be read."""
    return F.timestamp_millis(millis.try_cast("bigint"))


def any_date(text: Column) -> Column:
    """A date in one of three written forms; null for any other."""
    clean = F.trim(text)
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))
    return F.coalesce(*(F.when(clean.rlike(p), F.to_date(F.try_to_timestamp(clean, F.lit(f)))) for p, f in forms))


def local_text(ts: Column, pattern: str = "dd-MM-yyyy HH:mm:ss") -> Column:
    """A UTC time as local wall-clock text."""
    return F.date_format(F.from_utc_timestamp(ts, ZONE), pattern)


def joined_zone(zone: Column) -> Column:
    """Non-empty parts of ``A / B`` joined by one slash."""
    return F.array_join(F.filter(F.transform(F.split(zone, "/"), lambda x: F.trim(x)), lambda x: x != ""), " / ")


def district_code(name: Column) -> Column:
    """The first three letters, upper case, or GEN."""
    letters = F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z]", ""))
    return F.when(F.length(letters) >= 3, F.substr(letters, F.lit(1), F.lit(3))).otherwise(F.lit("GEN"))


def device_id(prefix: Column, department: Column, district: Column, source_id: Column) -> Column:
    """A canonical id whose last part is the source's number, padded, or its last word."""
    last = F.element_at(F.split(source_id, "[^A-Za-z0-9]+"), -1)
    tail = F.when(last.rlike("^[0-9]{1,3}$"), F.lpad(last, 4, "0")).otherwise(F.upper(last))
    return F.concat_ws("-", prefix, department, district_code(district), tail)


def host_of(endpoint: Column) -> Column:
    """Host and port of an address, without scheme, user and path."""
    return F.regexp_extract(endpoint, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^@/]*@)?([^/?#]*)", 1)


def masked_number(number: Column) -> Column:
    """Only the last four digits of a number."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))


def place_text(*parts: Column) -> Column:
    """Non-empty parts joined by commas; null if there are none."""
    return F.nullif(F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))


def age_years(born: Column, today: Column) -> Column:
    """Years between dates with two decimals."""
    return F.round(F.datediff(today, born) / 365.25, 2)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and 20 hexadecimal digits of the SHA-1 of the parts."""
    return F.concat(F.lit(prefix), F.substr(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), F.lit(1), F.lit(20)))


def hash_split(key: Column, shares: tuple[float, float] = (0.70, 0.85)) -> Column:
    """train, val or test by the first 8 bytes of a SHA-256, the same for a key everywhere."""
    number = F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
    return F.when(number < shares[0], "train").when(number < shares[1], "val").otherwise("test")


def banded(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The name of the first edge above a value, or the last name; null for null."""
    out = None
    for edge, name in edges:
        out = F.when(value < edge, name) if out is None else out.when(value < edge, name)
    return F.when(value.isNotNull(), out.otherwise(last))


# Where sizes are cut, how far cuts are apart at least, and the cuts of fewer than LEAST_SIZES sizes.
BAND_SHARES, BAND_GAP, LEAST_SIZES, PLAIN_BANDS = (0.20, 0.40, 0.65, 0.85), 1.0, 20, (20.0, 40.0, 60.0, 120.0)


def derived_bands(width: Column) -> Column:
    """An aggregate: the four edges of five bands of positive sizes, by their own quantiles."""
    seen = F.when(width > 0, width.cast("double"))
    cuts = F.percentile(seen, F.array(*map(F.lit, BAND_SHARES)))
    apart = F.aggregate(cuts, F.array().cast("array<double>"), lambda kept, cut: F.array_append(kept, F.greatest(cut, F.coalesce(F.try_element_at(kept, F.lit(-1)) + BAND_GAP, cut))))
    return F.when(F.count(seen) < LEAST_SIZES, F.array(*map(F.lit, PLAIN_BANDS))).otherwise(apart)


def tags(**conditions: Column) -> Column:
    """An array of the names whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def first_reason(**checks: Column) -> Column:
    """The name of the first check that fails; null if all hold."""
    return F.coalesce(*(F.when(~c | c.isNull(), F.lit(n)) for n, c in checks.items()))


def priority(exact: Column, category: Column) -> Column:
    """How urgent a hit on a list is."""
    return F.when(~exact, "review").when(category.isin("stolen", "wanted"), "critical").otherwise("high")
