"""Column functions of the engine: times, ids, names, texts. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: Microseconds from 1601 to 1970; days from 1899-12-30 to 1970.
MICROS_1601, DAYS_1899 = 11_644_473_600_000_000, 25_569
#: A value with one of these in it says where something was hosted, not what it is.
GENERIC_HOSTS = ("svchost.exe", "rundll32.exe", "dllhost.exe", "wmiprvse.exe", "conhost.exe", "msiexec.exe", "taskhostw.exe")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: str | Column) -> Column:
    """The text, or NULL where it is empty."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def first_truthy(*columns: str | Column) -> Column:
    return F.coalesce(*[truthy(c) for c in columns])


# --- times: NULL on bad input, never an error; all are naive UTC


def from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros.cast("long"), F.expr(EPOCH))


def chrome_time(value: str | Column) -> Column:
    """Microseconds since 1601; 0 is no time."""
    v = F.nullif(col(value).cast("long"), F.lit(0).cast("long"))
    return from_micros(v - MICROS_1601)


def filetime(value: str | Column) -> Column:
    """Steps of 100 ns since 1601; 0 is no time."""
    v = F.nullif(col(value).cast("long"), F.lit(0).cast("long"))
    return from_micros(F.call_function("div", v, F.lit(10).cast("long")) - MICROS_1601)


def unix_time(value: str | Column) -> Column:
    """Seconds since 1970, with a fraction; 0 is a time."""
    return from_micros(F.round(col(value).cast("double") * 1e6))


def firefox_time(value: str | Column) -> Column:
    """Microseconds since 1970; 0 is no time."""
    return from_micros(F.nullif(col(value).cast("long"), F.lit(0).cast("long")))


def ole_time(value: str | Column) -> Column:
    """Days since 1899-12-30, with a fraction."""
    return from_micros(F.round((col(value).cast("double") - DAYS_1899) * 86_400e6))


def coerce_time(value: str | Column) -> Column:
    """ISO text to naive UTC: an offset is applied, a text without one is taken as it is."""
    text = F.trim(col(value))
    zoned = F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.when(text.rlike(r"(?i)[0-9](?:Z|[+-][0-9]{2}:?[0-9]{2})$"), zoned).otherwise(text.try_cast("timestamp_ntz"))


def iso(timestamp: str | Column) -> Column:
    """2024-01-01T00:00:00[.ffffff]: the fraction only where it isn't zero."""
    return F.regexp_replace(F.date_format(col(timestamp), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


# --- ids


def digest(*parts: str | Column) -> Column:
    """sha256 of the parts with | between; NULL counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def event_id(artifact_type, event_type, timestamp, source, name, path, record_id: Column | None = None) -> Column:
    """The id follows from the event itself; a record id is part of it only where there is one."""
    base = [F.coalesce(col(p).cast("string"), F.lit("")) for p in (artifact_type, event_type, iso(timestamp), source, name, path)]
    return F.sha2(F.concat_ws("|", *base, *([] if record_id is None else [record_id.cast("string")])), 256)


# --- names


def windows_parts(path: str | Column) -> Column:
    return F.split(col(path), r"\\")


def last_part(path: str | Column) -> Column:
    """What follows the last backslash."""
    return F.try_element_at(windows_parts(path), F.lit(-1))


def basename(path: str | Column) -> Column:
    """What follows the last backslash or slash."""
    return F.try_element_at(F.split(col(path), r"[\\/]"), F.lit(-1))


def user_of_path(path: str | Column) -> Column:
    """The folder below the first Users folder that has one."""
    return truthy(F.regexp_extract(col(path), r"(?i)(?:^|[\\/])users[\\/]([^\\/]+)", 1))


def best_identity(name: str | Column, path: str | Column) -> Column:
    """The file name, in lower case, of the name or else the path."""
    return truthy(last_part(F.lower(F.trim(first_truthy(name, path)))))


def rot13(c: str | Column) -> Column:
    plain = "abcdefghijklmnopqrstuvwxyz"
    turned = plain[13:] + plain[:13]
    return F.translate(col(c), plain + plain.upper(), turned + turned.upper())


def browser_of_path(path: str | Column) -> Column:
    low = F.lower(col(path))
    return F.when(low.contains("edge"), "edge").when(low.contains("chrome"), "chrome").when(low.contains("firefox"), "firefox").otherwise("unknown")


def sid_text(value: str | Column) -> Column:
    """S-revision-authority-sub...: authority big-endian, sub-authorities little-endian."""
    h = F.hex(col(value))
    number = lambda start, size: F.conv(F.substring(h, start, size), 16, 10)
    count = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    turned = lambda i: F.concat(*[F.substr(h, F.lit(17) + i * 8 + k, F.lit(2)) for k in (6, 4, 2, 0)])
    subs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(turned(i), 16, 10))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(F.length(h) >= 16, F.concat(F.lit("S-"), F.array_join(F.concat(F.array(number(1, 2), number(5, 12)), subs), "-")))


def sru_application(value: str | Column) -> Column:
    """!!name!time!hash! gives the name; anything else stays."""
    v = col(value)
    return F.when(v.startswith("!!"), F.get(F.split(v, "!"), F.lit(2))).otherwise(v)


def file_reference(record: str | Column, sequence: str | Column) -> Column:
    return F.shiftleft(col(sequence).cast("long").bitwiseAND(0xFFFF), 48).bitwiseOR(col(record).cast("long").bitwiseAND(0xFFFFFFFFFFFF))


# --- maps and arrays


def text_map(pairs: dict[str, str | Column]) -> Column:
    """A map of the entries that are not NULL."""
    built = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), col(v).cast("string"))])
    return F.map_filter(built, lambda _, v: v.isNotNull())


def strings(*items: str | Column) -> Column:
    """An array of the texts that are not NULL."""
    return F.array_compact(F.array(*[col(i).cast("string") for i in items])) if items else F.expr("cast(array() as array<string>)")


def ordered(values: Column, order: Column) -> Column:
    """An aggregate: distinct values in the order of their first occurrence."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(values.isNotNull(), F.struct(order.alias("o"), values.alias("v"))))), lambda x: x["v"]))


def any_of(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [column.contains(w) for w in words])


def combined_confidence(*columns: str | Column) -> Column:
    """The smallest that is not NULL; 1 if none."""
    return F.coalesce(F.array_min(F.array_compact(F.array(*[col(c) for c in columns]))), F.lit(1.0))
