"""Times, counts, prices and schedules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted formats of times and of a clock.
STRICT_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
LOOSE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d$"
#: The multipliers that count texts use, and the form of such a text.
MULTIPLIERS = {"k": 1_000, "m": 1_000_000, "萬": 10_000, "万": 10_000}
COUNT = r"^(\d+(?:\.\d+)?)\s*([km萬万]?)$"
SAFE_INTEGER = 9_007_199_254_740_991


def valid_timestamp(c: Column) -> Column:
    """The instant of a full ISO text with seconds and zone; null for anything else, such as February 30th."""
    return F.when(c.rlike(STRICT_TIME), c.try_cast("timestamp"))


def absolute_time(c: Column) -> Column:
    """As valid_timestamp, but seconds and the zone's colon may be missing, and epoch seconds count. Relative text is null."""
    zoned = F.regexp_replace(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    epoch = F.when(c.rlike(r"^\d{9,11}$"), F.timestamp_seconds(c.try_cast("long")))
    return F.coalesce(F.when(c.rlike(LOOSE_TIME), zoned.try_cast("timestamp")), epoch)


def reference_time(published: Column, scraped: Column, finished: Column) -> Column:
    """struct(at, source): the first known of publication, capture and end of batch."""
    source = F.when(published.isNotNull(), "published").when(scraped.isNotNull(), "scraped").when(finished.isNotNull(), "batch_finished").otherwise("unavailable")
    return F.struct(F.coalesce(published, scraped, finished).alias("at"), source.alias("source"))


def valid_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def weekday(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def _minutes(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).cast("int")


def duration_minutes(start: Column, end: Column, offset: Column) -> Column:
    """Minutes from start to end (HH:mm; offset is 0 or 1 days); null unless from 1 to 1440."""
    known = start.rlike(CLOCK) & end.rlike(CLOCK) & offset.isin(0, 1)
    d = F.when(known, _minutes(end) + offset * 1440 - _minutes(start))
    return F.when(d.between(1, 1440), d)


def schedule_identity(date: Column, weekdays: Column, start: Column, end: Column, offset: Column) -> Column:
    """date:… or weekly:… with its times; null if the day or a time is unknown."""
    day = F.when(date != "", F.concat(F.lit("date:"), date)).when(F.size(weekdays) > 0, F.concat(F.lit("weekly:"), F.array_join(F.transform(F.array_sort(weekdays), lambda x: x.cast("string")), "-")))
    return F.when(day.isNotNull() & (start != "") & (end != ""), F.concat_ws("|", day, start, end, F.coalesce(offset, F.lit(0)).cast("string")))


def date_group(date: Column, weekdays: Column) -> Column:
    """The heading of a listing: weekly, its date, or unknown."""
    return F.when(F.size(weekdays) > 0, F.lit("weekly")).when(date != "", date).otherwise(F.lit("unknown"))


def normalize_count(c: Column) -> Column:
    """1.2K, 3 萬 or 1,234 as a whole number; null if it is not one, or not a safe integer. Decimal arithmetic throughout."""
    text = F.lower(F.regexp_replace(F.trim(c), ",", ""))
    number = F.nullif(F.regexp_extract(text, COUNT, 1), F.lit("")).try_cast("decimal(20,6)")
    table = F.create_map(*[F.lit(x) for sign, by in MULTIPLIERS.items() for x in (sign, by)])
    times = F.coalesce(F.try_element_at(table, F.regexp_extract(text, COUNT, 2)), F.lit(1))
    value = number * times.cast("decimal(9,0)")
    whole = value.cast("decimal(24,0)")
    return F.when((value == whole) & (whole <= SAFE_INTEGER), whole.cast("bigint"))


def metric_from_text(c: Column, patterns: list[str]) -> Column:
    """The count in the first pattern (one group) that a text matches."""
    return F.coalesce(*[normalize_count(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))) for p in patterns])


def fee_range(options: Column) -> Column:
    """struct(fee_min, fee_max) over price options; free (0) is a price."""
    amounts = F.filter(F.transform(options, lambda o: o["amount"]), lambda a: a.isNotNull())
    return F.struct(F.array_min(amounts).alias("fee_min"), F.array_max(amounts).alias("fee_max"))


def hourly_price(options: Column, session_minutes: Column) -> Column:
    """The least rate an hour among the cheapest options, each by its own duration or else the session's."""
    least = F.array_min(F.transform(options, lambda o: o["amount"]))
    cheap = F.filter(options, lambda o: o["amount"] == least)
    rate = F.transform(cheap, lambda o: o["amount"] * 60.0 / F.nullif(F.coalesce(o["duration_minutes"], session_minutes), F.lit(0)))
    return F.array_min(F.filter(rate, lambda r: r.isNotNull()))


def price_display(options: Column, empty: str = "price not given", unit: str = "TWD ", between: str = " / ") -> Column:
    """Amounts with condition and minutes in brackets; a fixed text when there is none."""
    def one(o: Column) -> Column:
        minutes = F.when(o["duration_minutes"].isNotNull(), F.concat(o["duration_minutes"].cast("string"), F.lit(" min")))
        notes = F.concat_ws(", ", F.when(o["condition"] != "", o["condition"]), minutes)
        return F.concat(F.lit(unit), o["amount"].cast("string"), F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""))

    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(F.transform(options, one), between))


def time_label(date: Column, weekdays: Column, start: Column, end: Column, offset: Column) -> Column:
    day = F.when(date != "", date).when(F.size(weekdays) > 0, F.concat(F.lit("weekly "), F.array_join(F.transform(weekdays, lambda x: x.cast("string")), ",")))
    span = F.when((start != "") & (end != ""), F.concat(start, F.lit("-"), F.when(offset == 1, F.lit("+1d ")).otherwise(""), end))
    return F.coalesce(F.nullif(F.concat_ws(" ", day, span), F.lit("")), F.lit("time not given"))


def duration_label(minutes: Column, unknown: str = "not given") -> Column:
    """Hours with up to two decimals."""
    hours = F.regexp_replace(F.regexp_replace(F.round(minutes.cast("decimal(10,4)") / 60, 2).cast("decimal(10,2)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.coalesce(F.concat(hours, F.lit(" HR")), F.lit(unknown))


def hourly_label(rate: Column) -> Column:
    """A rate an hour, grouped and with up to two decimals; empty where it is unknown."""
    shown = F.regexp_replace(F.regexp_replace(F.format_number(rate, 2), r"0+$", ""), r"\.$", "")
    return F.coalesce(F.concat(shown, F.lit("/hr")), F.lit(""))


def capacity_label(courts: Column, capacity: Column, unknown: str = "not given") -> Column:
    named = lambda n, unit: F.coalesce(F.concat(n.cast("string"), F.lit(f" {unit}")), F.lit(unknown))
    return F.concat(F.lit("courts: "), named(courts, "courts"), F.lit("; people: "), named(capacity, "people"))


def venue_identity(address: Column, city: Column, district: Column, name: Column) -> Column:
    """By address, else by city, district and name; null if neither is known. Arguments are normalised texts."""
    return F.when(address != "", F.concat(F.lit("address:"), address)).when(name != "", F.concat(F.lit("name:"), F.concat_ws(":", F.coalesce(city, F.lit("")), F.coalesce(district, F.lit("")), name)))


def organiser_identities(**kinds: Column) -> Column:
    """kind:value of every known organiser field."""
    return F.array_compact(F.array(*[F.when(c != "", F.concat(F.lit(k + ":"), c)) for k, c in kinds.items()]))


def registration_text(methods: Column, labels: dict[str, str], covered: Column) -> Column:
    """Labels of the registration methods that no contact link covers yet."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    left = F.filter(methods, lambda m: ~F.array_contains(covered, m))
    return F.array_join(F.array_distinct(F.transform(left, lambda m: F.coalesce(F.try_element_at(table, m), m))), "；")
