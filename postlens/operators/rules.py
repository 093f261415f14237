"""Validation rules as boolean columns; the result is one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.urls import TEXT_URL
from postlens.functions.values import CLOCK, duration_minutes, valid_date, weekday


def violations(df: DataFrame, ids: list[str], rules: dict[tuple[str, str], Column]) -> DataFrame:
    """ids, path and code of every rule that a row breaks; rules maps (path, code) to a condition that is true where broken."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for (path, code), c in rules.items()]
    return df.select(*ids, F.explode(F.array_compact(F.array(*broken))).alias("_v")).select(*ids, "_v.path", "_v.code")


def has_url(text: Column) -> Column:
    """No result text may hold a URL."""
    return text.rlike(TEXT_URL)


def context_keys(context: Column, allowed: list[list[str]]) -> Column:
    """A task's context (JSON text) has exactly one of the allowed key sets."""
    keys = F.array_sort(F.json_object_keys(context))
    ok = F.lit(False)
    for a in allowed:
        ok |= keys == F.array(*[F.lit(k) for k in sorted(a)])
    return ~F.coalesce(ok, F.lit(False))


def structure(listing: dict[str, Column], required: list[str], enums: dict[str, list[str]], ranges: dict[str, tuple[float, float]], patterns: dict[str, str], unique: list[str]) -> dict[tuple[str, str], Column]:
    """Rules of shape: what is required, listed values, bounds, patterns, distinct items."""
    out = {(p, "required"): listing[p].isNull() for p in required}
    out |= {(p, "enum"): ~listing[p].isin(*v) for p, v in enums.items()}
    out |= {(p, "range"): ~listing[p].between(*v) for p, v in ranges.items()}
    out |= {(p, "pattern"): ~listing[p].rlike(v) for p, v in patterns.items()}
    return out | {(p, "unique"): F.size(F.array_distinct(listing[p])) < F.size(listing[p]) for p in unique}


def empty_recruitment(is_recruitment: Column, listings: Column, warnings: Column) -> Column:
    """Recruitment without a listing must say so; without recruitment there are no listings."""
    none = F.size(listings) == 0
    return is_recruitment & none & ~F.array_contains(warnings, "insufficient_information") | ~is_recruitment & ~none


def service_details(type_: Column, details: dict[str, list[Column]], plain: str = "session") -> Column:
    """A listing's details belong to its type; a plain one has none."""
    wrong = F.lit(False)
    for t, fields in details.items():
        for c in fields:
            wrong |= c.isNotNull() & (F.coalesce(type_, F.lit(plain)) != t)
    return wrong


def index_gaps(listings: Column) -> Column:
    """listing_index counts from 0."""
    return F.exists(F.transform(listings, lambda x, i: x["listing_index"] != i), lambda b: b)


def unsupported_quotes(source: Column, evidence: Column) -> Column:
    """A quote is verbatim in its source."""
    return F.exists(evidence, lambda e: ~F.contains(source, e["quote"]))


def missing_evidence(facts: dict[str, Column], evidence: Column, derived: tuple[str, ...] = ()) -> Column:
    """Every filled fact that is not derived has evidence."""
    paths = F.transform(evidence, lambda e: e["field"])
    out = F.lit(False)
    for name, c in facts.items():
        if name not in derived:
            out |= c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "unknown") & ~F.array_contains(paths, name)
    return out


def bad_date(date: Column, weekdays: Column) -> Column:
    """A date is a calendar day, and one of its recurrence's weekdays."""
    d = valid_date(date)
    return date.isNotNull() & (d.isNull() | (F.size(weekdays) > 0) & ~F.array_contains(weekdays, weekday(d)))


def bad_tournament(start: Column, end: Column, deadline: Column) -> Column:
    wrong = end.isNotNull() & (valid_date(end).isNull() | (valid_date(end) < valid_date(start)))
    return wrong | deadline.isNotNull() & valid_date(deadline).isNull()


def bad_duration(start: Column, end: Column, offset: Column) -> Column:
    """Both times need an offset and 1 to 1440 minutes; else the offset is null."""
    both = start.rlike(CLOCK) & end.rlike(CLOCK)
    return F.when(F.coalesce(both, F.lit(False)), duration_minutes(start, end, offset).isNull()).otherwise(offset.isNotNull())


def bad_levels(low: Column, high: Column) -> Column:
    return low > high


def bad_vacancies(vacancies: Column, capacity: Column, status: Column) -> Column:
    return (vacancies > capacity) | (status == "full") & (vacancies > 0)


def not_verbatim(value: Column, source: Column) -> Column:
    return value.isNotNull() & ~F.contains(source, value)


def quality_warnings(model: Column, origin: Column, derived: dict[str, Column]) -> Column:
    """Union of the model's, the source's and the derived codes, in that order."""
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in derived.items()]))
    return F.array_distinct(F.concat(F.coalesce(model, F.expr("cast(array() as array<string>)")), F.coalesce(origin, F.expr("cast(array() as array<string>)")), own))


def needs_review(warnings: Column, harmless: tuple[str, ...] = ("not_recruitment",)) -> Column:
    return F.exists(warnings, lambda w: ~w.isin(*harmless))


def minimum_data(post_id: Column, url: Column, text: Column, author: Column, time: Column) -> Column:
    """Enough to keep a post: an id or URL, or a text with an author or a time."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return has(post_id) | has(url) | has(text) & (has(author) | has(time))


def post_warnings(post_id: Column, url: Column, truncated: Column, raw_time: Column, time: Column, raw_counts: list[Column], counts: list[Column]) -> Column:
    warn = lambda c, code: F.when(F.coalesce(c, F.lit(False)), F.lit(code))
    lost = F.lit(False)
    for raw, n in zip(raw_counts, counts):
        lost |= raw.isNotNull() & n.isNull()
    return F.array_compact(F.array(warn(post_id.isNull() & url.isNull(), "missing_identity"), warn(truncated, "content_truncated"), warn(raw_time.isNotNull() & time.isNull(), "time_not_normalized"), warn(lost, "count_not_normalized")))


def registry(datasets: DataFrame) -> DataFrame:
    """Problems of a dataset registry (id, batch_ids): bad or repeated ids, batches of several datasets."""
    bad = datasets.where(~F.col("id").rlike(r"^[a-z][a-z0-9-]*$")).select(F.lit("bad_id").alias("problem"), F.col("id").alias("what"))
    twice = datasets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_id"), "id")
    shared = datasets.select("id", F.explode("batch_ids").alias("b")).groupBy("b").agg(F.count_distinct("id").alias("n")).where("n > 1").select(F.lit("shared_batch"), "b")
    return bad.union(twice).union(shared)
