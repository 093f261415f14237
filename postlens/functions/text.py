"""Text functions as Column expressions; only Unicode compatibility folding needs an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def trim_all(c: Column) -> Column:
    """Trim every kind of Unicode white space, which F.trim does not."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """LF line ends, single blanks, trimmed lines, at most one empty line in a row, trimmed as a whole."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t ]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fingerprint_part(c: Column, fold: bool = True) -> Column:
    """Cleaned, lower case, then NFKC. fold=False leaves NFKC out, for columns known to be composed."""
    c = F.lower(clean_text(F.coalesce(c, F.lit(""))))
    return nfkc(c) if fold else c


def identity_text(c: Column, postal_prefix: tuple[str, ...] = (), fold: bool = True) -> Column:
    """NFKC, then lower case, without a postal code before the given places, punctuation or blanks."""
    c = F.coalesce(c, F.lit(""))
    c = F.lower(nfkc(c) if fold else c)
    if postal_prefix:
        c = F.regexp_replace(c, rf"^[0-9]{{3}}(?={'|'.join(map(re.escape, postal_prefix))})", "")
    return F.regexp_replace(c, r"(?U)[\s\p{Punct}]+", "")


def search_text(*parts: Column, fold: bool = True) -> Column:
    """Non-empty parts joined by blanks, folded and lower case, for substring search."""
    joined = F.concat_ws(" ", *[F.when(p != "", p) for p in parts])
    joined = nfkc(joined) if fold else joined
    return F.lower(trim_all(F.regexp_replace(joined, r"(?U)\s+", " ")))


def contains_any(c: Column, signals: list[str]) -> Column:
    """Whether the text has one of the signals, upper and lower case alike."""
    if not signals:
        return F.lit(False)
    return F.coalesce(F.lower(c).rlike("|".join("\\Q" + s.lower() + "\\E" for s in signals)), F.lit(False))


def csv_safe(c: Column, kind: str = "strict") -> Column:
    """An apostrophe before what a spreadsheet would run as a formula.

    ``strict`` guards any leading = + - @ tab or CR; ``text`` also looks past leading white space.
    """
    pattern = r"^[=+\-@\t\r]" if kind == "strict" else r"^\s*[=+\-@]"
    return F.when(c.rlike(pattern), F.concat(F.lit("'"), c)).otherwise(c)


def preview_text(c: Column, most: int = 100) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def code_labels(codes: Column, labels: dict[str, str]) -> Column:
    """Display labels of an array of codes; unknown codes stay."""
    if not labels:
        return codes
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), c))


def clean_title(og: Column, title: Column, heading: Column, suffix: str = "", reject: tuple[str, ...] = ()) -> Column:
    """The first usable page title, without a ``(n)`` counter before it and the site's suffix behind it."""

    def usable(c: Column) -> Column:
        c = F.regexp_replace(trim_all(c), r"^\(\d+\+?\)\s*", "")
        if suffix:
            c = F.regexp_replace(c, r"\Q" + suffix + r"\E$", "")
        c = trim_all(c)
        return F.when((c != "") & ~F.lower(c).isin(*[r.lower() for r in reject] or [""]), c)

    return F.coalesce(usable(og), usable(title), usable(heading))


def page_title(html: Column, suffix: str = "", reject: tuple[str, ...] = ()) -> Column:
    """clean_title of raw HTML: og:title, <title>, or the heading if there is only one."""
    pick = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    headings = F.regexp_extract_all(html, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), 1)
    return clean_title(pick(r'(?i)<meta property="og:title" content="([^"]*)"'), pick(r"(?is)<title[^>]*>(.*?)</title>"), F.when(F.size(headings) == 1, F.get(headings, 0)), suffix, reject)
