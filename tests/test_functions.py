"""Scalar functions on small tables of cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postlens.functions import ids, text, urls, values
from postlens.plans import predicates

SITE = urls.Site("social.test", "www.social.test", ("ref", "__tn__"), ("__cft__",))


def apply(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r.o for r in df.select("i", f(F.col("c")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    assert apply(spark, ["a\r\nb", " a \t b \n\n\n\n c ", "　x　", None], text.clean_text) == ["a\nb", "a b\n\nc", "x", None]


def test_identity_text(spark):
    f = lambda c: text.identity_text(c, ("Taipei",))
    assert apply(spark, ["100Ｔaipei，No. 1", "100Taipei", "Court (A)", None], f)[1:] == ["100taipei", "courta", ""]


def test_csv_safe(spark):
    assert apply(spark, ["=1", "-5", "a=1", " =1", "\tx"], text.csv_safe) == ["'=1", "'-5", "a=1", " =1", "'\tx"]
    assert apply(spark, [" =1", "a"], lambda c: text.csv_safe(c, "text")) == ["' =1", "a"]


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("http://m.social.test/groups/1/?ref=x&id=2#top", "https://www.social.test/groups/1/?id=2"),
        ("https://social.test/p?__cft__[0]=1&__tn__=a", "https://www.social.test/p"),
        ("https://other.test/a/?ref=x", "https://other.test/a/?ref=x"),
        ("ftp://social.test/a", None),
        ("nonsense", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, wanted):
    assert apply(spark, [url], lambda c: urls.canonical_url(c, SITE)) == [wanted]


def test_extract_and_mask_urls(spark):
    got = apply(spark, ["see https://a.test/x，or (https://a.test/x/long). https://a.test/x"], lambda c: F.array_join(urls.extract_urls(c), " "))
    assert got == ["https://a.test/x https://a.test/x/long"]
    assert apply(spark, ["https://a.test/x and https://a.test/x/long"], urls.mask_urls) == ["[URL] and [URL]"]


def test_profile_url(spark):
    f = lambda c: urls.profile_url(c, F.lit(False), SITE, ("groups",))
    cases = ["https://m.social.test/profile.php?id=12&x=1", "https://social.test/profile.php?id=1&id=2", "https://social.test/some.name/", "https://social.test/groups", "https://u@social.test/a", "https://social.test:8080/a"]
    assert apply(spark, cases, f) == ["https://www.social.test/profile.php?id=12", None, "https://www.social.test/some.name", None, None, None]


def test_valid_timestamp(spark):
    cases = ["2026-09-05T10:00:00Z", "2026-09-05T10:00:00+08:00", "2026-02-30T10:00:00Z", "2026-09-07", "nonsense", "2026-09-05T24:00:00Z", None]
    assert apply(spark, cases, lambda c: values.valid_timestamp(c).cast("timestamp_ntz")) == [datetime(2026, 9, 5, 10), datetime(2026, 9, 5, 2), None, None, None, None, None]


def test_normalize_count(spark):
    cases = ["1.2 萬", "3K", "1,234", "1.25", "0", "99999999999 億", "", "many", None]
    assert apply(spark, cases, values.normalize_count) == [12000, 3000, 1234, None, 0, None, None, None, None]


def test_duration(spark):
    df = spark.createDataFrame([("19:00", "21:30", 0), ("23:00", "01:00", 1), ("10:00", "10:00", 1), ("10:00", "09:00", 0), ("x", "09:00", 0), ("10:00", "11:00", None)], "a string, b string, c int")
    assert [r.d for r in df.select(values.duration_minutes(F.col("a"), F.col("b"), F.col("c")).alias("d")).collect()] == [150, 120, 1440, None, None, None]


def test_hourly_price(spark):
    df = spark.createDataFrame([([(200, 120), (200, 60), (300, 60)], 90), ([(200, None)], 90), ([(200, None)], None), ([], 60)], "o array<struct<amount: int, duration_minutes: int>>, m int")
    assert [None if r.p is None else round(r.p, 3) for r in df.select(values.hourly_price(F.col("o"), F.col("m")).alias("p")).collect()] == [100.0, 133.333, None, None]


def test_canonical_json_and_ids(spark):
    a, b = apply(spark, ['{"b": 1, "a": [2, {"d": 1, "c": 2}]}', '{"a":[2,{"c":2,"d":1}],"b":1}'], ids.canonical_json)
    assert a == b
    x, y = apply(spark, ["p", None], lambda c: ids.hash_id("post", c))
    assert x.startswith("post_") and len(x) == 25 and x != y


def test_plans(spark):
    fields = predicates.Fields(("a", "t"), {"t": "array"})
    df = spark.createDataFrame([(1, "x", ["p"]), (2, None, []), (3, "y", None)], "i int, a string, t array<string>")
    ids_of = lambda node: [r.i for r in df.where(predicates.compile_where(node, fields)).orderBy("i").collect()]
    leaf = lambda f, o, v: {"field": f, "op": o, "value": v}
    assert ids_of(leaf("a", "neq", "x")) == [3]  # unknown is not different
    assert ids_of({"all": []}) == [1, 2, 3] and ids_of({"any": []}) == []
    assert ids_of(leaf("t", "is_known", True)) == [1] and ids_of(leaf("t", "is_known", False)) == [2, 3]
    assert ids_of(leaf("a", "in", ["x", None])) == [1, 2]
    good = predicates.make_plan({"all": []})
    assert predicates.validate(good, fields) == good
    wheres = (leaf("z", "eq", 1), leaf("a", "like", 1), leaf("t", "eq", 1), {"all": [], "any": []}, {"any": []}, {"all": {}}, "x", {"field": "a", "op": "eq"})
    bads = [good | {"where": w} for w in wheres] + [good | {"more": 1}] + [{k: v for k, v in good.items() if k != gone} for gone in good]
    bads += [good | {"interpretation": i} for i in ("", None, 3)]
    bads += [good | {"preferences": p} for p in ({}, None, good["preferences"] | {"x": 1}, *[good["preferences"] | {k: v} for k, v in (("beginner_friendly", "yes"), ("max_fee", -1), ("max_fee", 1.5), ("max_fee", True), ("require_contactable", None))])]
    bads += [good | {"include": i} for i in ({}, [], good["include"] | {"full": None}, good["include"] | {"x": True}, {"full": True})]
    for bad in bads:
        with pytest.raises(ValueError):
            predicates.validate(bad, fields)


def test_decode_diagnostic(spark):
    import gzip

    assert apply(spark, [bytearray(gzip.compress("héllo".encode())), bytearray(b"no"), None], ids.decode_diagnostic, "binary") == ["héllo", None, None]
