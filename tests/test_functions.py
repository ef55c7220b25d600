"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import content as C
from webloom.functions import encoding as E
from webloom.functions import headers as H
from webloom.functions import schedule as S
from webloom.functions import url as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (lambda: U.normalize(F.lit("HTTP://Example.COM:80/a?b=2&a=1#x")), "http://example.com/a?a=1&b=2"),
        (lambda: U.normalize(F.lit("not a url")), "not a url"),
        (lambda: U.normalize(F.lit("http://h.example/a/"), strip_trailing_slash=True), "http://h.example/a"),
        (lambda: U.normalize(F.lit("http://h.example/?utm=1&q=a%20b"), strip_params=("utm",)), "http://h.example/?q=a+b"),
        (lambda: U.template(F.lit("https://h.example/users/123/orders?x=1")), "https://h.example/users/:id/orders"),
        (lambda: U.template(F.lit("https://h.example/items/550e8400-e29b-41d4-a716-446655440000")), "https://h.example/items/:id"),
        (lambda: U.template(F.lit("https://h.example/abcdefghij1234567890")), "https://h.example/:id"),
        (lambda: U.template(F.lit("https://h.example")), "https://h.example/"),
        (lambda: U.query_params(F.lit("http://h.example/?z=1&a=2&a=3")), ["a", "a", "z"]),
        (lambda: U.query_map(F.lit("http://h.example/?a=1&a=2&b")), {"a": "2", "b": ""}),
        (lambda: U.next_page(F.lit("http://h.example/?page=2")), "http://h.example/?page=3"),
        (lambda: U.next_page(F.lit("http://h.example/news/page/2")), "http://h.example/news/page/3"),
        (lambda: U.next_page(F.lit("http://h.example/x")), None),
        (lambda: U.classify_ip(F.lit("::ffff:7f00:1")), "loopback"),
        (lambda: U.classify_ip(F.lit("fe80::1")), "link-local"),
        (lambda: U.classify_ip(F.lit("fd00::1")), "unique-local"),
        (lambda: U.classify_ip(F.lit("172.20.1.1")), "private-b"),
        (lambda: U.classify_ip(F.lit("2001:db8::1")), None),
        (lambda: U.extension_type(F.lit("http://h.example/a.min.js?x")), "script"),
        (lambda: U.domain(F.lit("nope")), "unknown"),
        (lambda: E.detect_and_decode(F.lit("48656c6c6f"))["decoded"], "Hello"),
        (lambda: E.detect_and_decode(F.lit("SGVsbG8="))["decoded"], "Hello"),
        (lambda: E.detect_and_decode(F.lit("plain!"))["encoding"], None),
        (lambda: E.rot13(F.lit("Hello")), "Uryyb"),
        (lambda: E.parse_jsonp(F.lit('cb({"a":1});'))["callback"], "cb"),
        (lambda: E.parse_jsonp(F.lit("cb({bad)")), None),
        (lambda: E.decode_entities(F.lit("&amp;&lt;&#65;&#x42;&nope;")), "&<AB&nope;"),
        (lambda: E.decode_escapes(F.lit(r"A\x42\u{1F600}")), "AB😀"),
        (lambda: E.source_map_url(F.lit("x\n//@ sourceMappingURL=a.map")), "a.map"),
        (lambda: E.truncate(F.lit("abcdef"), 3), "abc\n... (truncated)"),
        (lambda: S.duration_ms(F.lit("2h")), 7_200_000),
        (lambda: S.duration_ms(F.lit("1500")), 1500),
        (lambda: S.duration_ms(F.lit("soon")), None),
        (lambda: S.format_duration(F.lit(300_000)), "5m"),
        (lambda: S.next_interval(F.lit(5000), F.lit(60_000), F.lit(5000)), 65_000),
        (lambda: H.rate_limit(F.create_map(F.lit("x-ratelimit-limit"), F.lit("100"), F.lit("ratelimit-remaining"), F.lit("3")))["remaining"], 3),
        (lambda: H.rate_limit(F.create_map(F.lit("a"), F.lit("b"))), None),
        (lambda: H.retry_after_ms(F.lit("Thu, 01 Jan 1970 00:00:10 GMT"), F.lit(4000)), 6000),
        (lambda: H.to_expiry(F.lit("2000000000")), 2_000_000_000_000),
        (lambda: H.to_expiry(F.lit("0")), None),
        (lambda: C.charset_of_type(F.lit("text/html; charset=GBK")), "gbk"),
        (lambda: C.sniff_type(F.unhex(F.lit("774F4632"))), "font/woff2"),
        (lambda: C.sniff_type(F.unhex(F.lit("52494646000000004156492000"))), None),
        (lambda: C.bom(F.unhex(F.lit("EFBBBF41"))), "utf-8"),
        (lambda: C.is_binary(F.unhex(F.lit(""))), False),
        (lambda: C.response_type(F.lit("text/plain"), F.lit(' {"a":1}')), "json"),
        (lambda: C.response_type(F.lit(None).cast("string"), F.lit("<?xml version='1.0'?><rss>")), "feed"),
    ],
)
def test_value(spark, f, want):
    got = value(spark, f())
    assert (dict(got) if isinstance(want, dict) else got) == want


def test_header_map_keeps_the_first(spark):
    pairs = F.array(F.struct(F.lit("A").alias("name"), F.lit("1").alias("value")), F.struct(F.lit("a").alias("name"), F.lit("2").alias("value")))
    assert value(spark, H.header_map(pairs)) == {"a": "1"}


def test_set_cookie(spark):
    c = value(spark, H.set_cookie(F.lit("a=b=c; Path=/x; Max-Age=10; HttpOnly"), F.lit(1000).cast("bigint")))
    assert (c["name"], c["value"], c["path"], c["expires"], c["http_only"]) == ("a", "b=c", "/x", 11_000, True)


AT = 1_705_314_600_000  # 2024-01-15T10:30:00Z, a Monday


@pytest.mark.parametrize(
    ("cron", "minutes"),
    [("*/5 * * * *", 5), ("*/15 9-17 * * *", 15), ("0 3 * * *", 16 * 60 + 30), ("30 8 * * mon", 7 * 24 * 60 - 120), ("30 10 15 1 *", 366 * 24 * 60)],
)
def test_cron(cron, minutes):
    assert S.next_cron(S.parse_cron(cron), AT) == AT + minutes * 60_000


def test_cron_days_are_alternatives():
    # the 16th or a Friday: tomorrow noon
    assert S.next_cron(S.parse_cron("0 12 16 * 5"), AT) == AT + (24 * 60 + 90) * 60_000


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *"])
def test_bad_cron(bad):
    with pytest.raises(S.CronError):
        S.parse_cron(bad)


def test_cron_without_a_day_is_none():
    assert S.next_cron(S.parse_cron("0 0 31 2 *"), AT) is None


def test_retry(spark):
    assert [value(spark, S.retry_delay(F.lit(429), F.lit(n))) for n in (1, 2, 9)] == [5000, 10_000, 120_000]
    assert value(spark, S.should_retry(F.lit(None).cast("int"), F.lit("CANCELED"), F.lit(1))) is False
    assert value(spark, S.should_retry(F.lit(503), F.lit(None).cast("string"), F.lit(3))) is True
