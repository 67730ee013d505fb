"""Literal cases of payloads, configuration strings, numbers and labels."""

import math

import pytest
from pyspark.sql import functions as F

from probefleet.functions import keyvalue, labels, lookups, numbers
from probefleet.functions.payload import decode_payload, encode_payload


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_payload_text_and_round_trip(rows):
    df = rows("p STRING, m BIGINT, t BIGINT", ("producer-id", 0, 12345), ("producer-id", 1, 67890))
    texts = df.select("*", encode_payload(F.col("p"), F.col("m"), F.col("t")).alias("text"))
    assert texts.first()["text"] == '{"producerId":"producer-id","messageId":0,"timestamp":12345}'
    back = texts.select("p", "m", "t", decode_payload(F.col("text")).alias("d")).collect()
    assert [(r.p, r.m, r.t, False) for r in back] == [tuple(r.d) for r in back]


def test_absent_payload_fields_are_written_as_zero_values(rows):
    df = rows("p STRING, m BIGINT, t BIGINT", (None, None, None))
    assert one(df, encode_payload(F.col("p"), F.col("m"), F.col("t"))) == '{"producerId":"","messageId":0,"timestamp":0}'


@pytest.mark.parametrize("text", ["bad", '{"producerId":"a","mess', "", None, '{"messageId":"x"}'])
def test_malformed_payload_gives_zero_values(rows, text):
    got = one(rows("v STRING", (text,)), decode_payload(F.col("v")))
    assert tuple(got) == ("", 0, 0, True)


def test_payload_with_one_bad_field_keeps_the_others(rows):
    got = one(rows("v STRING", ('{"producerId":"a","messageId":"x","timestamp":5}',)), decode_payload(F.col("v")))
    assert tuple(got) == ("a", 0, 5, True)


@pytest.mark.parametrize(
    "text, want",
    [
        (
            "retention.ms=600000;segment.bytes=16384;cleanup.policy=compact,delete",
            {"retention.ms": "600000", "segment.bytes": "16384", "cleanup.policy": "compact,delete"},
        ),
        ("retry.backoff.ms=10000;request.timeout.ms=10000", {"retry.backoff.ms": "10000", "request.timeout.ms": "10000"}),
        ("a=1;", {"a": "1"}),
        ("a=", {"a": ""}),
        ("a=1;b=2;a=3", {"b": "2", "a": "3"}),
        ("", {}),
        ("=600000;segment.bytes=16384;cleanup.policy=compact,delete", None),
        ("aaaaa;segment.bytes=16384;cleanup.policy=compact,delete", None),
        (";;;;segment.bytes=16384;cleanup.policy=compact,delete", None),
        (";;a=1", None),
        ("a=1=2", None),
        ("a=1;;", None),
        (";", None),
    ],
)
def test_pairs(rows, text, want):
    got = one(rows("v STRING", (text,)), keyvalue.parse_pairs(F.col("v")))
    assert got["is_valid"] == (want is not None)
    assert {p["key"]: p["value"] for p in got["pairs"]} == (want or {})
    assert len(got["pairs"]) == len(want or {})


@pytest.mark.parametrize(
    "text, want",
    [
        ("400,800,1600,3200,6400", [400, 800, 1600, 3200, 6400]),
        ("200,400,800", [200, 400, 800]),
        ("0.5,1e2,.5,5.,+1,-2", [0.5, 100, 0.5, 5, 1, -2]),
        ("1,Inf", [1, math.inf]),
        ("2, 5", None),
        ("1,2,", None),
        ("", None),
        ("10d", None),
        ("1f", None),
        ("1e400", None),
        ("x", None),
    ],
)
def test_bounds(rows, text, want):
    got = one(rows("v STRING", (text,)), keyvalue.parse_bounds(F.col("v")))
    assert got["is_valid"] == (want is not None)
    assert got["bounds"] == (want or [])


@pytest.mark.parametrize(
    "text, want",
    [(None, 7), ("", 0), ("3", 3), ("+5", 5), ("-1", -1), ("three", 0), (" 3", 0), ("99999999999999999999", 2**63 - 1),
     ("-99999999999999999999", -(2**63)), ("1.5", 0)],
)
def test_int_values(rows, text, want):
    assert one(rows("v STRING", (text,)), lookups.int_value(F.col("v"), 7)) == want


@pytest.mark.parametrize(
    "text, want", [(None, True), ("", False), ("1", True), ("t", True), ("TRUE", True), ("yes", False), ("tRUE", False), ("0", False)]
)
def test_bool_values(rows, text, want):
    assert one(rows("v STRING", (text,)), lookups.bool_value(F.col("v"), True)) is want


def test_disconnections(rows):
    classes = [None, "foobar", "EOF", "EPIPE", "ECONNRESET", "ETIMEDOUT", "DEADLINE_EXCEEDED"]
    df = rows("v STRING", *[(c,) for c in classes])
    got = [r.x for r in df.select(lookups.is_disconnection(F.col("v")).alias("x")).collect()]
    assert got == [False, False, True, True, True, True, True]


@pytest.mark.parametrize(
    "value, want",
    [(0.0, "0"), (1.0, "1"), (151.0, "151"), (0.5, "0.5"), (999999.0, "999999"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"),
     (1234567.25, "1.23456725e+06"), (123456789.0, "1.23456789e+08"), (1e21, "1e+21"), (0.001, "0.001"), (0.0005, "0.0005"),
     (0.00012, "0.00012"), (0.00001, "1e-05"), (-3.0, "-3"), (-2500000.0, "-2.5e+06"), (math.inf, "+Inf"), (-math.inf, "-Inf"),
     (math.nan, "NaN"), (1e100, "1e+100"), (-0.00025, "-0.00025")],
)
def test_sample_text(rows, value, want):
    assert one(rows("v DOUBLE", (value,)), numbers.sample_text(F.col("v"))) == want


@pytest.mark.parametrize("value, want", [(100.0, "100"), (-1.0, "-1"), (98.5, "98.5"), (33.33, "33.33"), (0.0, "0"), (1200.0, "1200")])
def test_percentage_text(rows, value, want):
    assert one(rows("v DOUBLE", (value,)), numbers.percentage_text(F.col("v"))) == want


def test_label_block_order_and_escapes(rows):
    df = rows("v MAP<STRING,STRING>", ({"le": "5", "z": 'say "hi"', "b": "back\\slash\nline"},))
    assert one(df, labels.label_block(F.col("v"))) == '{b="back\\\\slash\\nline",z="say \\"hi\\"",le="5"}'
    assert one(rows("v MAP<STRING,STRING>", ({},)), labels.label_block(F.col("v"))) == ""


def test_series_label_wins_over_constant_label(rows):
    df = rows("v MAP<STRING,STRING>, c MAP<STRING,STRING>", ({"a": "1"}, {"a": "9", "site": "x"}), ({"a": "1"}, None))
    got = [r.x for r in df.select(labels.with_labels(F.col("v"), F.col("c")).alias("x")).collect()]
    assert got == [{"a": "1", "site": "x"}, {"a": "1"}]
