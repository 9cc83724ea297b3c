"""Texts are cleaned in one go: sets of characters are looked up, and no step makes its text anew."""

import sys
import unicodedata

from pyspark.sql import functions as F

from waymerge.functions import text as T


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_name_is_lowered_once(spark):
    df = spark.createDataFrame([("a",)], "t string").repartition(2)
    assert plan_of(df.select(T.canonical_name(F.col("t")).alias("n"))).count("lower(") <= 2


def test_sets_of_characters(spark):
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    df = spark.createDataFrame([(i, chr(i)) for i in points[:0x11000] if i], "i int, c string")
    kept = {r.i: (r.name, r.key) for r in df.select("i", (F.regexp_replace("c", T._NOT_NAME_CHAR, "") != "").alias("name"),
                                                    (F.regexp_replace("c", T._NOT_KEY_CHAR, "") != "").alias("key")).collect()}
    spaces = {0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0xA0, *range(0x2000, 0x200B), *b"\t\n\x0b\f\r "}
    for i, (name, key) in kept.items():
        plain = i in spaces or (i < 128 and (chr(i).isalnum() or chr(i) == "_"))
        assert key == plain and name == (plain or chr(i) in "'-"), unicodedata.name(chr(i), hex(i))
    assert not T._NOT_NAME_CHAR.count("A-Z") and not T._NOT_KEY_CHAR.count("A-Z")
