import pytest
from pyspark.sql import functions as F

from shelflight.functions.phonetic import metaphone, query_codes
from shelflight.functions.price import bucket_label, bucket_max, bucket_min, bucket_number
from shelflight.functions.text import (
    facet_title, is_usable, missing_to_null, normalise, or_not_available, strip, tokens,
)
from shelflight.functions.vector import squared_l2


def column(spark, values, expression, kind="string"):
    """Evaluate an expression over column ``x``, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_strip_matches_python(spark):
    texts = ["  a b\t\n", " x ", "\x1cy\x1f", "", "plain", "　 z \u0085"]
    assert column(spark, texts, strip) == [t.strip() for t in texts]


def test_strip_takes_every_blank_without_a_regular_expression(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    texts = [f"{b}{b}a{b}b{b}" for b in blanks] + [chr(i) + "a" for i in range(0x21, 0x3100)] + [None, " \r\n"]
    assert column(spark, texts, strip) == [t and t.strip() for t in texts]
    plan = spark.range(1).select(strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan


def test_tokens_match_python(spark):
    texts = [" red  ring ", "a b\tc", "", "   ", "one"]
    assert column(spark, texts, tokens) == [t.split() for t in texts]


def test_null_becomes_the_word_nan(spark):
    assert column(spark, [None, " X "], normalise) == ["nan", "x"]
    assert column(spark, [None], lambda c: normalise(c, "")) == [""]


def test_missing_tokens(spark):
    texts = ["NA", "n/a", "", "None", "na", "Null", "x"]
    assert column(spark, texts, missing_to_null) == [None, None, None, None, "na", "Null", "x"]


def test_placeholder_values(spark):
    texts = [None, "", " ", "N/A", " na ", "NULL", "None", "-", "--", "x ", " "]
    usable = column(spark, texts, is_usable)
    assert [t for t, ok in zip(texts, usable) if ok] == ["--", "x ", " "]


def test_titles_keep_the_rest(spark):
    keys = ["brand_line", "pack_SIZE", "x", "price_range", "a__b"]
    assert column(spark, keys, facet_title) == ["Brand Line", "Pack SIZE", "X", "💰 Price Range", "A  B"]


def test_not_available(spark):
    assert column(spark, ["", None, "x"], or_not_available) == ["N/A", "N/A", "x"]


# Expected codes (fixed values).
CODES = {
    "red": "RT", "blue": "BL", "large": "LRJ", "new": "N", "cold": "KLT", "hot": "HT",
    "old": "OLT", "small": "SML", "ring": "RNK", "bolt": "BLT", "anvil": "ANFL",
    "widget": "WJT", "gear": "JR", "gizmo": "JSM", "plate": "PLT", "rod": "RT",
    "knight": "NT", "school": "SKL", "match": "MX", "science": "SNS", "nation": "NXN",
    "brand#17": "BRNT", "brands co": "BRNTS K", "123": "", "xylophone": "SLFN", "thumb": "0M",
    "phone": "FN", "wrist": "RST", "vision": "FXN", "judge": "JJ",
}


def test_metaphone(spark):
    words = list(CODES)
    assert dict(zip(words, column(spark, words, metaphone))) == CODES


def test_query_codes_are_a_set_without_blanks(spark):
    assert column(spark, ["Rod red  123 ring", "", "7"], query_codes) == [["RNK", "RT"], [], []]


def test_price_buckets_follow_the_upper_bounds(spark):
    prices = [None, -1.0, 0.0, 99.99, 99.995, 100.0, 249.99, 250.0, 500.0, 1000.0, 2500.0, 4999.99,
              5000.0, 100000.0]
    numbers = column(spark, prices, bucket_number, "double")
    assert numbers == [None, 0, 0, 0, 0, 1, 1, 2, 3, 4, 5, 5, 6, 6]
    shown = column(
        spark, [99.995, 5000.0],
        lambda c: F.struct(*[f(bucket_number(c)) for f in (bucket_label, bucket_min, bucket_max)]),
        "double",
    )
    assert [tuple(s) for s in shown] == [("Under ₹100", 0.0, 99.99), ("Above ₹5,000", 5000.0, 999999.0)]


def test_vector_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert df.select(squared_l2(F.col("a"), F.col("b"))).first()[0] == 25.0
    odd = spark.createDataFrame([([1.0], [4.0, 6.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in length"):
        odd.select(squared_l2(F.col("a"), F.col("b"))).collect()
