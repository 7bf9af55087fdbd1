"""Double Metaphone against a published list of words and their two codes."""

import pytest
from pyspark.sql import functions as F

from shelflight.functions import double_metaphone as dm
from shelflight.functions.phonetic import METAPHONE, query_codes
from shelflight.operators.embedding import HashedNGrams
from shelflight.plans.index_build import build_catalog_index
from shelflight.plans.search import ranked_pool

# word: first code, second code (fixed values, cut at four letters)
PUBLISHED = {
    "smith": ("SM0", "XMT"), "schmidt": ("XMT", "SMT"), "thumb": ("0M", "TM"), "thomas": ("TMS", "TMS"),
    "knight": ("NT", "NT"), "caesar": ("SSR", "SSR"), "chianti": ("KNT", "KNT"), "michael": ("MKL", "MXL"),
    "czerny": ("SRN", "XRN"), "focaccia": ("FKX", "FKX"), "bellocchio": ("PLX", "PLX"), "bacchus": ("PKS", "PKS"),
    "accident": ("AKST", "AKST"), "edge": ("AJ", "AJ"), "edgar": ("ATKR", "ATKR"), "ghost": ("KST", "KST"),
    "ghislane": ("JLN", "JLN"), "laugh": ("LF", "LF"), "mclaughlin": ("MKLF", "MKLF"), "hugh": ("H", "H"),
    "bough": ("P", "P"), "cabrillo": ("KPRL", "KPR"), "gallegos": ("KLKS", "KKS"), "jose": ("HS", "HS"),
    "san jacinto": ("SNHS", "SNHS"), "bajador": ("PJTR", "PHTR"), "rogier": ("RJ", "RJR"), "island": ("ALNT", "ALNT"),
    "isle": ("AL", "AL"), "sugar": ("XKR", "SKR"), "snider": ("SNTR", "XNTR"), "school": ("SKL", "SKL"),
    "schooner": ("SKNR", "SKNR"), "schenker": ("XNKR", "SKNK"), "resnais": ("RSN", "RSNS"), "artois": ("ART", "ARTS"),
    "wasserman": ("ASRM", "FSRM"), "vasserman": ("FSRM", "FSRM"), "uomo": ("AM", "AM"), "womo": ("AM", "FM"),
    "arnow": ("ARN", "ARNF"), "filipowicz": ("FLPT", "FLPF"), "breaux": ("PR", "PR"), "zhao": ("J", "J"),
    "xavier": ("SF", "SFR"), "chorus": ("KRS", "KRS"), "chore": ("XR", "XR"), "architect": ("ARKT", "ARKT"),
    "orchestra": ("ARKS", "ARKS"), "bacher": ("PKR", "PKR"), "macher": ("MKR", "MKR"), "danger": ("TNJR", "TNKR"),
    "biaggi": ("PJ", "PK"), "tagliaro": ("TKLR", "TLR"), "jankelowicz": ("JNKL", "ANKL"),
    "testing": ("TSTN", "TSTN"), "the": ("0", "T"), "quick": ("KK", "KK"), "brown": ("PRN", "PRN"),
    "fox": ("FKS", "FKS"), "jumped": ("JMPT", "AMPT"), "over": ("AFR", "AFR"), "lazy": ("LS", "LS"),
    "dogs": ("TKS", "TKS"), "maccafferey": ("MKFR", "MKFR"), "mac caffrey": ("MKFR", "MKFR"),
    "mac gregor": ("MKRK", "MKRK"), "stephan": ("STFN", "STFN"), "kuczewski": ("KSSK", "KXFS"),
    "mcclelland": ("MKLL", "MKLL"), "san jose": ("SNHS", "SNHS"), "xenophobia": ("SNFP", "SNFP"), "fokker": ("FKR", "FKR"),
    "joqqi": ("JK", "AK"), "hovvi": ("HF", "HF"), "succeed": ("SKST", "SKST"), "pizza": ("PS", "PTS"), "wright": ("RT", "RT"),
    "gnome": ("NM", "NM"), "pneumonia": ("NMN", "NMN"), "psalm": ("SLM", "SLM"), "dumb": ("TM", "TM"), "thumbs": ("0MPS", "TMPS"),
    "nation": ("NXN", "NXN"), "match": ("MX", "MX"), "phone": ("FN", "FN"), "campbell": ("KMPL", "KMPL"),
}


def codes_of(spark, words, length=dm.LENGTH):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = df.select("word", dm.double_codes(F.col("word"), length).alias("c")).collect()
    return {r.word: (r.c.primary, r.c.alternate) if r.c else None for r in rows}


def test_published_words(spark):
    found = codes_of(spark, PUBLISHED)
    assert {w: (found[w], c) for w, c in PUBLISHED.items() if found[w] != c} == {}
    upper = codes_of(spark, [w.upper() for w in PUBLISHED])
    assert upper == {w.upper(): c for w, c in PUBLISHED.items()}


def test_whole_codes(spark):
    assert codes_of(spark, ["filipowicz", "mclaughlin"], None) == {
        "filipowicz": ("FLPTS", "FLPFX"), "mclaughlin": ("MKLFLN", "MKLFLN"),
    }


def test_words_without_sound_and_odd_letters(spark):
    found = codes_of(spark, ["", " ", "100", "3m 300", "|", "ça", "señor", "élan", "漢", None])
    assert found == {
        "": ("", ""), " ": ("", ""), "100": ("", ""), "3m 300": ("M", "M"), "|": ("", ""), "ça": ("S", "S"),
        "señor": ("SNR", "SNR"), "élan": ("ALN", "ALN"), "漢": ("", ""), None: None,
    }


@pytest.mark.parametrize("word, code", [("rogier", "RJ"), ("100", ""), ("ier", "A"), ("r", "R")])
def test_brand_takes_the_first_code_that_is_not_empty(spark, word, code):
    df = spark.createDataFrame([(word,)], "word string")
    assert df.select(dm.brand_code(F.col("word"))).first()[0] == code


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("word",)], "word string").select(dm.word_codes(F.col("word")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def test_queries_take_both_codes_of_every_token(spark):
    df = spark.createDataFrame([("large ring  gear 100",), ("",), (None,)], "q string")
    found = [r[0] for r in df.select(query_codes(F.col("q"), dm.DOUBLE_METAPHONE)).collect()]
    assert found == [["JR", "KR", "LRJ", "LRK", "RNK"], [], None]


def test_search_with_either_encoder(spark, tmp_path):
    """A brand is boosted by a token's second code only with the two-code encoder."""
    rows = [(0, "a", "sauce", "schmidt", "food"), (1, "b", "sauce", "miller", "food")]
    raw = spark.createDataFrame(
        rows, "row_id long, brand_sku_id string, product_name string, brand_name string, category_name string"
    )
    asked = spark.createDataFrame([("q", "smith sauce")], "query_id string, q string")
    boosted = {}
    for encoder in (METAPHONE, dm.DOUBLE_METAPHONE):
        index = build_catalog_index(raw, f"{tmp_path}/{encoder.name}", phonetic=encoder)
        pool = ranked_pool(asked, index, HashedNGrams(), phonetic=encoder).where("row_id = 0").first()
        boosted[encoder.name] = pool.score < pool.dist
    assert boosted == {"metaphone": False, "double-metaphone": True}
