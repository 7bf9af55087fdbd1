"""Text rules: stripping, tokens, placeholders, titles and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelflight.settings import PRICE_KEY

# Whitespace as Python's str.strip() and str.split() see it: the Unicode
# White_Space property plus the four separator control characters.
_BLANK = r"[\s\x1c-\x1f]"
# The same characters one by one.
_BLANKS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)))

# Facet values that mean "nothing was entered" (fixed values).
PLACEHOLDERS = ("n/a", "na", "null", "none", "-")

# Tokens a CSV reader in the pandas tradition treats as missing (fixed values).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Title of the price facet (fixed value).
PRICE_TITLE = "💰 Price Range"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` only removes spaces)."""
    return F.btrim(text, F.lit(_BLANKS))


def tokens(text: Column) -> Column:
    """Whitespace tokens, no empty ones."""
    return F.filter(F.split(text, rf"(?U){_BLANK}+"), lambda token: token != "")


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TOKENS), text)


def normalise(text: Column, null_text: str = "nan") -> Column:
    """Strip and lower-case; a null becomes ``null_text``.

    The default is the text ``nan``: the catalog builder turns nulls into that
    word before any fill could apply. Pass ``""`` for blank nulls.
    """
    return F.lower(strip(F.coalesce(text.cast("string"), F.lit(null_text))))


def search_text(brand: Column, product: Column, category: Column) -> Column:
    """``brand product category``; inner spaces of empty parts are kept."""
    return strip(F.concat(brand, F.lit(" "), product, F.lit(" "), category))


def collated(text: Column, collation: str | None) -> Column:
    """A text that is compared by one of Spark's collations (None: by bytes)."""
    return F.collate(text, collation) if collation else text


def is_usable(value: Column) -> Column:
    """True for a facet value that is neither null, blank nor a placeholder."""
    bare = F.trim(value)
    return value.isNotNull() & (bare != "") & ~F.lower(bare).isin(*PLACEHOLDERS)


def facet_title(key: Column) -> Column:
    """``brand_line`` -> ``Brand Line``; only first letters change."""
    words = F.transform(
        F.split(key, "_"),
        lambda word: F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30)),
    )
    return F.when(key == PRICE_KEY, F.lit(PRICE_TITLE)).otherwise(F.array_join(words, " "))


def or_not_available(*texts: Column) -> Column:
    """First non-empty text, else ``N/A``."""
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts], F.lit("N/A"))
