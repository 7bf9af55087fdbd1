"""Metaphone as one chain of built-in regular-expression replacements.

Input letters are lower case and emitted codes are upper case, so no rule reads
the output of an earlier one by mistake; context rules (``(?<=[CSPTG])h``) look
at emitted codes on purpose. The rules are the published ones (Philips, 1990).
Start and end rules apply to the whole string, and spaces are kept, so the code
of a two-word brand contains a space and equals no single token's code.

The chain is evaluated where the row is: encoding needs no dictionary join and
so no shuffle, whatever share of the catalog one brand holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from shelflight.functions.text import tokens

# Accented letters count as their base letter (fixed values).
ACCENTED, BASE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

# (pattern, replacement), in order of application (fixed values).
RULES = (
    # digits and signs have no sound; a later "0" can only be the code of "th"
    (r"[^a-z ]", ""),
    # doubled letters and word starts
    (r"([^c])\1+", "$1"),
    (r"^(?:k(?=n)|g(?=n)|p(?=n)|a(?=e)|w(?=r))", ""),
    (r"^x", "S"),
    (r"^wh", "W"),
    (r"mb$", "M"),
    # c
    (r"sch", "SK"),
    (r"ch|c(?=ia)", "X"),
    (r"(?<=s)c(?=[iey])", ""),
    (r"c(?=[iey])", "S"),
    (r"ck|c", "K"),
    # d, g
    (r"dg(?=[eiy])", "J"),
    (r"d", "T"),
    (r"gh(?![aeiou]|$)", ""),
    (r"gn(?=$|ed$)", "N"),
    (r"g(?=[iey])", "J"),
    (r"g", "K"),
    # p, q, s
    (r"ph", "F"),
    (r"q", "K"),
    (r"sh|s(?=io|ia)", "X"),
    (r"s", "S"),
    # t, v
    (r"th", "0"),
    (r"tX", "X"),
    (r"t(?=ia|io)", "X"),
    (r"t", "T"),
    (r"v", "F"),
    # w, x, y, z
    (r"w(?![aeiou])", ""),
    (r"w", "W"),
    (r"x", "KS"),
    (r"y(?![aeiou])", ""),
    (r"y", "Y"),
    (r"z", "S"),
    # h, then vowels last because the rules above need them as context
    (r"h(?![aeiou])", ""),
    (r"(?<=[CSPTG])h", ""),
    (r"h", "H"),
    (r"(?<!^)[aeiou]", ""),
)


def metaphone(text: Column) -> Column:
    """Upper-case Metaphone code; empty when nothing in the text is a letter."""
    plain = F.translate(F.lower(text), ACCENTED, BASE)
    coded = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), RULES, plain)
    return F.upper(coded)


@dataclass(frozen=True)
class PhoneticEncoder:
    """``brand``: text to its one code; ``words``: a token to an array of its codes."""

    name: str
    brand: Callable[[Column], Column]
    words: Callable[[Column], Column]


METAPHONE = PhoneticEncoder("metaphone", metaphone, lambda token: F.array(metaphone(token)))


def query_codes(text: Column, encoder: PhoneticEncoder = METAPHONE) -> Column:
    """Sorted set of the codes of a query's tokens, alternate codes included."""
    codes = F.flatten(F.transform(tokens(text), lambda token: encoder.words(token)))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda code: code != "")))
