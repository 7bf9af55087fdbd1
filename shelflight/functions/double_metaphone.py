"""Double Metaphone: two codes a word, by context rules at a cursor.

A word is read from left to right. At each place the first rule whose context holds
emits its codes and moves the cursor. A context is one regular expression over the
word with ``|`` at the cursor, so it sees the letters on both sides as they were
written. The rules are the published ones (Philips, 2000): words may come from
several languages, and where their readings differ the second code gets the other one.

All of it is one expression of built-in functions, evaluated where the row is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

from shelflight.functions.phonetic import ACCENTED, BASE, PhoneticEncoder

# The published length of a code (fixed value).
LENGTH = 4

# Words that look Slavic or Germanic (fixed value); some rules hold only for others.
_SLAVIC = "w|k|cz"

# Rules by the letter at the cursor, in the order they are tried (fixed values):
# context, first code, second code (same if None), letters read, and whether the word
# must look Slavic or Germanic (True), must not (False), or either (None).
_VOWEL = ((r"^\|", "A", None, 1, None), (r"\|", "", None, 1, None))
RULES = {
    **dict.fromkeys("aeiouy", _VOWEL),
    "b": ((r"\|bb", "P", None, 2, None), (r"\|b", "P", None, 1, None)),
    "ç": ((r"\|ç", "S", None, 1, None),),
    "c": (
        (r"[^aeiouy]a\|ch(?![ie])", "K", None, 2, None),
        (r"[bm]a\|cher", "K", None, 2, None),
        (r"^\|caesar", "S", None, 2, None),
        (r"\|chia", "K", None, 2, None),
        (r".\|chae", "K", "X", 2, None),
        (r"^\|ch(?:arac|aris|or(?!e)|ym|ia|em)", "K", None, 2, None),
        (r"^(?:v[ao]n |sch).*\|ch", "K", None, 2, None),
        (r"or\|ches|ar\|chit|or\|chid", "K", None, 2, None),
        (r"\|ch[ts]", "K", None, 2, None),
        (r"(?:^|[aoue])\|ch(?:[lrnmbhfvw ]|$)", "K", None, 2, None),
        (r"^m(?:c.*)?\|ch", "K", None, 2, None),
        (r".\|ch", "X", "K", 2, None),
        (r"\|ch", "X", None, 2, None),
        (r"(?<!wi)\|cz", "S", "X", 2, None),
        (r"\|ccia", "X", None, 3, None),
        (r"^a\|cc(?:[ie]|h(?!u))|u\|cce[es]", "KS", None, 3, None),
        (r"(?<!^m)\|cc(?:[ie]|h(?!u))", "X", None, 3, None),
        (r"(?<!^m)\|cc", "K", None, 2, None),
        (r"\|c[kgq]", "K", None, 2, None),
        (r"\|ci[oea]", "S", "X", 2, None),
        (r"\|c[iey]", "S", None, 2, None),
        (r"\|c [cqg]", "K", None, 3, None),
        (r"\|c(?:[kq]|c(?![ei]))", "K", None, 2, None),
        (r"\|c", "K", None, 1, None),
    ),
    "d": (
        (r"\|dg[iey]", "J", None, 3, None),
        (r"\|dg", "TK", None, 2, None),
        (r"\|d[td]", "T", None, 2, None),
        (r"\|d", "T", None, 1, None),
    ),
    "f": ((r"\|ff", "F", None, 2, None), (r"\|f", "F", None, 1, None)),
    "g": (
        (r"[^aeiouy]\|gh", "K", None, 2, None),
        (r"^\|ghi", "J", None, 2, None),
        (r"^\|gh", "K", None, 2, None),
        (r"[bhd]..?\|gh|[bh]...\|gh", "", None, 2, None),
        (r"[cglrt].u\|gh", "F", None, 2, None),
        (r"[^i]\|gh", "K", None, 2, None),
        (r"\|gh", "", None, 2, None),
        (r"^\|gn", "", None, 1, None),
        (r"^[aeiouy]\|gn", "KN", "N", 2, False),
        (r"\|gn(?!ey)", "N", "KN", 2, False),
        (r"\|gn", "KN", None, 2, None),
        (r"\|gli", "KL", "L", 2, False),
        (r"^\|g(?:y|e[spblyir]|i[blne])", "K", "J", 2, None),
        (r"(?<!^[drm]an)(?<![ei])\|ger|(?<![eiro])\|gy", "K", "J", 2, None),
        (r"^(?:v[ao]n |sch).*(?:\|g[eiy]|[ao]\|ggi)|\|get", "K", None, 2, None),
        (r"\|gier(?: |$)", "J", None, 2, None),
        (r"\|g[eiy]|[ao]\|ggi", "J", "K", 2, None),
        (r"\|gg", "K", None, 2, None),
        (r"\|g", "K", None, 1, None),
    ),
    "h": ((r"(?:^|[aeiouy])\|h[aeiouy]", "H", None, 2, None), (r"\|h", "", None, 1, None)),
    "j": (
        (r"^san .*\|j|^\|jose(?: |$)", "H", None, 1, None),
        (r"\|jose", "J", "H", 1, None),
        (r"^\|jj", "J", "A", 2, None),
        (r"^\|j", "J", "A", 1, None),
        (r"[aeiouy]\|j[ao]", "J", "H", 1, False),
        (r"\|j$", "J", "", 1, None),
        (r"(?<![skl])\|jj", "J", None, 2, None),
        (r"(?<![skl])\|j(?![ltksnmbz])", "J", None, 1, None),
        (r"\|jj", "", None, 2, None),
        (r"\|j", "", None, 1, None),
    ),
    "k": ((r"^\|kn", "", None, 1, None), (r"\|kk", "K", None, 2, None), (r"\|k", "K", None, 1, None)),
    "l": (
        (r"(?:i\|ll[oa]|a\|lle)$|a\|lle.*(?:[ao]s|[ao])$", "L", "", 2, None),
        (r"\|ll", "L", None, 2, None),
        (r"\|l", "L", None, 1, None),
    ),
    "m": (
        (r"u\|mb(?:$|er)|\|mm", "M", None, 2, None),
        (r"\|m", "M", None, 1, None),
    ),
    "n": ((r"\|nn", "N", None, 2, None), (r"\|n", "N", None, 1, None)),
    "p": (
        (r"^\|p[ns]", "", None, 1, None),
        (r"\|ph", "F", None, 2, None),
        (r"\|p[pb]", "P", None, 2, None),
        (r"\|p", "P", None, 1, None),
    ),
    "q": ((r"\|qq", "K", None, 2, None), (r"\|q", "K", None, 1, None)),
    "r": (
        (r"(?<!m[ea])ie\|r$", "", "R", 1, False),
        (r"\|rr", "R", None, 2, None),
        (r"\|r", "R", None, 1, None),
    ),
    "s": (
        (r"[iy]\|sl", "", None, 1, None),
        (r"^\|sugar", "X", "S", 1, None),
        (r"\|sh(?:eim|oek|ol[mz])", "S", None, 2, None),
        (r"\|sh", "X", None, 2, None),
        (r"\|si[oa]", "S", "X", 3, False),
        (r"\|si[oa]", "S", None, 3, None),
        (r"^\|s[mnlw]", "S", "X", 1, None),
        (r"\|sz", "S", "X", 2, None),
        (r"\|sche[rn]", "X", "SK", 3, None),
        (r"\|sch(?:oo|uy|e[dm])", "SK", None, 3, None),
        (r"^\|sch(?![aeiouyw])", "X", "S", 3, None),
        (r"\|sch", "X", None, 3, None),
        (r"\|sc[iey]", "S", None, 3, None),
        (r"\|sc", "SK", None, 3, None),
        (r"[ao]i\|s$", "", "S", 1, None),
        (r"\|ss", "S", None, 2, None),
        (r"\|s", "S", None, 1, None),
    ),
    "t": (
        (r"\|tion|\|tia|\|tch", "X", None, 3, None),
        (r"\|th[oa]m|^(?:v[ao]n |sch).*\|tt?h", "T", None, 2, None),
        (r"\|tt?h", "0", "T", 2, None),
        (r"\|t[td]", "T", None, 2, None),
        (r"\|t", "T", None, 1, None),
    ),
    "v": ((r"\|vv", "F", None, 2, None), (r"\|v", "F", None, 1, None)),
    "w": (
        (r"^\|wr", "", None, 1, None),
        (r"\|wr", "R", None, 2, None),
        (r"^\|w[aeiouy]", "A", "F", 1, None),
        (r"^\|wh", "A", None, 1, None),
        (r"[aeiouy]\|w$|[eo]\|wsk[iy]|^sch.*\|w", "", "F", 1, None),
        (r"\|wi[ct]z", "TS", "FX", 4, None),
        (r"\|w", "", None, 1, None),
    ),
    "x": (
        (r"^\|x", "S", None, 1, None),
        (r"[ao]u\|x$", "", None, 1, None),
        (r"\|x[cx]", "KS", None, 2, None),
        (r"\|x", "KS", None, 1, None),
    ),
    "z": (
        (r"\|zh", "J", None, 2, None),
        (r"\|zz[oia]", "S", "TS", 2, None),
        (r"[^t]\|zz", "S", "TS", 2, True),
        (r"[^t]\|z", "S", "TS", 1, True),
        (r"\|zz", "S", None, 2, None),
        (r"\|z", "S", None, 1, None),
    ),
}


@lru_cache(maxsize=1)
def _reading() -> str:
    """The rules as one SQL lambda: (codes read so far, a place and its context) to the
    codes after the rule that holds there. As text it is parsed at once."""

    def branch(context, first, second, letters, kind) -> str:
        guard = "" if kind is None else " AND seen.slavic" if kind else " AND NOT seen.slavic"
        return (
            f"WHEN seen.context RLIKE r'{context}'{guard} THEN named_struct("
            f"'primary', concat(read.primary, '{first}'), "
            f"'alternate', concat(read.alternate, '{first if second is None else second}'), "
            f"'next', seen.place + {letters})"
        )

    letters = " ".join(
        f"WHEN '{letter}' THEN CASE {' '.join(branch(*rule) for rule in rules)} END" for letter, rules in RULES.items()
    )
    return f"(read, seen) -> CASE WHEN seen.place < read.next THEN read ELSE CASE seen.letter {letters} ELSE read END END"


def double_codes(text: Column, length: int | None = LENGTH) -> Column:
    """``struct(primary, alternate)``, each of ``length`` characters at most (None: whole).

    Accented letters count as their base letter, but ``ç`` is an s. Digits, signs and
    spaces have no sound. Null gives null, a text without letters two empty codes.
    """
    word = F.replace(F.translate(F.lower(text), ACCENTED.replace("ç", ""), BASE.replace("c", "")), F.lit("|"), F.lit(" "))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: i <= F.length(word))
    contexts = F.transform(places, lambda i: F.struct(
        i.alias("place"), F.substring(word, i, F.lit(1)).alias("letter"),
        F.concat(F.substring(word, F.lit(1), i - 1), F.lit("|"), F.substring(word, i, F.length(word))).alias("context"),
        F.rlike(word, F.lit(_SLAVIC)).alias("slavic"),
    ))
    start = F.struct(F.lit("").alias("primary"), F.lit("").alias("alternate"), F.lit(1).alias("next"))
    codes = F.call_function("aggregate", contexts, start, F.expr(_reading()))
    cut = (lambda c: c) if length is None else (lambda c: F.left(c, F.lit(length)))
    both = _bound(codes, lambda r: F.struct(*[cut(r[c]).alias(c) for c in ("primary", "alternate")]))
    return F.when(text.isNotNull(), both)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def brand_code(text: Column, length: int | None = LENGTH) -> Column:
    """The first code, or the second where the first is empty."""
    first = lambda c: F.coalesce(F.nullif(c["primary"], F.lit("")), c["alternate"])
    return _bound(double_codes(text, length), first)


def word_codes(text: Column, length: int | None = LENGTH) -> Column:
    """Both codes as an array; some may be empty or equal."""
    return _bound(double_codes(text, length), lambda c: F.array(c["primary"], c["alternate"]))


DOUBLE_METAPHONE = PhoneticEncoder("double-metaphone", brand_code, word_codes)
