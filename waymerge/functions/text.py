"""Name cleaning, tokens and edit similarity.

Patterns never use ``\\b`` or a bare ``\\s``: word edges are ASCII and white space
includes the Unicode spaces, so both are spelled out once here.
"""

from __future__ import annotations

import functools
import string
import sys
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .numbers import round_half_up

_SPACE_SET = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{_SPACE_SET}]"
# Written out, not as ranges: Java looks such a set up in one table, and tests ranges and ``\\s`` one by one.
_NARROW = string.ascii_letters + string.digits + r"_\t\n\x0B\f\r \u00A0"
_WIDE_SPACES = r"\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_NOT_NAME_CHAR = rf"[[^{_NARROW}'\-]&&[^{_WIDE_SPACES}]]"
_NOT_KEY_CHAR = rf"[[^{_NARROW}]&&[^{_WIDE_SPACES}]]"
LEFT_EDGE = r"(?<![A-Za-z0-9_])"
RIGHT_EDGE = r"(?![A-Za-z0-9_])"

# --- fixed values -----------------------------------------------------------
# Words dropped at the end of a canonical name.
TRAILING_SUFFIXES = [
    "llc", "inc", "corp", "ltd", "co", "company", "corporation", "limited",
    "restaurant", "cafe", "coffee", "shop", "store", "market", "deli",
    "bar", "pub", "grill", "bistro", "eatery", "kitchen", "house",
    "center", "centre", "plaza", "mall", "outlet", "emporium",
    "services", "service", "group", "associates", "partners",
    "solutions", "systems", "technologies", "tech",
]
# Words dropped anywhere in a matcher name or provider name.
LEGAL_WORDS = ["llc", "inc", "corp", "ltd", "co"]
TRADE_WORDS = ["restaurant", "cafe", "coffee", "shop", "store", "market"]
# Abbreviations written out in names, in this order.
NAME_ABBREVIATIONS = {
    "st": "saint", "mt": "mount", "ft": "fort", "pt": "point",
    "intl": "international", "natl": "national", "univ": "university",
    "hosp": "hospital", "med": "medical", "ctr": "center", "bldg": "building",
}
# Letters without a canonical decomposition, and basic Cyrillic.
LETTER_SPELLINGS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh",
    "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya",
}
# Emoji and symbol blocks removed from names.
SYMBOL_BLOCKS = [
    ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"),
    ("1F1E0", "1F1FF"), ("2600", "26FF"), ("2700", "27BF"),
]
# ----------------------------------------------------------------------------


def word(pattern: str) -> str:
    """``pattern`` as a whole ASCII word."""
    return f"{LEFT_EDGE}(?:{pattern}){RIGHT_EDGE}"


_SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Single spaces for runs of white space; a lone plain space is left as it is."""
    return F.regexp_replace(c, f"{SPACE}{{2,}}|[{_SPACE_SET}&&[^ ]]", " ")


def _spelled(c: Column, sign: str, pattern: str) -> Column:
    """Replace a sign and the spaces around it by `` and ``; most texts lack the sign."""
    return F.when(c.contains(sign), F.regexp_replace(c, f"{SPACE}*{pattern}{SPACE}*", " and ")).otherwise(c)


def split_words(c: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


@functools.cache
def _accent_table() -> tuple[str, str]:
    """Characters whose decomposition, less U+0300-U+036F, is one character (or none)."""
    changed, deleted = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        base = "".join(
            ch for ch in unicodedata.normalize("NFD", char) if not 0x300 <= ord(ch) <= 0x36F
        )
        if not base:
            deleted.append(char)
        elif base != char and len(base) == 1:
            changed.append((char, base))
    source = "".join(a for a, _ in changed) + "".join(deleted)
    return source, "".join(b for _, b in changed)


def strip_marks(c: Column) -> Column:
    """Decompose and drop combining marks; plain ASCII rows skip the table."""
    source, target = _accent_table()
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, source, target)).otherwise(c)


def plain_letters(c: Column) -> Column:
    """De-accent, then spell out ligatures and basic Cyrillic."""
    base = strip_marks(c)
    single = {k: v for k, v in LETTER_SPELLINGS.items() if len(v) == 1}
    gone = [k for k, v in LETTER_SPELLINGS.items() if v == ""]
    spelled = F.translate(base, "".join(single) + "".join(gone), "".join(single.values()))
    for letter, letters in LETTER_SPELLINGS.items():
        if len(letters) > 1:
            spelled = F.replace(spelled, F.lit(letter), F.lit(letters))
    return F.when(base.rlike(r"[^\x00-\x7F]"), spelled).otherwise(base)


def dedupe_key(c: Column) -> Column:
    """Lower case, ASCII words only, single spaces."""
    return trim(squeeze(F.regexp_replace(F.lower(c), _NOT_KEY_CHAR + "+", "")))


def standard_symbols(c: Column) -> Column:
    """Drop emoji and trademark signs, spell ``&`` and ``+``, unify dashes."""
    blocks = "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in SYMBOL_BLOCKS)
    signs = F.translate(F.regexp_replace(c, f"[{blocks}]", ""), "–—™®©", "--")
    out = F.when(c.rlike(r"[^\x00-\x7F]"), signs).otherwise(c)
    return squeeze(_spelled(_spelled(out, "&", "&"), "+", r"\+"))


def drop_trailing_suffix(c: Column) -> Column:
    """A suffix can only sit in the last characters, so only those are searched."""
    pattern = rf"(?i){word('|'.join(TRAILING_SUFFIXES))}\.?\z"
    reach = max(map(len, TRAILING_SUFFIXES)) + 2  # a full stop, and the character before the word
    text = trim(c)
    tail = F.regexp_replace(F.right(text, F.lit(reach)), pattern, "")
    return trim(F.concat(F.left(text, F.greatest(F.length(text) - reach, F.lit(0))), tail))


def drop_punctuation(c: Column) -> Column:
    out = F.replace(F.regexp_replace(c, _NOT_NAME_CHAR + "+", ""), F.lit("'"), F.lit(""))
    out = F.when(out.contains("-"), F.regexp_replace(out, rf"{SPACE}+-{SPACE}+", " ")).otherwise(out)
    return F.trim(out, F.lit("-"))


def expand_name_words(c: Column) -> Column:
    for short, full in NAME_ABBREVIATIONS.items():
        c = F.regexp_replace(c, "(?i)" + word(short), full)
    return c


@dataclass(frozen=True)
class Cleaning:
    """Switches of the canonical name."""

    accents: bool = True
    punctuation: bool = True
    spaces: bool = True
    lower: bool = True
    suffixes: bool = True
    abbreviations: bool = False


def canonical_name(c: Column, how: Cleaning = Cleaning()) -> Column:
    out = trim(F.coalesce(c, F.lit("")))
    if how.lower:
        out = F.lower(out)
    # each of these reads its text several times, and would have it made anew each time
    if how.accents:
        out = _let(out, plain_letters)
    if how.spaces:
        out = trim(squeeze(out))
    out = _let(out, standard_symbols)
    if how.suffixes:
        out = _let(out, drop_trailing_suffix)
    if how.punctuation:
        out = _let(out, drop_punctuation)
    if how.abbreviations:
        out = expand_name_words(out)
    return trim(out)


def matcher_name(c: Column) -> Column:
    """Name form the scorer compares."""
    out = squeeze(strip_marks(trim(F.lower(F.coalesce(c, F.lit(""))))))
    out = F.regexp_replace(out, word("|".join(LEGAL_WORDS + TRADE_WORDS)) + r"\.?", "")
    out = F.regexp_replace(_spelled(out, "&", "&"), _NOT_NAME_CHAR + "+", "")
    return trim(F.replace(out, F.lit("'"), F.lit("")))


def provider_name(c: Column) -> Column:
    """Name form of the provider profile; case is kept."""
    out = squeeze(trim(F.coalesce(c, F.lit(""))))
    out = F.regexp_replace(out, "(?i)" + word("|".join(LEGAL_WORDS)) + r"\.?", "")
    out = F.regexp_replace(out, "(?i)" + word("|".join(TRADE_WORDS)), "")
    return trim(F.regexp_replace(_spelled(out, "&", "&"), _NOT_NAME_CHAR + "+", ""))


def search_tokens(name: Column) -> Column:
    """Full canonical name, its words and phrases; distinct, longest first."""

    def of(full: Column) -> Column:
        words = F.filter(split_words(full), lambda w: F.length(w) >= 2)

        def phrases(ws: Column) -> Column:
            n = F.size(ws)
            spans = F.flatten(
                F.transform(
                    F.sequence(F.lit(1), n - 1),
                    lambda i: F.transform(
                        F.sequence(F.lit(1), n - i + 1),
                        lambda k: F.array_join(F.slice(ws, i, k), " "),
                    ),
                )
            )
            spans = F.filter(spans, lambda p: F.length(p) >= 3)
            return F.concat(
                F.array(full), ws, F.when(n > 1, spans).otherwise(F.array().cast("array<string>"))
            )

        ranked = F.transform(
            F.array_distinct(_let(words, phrases)),
            lambda t, i: F.struct((-F.length(t)).alias("len"), i.alias("pos"), t.alias("token")),
        )
        return F.transform(F.array_sort(ranked), lambda s: s["token"])

    return _let(canonical_name(name), of)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edit_similarity(a: Column, b: Column) -> Column:
    """0 when a side is empty, 100 when equal, else rounded share of kept characters."""
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    return (
        F.when(F.coalesce(a, F.lit("")) == "", F.lit(0))
        .when(F.coalesce(b, F.lit("")) == "", F.lit(0))
        .when(a == b, F.lit(100))
        .otherwise(round_half_up((longest - F.levenshtein(a, b)) / longest * 100.0))
        .cast("int")
    )


def split_tags(c: Column) -> Column:
    """``a, b;c|d`` to an array without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;|]"), trim), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.coalesce(F.array_join(tags, ";"), F.lit(""))


def first_tag(tags: Column) -> Column:
    return F.get(tags, F.lit(0))
