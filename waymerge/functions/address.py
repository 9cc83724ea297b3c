"""Address forms and component parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numbers import present, settled
from .text import LEFT_EDGE, RIGHT_EDGE, SPACE, plain_letters, split_words, squeeze, strip_marks, trim, word

# --- fixed values -----------------------------------------------------------
# Street words, English then French, then directions.
STREET_WORDS = {
    "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive",
    "rd": "road", "ln": "lane", "ct": "court", "pl": "place",
    "pkwy": "parkway", "hwy": "highway", "fwy": "freeway",
    "expy": "expressway", "trl": "trail", "cir": "circle", "sq": "square",
    "ter": "terrace", "way": "way", "walk": "walk", "path": "path",
    "row": "row", "mews": "mews", "gdns": "gardens", "pk": "park",
    "est": "estate", "cl": "close", "crescent": "crescent",
    "cres": "crescent",
    "rue": "rue", "av": "avenue", "boul": "boulevard", "ch": "chemin",
    "rte": "route", "autoroute": "autoroute",
    "n": "north", "ne": "northeast", "e": "east", "se": "southeast",
    "s": "south", "sw": "southwest", "w": "west", "nw": "northwest",
}
# Abbreviations of the matcher form.
MATCHER_STREET_WORDS = {
    "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive",
    "rd": "road", "ln": "lane", "ct": "court", "pl": "place",
    "pkwy": "parkway", "hwy": "highway",
}
# Abbreviations of the provider form.
PROVIDER_STREET_WORDS = {
    "st": "Street", "ave": "Avenue", "blvd": "Boulevard", "dr": "Drive",
    "rd": "Road", "ln": "Lane", "ct": "Court", "pl": "Place",
}
# A street name ends at the first of these; what follows is read as the city.
STREET_ENDINGS = [
    "street", "avenue", "boulevard", "drive", "road", "lane", "court",
    "place", "parkway", "highway", "trail", "terrace", "square", "way",
]
# Postal codes in order of preference: US, CA, UK, AU (DE and FR equal US).
POSTAL_PATTERNS = [
    r"\d{5}(?:-\d{4})?",
    r"[A-Za-z]\d[A-Za-z]SP?\d[A-Za-z]\d",
    r"[A-Za-z]{1,2}\d[A-Za-z\d]?SP?\d[A-Za-z]{2}",
    r"\d{4}",
]
# ----------------------------------------------------------------------------

_POSTAL = [LEFT_EDGE + p.replace("SP", SPACE) + RIGHT_EDGE for p in POSTAL_PATTERNS]
_ANY_POSTAL = "|".join(_POSTAL)
_NUMBER = rf"\A(\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?)[,{SPACE[1:-1]}]+"
_REGION_POSTAL = rf"\A([A-Za-z]{{2,3}}){SPACE}+([A-Za-z0-9\-{SPACE[1:-1]}]+)\z"
_WORD_EDGES = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"


def _map_of(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def expand_street_words(c: Column) -> Column:
    """Write out street and direction words; a full stop after one goes if a space or the end follows.

    One pass over the words: no expansion is itself a different abbreviation, so
    this equals applying the rules one after another.
    """
    full = _map_of(STREET_WORDS)
    keys = [F.lit(k) for k in STREET_WORDS]

    def rewrite(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def one(piece: Column, i: Column) -> Column:
            before = F.lower(F.get(pieces, i - 1))
            stop_goes = (
                (i > 0)
                & before.isin(*keys)
                & piece.startswith(".")
                & (piece.rlike(rf"\A\.{SPACE}") | ((i == last) & (piece == ".")))
            )
            return F.when(stop_goes, F.substring(piece, 2, 1 << 30)).otherwise(
                F.coalesce(F.element_at(full, F.lower(piece)), piece)
            )

        return F.transform(pieces, one)

    pieces = F.split(c, _WORD_EDGES)
    return F.array_join(F.get(F.transform(F.array(pieces), rewrite), F.lit(0)), "")


def canonical_address(c: Column) -> Column:
    out = plain_letters(F.lower(trim(F.coalesce(c, F.lit("")))))
    out = expand_street_words(trim(squeeze(out)))
    return trim(F.regexp_replace(out, r"[,.]\z", ""))


def matcher_address(c: Column) -> Column:
    """Address form the scorer compares."""
    out = squeeze(strip_marks(trim(F.lower(F.coalesce(c, F.lit(""))))))
    for short, full in MATCHER_STREET_WORDS.items():
        out = F.regexp_replace(out, word(short) + r"\.?", full)
    out = F.regexp_replace(out, LEFT_EDGE + "ste-", "sainte-")
    return trim(F.regexp_replace(out, r"[,.]\z", ""))


def provider_address(c: Column) -> Column:
    """Address form of the provider profile; case is kept."""
    out = squeeze(trim(F.coalesce(c, F.lit(""))))
    for short, full in PROVIDER_STREET_WORDS.items():
        out = F.regexp_replace(out, "(?i)" + word(short), full)
    return F.regexp_replace(out, r"[,.]\z", "")


def postal_code(c: Column) -> Column:
    """First match of the postal patterns in order, without spaces."""
    found = F.coalesce(*[present(F.regexp_extract(c, p, 0)) for p in _POSTAL])
    return F.regexp_replace(found, SPACE, "")


def with_address_parts(df: DataFrame, address: str, out: str) -> DataFrame:
    """Add struct ``out``: number, street, city, region, country, postal.

    Steps are separate projections so that each shared value is computed once.
    """
    p = f"__{out}_"
    a = F.coalesce(F.col(address), F.lit(""))
    street_text = trim(F.regexp_replace(F.get(F.split(a, ","), F.lit(0)), _NUMBER, ""))
    df = df.withColumns({
        p + "street": trim(
            F.regexp_replace(canonical_address(street_text), rf"{SPACE}+\d+[A-Za-z]?\z", "")
        ),
        p + "parts": F.filter(F.transform(F.split(a, ","), trim), lambda x: x != ""),
    })
    df = df.withColumns({
        p + "words": split_words(F.col(p + "street")),
        p + "loc": F.slice(F.col(p + "parts"), 2, 1 << 30),
    })
    endings = [F.lit(w) for w in STREET_ENDINGS]
    loc, n_loc = F.col(p + "loc"), F.size(p + "loc")
    second, last = F.get(loc, n_loc - 2), F.get(loc, n_loc - 1)
    df = df.withColumns({
        p + "end": F.array_position(F.transform(p + "words", lambda w: w.isin(*endings)), True),
        p + "second": second,
        p + "last": last,
        p + "second_tail": F.regexp_extract(second, _REGION_POSTAL, 2),
        p + "last_tail": F.regexp_extract(last, _REGION_POSTAL, 2),
    })
    words, end = F.col(p + "words"), F.col(p + "end").cast("int")
    cut = (end > 0) & (end < F.size(words))
    df = df.withColumns({
        p + "cut": cut,
        p + "by_second": F.coalesce(F.col(p + "second_tail").rlike(_ANY_POSTAL), F.lit(False)),
        p + "by_last": F.coalesce(F.col(p + "last_tail").rlike(_ANY_POSTAL), F.lit(False)),
        p + "last_postal": F.coalesce(F.col(p + "last").rlike(_ANY_POSTAL), F.lit(False)),
    })
    by_second, by_last = F.col(p + "by_second"), F.col(p + "by_last")
    first_loc = F.get(loc, F.lit(0))
    cut = F.col(p + "cut")
    inferred = F.when(cut, F.array_join(F.slice(words, end + 1, F.greatest(F.size(words) - end, F.lit(0))), " "))
    plain_city = (
        F.when(F.col(p + "last_postal"), F.when(n_loc >= 3, F.get(loc, n_loc - 3)).when(n_loc == 2, first_loc))
        .otherwise(first_loc)
    )
    plain_region = (
        F.when(F.col(p + "last_postal"), F.when(n_loc >= 3, F.col(p + "second")))
        .otherwise(F.get(loc, F.lit(1)))
    )
    street = F.when(cut, F.array_join(F.slice(words, 1, F.greatest(end, F.lit(0))), " ")).otherwise(F.col(p + "street"))
    parts = F.struct(
        present(F.regexp_extract(a, _NUMBER, 1)).alias("number"),
        F.coalesce(present(street), present(canonical_address(first_loc))).alias("street"),
        F.when(by_second, first_loc)
        .when(by_last, F.when(n_loc >= 2, first_loc))
        .otherwise(F.coalesce(plain_city, inferred))
        .alias("city"),
        F.when(by_second, F.regexp_extract(F.col(p + "second"), _REGION_POSTAL, 1))
        .when(by_last, F.regexp_extract(F.col(p + "last"), _REGION_POSTAL, 1))
        .otherwise(plain_region)
        .alias("region"),
        F.when(by_second, F.col(p + "last")).alias("country"),
        F.when(by_second, F.regexp_replace(p + "second_tail", SPACE, ""))
        .when(by_last, F.regexp_replace(p + "last_tail", SPACE, ""))
        .otherwise(postal_code(a))
        .alias("postal"),
    )
    df = df.withColumn(out, parts)
    return settled(df.drop(*[c for c in df.columns if c.startswith(p)]), out)
