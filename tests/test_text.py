"""Golden values of names, addresses, coordinates and categories."""

import pytest
from pyspark.sql import functions as F

from waymerge.functions import address as A, category as C, geo as G, text as T, urls as U
from waymerge.functions.numbers import leading_number, round_half_up


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize("given, expected", [
    ("McDonald's Restaurant", "mcdonalds"), ("Café René", "cafe rene"), ("Naïve Café", "naive"),
    ("Ben & Jerry's", "ben and jerrys"), ("AT&T™ Store", "at and t"), ("Joe's Pizza LLC", "joes pizza"),
    (None, ""), ("   ", ""), ("Straße Øst Œuvre", "strasse ost oeuvre"), ("Чайка йод", "chaika iod"),
    ("Fun 😀 Park ☀", "fun park"), ("Grill  House.", "grill"),
])
def test_canonical_name(spark, given, expected):
    assert one(spark, T.canonical_name, given) == expected


def test_canonical_name_switches(spark):
    keep = T.Cleaning(suffixes=False, abbreviations=True)
    assert one(spark, lambda c: T.canonical_name(c, keep), "St. Mary's Hospital Inc.") == "saint marys hospital inc"


@pytest.mark.parametrize("given, expected", [
    ("Joe's Coffee Shop & Co.", "joes   and"), ("Écocafé Café", "ecocafe"), ("Smith-Jones, Ltd.", "smith-jones"), ("!!!", ""),
])
def test_matcher_name(spark, given, expected):
    assert one(spark, T.matcher_name, given).replace("  ", " ").strip() == expected.replace("  ", " ").replace("  ", " ").strip()


def test_search_tokens(spark):
    tokens = one(spark, T.search_tokens, "New York Pizza Company")
    assert {"new york pizza", "new york", "york pizza", "pizza"} <= set(tokens)
    assert [len(x) for x in tokens] == sorted((len(x) for x in tokens), reverse=True)
    assert one(spark, T.search_tokens, "") == [""]


@pytest.mark.parametrize("given, expected", [
    ("100 N. Main St.", "100 north main street"), ("200 SE Oak Dr", "200 southeast oak drive"),
    ("456 Boul. Saint-Laurent", "456 boulevard saint-laurent"),
    ("123 Main St, New York, NY 10001", "123 main street, new york, ny 10001"),
    ("1 St., X", "1 street., x"), ("1 Way. End", "1 way end"),
])
def test_canonical_address(spark, given, expected):
    assert one(spark, A.canonical_address, given) == expected


@pytest.mark.parametrize("given, number, street, city, region, country, postal", [
    ("123 Main Street, New York, NY 10001", "123", "main street", "New York", "NY", None, "10001"),
    ("456 Oak Ave, Toronto, ON M5V 3A8", "456", "oak avenue", "Toronto", "ON", None, "M5V3A8"),
    ("12 Oak Ave, Toronto, ON M5V 3A8, Canada", "12", "oak avenue", "Toronto", "ON", "Canada", "M5V3A8"),
    ("10 Downing Street, London SW1A 2AA", "10", "downing street", None, None, None, "SW1A2AA"),
    ("12 Main St New York", "12", "main street", "new york", None, None, None),
    ("Unter den Linden 1, Berlin, 10117", None, "unter den linden", "Berlin", None, None, "10117"),
])
def test_address_parts(spark, given, number, street, city, region, country, postal):
    df = A.with_address_parts(spark.createDataFrame([(given,)], "a string"), "a", "p")
    assert tuple(df.first().p) == (number, street, city, region, country, postal)


def test_house_number_range(spark):
    df = A.with_address_parts(spark.createDataFrame([("123A-125B Main St",)], "a string"), "a", "p")
    assert df.first().p.number == "123A-125B"


@pytest.mark.parametrize("lat, lng, errors, precision", [
    (91.0, -74.006, ["Latitude must be between -90 and 90"], None), (0.0, 0.0, ["Coordinates (0,0) are likely invalid"], None),
    (40.712345, -74.006789, [], "exact"), (40.71, -74.0, [], "city"), (40.0, -74.0, [], "region"), (40.123, -74.0, [], "approximate"),
])
def test_coordinates(spark, lat, lng, errors, precision):
    got = one(spark, G.check_coordinates, lat, lng)
    assert (got.errors, got.precision, got.is_valid) == (errors, precision, not errors)


def test_new_york_to_los_angeles(spark):
    km = one(spark, lambda a, b, c, d: G.haversine_km(a, b, c, d), 40.7128, -74.0060, 34.0522, -118.2437)
    assert abs(km - 3936) < 5


@pytest.mark.parametrize("given, expected", [
    ("food", "restaurant"), ("Fast Food", "restaurant"), ("restaurante", "restaurant"), ("unknown_category", "establishment"),
    (None, "establishment"), ("cafe", "cafe"),
])
def test_canonical_category(spark, given, expected):
    df = C.with_canonical_category(spark.createDataFrame([(given,)], "c string"), "c", "k")
    assert df.first().k == expected


@pytest.mark.parametrize("a, b, expected", [
    ("restaurant", "cafe", 75), ("restaurant", "hospital", 0), ("cafe", "cafe", 100), ("hospital", "gym", 60), ("grocery", "supermarket", 75),
])
def test_category_similarity(spark, a, b, expected):
    sim = lambda x, y: C.canonical_similarity(x, y, C.canonical_variations(x), C.canonical_variations(y))
    assert one(spark, sim, a, b) == expected


def test_rounding_and_numbers(spark):
    assert [one(spark, round_half_up, v) for v in (-2.5, 2.5, -0.4)] == [-2, 3, 0]
    assert [one(spark, leading_number, v) for v in ("40.7abc", "abc", " -3e2x", "")] == [40.7, None, -300.0, None]


def test_links(spark):
    link = lambda t, a, x, y: U.apple_link(t, a, x, y)
    assert one(spark, link, "Big Café", "", 40.5, -74.0) == "https://maps.apple.com/?ll=40.5%2C-74&q=Big+Caf%C3%A9"
    assert one(spark, U.google_link, "A (b)", " 1 Main St ", 95.0, 0.0).endswith("query=1%20Main%20St")
    parsed = one(spark, U.parse_map_url, "https://www.google.com/maps/place/Big+Park/@41.5,-71.25,15z")
    assert (parsed.title, parsed.latitude, parsed.longitude) == ("Big Park", 41.5, -71.25)
    assert one(spark, U.parse_map_url, "https://example.org/x") is None


def test_whole_records_in_three_forms(spark):
    from pyspark.sql import functions as F

    from waymerge.operators.records import normalize_records

    rows = [("1", "The Blue Door LLC", "12 Main St., Paris, 75001", 1.5, 2.25, ["Fast Food"]), ("2", "plain", "", None, 2.0, []), ("3", None, None, 95.0, 2.0, None), ("4", "x", "y", 0.0, 0.0, ["restaurant"])]
    df = spark.createDataFrame(rows, "id string, title string, address string, latitude double, longitude double, tags array<string>")
    got = {p: {r.id: r for r in normalize_records(df, "title", F.get("tags", F.lit(0)), p).collect()} for p in ("canonical", "matcher", "provider")}
    one = got["canonical"]["1"]
    assert (one.name, one.components.city, one.components.postal, one.coordinates.precision) == ("the blue door", "Paris", "75001", "city")
    assert one.flags == ["name_normalized", "address_normalized", "category_normalized"] and "blue door" in one.tokens and one.original.title == "The Blue Door LLC"
    assert got["matcher"]["1"].address == "12 main street, paris, 75001" and got["provider"]["1"].name == "The Blue Door" and got["provider"]["1"].address.startswith("12 Main Street")
    assert [got["canonical"][k].flags for k in "234"] == [[], ["invalid_coordinates"], ["invalid_coordinates"]]
    assert got["canonical"]["2"].coordinates is None and got["canonical"]["3"].name == ""
