"""Files with different headers, share URLs with missing texts, distance bounds and name order."""

from waymerge.operators.filters import MatchFilter, filter_matches
from waymerge.operators.windows import review_order
from waymerge.sources.files import read_places_csv
from waymerge.sources.sinks import share_urls


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Note,url,lat,lng\ngood,\"x\ny\",u1,1,2\n")
    (tmp_path / "b.csv").write_text("description,Title\nfine,Lake\n,\n\"a, b\",Hill\n")
    places, rejects = read_places_csv(spark, str(tmp_path))
    got = sorted((r.title, r.notes, r.sourceUrl, r.latitude) for r in places.collect())
    assert got == [("Hill", "a, b", None, None), ("Lake", "fine", None, None), ("good", None, "u1", 1.0)]
    assert [r.row for r in rejects.collect()] in ([3], [])


def test_share_urls_with_missing_texts(spark):
    lists = spark.createDataFrame([("l", "t", "d", None)], "id string, title string, description string, createdAt string")
    places = spark.createDataFrame([("l", 0, "p", None, None, "1", "2", ["x"])], "listId string, pos int, id string, title string, address string, latitude string, longitude string, tags array<string>")
    import base64

    url = share_urls(lists, places, "http://h").collect()[0].url
    assert '"id":"p"' in base64.b64decode(url.split("?data=")[1]).decode()


def test_name_order(spark):
    rows = [(str(i), f'{{"name":"{n}"}}') for i, n in enumerate(["Zoo", "apple", "École", "Delta"])]
    df = spark.createDataFrame(rows, "id string, targetPlaceData string").selectExpr("*", "1 confidenceScore", "'pending' verificationStatus", "cast(null as timestamp) verifiedAt")
    assert [r.id for r in review_order(df, "name", True).collect()] == ["1", "3", "2", "0"]


def test_distance_bounds(spark):
    # a degree of longitude on the equator is 111.2 km; the last match has no point
    rows = [("at", '{"latitude":0,"longitude":0}'), ("near", '{"latitude":0,"longitude":1}'), ("far", '{"latitude":0,"longitude":2}'), ("none", '{"name":"x"}')]
    df = spark.createDataFrame(rows, "id string, targetPlaceData string").selectExpr(
        "*", "50 confidenceScore", "'medium' confidenceLevel", "'pending' verificationStatus", "cast(null as timestamp) verifiedAt", "'[]' matchFactors",
        "0.0D latitude", "0.0D longitude", "'x' title")
    kept = lambda low, high: {r.id for r in filter_matches(df, MatchFilter(distance_km=(low, high))).collect()}
    assert kept(0, 0) == {"at"} and kept(0, 112) == {"at", "near"} and kept(111, 223) == {"near", "far"} and kept(300, 400) == set()
    assert {r.id for r in filter_matches(df, MatchFilter()).collect()} == {"at", "near", "far", "none"}
