"""Reading and writing: files, links, provider JSON, share and transfer URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymerge.functions.text import split_tags
from waymerge.functions.urls import parse_map_url, provider_of
from waymerge.plans.imports import import_places
from waymerge.plans.storage import work_folder
from waymerge.operators.dedupe import with_dedupe_keys
from waymerge.sources import files, providers, sinks

from . import duck as d
from .curation import lists
from .registry import query
from .scoring import places as tagged_places

_CSV = dict(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _csv_rows(t):
    """Every page as a CSV row under alias headers; some without a title."""
    p = t["places"]
    return p.select(
        F.when(F.col("page_id") % 10 == 0, "").otherwise(F.col("title")).alias("Name"), F.col("address").alias("Location"),
        F.concat(F.col("latitude").cast("string"), F.lit("N")).alias("Lat"), F.col("longitude").cast("string").alias("Lng"),
        F.concat_ws(" ;", F.lit("seen"), "tags_csv").alias("Categories"), F.col("source_url").alias("URL"), F.col("id").alias("Notes"))


_CSV_SQL = """
    from (select *, latitude is not null and longitude is not null as whole, page_id % 10 = 0 or title = '' as bare from {places}) p"""


@query("io1_csv_import", f"""
    select id as notes, title, address, case when whole then latitude end as latitude, case when whole then longitude end as longitude,
        case when tags_csv is null then 'seen' else 'seen,' || tags_csv end as tags, source_url as "sourceUrl" {_CSV_SQL} where not bare""")
def _(t):
    path = work_folder(t.spark, "csv")
    _csv_rows(t).write.options(**_CSV).csv(path)
    rows, _ = files.read_places_csv(t.spark, path)
    return rows.select("notes", "title", "address", "latitude", "longitude", F.array_join("tags", ",").alias("tags"), "sourceUrl")


@query("io1_csv_rejects", f"""select 'Missing title/name' as reason, count(*) as rows {_CSV_SQL} where bare""")
def _(t):
    path = work_folder(t.spark, "csv")
    _csv_rows(t).write.options(**_CSV).csv(path)
    return files.read_places_csv(t.spark, path)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("io2_saved_lists", """
    select id as notes, title, address, case when page_id % 2 = 0 then 12.5 else latitude end as latitude, case when page_id % 2 = 0 then -7.25 else longitude end as longitude
    from {places} where title <> ''""")
def _(t):
    path = work_folder(t.spark, "archive") + "/Takeout/Saved"
    rows = t["places"].select(
        F.col("title").alias("Title"), F.col("address").alias("Address"), F.col("id").alias("Note"),
        F.when(F.col("page_id") % 2 == 0, "https://www.google.com/maps/@12.5,-7.25,15z").alias("URL"),
        F.col("latitude").cast("string").alias("Latitude"), F.col("longitude").cast("string").alias("Longitude"))
    rows.write.options(**_CSV).csv(path)
    return files.read_saved_lists(t.spark, path).select("notes", "title", "address", "latitude", "longitude")


def _saved_text(rows: list, style: int) -> str:
    """A saved list as a person's export has it; one in two styles, with a line break in the second's header."""
    quote = lambda x: "" if x is None else '"' + str(x).replace('"', '""') + '"'
    if style == 0:
        return "Title,Address,Note,URL\n" + "".join(f"{quote(r.title)},{quote(r.address)},{r.id},\n" for r in rows)
    return '\n"Added\non",Comment,Name,location,Location\r\n' + "".join(f'"line\nbreak",{r.id},{quote(r.title)},x,{quote(r.address)}\r\n' for r in rows)


def _archives(t):
    """Zip archives of twenty places each: saved lists in two styles and a table that is no saved list."""
    import io
    import zipfile

    import pandas as pd

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out, rows = io.BytesIO(), list(part.astype(object).where(part.notna(), None).itertuples())
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for style in (0, 1):
                z.writestr(f"Takeout/Saved/list{style}.csv", _saved_text([r for r in rows if r.page_id % 2 == style], style))
            z.writestr("Takeout/other.csv", "Title\nnot saved\n")
        return pd.DataFrame({"path": [f"export-{part.page_id.min() // 20}.zip"], "content": [out.getvalue()]})

    rows = t["places"].select("page_id", "id", "title", "address", F.floor(F.col("page_id") / 20).alias("archive"))
    return rows.groupBy("archive").applyInPandas(pack, "path string, content binary")


@query("io2_archives", """
    select id as notes, title, address, 'list' || (page_id % 2) as "listName", 'export-' || (page_id // 20) || '.zip' as archive from {places} where title <> ''""")
def _(t):
    places, _ = files.saved_archives(_archives(t))
    return places.select("notes", "title", "address", "listName", F.split("ord.file", "!")[0].alias("archive"))


@query("io2_mixed_headers", """select id as notes, title, address, case when title = '' then 1 else 0 end as untitled from {places} where title <> ''""")
def _(t):
    path = work_folder(t.spark, "mixed")
    p = t["places"]
    one = p.where("page_id % 2 = 0").select(F.col("title").alias("Title"), F.col("address").alias("Address"), F.col("id").alias("Note"))
    two = p.where("page_id % 2 = 1").select(F.col("id").alias("Comment"), F.lit("line\nbreak").alias("Added\non"), F.col("address").alias("Location"), F.col("title").alias("Name"))
    one.write.options(**_CSV).csv(f"{path}/Saved/one")
    two.write.options(**_CSV).csv(f"{path}/Saved/two")
    return files.read_saved_lists(t.spark, path).select("notes", "title", "address", F.lit(0).alias("untitled"))


_LINK_SQL = """
    select page_id, case page_id % 7 when 0 then 'Cafe ' || lang || ' ' || n when 1 then 'Oak Street ' || n when 2 then 'Bar ' || lang || ' ' || n
          when 3 then 'Unnamed Place' when 4 then 'Big Park ' || n when 5 then 'Hotel ' || n end as title,
        case page_id % 7 when 0 then 'Cafe ' || lang || ' ' || n when 1 then 'Oak Street ' || n when 2 then 'Bar ' || lang || ' ' || n
          when 3 then '' when 4 then 'Big Park ' || n when 5 then 'Hotel ' || n end as address,
        case page_id % 7 when 0 then cast('40.' || n as double) when 3 then cast('12.' || n as double) when 4 then 41.5 end as latitude,
        case page_id % 7 when 0 then -74.5 when 3 then -3.25 when 4 then cast('-7' || (n % 10) || '.125' as double) end as longitude,
        case when page_id % 7 < 2 then 'apple' else 'google' end as source
    from {links} where page_id % 7 < 6"""


@query("io3_link_import", _LINK_SQL)
def _(t):
    places, _ = files.links_to_places(t["links"])
    return places.select("page_id", "title", "address", "latitude", "longitude", "source")


@query("g25_link_provider", """
    select page_id, case when page_id % 7 < 2 then 'apple' when page_id % 7 < 6 then 'google' end as provider from {links}""")
def _(t):
    return t["links"].select("page_id", provider_of(F.trim("url")).alias("provider"))


@query("io3_link_rejects", "select page_id, url as \"sourceUrl\" from {links} where page_id % 7 = 6")
def _(t):
    return files.links_to_places(t["links"])[1].select("page_id", "sourceUrl")


def _google_bodies(t):
    """Landed search responses of twenty results each."""
    result = F.struct(
        F.col("id").alias("place_id"), "name", F.col("address").alias("formatted_address"),
        F.struct(F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("location")).alias("geometry"),
        split_tags(F.col("types_csv")).alias("types"), (F.col("page_id") % 5).cast("double").alias("rating"),
        F.when(F.col("page_id") % 3 == 0, "OPERATIONAL").otherwise("UNKNOWN").alias("business_status"))
    rows = t["candidates"].groupBy(F.floor(F.col("page_id") / 20).alias("response")).agg(F.collect_list(result).alias("results"))
    return rows.select("response", F.to_json(F.struct(F.lit("OK").alias("status"), "results")).alias("body"))


@query("io4_google_ingest", """
    select id, name, address, latitude, longitude, split_part(types_csv, ',', 1) as category, cast(page_id % 5 as double) as rating,
        case when page_id % 3 = 0 then 'OPERATIONAL' end as "businessStatus", 'google_maps' as source, len(string_split(types_csv, ',')) as types from {candidates}""")
def _(t):
    out = providers.ingest_google(_google_bodies(t))
    return out.select("id", "name", "address", "latitude", "longitude", "category", "rating", "businessStatus", "source",
                      F.size("types").alias("types"))


def _apple_bodies(t):
    mark = lambda day, time: F.struct(F.lit(day).alias("day"), F.lit(time).alias("time"))
    hours = F.struct(F.array(F.struct(mark(1, "09:00").alias("open"), mark(1, "17:00").alias("close"))).alias("periods"))
    result = F.struct(
        "name", F.struct(F.col("latitude").alias("latitude"), F.coalesce("longitude", F.lit(1.0)).alias("longitude")).alias("coordinate"),
        F.split("address", ", ").alias("formattedAddressLines"), F.array("category").alias("categories"),
        F.when(F.col("page_id") % 2 == 0, hours).alias("businessHours"))
    rows = t["candidates"].groupBy(F.floor(F.col("page_id") / 25).alias("response")).agg(F.collect_list(result).alias("results"))
    return rows.select("response", F.to_json(F.struct("results")).alias("body"))


@query("io5_apple_ingest", f"""
    select 'apple_' || lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) || '_' || {d.rounded('latitude * 100000')} || '_' || {d.rounded('coalesce(longitude, 1) * 100000')} as id,
        name, address, category, page_id % 2 = 0 as hours, case when page_id % 2 = 0 then true end as "isOpen", case when page_id % 2 = 0 then 'OPERATIONAL' end as "businessStatus" from {{candidates}}""")
def _(t):
    monday_noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    out = providers.ingest_apple(_apple_bodies(t), monday_noon)
    return out.select("id", "name", "address", "category", F.col("openingHours").isNotNull().alias("hours"), "isOpen", "businessStatus")


def _stored_places(t):
    stamp = F.lit("2024-01-01 10:30:00").cast("timestamp")
    return tagged_places(t).withColumns({
        "notes": F.lit(None).cast("string"), "source": F.lit("manual"), "sourceUrl": F.col("source_url"), "createdAt": stamp, "updatedAt": stamp})


@query("io6_csv_export", """
    with n as (select placeId, string_agg(c.name, ';' order by m.id) as names from {memberships} m join {collections} c on c.id = m.collectionId group by 1)
    select p.id, title, address, coalesce(regexp_replace(cast(latitude as string), '\\.0$', ''), '') as latitude, coalesce(regexp_replace(cast(longitude as string), '\\.0$', ''), '') as longitude,
        coalesce(replace(tags_csv, ',', ';'), '') as tags, coalesce(names, '') as collections, '' as notes, 'manual' as source, source_url as "sourceUrl",
        '2024-01-01T10:30:00.000Z' as "createdAt", '2024-01-01T10:30:00.000Z' as "updatedAt" from {places} p left join n on n.placeId = p.id""")
def _(t):
    return sinks.export_places(_stored_places(t), t["memberships"], t["collections"])


@query("io6_scoped_export", """
    select id from {places} where id in (select placeId from {memberships} where collectionId = 'k00000007')""")
def _(t):
    return sinks.export_places(_stored_places(t), t["memberships"], t["collections"], "k00000007").select("id")


def _shared(t):
    from waymerge.operators.curate import list_places
    rows = list_places(lists(t), _stored_places(t))
    return sinks.share_urls(lists(t).drop("placeIds", "collectionIds"), rows, "https://maps.example.org")


_JSON_PLACE = """'{{"id":"' || p.id || '","title":' || to_json(p.title) || ',"address":' || to_json(p.address)
    || case when p.latitude is null then '' else ',"latitude":' || regexp_replace(cast(p.latitude as string), '\\.0$', '') end
    || case when p.longitude is null then '' else ',"longitude":' || regexp_replace(cast(p.longitude as string), '\\.0$', '') end
    || case when p.tags_csv is null then ',"tags":[]' else ',"tags":["' || replace(p.tags_csv, ',', '","') || '"]' end || '}}'"""


@query("io8_share_urls", f"""
    with s as (select s.listId, string_agg({_JSON_PLACE}, ',' order by s.pos) as parts from {{list_slots}} s left join {{places}} p on p.id = s.placeId group by 1),
    u as (select listId, 'https://maps.example.org/link-list/' || listId as short, '{{{{"id":"' || listId || '","title":"List ' || listId || '","places":[' || coalesce(parts, '')
        || '],"createdAt":"2024-01-01T00:00:00.000Z"}}}}' as json from s)
    select listId as "listId", case when length(short || '?data=' || base64(encode(json))) > 2000 then short else short || '?data=' || base64(encode(json)) end as url from u""")
def _(t):
    return _shared(t)


@query("io9_share_payloads", """
    select listId as "listId", p.id, title, coalesce(address, '') as address, latitude, longitude, lower(trim(title)) as "normalizedTitle", 'other' as source
    from {list_slots} s join {places} p on p.id = s.placeId""")
def _(t):
    return sinks.shared_places(_shared(t)).select("listId", "id", "title", "address", "latitude", "longitude", "normalizedTitle", "source")


_ENC = "replace(url_encode({}), '%2A', '*')"


@query("io10_transfer_urls", f"""
    with v as (select m.*, case when verificationStatus = 'manual' and manualSelectedPlace is not null then manualSelectedPlace when targetPlaceData <> 'not json' then targetPlaceData end as j
               from {{matches}} m where verificationStatus in ('accepted', 'manual')),
    f as (select v.id, v.originalPlaceId, k.target, p.title, p.id is null as absent, json_extract_string(j, '$.name') as nm, json_extract_string(j, '$.address') as ad, json_extract_string(j, '$.placeId') as pid,
            regexp_replace(json_extract_string(j, '$.latitude'), '\\.0$', '') as lat, regexp_replace(json_extract_string(j, '$.longitude'), '\\.0$', '') as lng
          from v join {{sessions}} s on s.id = v.sessionId join {{packs}} k on k.id = s.packId left join {{places}} p on p.id = v.originalPlaceId),
    u as (select *, case when target = 'apple' then case when lat is not null then 'https://maps.apple.com/?ll=' || lat || '%2C' || lng || '&q=' || replace({_ENC.format('nm')}, '%20', '+')
                 when ad is not null then 'https://maps.apple.com/?address=' || replace({_ENC.format('ad')}, '%20', '+') when nm is not null then 'https://maps.apple.com/?q=' || replace({_ENC.format('nm')}, '%20', '+') end
            else case when pid is not null then 'https://www.google.com/maps/place/' || {_ENC.format('pid')} when lat is not null then 'https://www.google.com/maps/@' || lat || ',' || lng || ',15z'
                 when nm is not null then 'https://www.google.com/maps/search/' || {_ENC.format("nm || coalesce(', ' || ad, '')")} end end as link from f)
    select id as "matchId", coalesce(title, 'Unknown Place') as "placeName", case when not absent then link end as url,
        case when absent then 'Original place not found: ' || originalPlaceId when link is null then 'Insufficient place data for ' || case target when 'apple' then 'Apple' else 'Google' end || ' Maps URL' end as error from u""")
def _(t):
    out = sinks.transfer_urls(t["matches"], t["sessions"], t["packs"], t["places"])
    return out.select("matchId", "placeName", "url", "error")


@query("io11_place_links", f"""
    with f as (select *, latitude between -90 and 90 and longitude between -180 and 180 as ok, regexp_replace(cast(latitude as string), '\\.0$', '') as lat, regexp_replace(cast(longitude as string), '\\.0$', '') as lng,
        coalesce(nullif({d.trimmed('address')}, ''), nullif({d.trimmed('title')}, ''), 'Location') as q from {{places}})
    select id, case when ok then 'https://maps.apple.com/?ll=' || lat || '%2C' || lng || '&q=' || replace(replace({_ENC.format('title')}, '%20', '+'), '~', '%7E') else 'https://maps.apple.com/?q=' || replace({_ENC.format('q')}, '%20', '+') end as "appleUrl",
        'https://www.google.com/maps/search/?api=1&query=' || case when ok then lat || ',' || lng else replace(replace(replace(replace({_ENC.format('q')}, '%21', '!'), '%28', '('), '%29', ')'), '%27', '''') end as "googleUrl" from f""")
def _(t):
    return sinks.with_place_links(t["places"]).select("id", "appleUrl", "googleUrl")


@query("import_plan", f"""
    with k as (select page_id, title, address, latitude, longitude, lang, {d.dedupe_key('title')} as kt, {d.dedupe_key('address')} as ka from {{places}}),
    h as (select {d.dedupe_key('name')} as kt, {d.dedupe_key('address')} as ka from {{candidates}} where source = 'google_maps' and category = 'establishment'),
    o as (select *, page_id = min(page_id) over (partition by kt, ka) and (kt, ka) not in (select kt, ka from h) as ok from k)
    select lang as "listName", count(case when ok then 1 end) as "importedCount", count(case when not ok then 1 end) as "skippedCount",
        count(case when ok and (latitude is null or longitude is null) then 1 end) as "missingCoordinatesCount" from o group by rollup(lang)""")
def _(t):
    incoming = _stored_places(t).select("page_id", "title", "address", "latitude", "longitude", "notes", "tags", "sourceUrl", F.col("lang").alias("listName"))
    existing = with_dedupe_keys(t["candidates"].where("category = 'establishment'").select(F.col("name").alias("title"), "address"))
    out = import_places(incoming, existing, F.lit("2024-06-01").cast("timestamp"), ordinal="page_id")
    return out["summary"].select("listName", "importedCount", "skippedCount", "missingCoordinatesCount")
