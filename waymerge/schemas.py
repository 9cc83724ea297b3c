"""Schemas of the stored tables, enforced at read."""

PLACES = (
    "id string, title string, address string, latitude double, longitude double, notes string, "
    "tags array<string>, source string, sourceUrl string, normalizedTitle string, "
    "normalizedAddress string, createdAt timestamp, updatedAt timestamp"
)
COLLECTIONS = "id string, name string, description string, createdAt timestamp, updatedAt timestamp"
MEMBERSHIPS = "id string, placeId string, collectionId string"
PACKS = (
    "id string, name string, target string, scopeType string, scopeId string, "
    "createdAt timestamp, updatedAt timestamp"
)
ITEMS = (
    "id string, packId string, placeId string, status string, mismatchReason string, "
    "mismatchNotes string, completedAt timestamp"
)
IMPORT_RUNS = (
    "id string, type string, fileName string, totalItems bigint, importedCount bigint, skippedCount bigint, "
    "errors array<struct<row:bigint,item:string,reason:string>>, createdAt timestamp"
)
LISTS = (
    "id string, title string, description string, placeIds array<string>, collectionIds array<string>, "
    "createdAt timestamp, updatedAt timestamp, expiresAt timestamp, isPublic boolean"
)
SESSIONS = (
    "id string, packId string, status string, createdAt timestamp, updatedAt timestamp, apiCallsUsed bigint, "
    "processingTimeMs bigint, errorCount bigint, totalPlaces bigint, processedPlaces bigint, "
    "verifiedPlaces bigint, completedPlaces bigint"
)
MATCHES = (
    "id string, sessionId string, originalPlaceId string, targetPlaceData string, confidenceScore int, "
    "confidenceLevel string, matchFactors string, verificationStatus string, verifiedAt timestamp, "
    "verifiedBy string, manualSearchQuery string, manualSelectedPlace string, userNotes string"
)
API_LOG = (
    "id string, service string, endpoint string, sessionId string, requestData string, "
    "responseStatus int, responseTimeMs bigint, createdAt timestamp"
)
EVENTS = "id string, type string, sessionId string, userId string, data string, timestamp timestamp"
CALLS = "callId string, tier string, userId string, ts timestamp"
CACHE_ENTRIES = (
    "key string, data string, createdAt timestamp, expiresAt timestamp, accessCount bigint, "
    "lastAccessedAt timestamp, size bigint, tags array<string>"
)
CANDIDATES = (
    "id string, name string, address string, latitude double, longitude double, category string, "
    "phoneNumber string, website string, rating double, isOpen boolean, source string, url string, "
    "businessStatus string, priceLevel int, types array<string>, "
    "photos array<struct<url:string,width:int,height:int,attribution:string>>, "
    "reviews array<struct<rating:double,text:string,author:string,time:timestamp>>, "
    "openingHours struct<isOpen:boolean,periods:array<struct<open:struct<day:int,time:string>,"
    "close:struct<day:int,time:string>>>,weekdayText:array<string>>"
)

# Allowed values of the string unions.
ALLOWED = {
    "places.source": ("apple", "google", "manual", "other"),
    "packs.target": ("apple", "google"),
    "packs.scopeType": ("library", "collection", "filtered"),
    "items.status": ("pending", "done", "skipped", "flagged"),
    "sessions.status": ("pending", "processing", "verifying", "completed", "failed", "paused"),
    "matches.confidenceLevel": ("high", "medium", "low"),
    "matches.verificationStatus": ("pending", "accepted", "rejected", "manual"),
    "matches.verifiedBy": ("user", "bulk_action"),
}


def disallowed(df, table: str):
    """Rows of ``table`` whose restricted columns hold a value outside their set."""
    from pyspark.sql import functions as F

    bad = F.lit(False)
    for key, values in ALLOWED.items():
        owner, column = key.split(".")
        if owner == table:
            bad = bad | (F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return df.where(bad)
