"""Fixed schemas of the fact tables and of landed API response pages.

Every read passes one of these schemas: a partition directory ``date=…`` would
otherwise be inferred as a DATE, and per-file inferred measure types could mix
int64 and double across days.
"""

from pyspark.sql import types as T

DIMENSIONS = ("query", "page", "device", "country")
MEASURES = ("clicks", "impressions", "ctr", "position")
PARTITION_COLUMNS = ("site_url", "date")

_MEASURE_FIELDS = [
    T.StructField("clicks", T.LongType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("ctr", T.DoubleType()),
    T.StructField("position", T.DoubleType()),
]

# One row per (site_url, date, query, page, device, country); date is 'YYYY-MM-DD'.
DAILY = T.StructType(
    [
        T.StructField("site_url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("country", T.StringType()),
        *_MEASURE_FIELDS,
    ]
)

# Daily grain plus the local hour of the source's hour key (0-23).
HOURLY = T.StructType(
    [
        T.StructField("site_url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("query", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("country", T.StringType()),
        *_MEASURE_FIELDS,
    ]
)

DAILY_COLUMNS = tuple(f.name for f in DAILY.fields)
HOURLY_COLUMNS = tuple(f.name for f in HOURLY.fields)

# One row of a response body. Measures arrive as JSON numbers (ints or floats).
RESPONSE_ROW = T.StructType(
    [
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("clicks", T.DoubleType()),
        T.StructField("impressions", T.DoubleType()),
        T.StructField("ctr", T.DoubleType()),
        T.StructField("position", T.DoubleType()),
    ]
)

# A landed response page: envelope written by the fetcher + the response rows.
RAW_PAGE = T.StructType(
    [
        T.StructField("site_url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("fetch_id", T.StringType()),
        T.StructField("start_row", T.LongType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("rows", T.ArrayType(RESPONSE_ROW)),
    ]
)

# Fixed values of the source API that the ingest rules depend on.
PAGE_ROW_LIMIT = 25000
DAILY_HISTORY_DAYS = 480
HOURLY_HISTORY_DAYS = 10
LAST_HOUR = 23
