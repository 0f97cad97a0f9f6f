"""Declared schemas of the landed files."""

from __future__ import annotations

from pyspark.sql import types as T

SALES = T.StructType([
    T.StructField("sale_date", T.DateType()),
    T.StructField("sale_price", T.DoubleType()),
    T.StructField("beds", T.IntegerType()),
    T.StructField("sqft", T.DoubleType()),
    T.StructField("bath_full", T.IntegerType()),
    T.StructField("bath_half", T.IntegerType()),
    T.StructField("bath_3qtr", T.IntegerType()),
    T.StructField("year_built", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])

# The columns of the sales report, in their order.
SALES_REPORT_COLUMNS = [
    "sale_date", "sale_price", "beds", "sqft", "price_per_sqft", "bath_full",
    "bath_half", "bath_3qtr", "year_built", "lat", "lng",
]


def _listing(type_field: str, status_field: str) -> T.StructType:
    return T.StructType([
        T.StructField("zpid", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("bedrooms", T.IntegerType()),
        T.StructField("bathrooms", T.IntegerType()),
        T.StructField("livingArea", T.DoubleType()),
        T.StructField(type_field, T.StringType()),
        T.StructField(status_field, T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("imgSrc", T.StringType()),
        T.StructField("pos", T.LongType()),
    ])


LISTING_A = _listing("propertyType", "listingStatus")
LISTING_B = _listing("homeType", "homeStatus")

PLACE = T.StructType([
    T.StructField("fsq_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StructType([T.StructField("formatted_address", T.StringType())])),
    T.StructField("geocodes", T.StructType([
        T.StructField("main", T.StructType([
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType()),
        ])),
    ])),
])

_PAGE_META = [
    T.StructField("resultsPerPage", T.IntegerType()),
    T.StructField("totalPages", T.LongType()),
    T.StructField("totalResultCount", T.LongType()),
]

PAGES_PAYLOAD = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("results", T.ArrayType(LISTING_B)),
    *_PAGE_META,
])

SEARCH_PAYLOAD = T.StructType([
    T.StructField("api_call_no", T.LongType()),
    T.StructField("search_long_lat", T.StringType()),
    T.StructField("currentPage", T.IntegerType()),
    T.StructField("props", T.ArrayType(LISTING_A)),
    *_PAGE_META,
])

PLACES_PAYLOAD = T.StructType([
    T.StructField("results", T.ArrayType(PLACE)),
    T.StructField("context", T.StructType([
        T.StructField("geo_bounds", T.StructType([
            T.StructField("circle", T.StructType([
                T.StructField("center", T.StructType([
                    T.StructField("latitude", T.DoubleType()),
                    T.StructField("longitude", T.DoubleType()),
                ])),
                T.StructField("radius", T.IntegerType()),
            ])),
        ])),
    ])),
])

PAIR = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(PAIR)
