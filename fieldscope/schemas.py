"""Table schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

# Columns of one collected item, before scoring.
ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("published_at", T.DateType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("summary", T.StringType()),
    T.StructField("prefilter_hits", T.IntegerType()),
    T.StructField("venue", T.StringType()),
    T.StructField("is_preprint", T.IntegerType()),
])

# Scores live in their own insert-only table, keyed by item id.
SCORE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("scored_at", T.TimestampType()),
    T.StructField("scorer", T.StringType()),
])

RUN = T.StructType([
    T.StructField("run_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("fetched", T.LongType()),
    T.StructField("new", T.LongType()),
    T.StructField("ok", T.IntegerType()),
    T.StructField("note", T.StringType()),
])

META = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# A scholarly work as the works API returns it.  ``issn`` and
# ``referenced_works`` carry what the API's own filters look at.
WORK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("publication_date", T.StringType()),
    T.StructField("primary_location", T.StructType([
        T.StructField("landing_page_url", T.StringType()),
        T.StructField("source", T.StructType([
            T.StructField("display_name", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("issn", T.ArrayType(T.StringType())),
        ])),
    ])),
    T.StructField("abstract_inverted_index",
                  T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    T.StructField("authorships", T.ArrayType(T.StructType([
        T.StructField("author", T.StructType([T.StructField("id", T.StringType())])),
    ]))),
    T.StructField("referenced_works", T.ArrayType(T.StringType())),
])

# A feed entry, already parsed from XML to JSON when it was landed.
ENTRY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("doi", T.StringType()),
])

# One record of a reference-manager JSON export.
LIBRARY_RECORD = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("itemType", T.StringType()),
        T.StructField("DOI", T.StringType()),
        T.StructField("extra", T.StringType()),
    ])),
])

JOURNAL = T.StructType([
    T.StructField("display_name", T.StringType()),
    T.StructField("issn_l", T.StringType()),
    T.StructField("works_count", T.LongType()),
    T.StructField("host_organization_name", T.StringType()),
])
