"""Row types of the stored tables."""

from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())

EVENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("labels", STRINGS),
    T.StructField("kv", STRINGS),
    T.StructField("latency_us", T.DoubleType()),
    T.StructField("raw", T.StringType()),
])

RULE = T.StructType([
    T.StructField("priority", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("hit_count", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("origin", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("instance", T.StringType()),
    T.StructField("severity_hint", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("occurrences", T.LongType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("triaged_at", T.TimestampType()),
])

CAMPAIGN_ACTOR = T.StructType([
    T.StructField("actor_id", T.StringType()),
    T.StructField("codename", T.StringType()),
    T.StructField("emoji", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("threat_tier", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("followup_tags", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
])
