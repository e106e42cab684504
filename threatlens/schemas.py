"""Column contracts shared by the operators.

``seq`` is the arrival order.  ``seq.part`` names a bounded slice of the input
(a file split, or a range of ids) and sorts in input order; ``seq.pos`` orders
rows inside the slice.  Operators that must rank rows in arrival order rank
inside one slice and add per-slice offsets, so no task ever sorts a whole key.

``ts`` is an instant; ``ts_offset`` has the minutes from UTC the line was written
with, and is null for times that name no offset.  Times are compared as instants
and shown on the event's own clock.
"""

from __future__ import annotations

from pyspark.sql import types as T

SEQ = T.StructType([
    T.StructField("part", T.StringType()),
    T.StructField("pos", T.LongType()),
])
LINES = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("seq", SEQ),
])
ENTRY_COLUMNS = (
    "ip", "ts", "ts_offset", "ts_hour", "method", "path", "protocol", "status_code", "bytes_sent",
    "referrer", "user_agent", "raw", "source", "extra",
)
THREAT_COLUMNS = (
    "threat_type", "severity", "source_ip", "ts", "ts_offset", "description", "target", "payload",
    "confidence", "details", "raw_log", "detection_method", "user_agent", "det",
)
REPLY = T.StructType([
    T.StructField("is_threat", T.BooleanType()),
    T.StructField("threat_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])
XML_EVENT = T.StructType([
    T.StructField("System", T.StructType([
        T.StructField("Provider", T.StructType([T.StructField("_Name", T.StringType())])),
        T.StructField("EventID", T.StringType()),
        T.StructField("Level", T.StringType()),
        T.StructField("TimeCreated", T.StructType([T.StructField("_SystemTime", T.StringType())])),
        T.StructField("Channel", T.StringType()),
        T.StructField("Computer", T.StringType()),
        T.StructField("Security", T.StructType([T.StructField("_UserID", T.StringType())])),
    ])),
    T.StructField("EventData", T.StructType([
        T.StructField("Data", T.ArrayType(T.StructType([
            T.StructField("_Name", T.StringType()),
            T.StructField("_VALUE", T.StringType()),
        ]))),
    ])),
])
NODES = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),   # -1 marks a leaf
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
])
