"""Fixed table schemas and the permissive step that brings any frame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(columns: str) -> T.StructType:
    kinds = {"f": T.DoubleType(), "s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split(":") for c in columns.split())])


PROVENANCE = " source_file:s source_line:l"
CONNECTIONS = _table("ts:f uid:s src_ip:s src_port:i dst_ip:s dst_port:i proto:s service:s duration:f orig_bytes:l resp_bytes:l orig_pkts:l resp_pkts:l conn_state:s" + PROVENANCE)
DNS = _table("ts:f uid:s src_ip:s dst_ip:s query:s qtype:s rcode:s answers:s" + PROVENANCE)
SSL = _table("ts:f uid:s src_ip:s src_port:i dst_ip:s dst_port:i version:s cipher:s server_name:s ja3:s ja3s:s established:b" + PROVENANCE)
PROCESSES = _table("ts:f host:s user:s image:s command_line:s current_directory:s integrity_level:s process_guid:s process_id:i parent_image:s parent_command_line:s parent_guid:s parent_process_id:i sha256:s" + PROVENANCE)
ALERTS = _table("ts:f src_ip:s dst_ip:s dst_port:i proto:s signature:s signature_id:l category:s severity:i" + PROVENANCE)

#: What every detector gives out. ``components`` are the measured parts of the score; an unmeasured part is NULL.
FINDING_COLUMNS = ["predicate", "subject_type", "subject", "object_type", "object", "score", "severity", "detector", "first_seen", "last_seen", "components", "evidence"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order; values that don't convert and columns that are absent become typed NULLs."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_event_time(df: DataFrame) -> DataFrame:
    """``event_time`` beside the epoch seconds, for watermarks and windows."""
    return df.withColumn("event_time", F.timestamp_micros(F.bround(F.col("ts") * 1_000_000).cast("long")))
