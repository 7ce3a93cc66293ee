"""Row types of messages, progress events and leases, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "root_id string, producer string, ack_hi bigint, ack_lo bigint, key string, content string"
CONTROL = (
    "seq bigint, ts timestamp, root_id string, producer string, ack_hi bigint, ack_lo bigint, is_fail boolean, msg_type string, process_name string, "
    "sender string, duration_s double, destination string, error_message string, message_content string"
)
LEASE = "snapshot int, shard_id string, checkpoint decimal(38,0), worker_id string, heartbeat bigint"
# The fields of the billing service.
INVOICE = (
    "uuid string, invoice_number string, vat_number string, total_in_cents bigint, tax_in_cents bigint, subtotal_in_cents bigint, state string, "
    "collection_method string, currency string, account string, created_at string, updated_at string, closed_at string"
)
ACCOUNT = "company_name string, account_code string"


def encode(content: Column) -> Column:
    """JSON of a struct or map; timestamps as ISO strings, decimals exact."""
    return F.to_json(content, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"})


def decode(df: DataFrame, column: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows whose JSON parses, with ``content``; the others as dead letters with ``error``). A null is neither."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = df.withColumn("content", F.from_json(column, kind.add("_corrupt", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("content._corrupt").isNotNull()
    good = marked.where(F.col(column).isNotNull() & ~bad).withColumn("content", F.col("content").dropFields("_corrupt"))
    return good, marked.where(bad).drop("content").withColumn("error", F.lit("malformed JSON"))


def lossy_float(column: Column) -> Column:
    """A decimal as the double that a JSON number would carry."""
    return column.cast("double")


def iso_timestamp(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
