"""The engine's queries over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import aggregates, brokers, routing, rows, stats, tracking
from ..sinks.messages import KAFKA_BYTES, SQS_BYTES, guarded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The driver's events span January 2024; "now" is fixed so that results are.
NOW = "TIMESTAMP '2024-01-30 12:30:00'"
SPARK_NOW = "TIMESTAMP_NTZ '2024-01-30 12:30:00'"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- words


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def word_count(spark, sf_dir):
    return aggregates.counts(rows.split_words(table(spark, sf_dir, "documents"), "text"), "word")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY word")
def word_count_union(spark, sf_dir):
    both = rows.fan_in(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "conversations").select("text"))
    return aggregates.counts(rows.split_words(both, "text"), "word")


@query("SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY lang, word")
def doc_word_map_explode(spark, sf_dir):
    """A map of counts per document, built within the row, exploded and summed by language."""
    words = F.array_sort(F.filter(fn.tokens(F.col("text")), lambda w: w.isNotNull()))

    def ends(w):
        """Of sorted words the place of the last of each run of equal ones; it is so far from the run before as the run is long."""
        return F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.coalesce(F.get(w, i) != F.get(w, i - 1), F.lit(True)))

    def entries(w, last):
        return F.map_from_entries(F.transform(last, lambda i, k: F.struct(F.get(w, i - 1).alias("word"), (i - F.coalesce(F.get(last, k - 1), F.lit(0))).alias("n"))))

    docs = table(spark, sf_dir, "documents").where("text is not null").select("lang", words.alias("w"))
    return rows.explode_map(docs.select("lang", fn.let(F.col("w"), lambda w: fn.let(ends(w), lambda last: entries(w, last))).alias("m")), "m", "word", "n").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# ---- upserts


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark, sf_dir):
    return aggregates.last_by_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def _upsert(spark, sf_dir):
    target = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    incoming = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return target, incoming


@query("SELECT c_custkey, max(o_orderkey) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY c_custkey")
def upsert_update_set(spark, sf_dir):
    target, incoming = _upsert(spark, sf_dir)
    return incoming.join(target, "c_custkey", "left_semi")


@query("SELECT o_custkey AS c_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey")
def upsert_insert_set(spark, sf_dir):
    target, incoming = _upsert(spark, sf_dir)
    return incoming.join(target, "c_custkey", "left_anti")


@query("SELECT c_custkey, b_c_name, b_c_nationkey FROM (SELECT c_custkey, c_name AS b_c_name, c_nationkey AS b_c_nationkey FROM customer)")
def bind_aliases(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").withColumnsRenamed({c: f"b_{c}" for c in ("c_name", "c_nationkey")})


@query("SELECT user_id, event_type AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def map_merge_last_wins(spark, sf_dir):
    """One map of event types per user, the latest event winning; exploded again to compare."""
    events = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null").select("user_id", "event_type", "event_id", F.col("event_id").cast("string").alias("id"))
    merged = aggregates.merged_map(events, "event_type", "id", "event_id", "user_id")
    return rows.explode_map(merged, "entries", "key", "value").select("user_id", "key", "value")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'right' ELSE 'left' END AS a, CASE WHEN event_id % 3 = 1 THEN NULL ELSE 'kept' END AS b FROM events""")
def map_merge_expression(spark, sf_dir):
    """Two maps of a row, the second winning; the second lacks a key, or is null."""
    one = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.when(F.col("event_id") % 3 != 1, "kept"))
    two = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("right")))
    merged = fn.merged_entries(one, two)
    return table(spark, sf_dir, "events").select("event_id", merged["a"].alias("a"), merged["b"].alias("b"))


@query("SELECT event_id, event_type || '!' AS content, CAST(user_id AS VARCHAR) AS key FROM events")
def derived_rows(spark, sf_dir):
    """Spin-offs keep what they come from; content and key are new."""
    events = table(spark, sf_dir, "events").select("event_id", F.lit("old").alias("content"), "event_type", "user_id")
    return rows.derive(events, F.concat("event_type", F.lit("!")), F.col("user_id").cast("string")).select("event_id", "content", "key")


# ---- message trees: an order is a root, its lines are spin-offs; a shipped line (F) is acknowledged, a returned one (R) failed

ACK = "((l_orderkey * 7 + l_linenumber) * 2654435761) % 9007199254740881"


def _control(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    base = lines.select(
        F.col("l_orderkey").alias("root_id"), F.lit("orders").alias("producer"), F.expr(ACK).alias("ack_lo"), F.lit(0).cast("bigint").alias("ack_hi"), F.col("l_linenumber").cast("bigint").alias("seq"),
        F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("destination"), "l_returnflag", "l_linestatus",
    )
    new = base.withColumn("is_fail", F.lit(False))
    ack = base.where("l_linestatus = 'F'").withColumn("is_fail", F.lit(False)).withColumn("destination", F.lit(None).cast("bigint"))
    fail = base.where("l_returnflag = 'R'").withColumn("is_fail", F.lit(True)).withColumn("destination", F.lit(None).cast("bigint"))
    return new.unionByName(ack).unionByName(fail)


STATUS_SQL = f"""
    SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed'
      WHEN bit_xor(CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST({ACK} AS BIGINT) END) = 0 THEN 'success' ELSE 'waiting' END AS status,
      bit_xor(CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST({ACK} AS BIGINT) END) AS xor_lo FROM lineitem GROUP BY l_orderkey"""


@query(STATUS_SQL)
def ack_tree_status(spark, sf_dir):
    return tracking.folded(_control(spark, sf_dir)).select(F.col("root_id").alias("l_orderkey"), "status", "xor_lo")


@query(f"SELECT status, count(*) AS n FROM ({STATUS_SQL}) GROUP BY status")
def tree_outcome_counts(spark, sf_dir):
    return aggregates.counts(tracking.folded(_control(spark, sf_dir)), "status")


@query(
    f"""SELECT t.l_orderkey, CASE WHEN status = 'waiting' AND TIMESTAMP '2000-01-01' - started > INTERVAL 400 DAYS THEN 'timeout' ELSE status END AS status
    FROM ({STATUS_SQL}) t JOIN (SELECT l_orderkey, min(l_shipdate) AS started FROM lineitem GROUP BY l_orderkey) s ON t.l_orderkey = s.l_orderkey"""
)
def tree_timeouts(spark, sf_dir):
    trees = tracking.with_timeouts(tracking.folded(_control(spark, sf_dir)), F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), "INTERVAL 400 DAYS")
    return trees.select(F.col("root_id").alias("l_orderkey"), "status")


@query("SELECT s_suppkey AS process, count(l_orderkey) AS waiting FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_linestatus = 'O') ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def waiting_by_destination(spark, sf_dir):
    open_ = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("destination"), F.lit("waiting").alias("status"))
    return stats.waiting(open_, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("process")))


# ---- statistics: an event is a progress event of its type, value its duration

ELIGIBLE_SQL = "event_type <> 'view'"
FREQ_SQL = f"SELECT event_type, round_even(value, 0) AS observation, count(*) AS frequency FROM events WHERE {ELIGIBLE_SQL} GROUP BY ALL"


def _progress(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnRenamed("value", "duration_s")


@query(FREQ_SQL)
def duration_frequency(spark, sf_dir):
    return stats.frequencies(_progress(spark, sf_dir), "event_type", ELIGIBLE_SQL)


@query(
    f"""WITH f AS ({FREQ_SQL}), r AS (SELECT *, coalesce(sum(frequency) OVER (PARTITION BY event_type ORDER BY observation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(frequency) OVER (PARTITION BY event_type) AS total FROM f)
    SELECT event_type, coalesce(min(CASE WHEN 1 + below >= total * 0.95 THEN observation END), max(observation)) AS percentile FROM r GROUP BY event_type"""
)
def p95_rank_rule(spark, sf_dir):
    return stats.rank_percentile(stats.frequencies(_progress(spark, sf_dir), "event_type", ELIGIBLE_SQL), "event_type")


@query(
    f"""SELECT user_id, round(sum(value), 6) AS time_taken_s, count(*) FILTER ({ELIGIBLE_SQL}) AS total_frequency,
    round(CASE WHEN count(*) FILTER ({ELIGIBLE_SQL}) > 0 THEN sum(value) / count(*) FILTER ({ELIGIBLE_SQL}) END, 6) AS avg_time_taken_s FROM events GROUP BY user_id"""
)
def avg_time_mixed_population(spark, sf_dir):
    out = stats.averages(_progress(spark, sf_dir), "user_id", ELIGIBLE_SQL)
    return out.withColumns({c: F.round(c, 6) for c in ("time_taken_s", "avg_time_taken_s")})


@query(
    f"""SELECT user_id, CAST(minute(ts) AS INTEGER) AS minute, count(*) FILTER (event_type = 'error') AS error_count, count(*) FILTER (event_type <> 'error') AS success_count
    FROM events WHERE ts <= {NOW} AND ts > {NOW} - INTERVAL 59 MINUTES GROUP BY ALL"""
)
def minute_histogram(spark, sf_dir):
    return stats.minute_histogram(table(spark, sf_dir, "events"), "user_id", "ts", F.expr(SPARK_NOW), error_count="event_type = 'error'", success_count="event_type <> 'error'")


@query(
    """SELECT user_id, waiting, recent, CASE WHEN waiting = 0 THEN 'available' WHEN waiting > recent THEN 'overloaded' ELSE 'busy' END AS state FROM (
    SELECT user_id, count(*) FILTER (event_type = 'error') AS waiting, count(*) FILTER (event_type = 'view') AS recent FROM events GROUP BY user_id)"""
)
def state_classification(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("waiting"), F.count_if(F.col("event_type") == "view").alias("recent"))
    return n.withColumn("state", fn.state(F.col("waiting"), F.col("recent")))


PROCESS_SQL = """SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS name, count(*) FILTER (value > 100) AS waiting, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS time_taken_s,
    count(*) FILTER (value <= 100) AS total_frequency FROM events GROUP BY ALL"""


@query(
    f"""SELECT split_part(name, '-', 1) AS "group", CAST(sum(waiting) AS BIGINT) AS waiting, CAST(sum(time_taken_s) AS BIGINT) AS time_taken_s, CAST(sum(total_frequency) AS BIGINT) AS total_frequency, count(*) AS processes,
    sum(time_taken_s) / greatest(sum(total_frequency), 1) / count(*) AS avg_time_taken_s FROM ({PROCESS_SQL}) GROUP BY ALL"""
)
def group_rollup(spark, sf_dir):
    name = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    processes = table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(
        F.count_if(F.col("value") > 100).alias("waiting"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("time_taken_s"), F.count_if(F.col("value") <= 100).alias("total_frequency")
    )
    return stats.rollup(processes, "name")


@query(
    """SELECT user_id, event_id, ts, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r <= 20"""
)
def recent_failures_top20(spark, sf_dir):
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return stats.recent(failures, "user_id", [F.desc("ts"), F.desc("event_id")])


@query(
    """SELECT event_type, CAST(minute(ts) AS INTEGER) AS minute, count(*) AS n, count(*) * 100.0::DOUBLE / max(count(*)) OVER (PARTITION BY event_type) AS percent FROM events GROUP BY event_type, minute(ts)"""
)
def histogram_percent_of_max(spark, sf_dir):
    bars = table(spark, sf_dir, "events").groupBy("event_type", F.minute("ts").alias("minute")).agg(F.count("*").alias("n"))
    return stats.percent_of_max(bars, "event_type", "n")


@query("SELECT event_id, round(value * 3, 6) AS seconds_left FROM events")
def seconds_left(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(fn.seconds_left(F.col("value"), F.lit(3)), 6).alias("seconds_left"))


@query("SELECT event_id, i AS back, CAST((minute(ts) - i + 60) % 60 AS INTEGER) AS minute FROM events, range(10) t(i)")
def last_minutes(spark, sf_dir):
    out = table(spark, sf_dir, "events").select("event_id", F.posexplode(fn.last_minutes(F.col("ts"))).alias("back", "minute"))
    return out.withColumn("back", F.col("back").cast("bigint"))


@query("SELECT \"group\", name, n, CAST(row_number() OVER (ORDER BY \"group\", name) AS INTEGER) AS place FROM (SELECT event_type AS \"group\", event_type || '-' || (user_id % 4) AS name, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)")
def display_order(spark, sf_dir):
    """The status page's order, read off the sorted rows (a few processes)."""
    name = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
    processes = aggregates.counts(table(spark, sf_dir, "events").where("user_id is not null").select(name.alias("name")), "name")
    shown = stats.displayed(processes, "name").coalesce(1)
    return shown.withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))


# ---- routing

MD5_LE = "CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT)"


@query(f"SELECT DISTINCT user_id, {MD5_LE} AS position FROM (SELECT user_id, md5(CAST(user_id AS VARCHAR)) AS h FROM events)")
def ring_position(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct().withColumn("position", fn.ring_key(F.col("user_id")))


NODES = {"worker-a": 1, "worker-b": 1, "worker-c": 2}


def _ring_sql() -> str:
    points = ", ".join(f"({p}, '{n}')" for p, n in routing.ring(NODES))
    return f"""WITH ring(point, node) AS (VALUES {points}), k AS (SELECT DISTINCT user_id, {MD5_LE} AS position FROM (SELECT user_id, md5(CAST(user_id AS VARCHAR)) AS h FROM events))
    SELECT user_id, coalesce((SELECT arg_min(node, point) FROM ring WHERE point > position), (SELECT arg_min(node, point) FROM ring)) AS node FROM k"""


@query(_ring_sql())
def ring_route(spark, sf_dir):
    return routing.ring_routed(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id", NODES)


@query("SELECT r_regionkey, r_name, i AS replica FROM region, range(3) t(i)")
def broadcast_replicas(spark, sf_dir):
    return routing.routed(table(spark, sf_dir, "region"), routing.Route.ALL, 3)


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def hash_routed_count(spark, sf_dir):
    return aggregates.counts(routing.routed(table(spark, sf_dir, "events"), routing.Route.HASH, 8, "user_id"), "event_type")


@query("SELECT event_id, user_id, CAST(1 AS BIGINT) AS consumers FROM events")
def competing_consumers(spark, sf_dir):
    """Three consumers share a stream: their shares are whole together, and no row is in two of them."""
    shares = routing.competing(table(spark, sf_dir, "events").select("event_id", "user_id"), 3, "event_id")
    named = rows.fan_in(*[s.withColumn("consumer", F.lit(i)) for i, s in enumerate(shares)])
    return named.groupBy("event_id", "user_id").agg(F.count_distinct("consumer").alias("consumers"))


# ---- sources: batches, offsets, throttling, leases


@query("SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS BIGINT) AS batch FROM events")
def batch_assign(spark, sf_dir):
    return brokers.batch_numbers(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 5)


def _records(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), "event_type")


@query("SELECT user_id % 4 AS partition, coalesce(min(CASE WHEN event_type = 'error' THEN event_id END), max(event_id) + 1) AS commit FROM events GROUP BY ALL")
def commit_low_water(spark, sf_dir):
    return brokers.commit_offsets(_records(spark, sf_dir), "partition", "offset", F.col("event_type") != "error")


@query(
    """SELECT policy, user_id % 4 AS partition, coalesce(min(CASE WHEN event_type = 'error' AND policy <> 'skip' OR event_type = 'view' THEN event_id END), max(event_id) + 1) AS commit,
    CASE WHEN policy = 'replay' THEN count(*) FILTER (event_type = 'error') ELSE 0 END AS replayed, count(*) FILTER (event_type NOT IN ('error', 'view') OR event_type = 'error' AND policy = 'skip') AS acknowledged
    FROM events, (VALUES ('skip'), ('replay'), ('redeliver')) p(policy) GROUP BY policy, user_id % 4"""
)
def failure_policies(spark, sf_dir):
    """Errors are failed records, views are open ones: what each policy commits, processes again and acknowledges."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "open").otherwise("success")
    records = _records(spark, sf_dir).withColumn("status", status)

    def by(policy):
        committed = brokers.commit_offsets(records, "partition", "offset", brokers.settled(F.col("status"), policy))
        replayed = brokers.again(records, "status", policy).groupBy("partition").agg(F.sum("attempt").alias("replayed"))
        acknowledged = brokers.acknowledged(records, "status", policy).groupBy("partition").agg(F.count("*").alias("acknowledged"))
        out = committed.join(replayed, "partition", "left").join(acknowledged, "partition", "left").na.fill(0, ["replayed", "acknowledged"])
        return out.withColumn("policy", F.lit(policy.value))

    return rows.fan_in(*map(by, brokers.OnFailure))


@query(f"SELECT user_id AS process, CAST(epoch(max(ts)) // 1 AS BIGINT) AS last_seen FROM events GROUP BY user_id HAVING CAST(epoch(max(ts)) // 1 AS BIGINT) < CAST(epoch({NOW}) // 1 AS BIGINT) - 86400")
def evicted_processes(spark, sf_dir):
    """Users whose last event, rounded to a second, is more than a day before now."""

    def rounded(ts):
        """A zoneless time as UTC, rounded half to even: the SQL casts epoch's double, whose fraction DuckDB's // keeps, while heartbeats cut it."""
        clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
        micros = F.unix_date(ts.cast("date")) * F.lit(86_400_000_000) + (clock * 1_000_000).cast("bigint")
        return F.timestamp_seconds(F.rint(micros / 1e6).cast("bigint"))

    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("process"), rounded(F.col("ts")).alias("ts"))
    return brokers.evicted(beats, rounded(F.expr(SPARK_NOW)), 86_400)


@query(
    """SELECT partition, uncompleted, uncompleted > 500 OR sum(uncompleted) OVER () > 10000 AS blocked
    FROM (SELECT user_id % 4 AS partition, count(*) FILTER (event_type = 'error') AS uncompleted FROM events GROUP BY ALL)"""
)
def blocked_partitions(spark, sf_dir):
    return brokers.blocked(brokers.uncompleted(_records(spark, sf_dir), "partition", F.col("event_type") != "error"), 500)


@query("SELECT id, user_id AS partition, event_id AS \"offset\" FROM (SELECT user_id, event_id, user_id || '-' || event_id AS id FROM events)")
def message_id_roundtrip(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(fn.message_id(F.col("user_id"), F.col("event_id")).alias("id"))
    return ids.withColumn("p", fn.parsed_message_id(F.col("id"))).select("id", "p.partition", "p.offset")


@query(
    """WITH o AS (SELECT s_nationkey AS worker, count(DISTINCT s_suppkey) AS owned FROM supplier GROUP BY ALL), a AS (SELECT sum(owned) // count(*) AS optimum FROM o)
    SELECT m.worker, m.owned, CAST(any_value(optimum) AS BIGINT) AS optimum, CAST(coalesce(sum(t.owned) FILTER (t.worker <> m.worker AND (t.owned > optimum OR m.owned = 0 AND t.owned > 1) AND m.owned < optimum), 0) AS BIGINT) AS claimable
    FROM o m, o t, a GROUP BY m.worker, m.owned"""
)
def lease_balance(spark, sf_dir):
    return brokers.shard_balance(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shard"), F.col("s_nationkey").alias("worker")), "shard", "worker")


@query("SELECT json_extract_string(props, '$.k') AS key, count(*) AS n FROM events GROUP BY ALL")
def json_group_key(spark, sf_dir):
    return aggregates.counts(table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("key")), "key")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def structural_filter(spark, sf_dir):
    events = rows.having_field(table(spark, sf_dir, "events"), "props", "$.k")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, 'malformed JSON' AS error FROM events WHERE event_id % 7 = 0 AND props IS NOT NULL")
def dead_letters(spark, sf_dir):
    from ..schema import decode

    broken = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    _, bad = decode(table(spark, sf_dir, "events").select("event_id", broken.alias("body")), "body", "k bigint")
    return bad.select("event_id", "error")


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS value, CASE WHEN event_id % 11 = 0 THEN 'not a number' END AS error FROM events"""
)
def error_capture(spark, sf_dir):
    """Rows with a value, and the dead letters with their error: both sides, every row in one of them."""
    body = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("user_id").cast("string"))
    good, bad = rows.captured(table(spark, sf_dir, "events").select("event_id", body.alias("body")), F.col("body").try_cast("bigint"), "not a number", "body")
    return rows.fan_in(good.select("event_id", "value"), bad.select("event_id", "error"))


# ---- scalar functions


@query(
    """SELECT 'documents' AS source, doc_id AS id, octet_length(encode(text)) AS n_bytes, octet_length(encode(text)) > 16384 AS oversize FROM documents
    UNION ALL SELECT 'pages', page_id, octet_length(encode(html)), octet_length(encode(html)) > 16384 FROM pages"""
)
def oversize_messages(spark, sf_dir):
    one = lambda name, key, text: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.col(text).alias("body"))
    good, bad = guarded(rows.fan_in(one("documents", "doc_id", "text"), one("pages", "page_id", "html")), "body", 16384)
    both = rows.fan_in(good.withColumn("oversize", F.lit(False)), bad.drop("error").withColumn("oversize", F.lit(True)))
    return both.select("source", "id", fn.n_bytes(F.col("body")).alias("n_bytes"), "oversize")


@query("SELECT doc_id, octet_length(encode(text)) <= 262144 AS queue_fits, octet_length(encode(text)) <= 1048576 AS topic_fits FROM documents")
def message_limits(spark, sf_dir):
    """The guards of both services."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fits = lambda limit, out: rows.fan_in(*[side.select("doc_id", F.lit(k == 0).alias(out)) for k, side in enumerate(guarded(docs, "text", limit))])
    return fits(SQS_BYTES, "queue_fits").join(fits(KAFKA_BYTES, "topic_fits"), "doc_id")


@query(
    """SELECT event_id, CASE WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' WHEN m > 0 THEN m || 'm ' || s || 's' WHEN s > 0 THEN s || 's' ELSE '500ms' END AS text FROM (
    SELECT event_id, event_id % 2 * 8064 + event_id % 3 * 672 + event_id % 5 * 168 + event_id % 7 * 24 + event_id % 4 AS h, event_id % 6 AS m, event_id % 8 AS s FROM events)"""
)
def duration_texts(spark, sf_dir):
    """Years, months, weeks, days, hours, minutes and seconds; half a second where the seconds are none."""
    e = F.col("event_id")
    parts = F.concat(*[F.concat((e % n).cast("string"), F.lit(u)) for n, u in ((2, "Y"), (3, "M"), (5, "W"), (7, "D"))], F.lit("T"), *[F.concat((e % n).cast("string"), F.lit(u)) for n, u in ((4, "H"), (6, "M"))])
    iso = F.concat(F.lit("P"), parts, F.when(e % 8 == 0, "0.5").otherwise((e % 8).cast("string")), F.lit("S"))
    return table(spark, sf_dir, "events").select("event_id", fn.duration_text(iso).alias("text"))


@query("SELECT event_id, 'PT' || (event_id // 60) || 'M' || (event_id % 60) || 'S' AS iso, CAST(event_id AS DOUBLE) AS seconds FROM events")
def iso_duration_parse(spark, sf_dir):
    iso = F.format_string("PT%dM%dS", F.floor(F.col("event_id") / 60), F.col("event_id") % 60)
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso")).withColumn("seconds", fn.duration_seconds(F.col("iso")))


@query("SELECT event_id, round(value, 2) AS seconds FROM events")
def iso_duration_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(fn.duration_seconds(fn.duration_iso(F.col("value"))), 2).alias("seconds"))


@query(
    """SELECT event_id, CASE WHEN s = 0 THEN '0s' ELSE trim(concat_ws(' ', CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h' END, CASE WHEN (s // 60) % 60 > 0 THEN ((s // 60) % 60) || 'm' END,
    CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END)) END AS clock FROM (SELECT event_id, event_id * 37 AS s FROM events)"""
)
def clock_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.clock(F.col("event_id") * 37).alias("clock"))


@query("SELECT DISTINCT upper(event_type[1]) || substr(event_type, 2) || 'Intersection' AS name, 'intersection' AS node_type FROM events")
def node_types(spark, sf_dir):
    name = F.concat(F.initcap("event_type"), F.lit("Intersection")).alias("name")
    return table(spark, sf_dir, "events").select(name).distinct().withColumn("node_type", fn.node_type(F.col("name")))


@query("SELECT event_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def null_filter(spark, sf_dir):
    return rows.without_nulls(table(spark, sf_dir, "events"), "user_id", "event_type").select("event_id", "event_type")


@query("SELECT page_id, url AS address FROM pages")
def project_drop(spark, sf_dir):
    return table(spark, sf_dir, "pages").drop("html").withColumnRenamed("url", "address")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM orders")
def encoded_types(spark, sf_dir):
    from ..schema import iso_timestamp, lossy_float

    return table(spark, sf_dir, "orders").select("o_orderkey", lossy_float(F.col("o_totalprice").cast("decimal(12,2)")).alias("price"), iso_timestamp(F.col("o_orderdate")).alias("iso"))


# ---- joins against registries


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def registry_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return suppliers.join(names, "n_nationkey").select("s_suppkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def registry_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def registry_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return rows.difference(table(spark, sf_dir, "nation").select("n_nationkey"), gone, "n_nationkey")


@query("SELECT e.event_id, coalesce(n_name, 'unknown') AS destination FROM events e LEFT JOIN nation ON n_nationkey = e.user_id")
def destination_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id"), "n_name")
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(names, "user_id", "left").select("event_id", F.coalesce("n_name", F.lit("unknown")).alias("destination"))


@query(
    """SELECT s_suppkey AS shard_id, s_nationkey AS worker_id FROM supplier WHERE s_suppkey % 3 = 0"""
)
def stale_leases(spark, sf_dir):
    """Every third supplier's heartbeat stood still between the snapshots."""
    shards = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shard_id"), F.col("s_nationkey").alias("worker_id"))
    before, after = shards.withColumn("heartbeat", F.lit(1)), shards.withColumn("heartbeat", F.when(F.col("shard_id") % 3 == 0, 1).otherwise(2))
    return brokers.stale_leases(before, after).select("shard_id", "worker_id")


# ---- event time


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_hours(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    out = table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session"""
)
def sessions(spark, sf_dir):
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    out = table(spark, sf_dir, "events").groupBy("user_id", w).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")
