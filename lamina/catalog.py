"""Registered queries of the versioned engine and their SQL oracles, over two views of the driver's tables.

KE: ``events`` as versions of user keys. KL: ``lineitem`` as versions of (order, line) keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import jobs
from lamina.functions import bloom
from lamina.functions import keys as K
from lamina.operators import batch, merge, runs_meta
from lamina.plans.table import VersionedTable
from lamina.schema import DELETE, PUT, SCHEMA, is_tombstone
from lamina.scratch import materialize, scratch_path
from lamina.sources import binary
from lamina.streaming.ingest import ingest
from lamina.streaming.latest import start_upserts

Query = Callable[[SparkSession, str], DataFrame]
AS_OF, UPPER = 6666, "u000100"
ROW = ["key", "ts", "kind", "value", "src", "seq"]


def events_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("event_id").alias("ts"),
        F.when(gone, 2).otherwise(1).alias("kind"),
        F.when(gone, F.lit(None)).otherwise(F.concat("event_type", F.lit(":"), "props")).alias("value"),
        (F.col("event_id") % 3).cast("int").alias("src"),
        F.col("event_id").alias("seq"),
    )


def lineitem_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    gone = F.col("l_returnflag") == "R"
    return li.select(
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("#"), F.col("l_linenumber").cast("string")).alias("key"),
        F.datediff(F.col("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("ts"),
        F.when(gone, 2).otherwise(1).alias("kind"),
        F.when(gone, F.lit(None)).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("value"),
        (F.col("l_suppkey") % 4).cast("int").alias("src"),
        F.col("l_partkey").alias("seq"),
    )


KE = """SELECT 'u' || lpad(cast(user_id AS varchar), 6, '0') AS key, event_id AS ts,
  cast(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS int) AS kind,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type || ':' || props END AS value,
  cast(event_id % 3 AS int) AS src, event_id AS seq FROM events"""
KL = """SELECT lpad(cast(l_orderkey AS varchar), 10, '0') || '#' || cast(l_linenumber AS varchar) AS key,
  cast(date_diff('day', date '1970-01-01', cast(l_shipdate AS date)) AS bigint) AS ts,
  cast(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS int) AS kind,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag || l_linestatus END AS value,
  cast(l_suppkey % 4 AS int) AS src, l_partkey AS seq FROM lineitem"""
WITH = f"WITH ke AS ({KE}), kl AS ({KL})"
NEWEST = "row_number() OVER (PARTITION BY key ORDER BY ts DESC, src, seq DESC)"
PICK = "key, ts, kind, value, src, seq"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"{WITH} {sql}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def _newest_sql(view: str, where: str = "TRUE", outer: str = "TRUE") -> str:
    return f"SELECT {PICK} FROM (SELECT *, {NEWEST} AS rn FROM {view} WHERE {where}) WHERE rn = 1 AND {outer}"


@query(_newest_sql("ke", f"ts <= {AS_OF} AND key <= '{UPPER}'", "kind <> 2"))
def snapshot_asof_live(spark, sf_dir):
    return merge.live(merge.snapshot(events_kv(spark, sf_dir), AS_OF, UPPER)).select(*ROW)


@query(_newest_sql("ke", f"ts <= {AS_OF}"))
def snapshot_asof_raw(spark, sf_dir):
    return merge.snapshot(events_kv(spark, sf_dir), AS_OF).select(*ROW)


@query(_newest_sql("kl", "ts <= 9500 AND key <= '0000005000#9'"))
def snapshot_bounded_key(spark, sf_dir):
    return merge.snapshot(lineitem_kv(spark, sf_dir), 9500, "0000005000#9").select(*ROW)


@query(_newest_sql("kl"))
def merge_latest(spark, sf_dir):
    return merge.latest(lineitem_kv(spark, sf_dir)).select(*ROW)


@query(_newest_sql("kl", outer="kind <> 2"))
def merge_latest_live(spark, sf_dir):
    return merge.live(merge.latest(lineitem_kv(spark, sf_dir))).select(*ROW)


@query(_newest_sql("kl", outer="kind <> 2"))
def compact(spark, sf_dir):
    return merge.compact(lineitem_kv(spark, sf_dir)).select(*ROW)


@query(f"SELECT {PICK}, {NEWEST} AS version_rank FROM kl")
def merge_history(spark, sf_dir):
    return merge.history(lineitem_kv(spark, sf_dir)).select(*ROW, "version_rank")


@query("SELECT key, ts, value FROM ke WHERE key = 'u000007' AND ts = (SELECT min(ts) FROM ke WHERE key = 'u000007' AND kind <> 2) AND kind <> 2")
def point_get_exact(spark, sf_dir):
    kv = events_kv(spark, sf_dir)
    ts = kv.where((F.col("key") == "u000007") & (F.col("kind") != DELETE)).agg(F.min("ts")).first()[0]
    if ts is None:
        return kv.limit(0).select("key", "ts", "value")
    wanted = K.KeyRange(K.Key("u000007", ts), K.Key("u000007", ts))
    return kv.where(wanted.contains() & ~is_tombstone()).select("key", "ts", "value")


@query(_newest_sql("ke", f"key = 'u000007' AND ts <= {AS_OF}"))
def point_get_asof(spark, sf_dir):
    kv = events_kv(spark, sf_dir).where(F.col("key") == "u000007")
    return merge.snapshot(kv, AS_OF).select(*ROW)


PROBES = "SELECT cast(o_orderkey AS bigint) AS probe_id, lpad(cast(o_orderkey AS varchar), 10, '0') || '#1' AS key, cast(date_diff('day', date '1970-01-01', cast(o_orderdate AS date)) + 60 AS bigint) AS probe_ts FROM orders"


@query(
    f"""SELECT probe_id, key, probe_ts, ts, kind, value FROM (SELECT p.probe_id, p.key, p.probe_ts, v.ts, v.kind, v.value,
    row_number() OVER (PARTITION BY p.probe_id ORDER BY v.ts DESC NULLS LAST, v.src, v.seq DESC) AS rn
    FROM ({PROBES}) p LEFT JOIN kl v ON v.key = p.key AND v.ts <= p.probe_ts) WHERE rn = 1"""
)
def multi_get_asof(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")) + 60
    probes = o.select(F.col("o_orderkey").alias("probe_id"), F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("#1")).alias("key"), day.cast("long").alias("probe_ts"))
    return merge.multi_get(probes, lineitem_kv(spark, sf_dir))


def _range_sql(condition: str) -> str:
    return f"SELECT {PICK} FROM ke WHERE {condition}"


@query(_range_sql("key >= 'u000003' AND (key > 'u000003' OR ts >= 500) AND key <= 'u000009' AND (key < 'u000009' OR ts <= 5000)"))
def range_scan_versions(spark, sf_dir):
    wanted = K.KeyRange(K.Key("u000003", 500), K.Key("u000009", 5000))
    return merge.ordered(events_kv(spark, sf_dir).where(wanted.contains())).select(*ROW)


@query(_range_sql("key <= 'u000004' AND (key < 'u000004' OR ts <= 3000)"))
def range_scan_open_start(spark, sf_dir):
    return merge.ordered(events_kv(spark, sf_dir).where(K.KeyRange(None, K.Key("u000004", 3000)).contains())).select(*ROW)


@query(_range_sql("key >= 'u000012' AND (key > 'u000012' OR ts >= 100)"))
def range_scan_open_end(spark, sf_dir):
    return merge.ordered(events_kv(spark, sf_dir).where(K.KeyRange(K.Key("u000012", 100), None).contains())).select(*ROW)


@query(
    """SELECT key, ts, kind FROM ke, (SELECT max(ts) AS lo FROM ke WHERE key = 'u000002') a, (SELECT min(ts) AS hi FROM ke WHERE key = 'u000006') b
    WHERE key >= 'u000002' AND (key > 'u000002' OR ts >= lo) AND key <= 'u000006' AND (key < 'u000006' OR ts <= hi)"""
)
def range_scan_boundary_ts(spark, sf_dir):
    kv = events_kv(spark, sf_dir)
    edge = kv.where(F.col("key").isin("u000002", "u000006")).agg(F.max(F.when(F.col("key") == "u000002", F.col("ts"))), F.min(F.when(F.col("key") == "u000006", F.col("ts")))).first()
    wanted = K.KeyRange(K.Key("u000002", edge[0] or 0), K.Key("u000006", edge[1] or 0))
    return kv.where(wanted.contains()).select("key", "ts", "kind")


@query("SELECT key, ts, kind FROM ke WHERE key > 'u000010' OR (key = 'u000010' AND ts <= 4000)")
def seek_lower_bound(spark, sf_dir):
    return merge.ordered(events_kv(spark, sf_dir).where(K.from_key(K.Key("u000010", 4000)))).select("key", "ts", "kind")


@query(f"SELECT {PICK} FROM kl ORDER BY key, ts DESC, src, seq DESC LIMIT 1")
def seek_first(spark, sf_dir):
    return merge.ordered(lineitem_kv(spark, sf_dir)).limit(1).select(*ROW)


@query(
    """SELECT key, ts, (key < 'u000005' OR (key = 'u000005' AND ts <= 5000)) AS at_most, (key = 'u000005' AND ts = 5000) AS same, key = 'u000005' AS same_raw,
    key > 'u000005' AS greater_raw, key < 'u000005' AS lesser_raw, strlen(key) = 0 AS empty_raw, kind = 1 AS is_put, kind = 2 AS is_delete FROM ke"""
)
def key_predicates(spark, sf_dir):
    k, t, other, at = F.col("key"), F.col("ts"), F.lit("u000005"), F.lit(5000)
    return events_kv(spark, sf_dir).select(
        "key", "ts", K.at_most(k, t, other, at).alias("at_most"), ((k == other) & (t == at)).alias("same"), (k == other).alias("same_raw"),
        (k > other).alias("greater_raw"), (k < other).alias("lesser_raw"), (F.octet_length(k) == 0).alias("empty_raw"), (F.col("kind") == 1).alias("is_put"), (F.col("kind") == 2).alias("is_delete"),
    )


@query(
    """SELECT key, ts, CASE WHEN key < 'u000005' THEN -1 WHEN key > 'u000005' THEN 1 WHEN ts > 5000 THEN -1 WHEN ts < 5000 THEN 1 ELSE 0 END AS cmp,
    CASE WHEN value IS NULL OR strlen(value) = 0 THEN TRUE ELSE value <= key END AS value_at_most_key FROM ke"""
)
def key_compare(spark, sf_dir):
    value = F.coalesce("value", F.lit(""))
    return events_kv(spark, sf_dir).select("key", "ts", K.compare(F.col("key"), F.col("ts"), F.lit("u000005"), F.lit(5000)).alias("cmp"), K.empty_first_at_most(value, F.col("key")).alias("value_at_most_key"))


@query("SELECT key, ts, hex(encode(key)) || lpad(hex(ts), 16, '0') AS encoded FROM kl")
def key_encode(spark, sf_dir):
    return lineitem_kv(spark, sf_dir).select("key", "ts", F.hex(K.encode(F.col("key"), F.col("ts"))).alias("encoded"))


@query("SELECT key, ts, key AS decoded_key, ts AS decoded_ts FROM kl")
def key_decode(spark, sf_dir):
    coded = lineitem_kv(spark, sf_dir).withColumn("e", K.encode(F.col("key"), F.col("ts")))
    return coded.select("key", "ts", K.decode_key(F.col("e")).cast("string").alias("decoded_key"), K.decode_ts(F.col("e")).alias("decoded_ts"))


@query("SELECT key || '@' || cast(ts AS varchar) AS label FROM ke")
def key_raw_string(spark, sf_dir):
    return events_kv(spark, sf_dir).select(K.label(F.col("key"), F.col("ts")).alias("label"))


@query(
    """SELECT key, ts, cast(strlen(key) + 8 AS bigint) AS encoded_size, cast(strlen(key) AS bigint) AS raw_size, cast(coalesce(strlen(value), 0) AS bigint) AS value_size,
    coalesce(strlen(value), 0) = 0 AS value_empty, cast(strlen(key) + 8 + coalesce(strlen(value), 0) AS bigint) AS entry_size FROM ke"""
)
def entry_sizes(spark, sf_dir):
    k, v = F.col("key"), F.col("value")
    return events_kv(spark, sf_dir).select("key", "ts", K.encoded_size(k).alias("encoded_size"), F.octet_length(k).cast("long").alias("raw_size"), K.value_size(v).alias("value_size"), (K.value_size(v) == 0).alias("value_empty"), K.entry_size(k, v).alias("entry_size"))


#: Batches for the batch queries: every hundred events make one, in event order.
@query("SELECT cast(ts // 100 AS bigint) AS batch_no, count(*) AS entries, cast(sum(strlen(key) + 8 + coalesce(strlen(value), 0)) AS bigint) AS bytes FROM ke GROUP BY 1")
def batch_size_bytes(spark, sf_dir):
    return batch.size_in_bytes(_batches(spark, sf_dir), "batch_no").select("batch_no", "entries", "bytes")


def _batches(spark, sf_dir):
    return events_kv(spark, sf_dir).withColumn("batch_no", F.floor(F.col("ts") / 100).cast("long"))


_BATCH = "SELECT *, cast(ts // 100 AS bigint) AS batch_no, row_number() OVER (PARTITION BY ts // 100, key ORDER BY seq) AS rn FROM ke"


@query(f"SELECT batch_no, key, kind, value, seq FROM ({_BATCH}) WHERE kind = 2 OR rn = 1")
def batch_first_put_wins(spark, sf_dir):
    return batch.accepted(_batches(spark, sf_dir), by=("batch_no",)).select("batch_no", "key", "kind", "value", "seq")


@query(f"SELECT batch_no, key, kind, value FROM ({_BATCH}) WHERE rn = 1")
def batch_get(spark, sf_dir):
    return batch.first_mutation(_batches(spark, sf_dir), by=("batch_no",)).select("batch_no", "key", "kind", "value")


@query("SELECT DISTINCT key FROM ke WHERE ts > 500 AND key IN (SELECT key FROM ke WHERE ts <= 100)")
def batch_contains(spark, sf_dir):
    kv = events_kv(spark, sf_dir)
    return batch.containing(kv.where("ts > 500").select("key").distinct(), kv.where("ts <= 100"))


@query("SELECT key, cast(777 AS bigint) AS ts, kind, CASE WHEN kind = 2 THEN NULL ELSE value END AS value, seq FROM kl")
def commit_stamp(spark, sf_dir):
    return batch.stamp(lineitem_kv(spark, sf_dir).drop("ts"), 777).select("key", "ts", "kind", "value", "seq")


@query("SELECT key, ts, src, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts, src ORDER BY seq DESC) AS rn FROM (SELECT key, ts // 100 AS ts, src, seq, kind, value FROM kl)) WHERE rn = 1")
def apply_last_wins(spark, sf_dir):
    coarse = lineitem_kv(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / 100).cast("long"))
    return merge.last_wins(coarse).select("key", "ts", "src", "seq", "kind", "value")


@query("SELECT src, count(*) AS entries, cast(sum(strlen(key) + 8 + coalesce(strlen(value), 0)) AS bigint) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY key, ts, src ORDER BY seq DESC) AS rn FROM kl) WHERE rn = 1 GROUP BY src")
def memtable_size(spark, sf_dir):
    return batch.size_in_bytes(merge.last_wins(lineitem_kv(spark, sf_dir)), "src").select("src", "entries", "bytes")


@query(
    f"""WITH RECURSIVE ke AS ({KE}), n AS (SELECT key, ts, src, cast(strlen(key) + 8 + coalesce(strlen(value), 0) AS bigint) AS entry_bytes, row_number() OVER (PARTITION BY src ORDER BY seq, key, ts) AS rn FROM ke),
    f AS (SELECT key, ts, src, entry_bytes, rn, entry_bytes AS held, cast(0 AS bigint) AS flush_no FROM n WHERE rn = 1
      UNION ALL SELECT n.key, n.ts, n.src, n.entry_bytes, n.rn, CASE WHEN f.held + n.entry_bytes > 65536 THEN n.entry_bytes ELSE f.held + n.entry_bytes END, CASE WHEN f.held + n.entry_bytes > 65536 THEN f.flush_no + 1 ELSE f.flush_no END
      FROM f JOIN n ON n.src = f.src AND n.rn = f.rn + 1)
    SELECT key, ts, src, entry_bytes, held, flush_no FROM f"""
)
def memtable_flush_points(spark, sf_dir):
    return batch.fill_levels(events_kv(spark, sf_dir), 65536).select("key", "ts", "src", "entry_bytes", "held", "flush_no")


@query("SELECT max(ts) AS max_ts, count(*) AS entries FROM kl")
def recover_max_ts(spark, sf_dir):
    return lineitem_kv(spark, sf_dir).agg(F.max("ts").alias("max_ts"), F.count("*").alias("entries"))


@query("SELECT src AS run_id, min(key) AS min_key, max(key) AS max_key, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS rows, cast(sum(strlen(key) + 8 + coalesce(strlen(value), 0)) AS bigint) AS bytes FROM kl GROUP BY src")
def run_zone_map(spark, sf_dir):
    return runs_meta.zone_map(lineitem_kv(spark, sf_dir))


_RUNS = "SELECT CASE WHEN src = 3 THEN 100 + cast(substr(key, 8, 1) AS int) ELSE src END AS run_id, key FROM kl"


@query(
    f"""SELECT run_id, range_id FROM (SELECT run_id, min(key) AS lo_key, max(key) AS hi_key FROM ({_RUNS}) GROUP BY run_id) z
    JOIN (VALUES (1, '', '0000000100#9'), (2, '0000000500#1', '0000000600#1'), (3, '9', '99'), (4, '0000000001#1', '0000000001#1')) r(range_id, lo, hi) ON hi_key >= lo AND lo_key <= hi"""
)
def run_overlap_prune(spark, sf_dir):
    kv = lineitem_kv(spark, sf_dir)
    named = kv.withColumn("run", F.when(F.col("src") == 3, 100 + F.substring("key", 8, 1).cast("int")).otherwise(F.col("src")))
    ranges = spark.createDataFrame([(1, "", "0000000100#9"), (2, "0000000500#1", "0000000600#1"), (3, "9", "99"), (4, "0000000001#1", "0000000001#1")], "range_id int, lo string, hi string")
    return runs_meta.overlap_pairs(runs_meta.zone_map(named, "run"), ranges).select("run_id", "range_id")


@query(
    """SELECT p.run_id, p.key, coalesce((SELECT max(b.block_no) FROM idx b WHERE b.run_id = p.run_id AND b.start_key <= p.key), 0) AS block_no FROM (SELECT DISTINCT src AS run_id, lpad(cast(cast(substr(key, 1, 10) AS bigint) + 1 AS varchar), 10, '0') AS key FROM kl) p"""
)
def block_index_lookup(spark, sf_dir):
    kv = lineitem_kv(spark, sf_dir)
    probes = kv.select(F.col("src").alias("run_id"), F.lpad((F.substring("key", 1, 10).cast("long") + 1).cast("string"), 10, "0").alias("key")).distinct()
    return runs_meta.locate(probes, runs_meta.block_index(kv, 50))


_SQL["block_index_lookup"] = _SQL["block_index_lookup"].replace(
    WITH, WITH + ", d AS (SELECT DISTINCT src AS run_id, key FROM kl), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS n FROM d), idx AS (SELECT run_id, n // 50 AS block_no, key AS start_key FROM n WHERE n % 50 = 0)"
)
_SQL["block_index_lookup"] = _SQL["block_index_lookup"].replace(
    "SELECT p.run_id, p.key, coalesce((SELECT max(b.block_no) FROM idx b WHERE b.run_id = p.run_id AND b.start_key <= p.key), 0) AS block_no FROM (",
    "SELECT p.run_id, p.key, cast(coalesce(b.block_no, 0) AS bigint) AS block_no FROM (",
).replace("FROM kl) p", "FROM kl) p ASOF LEFT JOIN idx b ON b.run_id = p.run_id AND p.key >= b.start_key")


@query(
    """WITH RECURSIVE e AS (SELECT 'u' || lpad(cast(user_id AS varchar), 6, '0') AS key, event_id AS ts, cast(user_id AS bigint) AS run_id,
      7 + 8 + 12 + CASE WHEN event_type = 'error' THEN 0 ELSE strlen(event_type || ':' || props) END AS cost FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key, ts DESC) AS rn FROM e),
    f AS (SELECT run_id, key, ts, cost, rn, cast(0 AS bigint) AS block_no, cost AS used FROM n WHERE rn = 1
      UNION ALL SELECT n.run_id, n.key, n.ts, n.cost, n.rn, CASE WHEN f.used + n.cost + 8 > 512 THEN f.block_no + 1 ELSE f.block_no END, CASE WHEN f.used + n.cost + 8 > 512 THEN n.cost ELSE f.used + n.cost END
      FROM f JOIN n ON n.run_id = f.run_id AND n.rn = f.rn + 1)
    SELECT run_id, key, ts, cast(cost AS bigint) AS cost, block_no FROM f"""
)
def block_packing(spark, sf_dir):
    kv = events_kv(spark, sf_dir).withColumn("run", F.substring("key", 2, 6).cast("long"))
    return runs_meta.pack_blocks(kv, 512, "run")


@query(
    """SELECT n, p, m, cast(CASE WHEN n <= 0 THEN 1 ELSE least(greatest(round(m / greatest(n, 1) * ln(2.0)), 1), 255) END AS int) AS k
    FROM (SELECT *, greatest(cast(ceil(-greatest(n, 1) * ln(p) / (ln(2.0) * ln(2.0))) AS bigint), 1) AS m FROM (SELECT cast(p_partkey AS double) AS n, 1.0 / (p_size + 1.5) AS p FROM part))"""
)
def bloom_sizing(spark, sf_dir):
    sized = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("double").alias("n"), (F.lit(1.0) / (F.col("p_size") + 1.5)).alias("p"))
    return sized.withColumn("m", bloom.bits(F.col("n"), F.col("p"))).withColumn("k", bloom.hashes(F.col("m"), F.col("n")))


_WANTED = ["0000000001#1", "0000000034#2", "0000000999#3", "0000001400#1", "none"]


@query(f"SELECT {PICK} FROM kl WHERE key IN ({', '.join(repr(k) for k in _WANTED)})")
def bloom_prune_no_false_negative(spark, sf_dir):
    path = scratch_path(spark, "bloom-run")
    kv = lineitem_kv(spark, sf_dir)
    sorted_run = kv.repartitionByRange("key").sortWithinPartitions(*K.version_order())
    sorted_run.write.options(**bloom.parquet_options("key", 100_000)).parquet(path)
    return spark.read.schema(kv.schema).parquet(path).where(F.col("key").isin(_WANTED)).select(*ROW)


@query("SELECT key, ts, src, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts, src ORDER BY seq DESC) AS rn FROM kl) WHERE rn = 1")
def wal_replay(spark, sf_dir):
    path = scratch_path(spark, "wal")
    kv = lineitem_kv(spark, sf_dir)
    for part in range(2):  # two appended batches
        kv.where(F.col("seq") % 2 == part).write.mode("append").parquet(path)
    return merge.last_wins(spark.read.schema(kv.schema).parquet(path)).select("key", "ts", "src", "seq", "kind", "value")


@query(_newest_sql("ke"))
def stream_latest(spark, sf_dir):
    logged, path = materialize(events_kv(spark, sf_dir), "stream-log")
    out = scratch_path(spark, "stream-out")
    entries = spark.readStream.schema(logged.schema).parquet(path)
    view = start_upserts(entries, lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out), scratch_path(spark, "stream-state"))
    view.awaitTermination()
    changes = spark.read.parquet(out)
    return merge.latest(changes.select(*ROW))


# The stored table: events committed in four batches, the first two flushed to one run, the third to another, the last in the log.

_BATCHES, _FANOUT = 4, 19  # commits; keys of a user, so that most keys have a few versions
_MUTATIONS = f"""muts AS (SELECT key || '#' || lpad(cast(ts % {_FANOUT} AS varchar), 2, '0') AS key, kind, CASE WHEN kind = 2 THEN NULL ELSE value END AS value, seq, cast(ts % {_BATCHES} + 1 AS bigint) AS ts FROM ke),
  taken AS (SELECT *, row_number() OVER (PARTITION BY ts, key ORDER BY seq) AS nth FROM muts),
  vt AS (SELECT key, ts, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY ts, key ORDER BY seq DESC) AS rn FROM taken WHERE kind = 2 OR nth = 1) WHERE rn = 1),
  logged AS (SELECT key, ts, kind, value, seq FROM taken WHERE kind = 2 OR nth = 1)"""
_VT = f"{WITH}, {_MUTATIONS}"
_BYTES = "cast(sum(strlen(key) + 8 + coalesce(strlen(value), 0)) AS bigint)"
#: Parts of the stored table by version: run 1 has 1 and 2, run 2 has 3, the log has 4.
_RUN_OF = "CASE WHEN ts <= 2 THEN 1 ELSE 2 END"


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = events_kv(spark, sf_dir)
    key = F.concat("key", F.lit("#"), F.lpad((F.col("ts") % _FANOUT).cast("string"), 2, "0"))
    return kv.select(key.cast("binary").alias("key"), F.col("kind").cast("byte"), F.col("value").cast("binary").alias("value"), "seq", (F.col("ts") % _BATCHES + 1).alias("no"))


def _new_table(spark: SparkSession, sf_dir: str, flush_after: tuple[int, ...] = (2, 3)) -> VersionedTable:
    table = VersionedTable(spark, scratch_path(spark, "table"))
    mutations = _mutations(spark, sf_dir)
    for no in range(1, _BATCHES + 1):
        table.commit(mutations.where(F.col("no") == no).drop("no"))
        if no in flush_after:
            table.flush()
    return table


_TABLES: dict[tuple[str, str], VersionedTable] = {}


def stored_table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """One stored table for each application and folder; the reading queries share it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TABLES:
        _TABLES[at] = _new_table(spark, sf_dir)
    return _TABLES[at]


def _text(rows: DataFrame, *more: str) -> DataFrame:
    """Versions with key and value as text, as the SQL has them."""
    return rows.select(F.col("key").cast("string").alias("key"), "ts", F.col("kind").cast("int").alias("kind"), F.col("value").cast("string").alias("value"), *more)


def _vt_sql(where: str = "TRUE", outer: str = "TRUE") -> str:
    return f"{_VT} SELECT key, ts, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS newest FROM vt WHERE {where}) WHERE newest = 1 AND {outer}"


@query(_vt_sql(outer="kind = 1"))
def table_snapshot(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(reader.snapshot())


@query(_vt_sql("ts <= 2", "kind = 1"))
def table_snapshot_asof(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(reader.snapshot(as_of=2))


@query(_vt_sql(f"ts <= 3 AND key <= '{UPPER}'"))
def table_snapshot_bounded_raw(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(reader.snapshot(as_of=3, upper_key=UPPER.encode(), raw=True))


@query(f"{_VT} SELECT key, ts, kind, value FROM vt")
def table_versions(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(reader.versions())


@query(f"{_VT} SELECT key, ts, kind, value FROM vt WHERE key >= 'u000003#04' AND (key > 'u000003#04' OR ts >= 2) AND key <= 'u000009#07' AND (key < 'u000009#07' OR ts <= 3)")
def table_scan(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(reader.scan(K.KeyRange(K.Key(b"u000003#04", 2), K.Key(b"u000009#07", 3))))


@query(f"{_VT} SELECT key, ts, kind, value FROM vt WHERE key > 'u000010#11' OR (key = 'u000010#11' AND ts <= 3)")
def table_seek(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(reader.seek(K.Key(b"u000010#11", 3)))


_ASKED = [(f"u{k:06d}#{k + 4:02d}", ts) for k in (0, 3, 7, 11) for ts in (1, 3)]
_ASKED_SQL = f"asked AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {ts})" for k, ts in _ASKED)}) x(key, asked_ts))"


def _found(spark, rows) -> DataFrame:
    kept = [(k, ts, r["ts"], bytes(r["value"]).decode()) for (k, ts), r in rows if r is not None]
    return spark.createDataFrame(kept, "key string, asked_ts long, ts long, value string")


@query(f"{_VT}, {_ASKED_SQL} SELECT a.key, cast(a.asked_ts AS bigint) AS asked_ts, v.ts, v.value FROM asked a JOIN vt v ON v.key = a.key AND v.ts = a.asked_ts WHERE v.kind = 1")
def table_get(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _found(spark, [((k, ts), reader.get(k.encode(), ts)) for k, ts in _ASKED])


@query(
    f"""{_VT}, {_ASKED_SQL} SELECT key, asked_ts, ts, value FROM (SELECT a.key, cast(a.asked_ts AS bigint) AS asked_ts, v.ts, v.value, v.kind, row_number() OVER (PARTITION BY a.key, a.asked_ts ORDER BY v.ts DESC) AS rn
    FROM asked a JOIN vt v ON v.key = a.key AND v.ts <= a.asked_ts) WHERE rn = 1 AND kind = 1"""
)
def table_get_asof(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _found(spark, [((k, ts), reader.get_asof(k.encode(), ts)) for k, ts in _ASKED])


@query(f"{_VT} SELECT cast({_RUN_OF} AS bigint) AS run_id, hex(encode(min(key))) AS min_key, hex(encode(max(key))) AS max_key, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS rows, {_BYTES} AS bytes FROM vt WHERE ts <= 3 GROUP BY 1")
def table_zones(spark, sf_dir):
    zones = [(r.run_id, r.min_key.upper(), r.max_key.upper(), r.min_ts, r.max_ts, r.rows, r.bytes) for r in stored_table(spark, sf_dir).zones]
    return spark.createDataFrame(zones, "run_id long, min_key string, max_key string, min_ts long, max_ts long, rows long, bytes long")


@query(f"{_VT} SELECT key, ts, kind, value FROM vt WHERE ts <= 2 AND (key > 'u000005#05' OR (key = 'u000005#05' AND ts <= 1))")
def run_seek(spark, sf_dir):
    table = stored_table(spark, sf_dir)
    return _text(table.runs.seek(next(r for r in table.zones if r.run_id == 1), K.Key(b"u000005#05", 1)))


@query(
    f"""{_VT} SELECT x.range_id, count(*) AS runs FROM (SELECT {_RUN_OF} AS run, min(key) AS lo_key, max(key) AS hi_key FROM vt WHERE ts <= 3 GROUP BY 1) z
    JOIN (VALUES (1, 'a', 'b'), (2, 'u000001', 'u000002'), (3, 'u0', 'v'), (4, 'v', 'w')) x(range_id, lo, hi) ON z.hi_key >= x.lo AND z.lo_key <= x.hi GROUP BY 1"""
)
def run_prune(spark, sf_dir):
    table, ranges = stored_table(spark, sf_dir), [(1, b"a", b"b"), (2, b"u000001", b"u000002"), (3, b"u0", b"v"), (4, b"v", b"w")]
    counts = [(n, sum(r.may_overlap(K.KeyRange(K.Key(lo, 0), K.Key(hi, 9))) for r in table.zones)) for n, lo, hi in ranges]
    return spark.createDataFrame([c for c in counts if c[1]], "range_id int, runs long")


@query(_vt_sql(outer="kind = 1"))
def table_compact(spark, sf_dir):
    table = _new_table(spark, sf_dir, flush_after=(1, 3, 4))
    table.compact()
    table.vacuum()
    with table.reader() as reader:
        return _text(reader.versions())


@query(_vt_sql(outer="kind = 1"))
def table_recovered(spark, sf_dir):
    """The snapshot that a second application sees, which reads manifests and replays the log."""
    again = VersionedTable(spark, stored_table(spark, sf_dir).root)
    with again.reader() as reader:
        return _text(reader.snapshot())


@query(f"{_VT} SELECT key, ts, kind, value FROM vt")
def log_replay(spark, sf_dir):
    return _text(_new_table(spark, sf_dir, flush_after=()).log.replay())


@query(f"{_VT} SELECT max(ts) AS max_ts, {_BYTES} AS bytes, cast(max(ts) + 1 AS bigint) AS next_ts FROM vt")
def log_recover(spark, sf_dir):
    table = _new_table(spark, sf_dir, flush_after=())
    _, top, size = table.log.recover()
    return spark.createDataFrame([(top, size, VersionedTable(spark, table.root).next_ts)], "max_ts long, bytes long, next_ts long")


@query(f"{_VT} SELECT cast(count(*) AS bigint) AS entries, {_BYTES} AS bytes FROM vt WHERE ts = 4")
def table_held(spark, sf_dir):
    """What the log holds beyond the runs."""
    table = stored_table(spark, sf_dir)
    with table.reader() as reader:
        pending = reader.versions().where(F.col("src") == -(2**31)).count()
    return spark.createDataFrame([(pending, table.held_bytes())], "entries long, bytes long")


@query(f"{_VT} SELECT key, kind, value FROM (SELECT key, kind, value, row_number() OVER (PARTITION BY key ORDER BY kind DESC, seq) AS rn FROM muts) WHERE rn = 1 AND kind = 1")
def stream_ingest(spark, sf_dir):
    """A stream of mutations committed as one batch: of a key's puts the first stays, any delete in the batch wins over it."""
    logged, path = materialize(_mutations(spark, sf_dir).drop("no").coalesce(1), "mutations")
    table = VersionedTable(spark, scratch_path(spark, "streamed"))
    ingest(spark.readStream.schema(logged.schema).parquet(path), table, scratch_path(spark, "ingest-state")).awaitTermination()
    with table.reader() as reader:
        return _text(reader.snapshot()).drop("ts")


_BINARY = f"{_VT} SELECT key, ts, CASE WHEN coalesce(strlen(value), 0) = 0 THEN 2 ELSE 1 END AS kind, value FROM"


def _folder_of(spark: SparkSession, rows: DataFrame, layout: str) -> str:
    binary.register(spark)
    path = scratch_path(spark, f"binary-{layout}")
    rows.select("key", "ts", "kind", "value").write.format("lamina_files").option("layout", layout).mode("append").save(path)
    return path


@query(f"{_BINARY} vt")
def binary_log_round_trip(spark, sf_dir):
    with stored_table(spark, sf_dir).reader() as reader:
        return _text(binary.read_logs(spark, _folder_of(spark, reader.versions(), "wal")))


def _sorted_files(spark: SparkSession, sf_dir: str) -> str:
    with stored_table(spark, sf_dir).reader() as reader:
        dealt = reader.versions().repartitionByRange(4, "key").sortWithinPartitions(*K.version_order())
        return _folder_of(spark, dealt, "sst")


@query(f"{_BINARY} vt")
def binary_table_round_trip(spark, sf_dir):
    return _text(binary.read_tables(spark, _sorted_files(spark, sf_dir)))


@query(f"{_BINARY} vt WHERE key >= 'u000004' AND key <= 'u000006'")
def binary_table_range(spark, sf_dir):
    """Files opened from their footers; the key's bounds are pushed down to files and blocks."""
    files = spark.read.format("lamina_files").option("layout", "sst").load(_sorted_files(spark, sf_dir))
    return _text(files.where(F.col("key").between(b"u000004", b"u000006")))


@query(f"{_VT}, {_ASKED_SQL} SELECT a.key, cast(a.asked_ts AS bigint) AS ts, v.value FROM asked a JOIN vt v ON v.key = a.key AND v.ts = a.asked_ts WHERE v.kind = 1")
def binary_table_get(spark, sf_dir):
    """Exact versions out of table files, by filter, index and block."""
    found = binary.get_versions(spark, _sorted_files(spark, sf_dir), [(k.encode(), ts) for k, ts in _ASKED])
    return found.where(F.octet_length("value") > 0).select(F.col("key").cast("string").alias("key"), "ts", F.col("value").cast("string").alias("value"))


# A driver-side batch of all nations: one key a region, every fifth nation a delete.

_NATIONS = """nations AS (SELECT 'r' || cast(n_regionkey AS varchar) AS key, cast(CASE WHEN n_nationkey % 5 = 4 THEN 2 ELSE 1 END AS int) AS kind,
  CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name END AS value, n_nationkey AS no, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth FROM nation),
  held AS (SELECT * FROM nations WHERE kind = 2 OR nth = 1)"""


def _nation_batch(spark: SparkSession, sf_dir: str) -> batch.Batch:
    built = batch.Batch()
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect():  # 25 rows at any scale
        key = f"r{r['n_regionkey']}".encode()
        if r["n_nationkey"] % 5 == 4:
            built.delete(key)
        else:
            built.put(key, r["n_name"].encode())
    return built


@query(f"WITH {_NATIONS} SELECT key, cast(7 AS bigint) AS ts, kind, value, cast(row_number() OVER (ORDER BY no) - 1 AS bigint) AS seq FROM held")
def batch_builder(spark, sf_dir):
    return _text(_nation_batch(spark, sf_dir).frame(spark, 7), "seq")


@query(
    f"""WITH {_NATIONS} SELECT x.key, h.key IS NOT NULL AS found, h.value, (SELECT count(*) FROM held) AS entries,
    cast((SELECT sum(strlen(key) + 8 + coalesce(strlen(value), 0)) FROM held) AS bigint) AS bytes
    FROM (SELECT 'r' || cast(r_regionkey AS varchar) AS key FROM region UNION ALL SELECT 'none') x LEFT JOIN (SELECT * FROM held WHERE nth = 1) h ON h.key = x.key"""
)
def batch_lookup(spark, sf_dir):
    built = _nation_batch(spark, sf_dir)
    keys = [f"r{r[0]}" for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()]  # 5 rows at any scale
    rows = []
    for key in [*keys, "none"]:
        value, found = built.get(key.encode())
        rows.append((key, found and key.encode() in built, None if value is None else value.decode(), len(built), built.size_in_bytes()))
    return spark.createDataFrame(rows, "key string, found boolean, value string, entries long, bytes long")


@query("SELECT * FROM (VALUES ('apple', cast(300 AS bigint), 'apple-300'), ('banana', 250, 'banana-250'), ('cherry', 300, 'cherry-300')) x(key, ts, value)")
def golden_snapshot(spark, sf_dir):
    """Two sources in memory, merged as of a version and up to a key."""
    rows = [[("apple", 400), ("banana", 250)], [("apple", 300), ("cherry", 300)]]
    sources = [spark.createDataFrame([(k.encode(), ts, PUT, f"{k}-{ts}".encode(), 0, n) for n, (k, ts) in enumerate(part)], SCHEMA) for part in rows]
    return _text(merge.live(merge.snapshot(merge.union_runs(*sources), 325, b"cherry"))).drop("kind")


@query(
    """SELECT step, is_valid, cast(pins AS int) AS pins, cast(runs AS int) AS runs, cast(segments AS int) AS segments FROM (VALUES ('opened', TRUE, 1, 2, 3), ('compacted', TRUE, 1, 2, 3),
    ('closed', FALSE, 0, 1, 3), ('closed twice', FALSE, 0, 1, 3), ('vacuumed', FALSE, 0, 1, 1)) x(step, is_valid, pins, runs, segments)"""
)
def table_life(spark, sf_dir):
    """Validity and pins of a reader, the runs that it or the table sees, and the log's segments, along a table's life.

    A flush ends a segment, so the first two commits have one each and the last two share one.
    """
    table = _new_table(spark, sf_dir, flush_after=(1, 2))
    reader, version, steps = table.reader(), table.version, []
    with reader as opened:

        def note(step: str) -> None:
            folders = opened.zones if opened.is_valid else table.zones
            steps.append((step, opened.is_valid, table.references(version), len(folders), len(table.log.segments())))

        note("opened")
        table.compact()
        note("compacted")
        opened.close()
        note("closed")
        opened.close()
        note("closed twice")
        table.vacuum()
        note("vacuumed")
    return spark.createDataFrame(steps, "step string, is_valid boolean, pins int, runs int, segments int")


@query("SELECT 'count' AS job, TRUE AS is_done, TRUE AS is_ok, FALSE AS is_error, count(*) AS result FROM lineitem UNION ALL SELECT 'fails', TRUE, FALSE, TRUE, NULL")
def job_status(spark, sf_dir):
    """Jobs beside the caller: one that counts, one that fails (no version is negative)."""
    known = {
        "count": jobs.submit(lambda: spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()),
        "fails": jobs.submit(lambda: batch.stamp(lineitem_kv(spark, sf_dir), -1).count()),
    }
    rows = []
    for name, job in known.items():
        job.wait()
        job.mark_ok(-1)  # done once: this changes nothing
        rows.append((name, job.is_done, job.status.is_ok, job.status.is_error, job.result))
    return spark.createDataFrame(rows, "job string, is_done boolean, is_ok boolean, is_error boolean, result long")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
