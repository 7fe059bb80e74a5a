"""Micro-fixtures of the versioned relation: merges, ranges, batches, metadata, codecs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import bloom
from lamina.functions import keys as K
from lamina.operators import batch, merge, runs_meta
from lamina.operators.along import carry_last, running_sum
from lamina.schema import DELETE, PUT, guard
from lamina.sources import binary

SCHEMA = "src int, key string, ts long, kind int, value string, seq long"


def rows(spark, *entries):
    """Entries ``(src, key, ts[, kind[, value]])``."""
    full = [(e[0], e[1], e[2], e[3] if len(e) > 3 else PUT, (e[4] if len(e) > 4 else f"{e[1]}-{e[2]}") if (e[3] if len(e) > 3 else PUT) == PUT else None, k) for k, e in enumerate(entries)]
    return spark.createDataFrame(full, SCHEMA)


def pairs(df):
    return [(r["key"], r["ts"]) for r in df.orderBy("key", F.col("ts").desc()).collect()]


def test_golden_snapshot(spark):
    df = rows(spark, (0, "apple", 400), (0, "banana", 250), (1, "apple", 300), (1, "cherry", 300))
    got = merge.snapshot(df, 325, "cherry")
    assert pairs(got) == [("apple", 300), ("banana", 250), ("cherry", 300)]
    assert [r["value"] for r in got.orderBy("key").collect()] == ["apple-300", "banana-250", "cherry-300"]


def test_latest_skips_older_versions(spark):
    assert pairs(merge.latest(rows(spark, (0, "apple", 300), (0, "apple", 200), (0, "banana", 100)))) == [("apple", 300), ("banana", 100)]


def test_rows_beyond_the_bound_do_not_end_a_source(spark):
    df = rows(spark, (0, "apple", 100), (0, "banana", 500), (0, "banana", 200), (0, "cherry", 100))
    assert pairs(merge.snapshot(df, 300, "zzz")) == [("apple", 100), ("banana", 200), ("cherry", 100)]
    df = rows(spark, (0, "apple", 900), (1, "apple", 100), (1, "banana", 50))
    assert pairs(merge.snapshot(df, 300, "zzz")) == [("apple", 100), ("banana", 50)]


def test_ties_go_to_the_lowest_source_then_the_last_seq(spark):
    df = rows(spark, (0, "k", 7, PUT, "A"), (1, "k", 7, PUT, "B"))
    assert merge.latest(df).first()["value"] == "A"
    df = rows(spark, (0, "k", 7, PUT, "A"), (0, "k", 7, PUT, "B"))
    assert merge.latest(df).first()["value"] == "B"
    assert merge.union_runs(df, df).select("src").distinct().count() == 2


def test_tombstones_hide_older_versions(spark):
    df = rows(spark, (0, "a", 1), (0, "a", 2, DELETE), (0, "b", 1))
    assert pairs(merge.live(merge.snapshot(df, 1))) == [("a", 1), ("b", 1)]
    assert pairs(merge.live(merge.snapshot(df, 2))) == [("b", 1)]
    assert pairs(merge.snapshot(df, 2)) == [("a", 2), ("b", 1)]
    assert pairs(merge.compact(df)) == [("b", 1)]
    empty_put = rows(spark, (0, "a", 1, PUT, ""))
    assert pairs(merge.live(empty_put)) == [] and pairs(merge.live(empty_put, empty_is_delete=False)) == [("a", 1)]


def test_ranges(spark):
    df = rows(spark, (0, "a", 1), (0, "a", 5), (0, "b", 3), (0, "b", 9), (0, "c", 2), (0, "c", 7))
    scan = lambda a, b: pairs(df.where(K.KeyRange(a, b).contains()))
    assert scan(K.Key("a", 2), K.Key("c", 5)) == [("a", 5), ("b", 9), ("b", 3), ("c", 2)]
    assert pairs(rows(spark, (0, "b", 9), (0, "b", 5)).where(K.KeyRange(None, K.Key("b", 5)).contains())) == [("b", 5)]
    assert scan(K.Key("b", 0), None) == [("b", 9), ("b", 3), ("c", 7), ("c", 2)]
    assert scan(None, None) == pairs(df)
    K.KeyRange(K.Key("a", 5), K.Key("a\x00", 3))
    with pytest.raises(ValueError):
        K.KeyRange(K.Key("b", 1), K.Key("a", 1))
    with pytest.raises(ValueError):
        K.Key("a", 2**63)
    assert pairs(df.where(K.from_key(K.Key("b", 5)))) == [("b", 3), ("c", 7), ("c", 2)]


def test_predicates_reach_the_scan(spark, tmp_path):
    rows(spark, (0, "a", 1)).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    read = spark.read.parquet(str(tmp_path / "t"))
    plan = read.where(K.KeyRange(K.Key("a", 2), K.Key("c", 5)).contains())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThanOrEqual(key,c)" in plan
    assert "WindowGroupLimit" in merge.snapshot(read, 5)._jdf.queryExecution().executedPlan().toString()


def test_batch_rules(spark):
    b = batch.Batch()
    assert [b.put(b"k", b"v1"), b.put(b"k", b"v2")] == [True, False]
    b.delete(b"k")
    assert b.put(b"k", b"v3") is False
    b.delete(b"j")
    assert b.put(b"j", b"x") is False
    assert len(b) == 3 and not b.is_empty and b.get(b"k") == (b"v1", True) and b.get(b"j") == (None, True) and b.get(b"x") == (None, False)
    assert b"k" in b and b"x" not in b and b.size_in_bytes() == 29
    applied = merge.latest(b.frame(spark, 5)).collect()
    assert {bytes(r["key"]): r["kind"] for r in applied} == {b"k": DELETE, b"j": DELETE}
    with pytest.raises(ValueError):
        b.put(b"", b"x")
    bulk = spark.createDataFrame([("k", PUT, "v1", 0), ("k", PUT, "v2", 1), ("k", DELETE, None, 2), ("k", PUT, "v3", 3), ("j", DELETE, None, 4), ("j", PUT, "x", 5)], "key string, kind int, value string, seq long")
    assert [r["seq"] for r in batch.accepted(bulk).orderBy("seq").collect()] == [0, 2, 4]
    stamped = batch.stamp(batch.accepted(bulk), 9)
    assert {r["ts"] for r in stamped.collect()} == {9}
    assert batch.size_in_bytes(stamped).first()["bytes"] == 29
    with pytest.raises(Exception, match="unknown kind"):
        batch.stamp(bulk.withColumn("kind", F.lit(3)), 9).collect()


def test_guard_rejects_bad_rows(spark):
    assert guard(rows(spark, (0, "a", 1))).count() == 1
    for bad in (rows(spark, (0, "a", -1)), rows(spark, (0, "", 1)), rows(spark, (0, "a", 1, 7))):
        with pytest.raises(Exception, match="version out of range"):
            guard(bad).collect()


def test_multi_get(spark):
    df = rows(spark, (0, "a", 1), (0, "a", 5), (1, "a", 5), (0, "b", 3, DELETE))
    probes = spark.createDataFrame([(1, "a", 4), (2, "a", 5), (3, "b", 3), (4, "c", 9), (5, "a", 0)], "probe_id long, key string, probe_ts long")
    got = {r["probe_id"]: (r["ts"], r["value"]) for r in merge.multi_get(probes, df).collect()}
    assert got == {1: (1, "a-1"), 2: (5, "a-5"), 3: (3, None), 4: (None, None), 5: (None, None)}


def test_block_packing_and_index(spark):
    df = spark.createDataFrame([(0, "abcd"[k], 1, PUT, "x" * 9, k) for k in range(4)], SCHEMA)
    assert [r["block_no"] for r in runs_meta.pack_blocks(df, 80).orderBy("key").collect()] == [0, 0, 1, 1]
    big = spark.createDataFrame([(0, "a", 1, PUT, "x", 0), (0, "b", 1, PUT, "y" * 500, 1), (0, "c", 1, PUT, "z", 2)], SCHEMA)
    assert [r["block_no"] for r in runs_meta.pack_blocks(big, 80).orderBy("key").collect()] == [0, 1, 2]
    index = runs_meta.block_index(df, 2)
    probes = spark.createDataFrame([(0, "A"), (0, "b"), (0, "c"), (0, "z")], "run_id int, key string")
    assert {r["key"]: r["block_no"] for r in runs_meta.locate(probes, index).collect()} == {"A": 0, "b": 0, "c": 1, "z": 1}
    zones = runs_meta.zone_map(df)
    assert zones.first()["min_key"] == "a" and runs_meta.overlapping(zones, K.KeyRange(K.Key("e", 0), None)).count() == 0


def test_running_values_over_many_parts(spark):
    data = [("hot" if k % 3 else f"g{k % 5}", k, 1 if k % 7 == 0 else None) for k in range(500)]
    df = spark.createDataFrame(data, "g string, k long, v int")
    sums, last = {}, {}
    for g, k, v in data:
        sums[g] = sums.get(g, 0) + k
        last[g] = k if v else last.get(g)
        data[k] = (g, k, sums[g], last[g])
    got = running_sum(df, ["g"], ["k"], "k", "s").orderBy("k").collect()
    assert [(r["g"], r["k"], r["s"]) for r in got] == [d[:3] for d in data]
    carried = carry_last(df.withColumn("v", F.when(F.col("v") == 1, F.col("k"))), ["g"], ["k"], "v").orderBy("k").collect()
    assert [(r["g"], r["k"], r["v"]) for r in carried] == [(d[0], d[1], d[3]) for d in data]


def test_bloom_sizes(spark):
    df = spark.createDataFrame([(1000.0, 0.01), (100.0, 0.01), (1000.0, 0.001), (0.0, 0.5)], "n double, p double").withColumn("m", bloom.bits(F.col("n"), F.col("p")))
    assert [(r["m"], r["k"]) for r in df.withColumn("k", bloom.hashes(F.col("m"), F.col("n"))).collect()] == [(9586, 7), (959, 7), (14378, 10), (2, 1)]


def test_key_codec(spark):
    df = rows(spark, (0, "a", 1), (0, "é", 2**63 - 1)).withColumn("e", K.encode(F.col("key"), F.col("ts")))
    for r in df.withColumns({"k": K.decode_key(F.col("e")).cast("string"), "t": K.decode_ts(F.col("e"))}).collect():
        assert (r["k"], r["t"]) == (r["key"], r["ts"])
        assert bytes(r["e"]) == binary.encode_key(r["key"].encode(), r["ts"])


ENTRIES = sorted(((f"k{k % 40:02d}".encode(), 300 - k, b"v" * (k % 50)) for k in range(200)), key=lambda e: (e[0], -e[1]))


def test_binary_layouts():
    data = binary.encode_table(ENTRIES, 256)
    table = binary.TableFile(data)
    assert list(table) == ENTRIES and len(table.index) > 5
    assert table.first_key == ENTRIES[0][:2] and table.last_key == ENTRIES[-1][:2]
    for raw, ts, value in ENTRIES:
        assert table.get(raw, ts) == value
    assert table.get(b"k00", 12345) is None and table.get(b"zz", 1) is None
    assert list(table.seek(b"k07", 150)) == [e for e in ENTRIES if (e[0], -e[1]) >= (b"k07", -150)]
    assert list(table.seek(b"", 0)) == ENTRIES
    assert binary.decode_index(binary.encode_index(table.index)) == table.index
    block = binary.encode_block(ENTRIES[:3], 4096)
    assert len(block) == 4096 and binary.decode_block(block) == ENTRIES[:3]
    log = b"".join(binary.encode_record(*e) for e in ENTRIES)
    assert list(binary.decode_records(log)) == ENTRIES
    with pytest.raises(ValueError, match="torn"):
        list(binary.decode_records(log[:-1]))
    with pytest.raises(ValueError):
        binary.encode_table(list(reversed(ENTRIES)))
    huge = [(b"a", 1, b"x" * 10_000), (b"b", 1, b"y")]
    assert list(binary.TableFile(binary.encode_table(huge))) == huge
    assert binary.murmur3(b"", 0) == 0 and binary.murmur3(b"hello", 0) == 0x248BFA47 and binary.murmur3(b"hello, world", 0) == 0x149BBB7F


def test_binary_files_round_trip(spark, tmp_path):
    binary.register(spark)
    df = spark.createDataFrame([(k, t, PUT if v else DELETE, v or None) for k, t, v in ENTRIES], "key binary, ts long, kind int, value binary")
    ordered = df.repartitionByRange(2, "key").sortWithinPartitions("key", F.col("ts").desc())
    for layout, read in (("wal", binary.read_logs), ("sst", binary.read_tables)):
        folder = str(tmp_path / layout)
        ordered.write.format("lamina_files").option("layout", layout).mode("append").save(folder)
        got = read(spark, folder).orderBy("key", F.col("ts").desc()).collect()
        assert [(bytes(r["key"]), r["ts"], bytes(r["value"] or b"")) for r in got] == ENTRIES
        assert {r["file"].rpartition(".")[2] for r in got} == {layout}


@pytest.mark.parametrize("layout", ["wal", "sst"])
def test_binary_partitions_without_rows_write_no_file(spark, tmp_path, layout):
    binary.register(spark)
    folder, read = str(tmp_path / "f"), {"wal": binary.read_logs, "sst": binary.read_tables}[layout]
    schema = "key binary, ts long, kind int, value binary"
    write = lambda df, mode: df.write.format("lamina_files").option("layout", layout).mode(mode).save(folder)
    write(spark.createDataFrame([], schema), "append")
    assert read(spark, folder).count() == 0
    one = spark.range(0, 4, 1, 4).where("id = 2").select(F.lit("a").cast("binary").alias("key"), F.lit(1).cast("long").alias("ts"), F.lit(PUT).alias("kind"), F.lit("v").cast("binary").alias("value"))
    write(one, "append")
    assert [(bytes(r["key"]), r["ts"], r["seq"]) for r in read(spark, folder).collect()] == [(b"a", 1, 0)]
    assert len([n for n in (tmp_path / "f").iterdir() if n.suffix == f".{layout}"]) == 1
    write(one.where("ts > 1"), "overwrite")
    assert read(spark, folder).count() == 0


def test_binary_files_of_a_mounted_folder_are_not_held_whole(spark, tmp_path):
    inside = tmp_path / "a b%20c"
    inside.mkdir()
    (inside / "t.wal").write_bytes(b"".join(binary.encode_record(*e) for e in ENTRIES))
    (inside / "t.sst").write_bytes(binary.encode_table(ENTRIES, 256))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lamina-binary.link./in", tmp_path.as_uri())
    paths = {str(inside): False, f"viewfs://lamina-binary/in/{inside.name}": True}
    for name, read in (("t.wal", binary.read_logs), ("t.sst", binary.read_tables)):
        for path, held in paths.items():
            df = read(spark, path)
            assert ("content" in df._jdf.queryExecution().executedPlan().toString()) is held
            got = df.orderBy("seq").collect()
            assert [(bytes(r["key"]), r["ts"], bytes(r["value"] or b"")) for r in got] == ENTRIES and got[0]["file"].endswith(f"/{name}")
    (inside / "t.wal").write_bytes((inside / "t.wal").read_bytes()[:-1])
    for path in paths:
        with pytest.raises(Exception, match="torn record"):
            binary.read_logs(spark, path).collect()


def test_appended_files_stay_and_overwritten_ones_go(spark, tmp_path):
    binary.register(spark)
    folder, one = str(tmp_path / "f"), lambda key: spark.createDataFrame([(key, 1, PUT, b"v")], "key binary, ts long, kind int, value binary").coalesce(1)
    write = lambda key, mode: one(key).write.format("lamina_files").option("layout", "wal").mode(mode).save(folder)
    write(b"a", "append")
    write(b"b", "append")
    assert {bytes(r["key"]) for r in binary.read_logs(spark, folder).collect()} == {b"a", b"b"}
    read = spark.read.format("lamina_files").option("layout", "wal").load(folder)
    assert {bytes(r["key"]) for r in read.collect()} == {b"a", b"b"} and read.where("key = 'b'").count() == 1
    write(b"c", "overwrite")
    assert [bytes(r["key"]) for r in binary.read_logs(spark, folder).collect()] == [b"c"]


def test_table_files_are_read_block_by_block(spark, tmp_path):
    path = tmp_path / "t.sst"
    path.write_bytes(binary.encode_table(ENTRIES, 256))
    with path.open("rb") as file:
        table = binary.TableFile(file)
        assert table.blocks_read == 0 and table.get(*ENTRIES[77][:2]) == ENTRIES[77][2] and table.blocks_read == 1
        assert table.get(b"absent", 1) is None
        blocks = {n for n, e in table.between(b"k10", b"k11")}
        assert len(blocks) < len(table.index) / 2 and {e for e in ENTRIES if b"k10" <= e[0] <= b"k11"} <= {e for _, e in table.between(b"k10", b"k11")}
    binary.register(spark)
    df = spark.read.format("lamina_files").option("layout", "sst").load(str(tmp_path))
    some = df.where((F.col("key") >= b"k10") & (F.col("key") <= b"k11"))
    assert sorted((bytes(r["key"]), -r["ts"]) for r in some.collect()) == sorted((k, -t) for k, t, _ in ENTRIES if b"k10" <= k <= b"k11")
    reader = binary.FilesReader(str(tmp_path), "sst")
    from pyspark.sql.datasource import EqualTo

    list(reader.pushFilters([EqualTo(("key",), b"k10")]))
    assert 0 < len(list(reader.read(binary.OneFile("t.sst")))) < len(ENTRIES) / 2
    reader.low = reader.high = b"zz"
    assert list(reader.read(binary.OneFile("t.sst"))) == []


def test_levels_never_exceed_their_budget(spark):
    # (seq, key, ts, value): a version written again counts the difference of its values
    puts = [(0, "a", 1, "x" * 10), (1, "b", 1, "x" * 10), (2, "a", 1, "x" * 15), (3, "c", 1, "x" * 10), (4, "a", 1, ""), (5, "huge", 1, "x" * 100), (6, "d", 1, "")]
    df = spark.createDataFrame([(0, k, t, v, s) for s, k, t, v in puts], "src int, key string, ts long, value string, seq long")
    got = [(r["held"], r["flush_no"]) for r in batch.fill_levels(df, 50).orderBy("seq").collect()]
    assert got == [(19, 0), (38, 0), (43, 0), (19, 1), (28, 1), (112, 2), (9, 3)]


def test_running_values_over_many_parts_and_batches(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if k % 3 else f"g{k % 40}" if k % 2 else None, k, int(rng.integers(0, 9)), int(rng.integers(0, 99)) if rng.random() < 0.05 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, n int, v int")
    sums, last, expect = {}, {}, {}
    for g, k, n, v in rows:
        sums[g] = sums.get(g, 0) + n
        last[g] = last.get(g) if v is None else v
        expect[k] = (sums[g], last[g])
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summed = running_sum(df, ["g"], ["k"], "n", "s")
        assert {r["k"]: r["s"] for r in summed.collect()} == {k: s for k, (s, _) in expect.items()}
        assert {r["k"]: r["v"] for r in carry_last(df, ["g"], ["k"], "v").collect()} == {k: v for k, (_, v) in expect.items()}
        assert "Exchange hashpartitioning" not in summed._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
