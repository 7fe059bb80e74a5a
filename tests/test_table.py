"""The versioned table: commits, flushes, compactions, recovery and pins against a dictionary of versions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lamina.functions.keys import Key, KeyRange
from lamina.jobs import Job, Status, submit
from lamina.operators.batch import Batch
from lamina.plans.table import SnapshotGone, VersionedTable
from lamina.streaming.ingest import ingest
from lamina.streaming.latest import start_view


def view(df):
    return {bytes(r["key"]): (r["ts"], bytes(r["value"])) for r in df.collect()}


def test_reads_before_a_compaction_fail(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    put(t, a="1", b="1")
    put(t, a="2")
    t.flush()
    t.compact()
    with t.reader() as r:
        for gone in (lambda: r.snapshot(as_of=1), lambda: r.get_asof(b"a", 1), lambda: r.get(b"a", 1), lambda: r.scan(KeyRange(None, Key(b"z", 1)))):
            with pytest.raises(SnapshotGone):
                gone()
        assert r.get(b"b", 1)["value"] == b"1" and r.get_asof(b"a")["ts"] == 2 and r.get(b"a", 9) is None and r.scan(KeyRange(Key(b"a", 0), None)).count() == 2


def test_a_crash_between_run_and_manifest_is_harmless(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    put(t, a="1")
    t.runs.write(t._manifest.next_run, t.log.replay(), 1)  # the run is there, its manifest never came
    again = VersionedTable(spark, str(tmp_path / "t"))
    run = again.flush()
    assert run.rows == 1 and len(again.runs.store.names("")) == 2
    assert len([n for n in again.vacuum() if n.startswith("run=")]) == 1
    with again.reader() as r:
        assert view(r.snapshot()) == {b"a": (1, b"1")}


def test_pins_of_another_application_hold(spark, tmp_path):
    t, other = VersionedTable(spark, str(tmp_path / "t")), None
    put(t, a="1")
    t.flush()
    other = VersionedTable(spark, str(tmp_path / "t"))  # stands for another application
    with other.reader() as r:
        put(t, a="2")
        t.flush()
        t.compact()
        assert not [n for n in t.vacuum() if n.startswith("run=000000000001")]
        assert view(r.snapshot()) == {b"a": (1, b"1")}
    assert [n for n in t.vacuum() if n.startswith("run=000000000001")]
    t.manifests.lease_s = -1
    with t.reader():  # a pin past its lease holds nothing
        assert t.manifests.pinned() == set()


def test_one_writer_wins_a_name(spark, tmp_path):
    from lamina.sources.files import Store

    store = Store(spark, str(tmp_path))
    store.create_text("v1", "first")
    with pytest.raises(FileExistsError):
        store.create_text("v1", "second")
    store.write_text("draft", "third")
    with pytest.raises(FileExistsError):  # the claim of stores other than a local one
        store._rename("draft", "v1")
    store._rename("draft", "v2")
    assert (store.read_text("v1"), store.read_text("v2")) == ("first", "third") and [n for n in store.names("") if "draft" in n] == []


def test_a_retried_micro_batch_is_committed_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(b"a", 1, b"1", 0)], "key binary, kind byte, value binary, seq long")
    assert t.commit(rows, stream="s", epoch=0) == 1 and t.commit(rows, stream="s", epoch=0) is None
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.commit(rows, stream="s", epoch=0) is None and again.commit(rows, stream="s", epoch=1) == 2 and again.commit(rows, stream="other", epoch=0) == 3
    again.flush()
    again.vacuum()
    assert VersionedTable(spark, str(tmp_path / "t")).commit(rows, stream="s", epoch=1) is None


def test_runs_are_read_in_one_scan_and_pruned(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for k in range(3):
        put(t, **{f"k{k}": "v"})
        t.flush()
    with t.reader() as r:
        plan = r.versions()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Union" not in plan

        def scanned(df):
            return sum("part-" in f for f in df.inputFiles())

        assert scanned(r.versions()) == 3 and scanned(r.snapshot(as_of=1)) == 1 and scanned(r.snapshot(upper_key=b"k1")) == 2
        assert scanned(r.seek(Key(b"k2", 9))) == 1 and t.runs.blocks(t.zones[0]) == 1
        assert view(r.snapshot(as_of=2)) == {b"k0": (1, b"v"), b"k1": (2, b"v")}


def put(table, **values):
    b = Batch()
    for key, value in values.items():
        if value is None:
            b.delete(key.encode())
        else:
            b.put(key.encode(), value.encode())
    return table.commit(b)


def test_life_of_a_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert put(t, a="1", b="1") == 1 and put(t, a="2") == 2
    assert t.held_bytes() == 3 * (1 + 8 + 1)
    run = t.flush()
    assert (run.rows, run.min_key, run.max_key, run.max_ts) == (3, b"a".hex(), b"b".hex(), 2)
    put(t, b=None, c="3")
    with t.reader() as r:
        assert view(r.snapshot()) == {b"a": (2, b"2"), b"c": (3, b"3")}
        assert view(r.snapshot(as_of=1)) == {b"a": (1, b"1"), b"b": (1, b"1")}
        assert r.snapshot(raw=True).count() == 3
        assert r.get(b"a", 1)["value"] == b"1" and r.get(b"a", 9) is None and r.get(b"b", 3) is None
        assert r.get_asof(b"b") is None and r.get_asof(b"b", 2)["ts"] == 1
        assert [(bytes(x["key"]), x["ts"]) for x in r.scan(KeyRange(Key(b"a", 2), Key(b"b", 9))).collect()] == [(b"a", 2), (b"b", 3), (b"b", 1)]
        assert bytes(r.seek(Key(b"b", 2)).first()["key"]) == b"b"
        rows = r.rows(r.snapshot())
        next(rows)
    assert not r.is_valid
    r.close()
    with pytest.raises(ValueError, match="iterator is not valid"):
        next(rows)
    with pytest.raises(ValueError, match="iterator is not valid"):
        r.versions()
    again = VersionedTable(spark, str(tmp_path / "t"))  # recovery: the unflushed commit is there
    assert again.next_ts == 4
    with again.reader() as r:
        assert view(r.snapshot()) == {b"a": (2, b"2"), b"c": (3, b"3")}
        again.flush()
        again.compact()
        again.vacuum()
        assert view(r.snapshot(as_of=1)) == {b"a": (1, b"1"), b"b": (1, b"1")}  # pinned files stay
    gone = again.vacuum()
    assert any(n.startswith("run=") for n in gone)
    with again.reader() as r:
        assert view(r.snapshot()) == {b"a": (2, b"2"), b"c": (3, b"3")}
        with pytest.raises(SnapshotGone):
            r.snapshot(as_of=1)
    assert again.flush() is None
    with pytest.raises(FileExistsError):  # a second writer of the same manifest version loses
        t.manifests.commit(t._manifest)


def test_bulk_commit_and_stream(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    bulk = spark.createDataFrame([(b"k", 1, b"v1", 0), (b"k", 1, b"v2", 1), (b"j", 2, None, 2)], "key binary, kind byte, value binary, seq long")
    t.commit(bulk)
    put(t, k="new")
    query = start_view(t.log.stream(), "running", str(tmp_path / "state"))
    query.awaitTermination()
    assert {bytes(r["key"]): (r["ts"], r["kind"]) for r in spark.table("running").collect()} == {b"k": (2, 1), b"j": (1, 2)}


def test_stream_of_mutations(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "key binary, kind byte, value binary, seq long"
    t = VersionedTable(spark, str(tmp_path / "t"))
    for rows in ([(b"a", 1, b"1", 0), (b"b", 1, b"1", 1)], [(b"a", 2, None, 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), t, str(tmp_path / "state")).awaitTermination()
    assert t.next_ts == 3
    with t.reader() as r:
        assert view(r.snapshot()) == {b"b": (1, b"1")} and set(view(r.snapshot(as_of=1))) == {b"a", b"b"}


def test_budget_flushes_and_refuses(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), budget_bytes=25)
    put(t, a="1")
    put(t, b="1")
    assert t.can_fit(5) and not t.can_fit(6) and not t.zones
    put(t, c="1")
    assert len(t.zones) == 1 and t.held_bytes() == 10
    with pytest.raises(ValueError, match="larger than the budget"):
        put(t, d="x" * 50)
    with t.reader() as r:
        assert t.references() == 1 and set(view(r.snapshot())) == {b"a", b"b", b"c"}
    assert t.references() == 0


def test_recovery_keeps_the_last_write_and_true_size(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.log.append(0, spark.createDataFrame([(b"a", 1, 1, b"x", 0, 0), (b"a", 1, 1, b"y", 0, 1), (b"b", 3, 2, None, 0, 2)], "key binary, ts long, kind byte, value binary, src int, seq long"))
    rows, top, size = t.log.recover()
    assert {bytes(r["key"]): r["value"] for r in rows.collect()} == {b"a": b"y", b"b": None} and (top, size) == (3, 19)
    assert VersionedTable(spark, str(tmp_path / "t")).next_ts == 4


STEP = st.one_of(
    st.tuples(st.just("commit"), st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", None])), min_size=1, max_size=3)),
    st.sampled_from([("flush",), ("compact",), ("reopen",)]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(steps=st.lists(STEP, min_size=2, max_size=6))
def test_model(spark, tmp_path_factory, steps):
    root = str(tmp_path_factory.mktemp("model"))
    t, model = VersionedTable(spark, root), {}
    for step in steps:
        if step[0] == "commit":
            b = Batch()
            for key, value in step[1]:
                b.delete(key.encode()) if value is None else b.put(key.encode(), value.encode())
            ts = t.commit(b)
            for key, kind, value in b.mutations:
                model[key] = (ts, value if kind == 1 else None)
        elif step[0] == "flush":
            t.flush()
        elif step[0] == "compact":
            t.compact()
        else:
            t = VersionedTable(spark, root)
        with t.reader() as r:
            assert view(r.snapshot()) == {k: v for k, v in model.items() if v[1] is not None}


def test_jobs(spark):
    job = submit(lambda: spark.range(10).count())
    assert job.wait(60) and job.status.is_ok and job.result == 10
    failed = submit(lambda: 1 / 0)
    failed.wait(60)
    assert failed.status.is_error and isinstance(failed.status.error, ZeroDivisionError)
    once = Job()
    assert once.status.is_ok and not once.is_done
    assert once.mark_ok(1) and not once.mark_error(ValueError()) and once.status == Status()
