"""Streams with state and commits against their batch twins."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.errors import EngineError
from attestry.operators import increments as N
from attestry.operators import retrieval as R
from attestry.sources.versions import Store
from attestry.streaming import incremental as I
from attestry.streaming import keyed as K

SHAPE = "key long, ts timestamp, version long, entry_id long, value string, ttl_seconds long"


def entries(n=400, seed=5):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(r.randrange(12), start + timedelta(hours=r.randrange(24 * 20)), r.randrange(4), k, r.choice("abc"), r.choice([3600, 86_400, 10 * 86_400])) for k in range(n)]


def test_current_entries_whatever_the_order(spark, tmp_path):
    rows = sorted(entries(), key=lambda r: (r[1] + timedelta(hours=r[3] % 9), r[3]))  # a row may come some hours late
    for k in range(5):
        part = rows[k * 80 : (k + 1) * 80]
        part = part + part[:7] + (rows[k * 80 - 5 : k * 80] if k else [])  # and again
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = lambda: I.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    K.current_table(stream(), store, "current", str(tmp_path / "c")).awaitTermination()
    want = {tuple(r) for r in K.current_entries(spark.createDataFrame(rows, SHAPE), 86_400).collect()}
    last = store.last()
    assert {tuple(r) for r in last.table("current").select("key", "version", "entry_id", "value", "expires_ms").collect()} == want and want
    # nothing new comes, nothing is written
    K.current_table(stream(), store, "current", str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in store.last().table("current").select("key", "version", "entry_id", "value", "expires_ms").collect()} == want


def test_entries_that_can_become_current():
    a, b, c = (3, 1, 1, "a", 10), (2, 5, 2, "b", 30), (2, 4, 3, "c", 20)
    assert K.front([b, a, c, a], 0) == [a, b] and K.front([a, b, c], 10) == [b] and K.front([a, b, c], 30) == []


def test_upserts_write_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    change = store.begin()
    change.upsert("t", spark.range(500).select("id", F.lit(0).cast("long").alias("v")), "id")
    first = change.commit()
    change = store.begin()
    touched = change.upsert("t", spark.createDataFrame([(7, 1), (8, 1)], "id long, v long"), "id", spark.createDataFrame([(9,)], "id long"))
    second = change.commit()
    assert len(touched) <= 3 and second.table("t").count() == 499 and {r.v for r in second.table("t").where("id in (7, 8)").collect()} == {1}
    moved = {b for b, p in second.state["tables"]["t"]["parts"].items() if first.state["tables"]["t"]["parts"].get(b) != p}
    assert moved <= set(map(str, touched)) and first.table("t").count() == 500


def test_a_crash_leaves_all_tables_at_one_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    change = store.begin()
    change.replace("a", spark.range(3))
    change.replace("b", spark.range(4))
    change.commit()
    writes = []
    own = type(change)._written

    def failing(self, name, df, bucketed):
        writes.append(name)
        if len(writes) == stop:
            raise RuntimeError("lost")
        return own(self, name, df, bucketed)

    monkeypatch.setattr(type(change), "_written", failing)
    for stop in (1, 2):
        writes.clear()
        with pytest.raises(RuntimeError):
            c = store.begin()
            c.replace("a", spark.range(30))
            c.replace("b", spark.range(40))
            c.commit()
        assert (store.last().number, store.last().table("a").count(), store.last().table("b").count()) == (1, 3, 4)
    monkeypatch.undo()
    c = store.begin()
    c.replace("a", spark.range(30))
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        c.commit()
    monkeypatch.undo()
    assert store.last().table("a").count() == 3
    assert store.vacuum(now_ms=1 << 45) == 2 and store.last().table("b").count() == 4


def test_a_stale_writer_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, two = store.begin(), store.begin()
    one.replace("a", spark.range(1))
    two.replace("a", spark.range(2))
    one.commit()
    with pytest.raises(EngineError, match="STALE_VERSION"):
        two.commit()
    assert store.last().table("a").count() == 1 and store.numbers() == [1]
    met = []

    def make(change):
        met.append(change.base.number)
        if len(met) == 1:
            other = store.begin()
            other.replace("a", spark.range(9))
            other.commit()
        change.replace("b", change.base.table("a"))

    assert store.transact(make).table("b").count() == 9 and met == [1, 2]
    with pytest.raises(EngineError, match="NO_TABLE"):
        store.last().table("none")


FIELDS = {"title": "title", "definitions": "text"}


def test_an_index_follows_its_documents(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["Ünïcode"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = {k: (text(2), text(r.randrange(12))) for k in range(40)}
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "id long, title string, text string")
    for step in range(5):
        new = {k: (text(2), text(r.randrange(12))) for k in r.sample(range(60), 6)} if step else docs
        gone = r.sample(sorted(docs), 4) if step else []
        change = store.begin()
        N.index_change(change, frame(new), FIELDS, spark.createDataFrame([(k,) for k in gone], "id long") if gone else None)
        change.commit()
        docs = {k: v for k, v in {**docs, **new}.items() if k not in gone or k in new}
        if step == 3:
            change = store.begin()
            assert N.compact_index(change, most=2)
            change.commit()
    index = N.LiveIndex(store.last())
    order = ["id", "dl", "field", "pos", "term"]
    assert sorted(map(tuple, index.rows.select(*order).collect())) == sorted(map(tuple, R.postings(frame(docs), FIELDS).select(*order).collect()))
    want = R.totals(frame(docs), FIELDS).first()
    assert (index.total.first().n, round(index.total.first().avgdl, 9)) == (want.n, round(want.avgdl, 9))
    df = {t: len({k for k, v in docs.items() if t in " ".join(v).lower().split()}) for t in words[:30]}
    assert {t: n for t, n in index.frequency().collect() if t in df} == {t: n for t, n in df.items() if n}


def test_postings_move_packed(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b{k % 3}", "b c b") for k in range(20)] + [(20, "", "")], "id long, title string, text string")
    store = Store(spark, str(tmp_path / "s"))
    change = store.begin()
    N.index_change(change, docs.coalesce(1), FIELDS)
    rows = change.commit().table(N.POSTINGS)
    assert rows.count() == rows.select("field", "term").distinct().count() == 6  # not one for each of 100 tokens
    order = ["id", "dl", "field", "pos", "term"]
    want = sorted(map(tuple, R.postings(docs, FIELDS).select(*order).collect()))
    assert sorted(map(tuple, R.each_place(R.packed(R.postings(docs, FIELDS))).select(*order).collect())) == want
    # documents and rows are taken some at a time
    monkeypatch.setattr(R, "AT_ONCE", 12)
    batch = pa.record_batch({"id": pa.array(range(4)), "dl": pa.array([5, 0, 20, 3], pa.int32()), "title": pa.array([["a", "b"], [], ["a"] * 20, []]), "definitions": pa.array([["b"] * 3, None, [], ["c", "b", "c"]])})
    flat = lambda bs: sorted((i, d, r["field"], p, r["term"]) for b in bs for r in b.to_pylist() for i, d, p in zip(r["ids"], r["dls"], r["places"]))
    texts = list(R._texts_packed([batch], ["title", "definitions"]))
    told = flat(texts)
    assert len(texts) > 2 and told == sorted((i, d, f, p, t) for i, d, *fs in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)) for f, ts in zip(("title", "definitions"), fs) for p, t in enumerate(ts or ()))
    single = pa.table(dict(zip(order, map(list, zip(*told))))).to_batches(max_chunksize=5)
    assert flat(R._rows_packed(single)) == told


def test_an_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    change = store.begin()
    N.index_change(change, spark.createDataFrame([(k, f"a{k}", "b c") for k in range(50)], "id long, title string, text string"), FIELDS)
    first = change.commit()
    change = store.begin()
    N.index_change(change, spark.createDataFrame([(3, "a3", "b c"), (4, "new", "b")], "id long, title string, text string"), FIELDS)
    second = change.commit()
    added = lambda name: {b for b, p in second.state["tables"][name]["parts"].items() if p != first.state["tables"][name]["parts"].get(b)}
    assert added("postings") == {str(R.bucket(t)) for t in ("new", "b")}  # the third document is as it was
    read = N.LiveIndex(second).of(["new"]).inputFiles()
    assert read and all(f"bucket={R.bucket('new')}/" in f for f in read)
    assert {r.id for r in N.LiveIndex(second).of(["a4"]).collect()} == set() and {r.id for r in N.LiveIndex(second).of(["a3"]).collect()} == {3}


def test_state_is_called_only_for_what_changes():
    from attestry.streaming.keyed import Holding

    class Cell:
        value, puts = None, 0

        def get(self):
            return self.value or []

        def exists(self):
            return self.value is not None

        def put(self, value):
            self.value, self.puts = value, self.puts + 1

        update = put

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    own = Holding()
    own.handle, own.entries, own.rev = Handle(), Cell(), Cell()
    a, b = (2, 0, 1, "a", 10), (1, 0, 2, "b", 20)
    assert len(list(own._told(7, [], [a, b]))) == 1 and own.handle.timers == {10, 20} and own.entries.puts == 1
    assert not list(own._told(7, [a, b], [a, b])) and own.entries.puts == 1
    assert len(list(own._told(7, [a, b], [b]))) == 1 and own.handle.timers == {20}
    assert not list(own._told(7, [b], []))[0]["holds"][0] and own.handle.timers == set() and own.entries.value is None
