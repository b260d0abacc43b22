"""Keyed streams over several micro-batches: state carries over from one to the next."""

import datetime as dt

from vantage.streaming import keyed as K
from vantage.streaming import windows as S


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def test_lifecycle_and_trigger_over_batches(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, event_type string, cents long"
    batches = [[(1, 2, at(2), "click", 5), (1, 1, at(1), "signup", 5), (2, 3, at(3), "purchase", 1)], [(1, 4, at(4), "purchase", None), (1, 5, at(5), None, 5), (2, 6, at(6), "signup", 1)]]
    events = stream(spark, tmp_path, batches, schema)
    found = sorted((r.event_id, r.state, r.legal) for r in S.run_to_table(K.lifecycle(events), "life").collect())
    assert found == [(1, "active", True), (2, "engaged", True), (3, "new", False), (4, "customer", True), (5, "customer", False), (6, "active", True)]
    shown = sorted((r.event_id, r.seen, r.total) for r in S.run_to_table(K.every_nth(events, 2), "nth").collect())
    assert shown == [(2, 2, 10), (5, 4, 15), (6, 2, 2)]


def test_reorder_over_batches(spark, tmp_path):
    batches = [[(7, s, k) for k, s in enumerate([1, 0, 0, 3])], [(7, s, 10 + k) for k, s in enumerate([2, 6, 7, 1])], [(7, s, 20 + k) for k, s in enumerate([8, 9, 4, 12])]]
    points = stream(spark, tmp_path, batches, "source long, seq long, arrived long")
    found = sorted((r.seq, r.gap) for r in S.run_to_table(K.reorder(points, depth=3), "reorder").collect())
    # 4 and 5 are given up when 6, 7 and 8 wait; the late 4 is left out; 12 still waits for 10
    assert found == [(0, 0), (1, 0), (2, 0), (3, 0), (6, 2), (7, 0), (8, 0), (9, 0)]


def test_changes_over_batches(spark, tmp_path):
    batches = [[(1, 5, 50, False), (1, 3, 30, False), (2, -1, 7, False)], [(1, 4, 40, False), (1, -1, 0, False), (2, 9, None, True)], [(1, 6, 60, False), (2, 8, 80, False), (2, -1, 7, False), (1, None, 0, True)]]
    changes = stream(spark, tmp_path, batches, "key long, lsn long, cents long, deleted boolean")
    found = sorted((r.key, r.lsn, r.deleted) for r in S.run_to_table(K.changes_applied(changes), "changes").collect())
    # late changes and snapshot rows do nothing, not even after a delete
    assert found == [(1, 5, False), (1, 6, False), (2, -1, False), (2, 9, True)]


def test_transactions_over_batches(spark, tmp_path):
    schema = "tx long, row_id long, expected int, ts timestamp"
    batches = [[(1, 10, 3, at(0)), (1, 11, 3, at(1)), (2, 20, 2, at(1)), (2, 20, 2, at(2))], [(1, 11, 3, at(2)), (1, 12, 3, at(3)), (3, 30, 1, at(3))], [(2, 21, 2, at(4)), (1, 12, 3, at(4)), (4, None, 1, at(4)), (5, 50, 1, None)]]
    rows = stream(spark, tmp_path, batches, schema)
    found = sorted((r.tx, r.n) for r in S.run_to_table(K.complete_transactions(rows), "tx").collect())
    assert found == [(1, 3), (2, 2), (3, 1)]


def test_a_transaction_is_given_up_behind_the_watermark(spark, tmp_path):
    schema = "tx long, row_id long, expected int, ts timestamp"
    batches = [[(1, 10, 2, at(0))], [(9, 90, 1, at(600))], [(8, 80, 1, at(601))], [(1, 11, 2, at(602))]]
    rows = stream(spark, tmp_path, batches, schema)
    found = sorted((r.tx, r.n) for r in S.run_to_table(K.complete_transactions(rows, "10 minutes"), "given_up").collect())
    assert found == [(8, 1), (9, 1)]


def test_replays_count_once_over_batches(spark, tmp_path):
    batches = [[(1, 1), (1, 2), (1, 1)], [(1, 2), (1, 3), (2, 1)], [(1, 1), (None, 1), (2, None)]]
    events = stream(spark, tmp_path, batches, "user_id long, event_id long")
    counts = lambda ring: sorted((r.user_id, r.n) for r in S.run_to_table(K.counted_once(events, ring), "once").collect())
    assert counts(64) == [(1, 2), (1, 3), (2, 1)]
    # a ring of two has forgotten the first event when it comes again
    assert counts(2) == [(1, 2), (1, 3), (1, 4), (2, 1)]


def test_progress_is_summed_over_all_reports(spark, tmp_path):
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        events = stream(spark, tmp_path, [[(1, 1)], [(1, 2), (1, 3)], [(2, 4)]], "user_id long, event_id long")
        table, progress = S.run_with_progress(events, "progress")
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert table.count() == 4 and progress == {"input_rows": 4, "late_rows": 0, "batches": 3}


def test_keyed_states_go_after_their_time(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, event_type string, cents long, source long, seq long, arrived long, key long, lsn long, deleted boolean"
    row = lambda user, k, minute: (user, k, at(minute), "view", 1, user, 0, k, user, k, False)
    # the first user falls silent; the second one's rows move the clock on by more than an hour, twice
    events = stream(spark, tmp_path, [[row(1, 1, 0), row(2, 2, 0)], [row(2, 3, 100)], [row(2, 4, 200)], [row(2, 5, 201)]], schema)
    for name, made in {"life": K.lifecycle(events, ttl="1 hour"), "nth": K.every_nth(events, 2, ttl="1 hour"), "order": K.reorder(events, ttl="1 hour"), "cdc": K.changes_applied(events, "1 hour"), "once": K.counted_once(events, ttl="1 hour")}.items():
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        left = spark.read.format("statestore").load(f"{tmp_path}/state-{name}").select("key.*").collect()
        assert [tuple(r) for r in left] == [(2,)], name
