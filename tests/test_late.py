import datetime as dt

from quern.operators import late as L
from quern.plans.runtime import scratch

T = lambda m: dt.datetime(2025, 6, 1) + dt.timedelta(minutes=m)
ROWS = "table_name string, topic string, partition_id int, kafka_offset bigint, row_id bigint, event_time timestamp_ntz, arrival timestamp_ntz, v bigint"


def table(spark, data):
    return spark.createDataFrame(data, ROWS)


def limits(spark):
    return spark.createDataFrame([("t", "a", 60, 30), ("t", "b", 1, 0)], "table_name string, topic string, period_minutes int, cutoff_minutes int")


DATA = [
    ("t", "a", 0, 1, 1, T(10), T(59), 1),
    ("t", "a", 0, 2, 2, T(10), T(60), 2),  # at the end of the period
    ("t", "a", 0, 3, 3, T(10), T(90), 4),  # exactly at the cut-off
    ("t", "a", 0, 4, 4, T(10), T(90) + dt.timedelta(microseconds=1), 8),
    ("t", "a", 0, 1, 5, T(10), T(200), 16),  # second delivery
    ("t", "a", 0, 6, 6, None, T(1), 32),
    ("t", "a", 0, 7, 7, T(1), None, 64),
    ("t", "c", 0, 8, 8, T(1), T(500), 128),  # no limits
    ("t", "a", None, 9, 9, T(70), T(121), 256),
    ("t", "a", None, 9, 10, T(70), T(121), None),  # null partition: a delivery of its own
    ("t", "a", 0, 11, 11, dt.datetime(1969, 12, 31, 23, 30), T(1), 512),
]


def restated(spark, batches):
    t = L.RestatedPeriods(spark, scratch(spark, "p"), limits(spark))
    for b in batches:
        t.apply(table(spark, b), "v")
    return t


def verdicts(t):
    return {r["row_id"]: r["verdict"] for r in t.retained().where("verdict <> 'on_time'").collect()}


def sums(t):
    return sorted(map(tuple, t.read().select("topic", "period_start", "n_rows", "n_first", "n_corrections", "total").collect()))


LATE = {2: "correction", 3: "correction", 4: "too_late", 9: "correction", 10: "correction", 11: "too_late"}


def test_verdicts_at_the_boundaries(spark):
    t = restated(spark, [DATA])
    assert verdicts(t) == LATE and [r[2:] for r in sums(t)] == [(3, 1, 2, 7), (2, 0, 2, 256)]
    t = restated(spark, [[]])
    assert verdicts(t) == {} and sums(t) == []


def test_batches_in_any_cut_and_again_give_the_same(spark):
    whole = sums(restated(spark, [DATA]))
    cut = [DATA[:1], DATA[1:4], DATA[1:4], DATA[4:], DATA]  # as after a crash, and a replay of everything
    t = restated(spark, cut)
    assert sums(t) == whole and verdicts(t) == LATE


def test_an_earlier_row_in_a_later_batch_takes_the_place_and_empties_its_old_partition(spark):
    day = 24 * 60
    late = [("t", "a", 0, 1, 5, T(3 * day), T(3 * day + 1), 16)]
    first = [("t", "a", 0, 1, 1, T(10), T(59), 1)]
    for batches in ([late, first], [first, late], [late, first, late], [late + first]):
        t = restated(spark, batches)
        assert [r[2:] for r in sums(t)] == [(1, 1, 0, 1)] and [r["row_id"] for r in t.retained().collect()] == [1]
    # the earlier row has no event time: the event has no period then
    t = restated(spark, [late, [("t", "a", 0, 1, 1, None, T(59), 1)]])
    assert sums(t) == [] and verdicts(t) == {}
