"""What the report queries move: no more than so many bytes an event, shuffled and written, where nothing is broadcast."""

import pytest

from hydrospark import catalog

SF = "/root/testdata/sf0.01"
EVENTS = 10_000


def moved(spark, f):
    """Bytes that the tasks of f's jobs shuffled and wrote."""
    sc = spark.sparkContext
    none, all_ = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList
    stages = lambda: sc._jsc.sc().statusStore().stageList(all_(), False, False, none, all_())
    each = lambda x: [x.apply(i) for i in range(x.size())]
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), max((x.stageId() for x in each(stages())), default=-1)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        f()
        return sum(x.shuffleWriteBytes() + x.outputBytes() for x in each(stages()) if x.stageId() > before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", ["a14_leaderboard", "a13_zone_bumps", "c5_sampling_sites", "a15_user_totals", "w8_running_bumps"])
def test_reports_move_once_to_meet_their_image(spark, name):
    """Reports went to their cell, to their image and back to their id, each time with hash, image and cell."""
    assert 0 < moved(spark, lambda: catalog.QUERIES[name](spark, SF).collect()) < EVENTS * 480
