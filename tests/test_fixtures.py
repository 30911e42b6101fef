"""The lazy fact views, and a store written from them by the shipped writers."""

from rankspark.schema import DAILY, DAILY_COLUMNS, HOURLY, HOURLY_COLUMNS
from rankspark.sinks.fact import write_daily, write_hourly
from rankspark.sources.fixtures import daily_view, hourly_view
from rankspark.sources.store import Store
from tests.conftest import SF_SMALL


def test_written_store_equals_views(spark, tmp_path):
    root, views = str(tmp_path / "store"), Store.fixtures(spark, SF_SMALL)
    assert write_daily(views.daily(), root) == views.units("daily").count()
    assert write_hourly(views.hourly(), root) == views.units("hourly").count()
    store = Store.at(spark, root)
    for got, want, cols, schema in ((store.daily(), views.daily(), DAILY_COLUMNS, DAILY), (store.hourly(), views.hourly(), HOURLY_COLUMNS, HOURLY)):
        assert got.columns == list(cols) and [f.dataType for f in got.schema] == [f.dataType for f in schema]
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    for kind in ("daily", "hourly"):
        assert sorted(map(tuple, store.units(kind).collect())) == sorted(map(tuple, views.units(kind).collect()))
    assert store.sites().collect() == views.sites().collect()
    assert daily_view(spark, SF_SMALL).count() == store.daily().count()
    assert hourly_view(spark, SF_SMALL).count() == store.hourly().count()
