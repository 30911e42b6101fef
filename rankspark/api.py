"""The eight report entry points of the source application, over a Store.

Same names and parameters as the source's tools, so existing calls carry
over; differences: the store and ``as_of`` are explicit (no wall clock, no
glob paths), and every call returns a lazy DataFrame instead of a list of
dicts (``.collect()`` / ``.toPandas()`` it, or write it out).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rankspark.functions.predicates import floor_date
from rankspark.operators import compare as C
from rankspark.operators import reports as R
from rankspark.sources.dictionary import matching
from rankspark.sources.store import Store


@dataclass
class Reports:
    store: Store
    as_of: dt.date = field(default_factory=dt.date.today)

    def _last(self, site: str, days: int) -> DataFrame:
        """A site's facts of the last days: files of other sites and dates are not opened."""
        return self.store.daily(site, since=floor_date(self.as_of, days))

    def query(self, site: str, sql: str, data_type: str = "daily", default_limit: int | None = None) -> DataFrame:
        """Free SQL with ``{site}`` / ``{site_hourly}`` placeholders (SRC-4); ``default_limit`` caps a statement without LIMIT."""
        return self.store.sql(sql, site=site, data_type=data_type, default_limit=default_limit, nan_to_null=True)

    def show_page_queries(self, site: str, page: str, days: int = 30) -> DataFrame:
        return R.page_queries(self._last(site, days), page, self.as_of, days=days, limit=50)

    def show_keyword_pages(self, site: str, keyword: str, days: int = 30) -> DataFrame:
        return R.keyword_pages(self._last(site, days), keyword, self.as_of, days=days)

    def search_keywords(self, site: str, pattern: str, days: int = 30) -> DataFrame:
        return R.search_keywords(matching(self.store, pattern, site=site, since=floor_date(self.as_of, days)), pattern, self.as_of, days=days, limit=100)

    def best_pages(self, site: str, days: int = 30, limit: int = 20) -> DataFrame:
        return R.best_pages(self._last(site, days), self.as_of, days=days, limit=limit)

    def track_pages(self, site: str, pages: list[str], keywords: list[str] | None = None,
                    days: int = 30) -> DataFrame:
        return R.track_pages(self._last(site, days), pages, self.as_of, keywords=keywords, days=days)

    def pages_queries(self, site: str, pages: list[str]) -> DataFrame:
        return R.pages_queries(self.store.daily(site), pages)

    def compare_periods(self, site: str, period_type: str = "week",
                        custom_periods: dict | None = None) -> DataFrame:
        return C.compare_periods(self.store.daily(site), self.as_of, period_type, custom_periods or {})
