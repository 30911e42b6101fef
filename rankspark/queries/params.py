"""Fixed parameters of the registered queries (chosen so each returns rows)."""

import datetime as dt

SITE = "sc-domain:n.example"
AS_OF = dt.date(1998, 6, 17)          # a Wednesday inside the daily data
HOURLY_AS_OF = dt.date(2024, 1, 31)   # day after the hourly data ends
DAYS = 365
PAGES = ["/economy/Brand-17", "/large/Brand-4"]
KEYWORDS = ["blue bolt", "red widget", "hot gear", "small bolt"]
ALL_TIME_FLOOR = dt.date(1995, 1, 1)


def sql_str(value: str) -> str:
    """A DuckDB string literal (oracle text only; Spark code binds literals)."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_str(v) for v in values)
