"""Command line: ``python -m rankspark <command> ...``.

    python -m rankspark sites   --store ROOT
    python -m rankspark report  --store ROOT best_pages site=sc-domain:x.com days=30 [--as-of D]
    python -m rankspark sql     --store ROOT --site S "SELECT * FROM {site} WHERE clicks > 100"
    python -m rankspark plan    --store ROOT --kind daily site=S [site=...] [--as-of D]
    python -m rankspark ingest  --store ROOT --landing DIR --kind daily|hourly [--checkpoint DIR]
    python -m rankspark fetches --store ROOT --kind daily|hourly [open|dropped]
    python -m rankspark compact --store ROOT --kind daily|hourly
    python -m rankspark index   --store ROOT --kind daily|hourly
    python -m rankspark vacuum  --store ROOT --kind daily|hourly [hours=24]

Results print as a table (``--rows`` rows) or are written with ``--out PATH``
(format by extension: .csv, .json, else Parquet) by the executors. The
session is whatever ``spark-submit`` / the environment provides.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from rankspark.api import Reports
from rankspark.plans.ingest import plan_daily, plan_hourly
from rankspark.session import configure
from rankspark.sinks.fact import compact, vacuum
from rankspark.sources.dictionary import index
from rankspark.sources.store import Store


def _params(items: list[str]) -> dict:
    out = {}
    for item in items:
        key, _, raw = item.partition("=")
        try:
            out.setdefault(key, []).append(json.loads(raw))
        except json.JSONDecodeError:
            out.setdefault(key, []).append(raw)
    return {k: (v[0] if len(v) == 1 else v) for k, v in out.items()}


def _emit(df: DataFrame, args) -> None:
    if args.out:
        w = df.write.mode("overwrite")
        if args.out.endswith(".csv"):
            w.option("header", True).csv(args.out)
        elif args.out.endswith(".json"):
            w.json(args.out)
        else:
            w.parquet(args.out)
    else:
        df.show(args.rows, truncate=False)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rankspark")
    ap.add_argument("command", choices=["sites", "report", "sql", "plan", "ingest", "fetches", "compact", "index", "vacuum"])
    ap.add_argument("args", nargs="*")
    ap.add_argument("--store", required=True)
    ap.add_argument("--as-of", default=None)
    ap.add_argument("--site", default=None)
    ap.add_argument("--data-type", default="daily")
    ap.add_argument("--kind", default="daily")
    ap.add_argument("--landing", default=None)
    ap.add_argument("--checkpoint", default=None)
    ap.add_argument("--out", default=None)
    ap.add_argument("--rows", type=int, default=50)
    args = ap.parse_intermixed_args(argv)

    spark = configure(SparkSession.builder.getOrCreate())
    store = Store.at(spark, args.store)
    as_of = dt.date.fromisoformat(args.as_of) if args.as_of else dt.date.today()

    if args.command == "sites":
        _emit(store.sites(), args)
    elif args.command == "report":
        name, params = args.args[0], _params(args.args[1:])
        _emit(getattr(Reports(store, as_of), name)(**params), args)
    elif args.command == "sql":
        _emit(store.sql(" ".join(args.args), site=args.site, data_type=args.data_type, nan_to_null=True), args)
    elif args.command == "plan":
        sites = _params(args.args).get("site", [])
        sites = sites if isinstance(sites, list) else [sites]
        fn = plan_daily if args.kind == "daily" else plan_hourly
        _emit(fn(store.units(args.kind), sites, as_of), args)
    elif args.command == "ingest":
        from rankspark.streaming.ingest import stream_daily, stream_hourly

        start = stream_daily if args.kind == "daily" else stream_hourly
        q = start(spark, args.landing, args.store, args.checkpoint)
        q.awaitTermination()
        if q.exception() is not None:
            print(q.exception(), file=sys.stderr)
            return 1
    elif args.command == "fetches":
        from rankspark.streaming.ingest import dropped_fetches, open_fetches

        fetches = dropped_fetches if args.args == ["dropped"] else open_fetches
        _emit(fetches(spark, args.store, args.kind), args)
    elif args.command == "compact":
        print(compact(spark, args.store, args.kind), "files rewritten")
    elif args.command == "index":
        print(index(spark, args.store, args.kind), "batches indexed")
    elif args.command == "vacuum":
        print(vacuum(spark, args.store, args.kind, float(_params(args.args).get("hours", 24))), "deleted")
    return 0


if __name__ == "__main__":
    sys.exit(main())
