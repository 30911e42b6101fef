"""Summarize the physical plan of every registered query into PLANS.md.

    python tools/plans.py [--sf /root/testdata/sf0.01] [--out PLANS.md]

For each query: the scans (table, partition filters, pushed filters, columns
read), the exchanges (shuffles and broadcasts), join strategies, aggregates and
whether a LIMIT runs as a per-task top-k or after a global sort. The plan is
the initial adaptive plan; AQE may still coalesce partitions or switch a join
to broadcast at run time.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        s = line.strip().lstrip(":+- ").strip()
        if s.startswith("FileScan parquet"):
            loc = re.search(r"Location: \w+\([^)]*\)\[([^\]]*)\]", s)
            table = loc.group(1).rstrip("/").split("/")[-1] if loc else "?"
            pf = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", s)
            pu = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", s)
            rs = re.search(r"ReadSchema: struct<(.*)>", s)
            cols = [c.split(":")[0] for c in (rs.group(1).split(",") if rs else [])]
            out.append(f"scan `{table}` cols={cols} partition_filters=[{_short(pf.group(1) if pf else '')}]"
                       f" pushed=[{_short(pu.group(1) if pu else '')}]")
        elif s.startswith("Exchange"):
            out.append("shuffle " + _short(s.split(",")[0].replace("Exchange ", ""), 90))
        elif s.startswith("BroadcastExchange"):
            out.append("broadcast exchange")
        elif re.match(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", s):
            kind = s.split(" ")[0]
            jt = re.search(r"\b(Inner|LeftSemi|LeftAnti|LeftOuter|RightOuter|FullOuter|Cross)\b", s)
            out.append(f"{kind} {jt.group(1) if jt else ''}".strip())
        elif s.startswith("TakeOrderedAndProject"):
            out.append("TakeOrderedAndProject (per-task top-k)")
        elif s.startswith("Sort ") and "true" in s.split("]")[-1][:10]:
            out.append("global Sort")
        elif s.startswith("HashAggregate") and "partial_" in s:
            out.append("partial HashAggregate")
        elif s.startswith("Expand"):
            out.append("Expand (distinct aggregates)")
        elif s.startswith("Window"):
            part = re.search(r"\[([^\]]*)\], \[", s)
            out.append("Window" + (f" partitionBy {part.group(1)}" if part else ""))
        elif s.startswith("Generate"):
            out.append("Generate " + _short(s.split("Generate ")[1].split(",")[0], 40))
    return out


def _short(text: str, n: int = 140) -> str:
    text = re.sub(r"#\d+L?", "", text)
    return text if len(text) <= n else text[: n - 3] + "..."


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                                  "PLANS.md"))
    args = ap.parse_args(argv)
    from rankspark.registry import load_all
    from rankspark.session import local_session

    spark = local_session(8, checkpoint_dir="file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # untruncated Location / ReadSchema
    lines = [
        "# PLANS — physical plan shape of every registered query",
        "",
        f"Generated by `python tools/plans.py --sf {args.sf}` (initial adaptive plans, over the lazy fact views).",
        "Scans list the partition filters and the filters pushed into Parquet; `cols` is the read schema.",
        "",
    ]
    for name, q in load_all().items():
        if q.writes:
            lines += [f"## {name} ({q.survey_id})", "", "- write job: files written, then read back (see README)", ""]
            continue
        plan = q.run(spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name} ({q.survey_id})", ""]
        lines += [f"- {s}" for s in summarize(plan)] + [""]
    with open(args.out, "w") as f:
        f.write("\n".join(lines))
    print(f"wrote {args.out}")


if __name__ == "__main__":
    main()
