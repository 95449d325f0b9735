"""Print the formatted physical plan of registered queries, plus a one-line
shape summary (exchanges, broadcasts, windows, pushed filters, scans).

usage: python scripts/show_plans.py [--sf DIR] [--full] name [name ...]
"""

from __future__ import annotations

import argparse
import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--full", action="store_true", help="print the whole formatted plan")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    from riskframe.plans import load_all
    from riskframe.session import local_session
    spark = local_session()
    reg = load_all()
    for n in a.names:
        df = reg[n].spark(spark, a.sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        def count(pat):
            return len(re.findall(pat, plan, re.M))
        summary = {
            "shuffles": count(r"^\(\d+\) Exchange\s*$"),
            "single_partition": count(r"^Arguments: SinglePartition"),
            "broadcasts": count(r"^\(\d+\) BroadcastExchange"),
            "reused": count(r"^\(\d+\) Reused"),
            "windows": count(r"^\(\d+\) Window"),
            "scans": count(r"^\(\d+\) Scan parquet"),
            "pushed_filter_scans": count(r"^PushedFilters: \[[^\]]"),
        }
        print(f"== {n}: {summary}")
        if a.full:
            print(plan)
    spark.stop()


if __name__ == "__main__":
    main()
