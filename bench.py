"""Times the headline queries once each, after one warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge.checks import QUERIES  # noqa: E402
from tallyforge.session import local_session  # noqa: E402

HEADLINE = (
    "agg01_statistics agg03_bank_statistics agg05_monthly_summary agg06_category_breakdown agg07_top_merchants "
    "agg08_category_comparison agg13_income_vs_spending agg14_flag_rows agg15_recurring_income agg16_bills "
    "flt01_query_transactions join01_current_debts join02_latest_portfolios join03_new_transactions "
    "join04_duplicate_audit join05_budget_status join07_recurring_details plan01_avalanche plan04_cash_flow_forecast "
    "snk05_spending_report txt01_redaction txt04_categories txt05_merchants txt10_text_transactions "
    "txt11_row_transactions txt13_balances txt15_paystub_fields txt20_tax_documents txt23_trades win01_spending_trends"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    QUERIES["agg06_category_breakdown"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
