"""Physical plans of the main operators on a saved ledger -> PLANS.md.

For each operator: shuffles (Exchange), Expand nodes, whole-stage codegen
spans, Python stages, and what reached the Parquet scan (PushedFilters,
ReadSchema), followed by the plan tree from ``explain("formatted")``.

Usage: python tools/plans_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerlake import (  # noqa: E402
    apply_filter,
    browse,
    children,
    export_report,
    filter_options,
    leaf_cap,
    node_table,
    page,
    profile,
    rollup_table,
    seek_page,
    totals,
)
from ledgerlake.session import local_session, shared_dir  # noqa: E402
from ledgerlake.sources.sinks import read_saved_ledger, write_ledger  # noqa: E402
from ledgerlake.sources.tables import ledger_from_tables  # noqa: E402


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def final_tree(text: str) -> str:
    """The operator tree of AQE's final plan (the whole tree if not adaptive)."""
    tree = text.split("\n\n")[0]
    if "== Final Plan ==" in tree:
        tree = tree.split("== Final Plan ==")[1].split("+- == Initial Plan ==")[0]
    return "\n".join(line for line in tree.splitlines() if line.strip())


def main(sf_dir: str) -> None:
    spark = local_session(8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    path = shared_dir(spark, "plans-report-ledger")
    write_ledger(ledger_from_tables(spark, sf_dir), path)
    led = spark.read.parquet(path)
    by_month_path = shared_dir(spark, "plans-report-ledger-by-month")
    write_ledger(led, by_month_path, by_month=True)
    by_month = read_saved_ledger(spark, by_month_path)
    day, ty = "1998-08-23", "ASIA"
    ops = {
        "totals (filtered)": totals(led, {"date": day, "entity_type": ty}),
        "totals (filtered, month-partitioned ledger)": totals(by_month, {"date": day, "entity_type": ty}),
        "rollup_table": rollup_table(led),
        "node_table (filtered)": node_table(led, {"entity_type": ty}),
        "browse": browse(led, {"date": day}),
        "children": children(led, [day, ty]),
        "leaf_cap (cap 10)": leaf_cap(led, 10),
        "profile": profile(led),
        "filter_options": filter_options(led),
        "page (first)": page(led, (), 0, 1000),
        "seek_page": seek_page(led, (day,), (), 1000),
        "export_report": export_report(led, {"entity_type": ty}),
        "ledger view (5-table join)": ledger_from_tables(spark, sf_dir),
    }
    print("# Physical plans\n")
    print(f"Saved ledger from `{sf_dir}` (range-partitioned, sorted Parquet), `local[8]`, AQE on. Each query "
          "is run once, then `explain(\"formatted\")` shows AQE's final plan; counts are taken from it.\n")
    print("| Operator | Exchanges | Expand | Codegen operators / all | Python stages | Partition filters | Pushed filters | Read columns |")
    print("|---|---|---|---|---|---|---|---|")
    texts = {}
    for name, df in ops.items():
        df.collect()
        text = formatted(df)
        texts[name] = text
        tree = final_tree(text)
        exchanges = len(re.findall(r"Exchange", tree)) - len(re.findall(r"BroadcastExchange", tree))
        expand = len(re.findall(r"\bExpand\b", tree))
        nodes = [ln for ln in tree.splitlines() if re.search(r"\(\d+\)", ln)]
        codegen = f"{sum(1 for ln in nodes if re.search(r'(^|- )\* ', ln.strip()))} / {len(nodes)}"
        python = len(re.findall(r"BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas", text))
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", text)))
        pushed = "; ".join(p for p in pushed if p) or "-"
        parts = sorted(set(re.findall(r"PartitionFilters: \[([^\]]*)\]", text)))
        parts = "; ".join(p for p in parts if p) or "-"
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
        cols = sorted({c.split(":")[0] for s in schemas for c in s.split(",") if c})
        print(f"| {name} | {exchanges} | {expand} | {codegen} | {python} | {parts} | {pushed} | {', '.join(cols)} |")
    for name in ("totals (filtered)", "rollup_table", "leaf_cap (cap 10)", "ledger view (5-table join)"):
        print(f"\n## {name}\n\n```\n{final_tree(texts[name])}\n```")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
