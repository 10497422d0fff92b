"""Budgets that a refused request does not use up: caps of tenants below one of all, with what is handed back."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVE, REFUND = "reserve", "refund"


def reserved(
    requests: DataFrame, groups: list[str], tenant: str, order: list[str], units: str, tenant_cap: float, global_cap: float, action: Column | None = None
) -> DataFrame:
    """requests with admitted, tenant_used and global_used (both after the row).

    In the order given, a request for units takes them from its tenant and from all tenants of its group, or
    from neither.  Where action is refund, units are handed back to both, never below zero, and the row counts
    as admitted.  A request for nothing (zero, negative or null units) is admitted and takes nothing; what is
    over a cap by itself is refused.  Rows of a null group or tenant share one.  Ties of order fall as they
    come, so order should end in a key.

    Whether a row gets its units depends on every row before it, so a group is one sorted run that a task
    streams through with a number for each tenant in hand: no group is held in memory, and groups are spread
    over tasks.  Requests that a cap alone refuses or that ask for nothing need no number of before, but pass
    through the same run, as their row tells the state.
    """
    names = dict(zip((f"_g{i}" for i in range(len(groups))), groups, strict=True))
    rows = requests.withColumns({
        **{k: F.col(g) for k, g in names.items()}, "_tenant": F.col(tenant), "_units": F.coalesce(F.col(units).cast("double"), F.lit(0.0)),
        "_back": F.coalesce((F.lit(RESERVE) if action is None else action) == REFUND, F.lit(False)),
    })
    sorted_rows = rows.repartition(*names).sortWithinPartitions(*names, *order)
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("tenant_used", T.DoubleType()), T.StructField("global_used", T.DoubleType())])
    return sorted_rows.mapInPandas(_ledger(list(names), requests.columns, float(tenant_cap), float(global_cap)), schema)


def _ledger(groups: list[str], columns: list[str], tenant_cap: float, global_cap: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, total = object(), defaultdict(float), 0.0
        for frame in frames:
            out = []
            keys = zip(*(frame[g].astype(object).where(frame[g].notna(), None) for g in groups), strict=True)
            who = frame["_tenant"].astype(object).where(frame["_tenant"].notna(), None)
            for key, name, units, back in zip(keys, who, frame["_units"].to_list(), frame["_back"].to_list(), strict=True):
                if key != current:
                    current, used, total = key, defaultdict(float), 0.0
                fits = units <= 0 or back or (used[name] + units <= tenant_cap and total + units <= global_cap)
                if units > 0 and fits:
                    used[name] = max(0.0, used[name] - units) if back else used[name] + units
                    total = max(0.0, total - units) if back else total + units
                out.append((fits, used[name], total))
            kept = frame[columns].reset_index(drop=True)
            yield kept.assign(**dict(zip(("admitted", "tenant_used", "global_used"), map(list, zip(*out, strict=True)), strict=True))) if out else kept.assign(admitted=True, tenant_used=0.0, global_used=0.0)

    return run


def spent(ledger: DataFrame, keys: list[str], order: list[str], used: str) -> DataFrame:
    """For each key what is used after its last row, and how many requests took units (column units, admitted, back)."""
    took = F.col("admitted") & (F.col("units") > 0) & ~F.col("back")
    return ledger.groupBy(*keys).agg(F.max_by(used, F.struct(*order)).alias("used"), F.count_if(took).alias("calls"), F.count_if(~F.col("admitted")).alias("refused"))
