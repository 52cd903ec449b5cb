"""Exact quantiles without a sort: the interval that holds the rank is narrowed by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048
#: Distinct values that are counted one by one at the end, for each name.
FEW = 4096


def exact_quantiles(rows: DataFrame, shares: dict[str, float]) -> dict[str, float | None]:
    """Quantile of the values of each name in ``rows(name, value)``, linear between two ranks; None without values.

    Each pass counts ``BINS`` parts of every name's interval and keeps the part with the rank, so the driver gets
    ``BINS`` rows a name whatever the input and the values are never moved. Nulls and NaN do not count.
    ``rows`` is read a few times; a computed one should be a table.
    """
    clean = rows.select("name", F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
    spans = {r["name"]: r for r in clean.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect() if r["name"] in shares}
    out: dict[str, float | None] = dict.fromkeys(shares)
    ranks = []  # name, 0-based rank, its weight in the result
    for name, r in spans.items():
        at = shares[name] * (r["n"] - 1)
        low = min(int(at), r["n"] - 1)
        ranks += [(name, low, 1 - (at - low))] + ([(name, low + 1, at - low)] if at > low else [])
    todo = {(name, k): (spans[name]["lo"], spans[name]["hi"], k, spans[name]["n"]) for name, k, _ in ranks}  # interval, rank and rows in it
    found: dict[tuple, float] = {}
    while todo:
        for key, (lo, hi, _, _) in list(todo.items()):
            if lo == hi:
                found[key] = lo
                del todo[key]
        if not todo:
            break
        spark = rows.sparkSession
        asked = spark.createDataFrame([(i, name, lo, hi, n <= FEW) for i, ((name, _), (lo, hi, _, n)) in enumerate(todo.items())], "q int, name string, lo double, hi double, few boolean")  # two rows a name
        inside = clean.join(F.broadcast(asked), "name").where("value >= lo and value <= hi")
        # halves first: the width of an interval may be more than a double holds
        share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.when(F.col("few"), F.col("value")).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double"))
        counts: dict[int, list] = {}
        for r in inside.groupBy("q", part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
            counts.setdefault(r["q"], []).append((r["lo"], r["hi"], r["n"]))
        for i, (key, (_, _, rank, _)) in enumerate(list(todo.items())):
            for lo, hi, n in sorted(counts[i]):
                if rank < n:
                    todo[key] = (lo, hi, rank, n)
                    break
                rank -= n
    for name, k, weight in ranks:
        out[name] = (out[name] or 0.0) + weight * found[name, k]
    return out


def long_form(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value) of the columns, one pass."""
    return rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))))


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return exact_quantiles(long_form(rows, columns), dict.fromkeys(columns, 0.5))
