"""Train, validation and test parts that never cut a family, and the corpus fingerprint."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.lexicons import CLASSES
from corpusmill.operators import neardup
from corpusmill.session import cut

SPLITS = ("train", "validation", "test")
RATIOS = (0.70, 0.15, 0.15)
MOST_OFF = 0.02
#: Below so many records a test part is held out and the rest is cross-validated.
SMALL = 5000
FOLDS, REPEATS = 5, 3


def family_sizes(rows: DataFrame, family: str = "family", label: str = "label") -> DataFrame:
    """(family, size, label): the most frequent label, the last in order among equals."""
    n = rows.groupBy(F.col(family).alias("family"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.groupBy("family").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("label"))


def greedy(ratios: tuple[float, ...], totals: dict) -> Iterator[int]:
    """Coroutine: send ``(size, label)``, get the number of the split that lacks most of its share of
    that label; among equals the one that lacks most of its rows; then the first."""
    rows = sum(totals.values())
    have, by_label = [0.0] * len(ratios), defaultdict(lambda: [0.0] * len(ratios))
    lack = lambda due, got: (due - got) / due if due > 0 else 0.0
    to = None
    while True:
        size, label = yield to
        own = by_label[label]
        need = [(lack(r * totals.get(label, 0), own[i]), lack(r * rows, have[i]), -i) for i, r in enumerate(ratios)]
        to = -max(need)[2]
        have[to] += size
        own[to] += size


def assign(rows: DataFrame, family: str = "family", label: str = "label", ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(family, size, label, split), families in ascending order.

    Each choice depends on all before it, so one task reads the families' rows (name, size, label)
    in order; it holds a few counts only. Texts and records never go there. Null labels count as
    a label of their own.
    """
    found = cut(family_sizes(rows, family, label), "split-families")
    totals = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}  # one row a class
    kinds = found.schema

    def fold(batches: Iterator[pa.RecordBatch]):
        choose = greedy(ratios, totals)
        next(choose)
        for b in batches:
            to = [SPLITS[choose.send(x)] for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.string())], names=["family", "size", "label", "split"])

    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in kinds) + ", split string"
    return found.repartition(1).sortWithinPartitions("family").mapInArrow(fold, schema)


def check_ratios(assigned: DataFrame, ratios: tuple[float, ...] = RATIOS, most_off: float = MOST_OFF) -> dict[str, float]:
    """The splits' shares of all rows; raises if one is off by more than ``most_off``."""
    n = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.sum("size").alias("n")).collect()}  # three rows
    total = max(1, sum(n.values()))
    share = {s: n.get(s, 0) / total for s in SPLITS}
    if any(abs(share[s] - r) > most_off for s, r in zip(SPLITS, ratios, strict=True)):
        raise ValueError(f"split_ratio_deviation: {share}")
    return share


def fingerprint(rows: DataFrame, raw_hash: str = "raw_hash") -> DataFrame:
    """One row (n, fingerprint) that any order of the rows gives alike: sums of the hashes' parts, mod 2^60, hashed."""
    part = lambda i: F.pmod(F.sum(F.conv(F.substring(raw_hash, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(1 << 60).cast("decimal(38,0)"))
    sums = rows.agg(F.count("*").alias("n"), *(F.coalesce(part(i), F.lit(0)).cast("long").alias(f"s{i}") for i in range(5)))
    return sums.select("n", F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(5))), 256).alias("fingerprint"))


# --- small corpora: a held-out part and repeated folds ---------------------------------------


@dataclass(frozen=True)
class Group:
    """A family of a small corpus: its name, its records by class, and their number."""

    name: object
    counts: tuple[int, ...]

    @property
    def size(self) -> int:
        return sum(self.counts)


def small_groups(rows: DataFrame, family: str = "family", label: str = "label", most: int = SMALL) -> list[Group]:
    """The families of a corpus below ``most`` records, by name; raises for a larger one, which has no place on the driver."""
    per = rows.groupBy(F.col(family).alias("family")).agg(F.count("*").alias("n"), *(F.sum((F.col(label) == c).cast("int")).alias(c) for c in CLASSES))
    found = per.orderBy("family").limit(most + 1).collect()
    if sum(r["n"] for r in found) >= most:
        raise ValueError(f"not_a_small_corpus:{most}")
    return [Group(r["family"], tuple(int(r[c] or 0) for c in CLASSES)) for r in found]


def hold_out(groups: list[Group], share: float = RATIOS[2], seed: int = 42) -> set:
    """Names of the families held out: about ``share`` of the records, each class once where that can be.

    Families have a seeded order. The first one of each class goes in; then those that come nearest to the size
    aimed at, counted from what is in by then, until it is reached. Five families at least stay.
    """
    order = dict(zip((g.name for g in groups), np.random.RandomState(seed).random_sample(len(groups)), strict=True))
    aim, most = max(1, round(sum(g.size for g in groups) * share)), len(groups) - 5
    if most < 3:
        raise ValueError(f"insufficient_groups_for_small_dataset_test_and_cv:{len(groups)}<8")
    shuffled = sorted(groups, key=lambda g: order[g.name])  # ties of the draw stay in order of name
    firsts = [next((g for g in shuffled if g.counts[c]), None) for c in range(len(CLASSES))]
    held = list(dict.fromkeys(g for g in firsts if g))[:most]
    used = sum(g.size for g in held)
    base = used
    for g in sorted(set(groups) - set(held), key=lambda g: (abs(base + g.size - aim), order[g.name], groups.index(g))):
        if used >= aim or len(held) >= most:
            break
        held.append(g)
        used += g.size
    return {g.name for g in held}


def fold_of_groups(groups: list[Group], folds: int = FOLDS, seed: int = 42) -> dict:
    """One repeat: family name -> fold. Every fold first gets, for each class it lacks, the smallest free family that has
    it; the others, in seeded order, go where class counts come nearest to equal, then to the smallest fold."""
    order = list(range(len(groups)))
    np.random.RandomState(seed).shuffle(order)
    counts = [Counter() for _ in range(folds)]
    to: dict = {}

    def put(i: int, fold: int) -> None:
        to[groups[i].name] = fold
        counts[fold].update({c: n for c, n in enumerate(groups[i].counts) if n})

    free = set(order)
    for fold in range(folds):
        for c, label in enumerate(CLASSES):
            if counts[fold][c]:
                continue
            own = [i for i in free if groups[i].counts[c]]
            if not own:
                raise ValueError(f"unable_to_seed_group_cv_class:{fold}:{label}")
            chosen = min(own, key=lambda i: (groups[i].size, i))
            free.remove(chosen)
            put(chosen, fold)
    due = [sum(g.counts[c] for g in groups) / folds for c in range(len(CLASSES))]
    for i in order:
        if i in free:
            off = lambda f: sum(abs(counts[f][c] + groups[i].counts[c] - due[c]) for c in range(len(CLASSES)) if due[c])  # noqa: B023, E731
            put(i, min(range(folds), key=lambda f: (off(f), counts[f].total(), f)))
    return to


def cross_validation(groups: list[Group], folds: int = FOLDS, repeats: int = REPEATS, seed: int = 42) -> list[tuple[int, int, object]]:
    """(repeat, fold, family) of the validation parts; raises unless each class can be in every part."""
    if sum(g.size for g in groups) < folds * len(CLASSES):
        raise ValueError("insufficient_records_for_group_cv")
    if len(groups) < folds:
        raise ValueError(f"insufficient_groups_for_group_cv:{len(groups)}<{folds}")
    few = [label for c, label in enumerate(CLASSES) if sum(1 for g in groups if g.counts[c]) < folds]
    if few:
        raise ValueError(f"insufficient_groups_per_class_for_cv:{few}")
    out = []
    for repeat in range(repeats):
        to = fold_of_groups(groups, folds, seed + repeat)
        for fold in range(folds):
            for part in (True, False):
                have = [sum(g.counts[c] for g in groups if (to[g.name] == fold) == part) for c in range(len(CLASSES))]
                if not all(have):
                    raise ValueError(f"group_cv_class_coverage_failure:{repeat}:{fold}:{have}")
        out += [(repeat, fold, name) for name, fold in to.items()]
    return out


def fold_rows(pool: DataFrame, folds: DataFrame, family: str = "family") -> DataFrame:
    """(repeat, fold, *pool, split): each record of the pool in every repeat and fold, as validation or train, from
    ``folds(repeat, fold, family)``, which says where a family is validated."""
    pairs = folds.select("repeat", "fold").distinct()  # a row per fold
    own = folds.select("repeat", F.col("fold").alias("home"), F.col("family").alias(family))
    return pool.join(own, family).join(F.broadcast(pairs), "repeat").select("repeat", "fold", *pool.columns, F.when(F.col("home") == F.col("fold"), "validation").otherwise("train").alias("split"))


@dataclass
class Split:
    """``records`` with family_id and split; ``folds(repeat, fold, family)`` for a small corpus, else None."""

    records: DataFrame
    folds: DataFrame | None
    info: dict


def with_families(records: DataFrame, question: str = "question", key: str = "question_id", **how) -> DataFrame:
    """``records`` with ``family``: the smallest id of the texts near to one another."""
    found = neardup.families(records, key, question, **how).select(F.col("id").alias(key), "family")
    return records.join(found, key)


def split_records(records: DataFrame, ratios: tuple[float, ...] = RATIOS, seed: int = 42, cv_seed: int = 42, most_off: float = MOST_OFF, small: int = SMALL, family: str = "family") -> Split:
    """Splits records(question_id, label, family). At ``small`` records or more: train, validation and test by family, with
    the ratio check. Below: a held-out test part and, with 15 records or more left, repeated folds over the rest."""
    n = records.count()
    if not n:
        raise ValueError("empty_dataset")
    names = [c for c in records.columns if c not in ("split", "family_id", family)]
    if n >= small:
        assigned = cut(assign(records, family, ratios=ratios), "split-assigned")
        shares = check_ratios(assigned, ratios, most_off)
        out = records.join(assigned.select(F.col("family").alias(family), "split"), family)
        return Split(out.select(*names, F.col(family).cast("string").alias("family_id"), "split"), None, {"shares": shares, "small_dataset_mode": False, "families": assigned.count()})
    spark, groups = records.sparkSession, small_groups(records, family, most=small)
    held = hold_out(groups, ratios[2], seed)
    kind = records.schema[family].dataType.simpleString()
    parts = spark.createDataFrame([(g.name, "test" if g.name in held else "train") for g in groups], f"{family} {kind}, split string")
    out = records.join(parts, family).select(*names, F.col(family).cast("string").alias("family_id"), "split")
    pool = [g for g in groups if g.name not in held]
    folds = None
    if sum(g.size for g in pool) >= FOLDS * len(CLASSES):
        folds = spark.createDataFrame([(r, f, str(name)) for r, f, name in cross_validation(pool, seed=cv_seed)], "repeat int, fold int, family string")
    test = sum(g.size for g in groups if g.name in held)
    return Split(out, folds, {"shares": {"train": 1 - test / n, "validation": 0.0, "test": test / n}, "small_dataset_mode": True, "families": len(groups)})
