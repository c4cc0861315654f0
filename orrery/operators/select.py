"""Exact quota-constrained selection.

Eligibility, ranks, signatures and counts are DataFrames. Only the search itself runs on
the driver, over the members of each cell that can be chosen, whose number is checked first; it is exact, or says that it is not
(`infeasible_or_unproven` at the node limit), and never approximates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.scalars import seeded_rank

POOL_LIMIT, NODE_LIMIT = 5000, 200_000


class Unproven(Exception):
    """The node limit was reached before the search was complete."""


@dataclass(frozen=True)
class Candidate:
    id: object
    penalty: int
    rank: str
    cell: tuple[str, ...]  # one category a dimension
    flag: bool = False  # counts for the minimum of flagged members


@dataclass
class Quotas:
    exact: Sequence[Mapping[str, int]]  # for each dimension: category -> members
    flagged: int = 0

    @property
    def slots(self) -> int:
        return sum(self.exact[0].values())


@dataclass
class Selection:
    status: str  # feasible, infeasible, infeasible_or_unproven
    members: list = field(default_factory=list)
    penalty: int | None = None


class Search:
    """Least penalty of a completion, by dynamic programming over cells with what each quota still needs."""

    def __init__(self, quotas: Quotas, limit: int):
        self.quotas, self.left = quotas, limit

    def least(self, pool: Sequence[Candidate], chosen: Sequence[Candidate]) -> int | None:
        """The least penalty of `chosen` with members of `pool` that meet the quotas; None if none do."""
        need = [dict(d) for d in self.quotas.exact]
        for c in chosen:
            for d, v in zip(need, c.cell, strict=True):
                d[v] = d.get(v, 0) - 1
                if d[v] < 0:
                    return None
        cells: dict[tuple, list[int]] = {}
        for c in pool:
            if all(d.get(v, 0) > 0 for d, v in zip(need, c.cell, strict=True)):
                cells.setdefault((c.cell, c.flag), []).append(c.penalty)
        order = sorted(cells)
        costs = []
        for k in order:
            sums, total = [0], 0
            for p in sorted(cells[k]):
                total += p
                sums.append(total)
            costs.append(sums)
        names = [(i, v) for i, d in enumerate(need) for v in sorted(d)]
        place = {n: k for k, n in enumerate(names)}
        # the last cell that can still serve a category: past it, an open quota is a dead end
        ends = {n: max((k for k, (cell, _) in enumerate(order) if cell[n[0]] == n[1]), default=-1) for n in names}
        start = tuple(need[i][v] for i, v in names)
        flagged = max(0, self.quotas.flagged - sum(c.flag for c in chosen))
        layer: dict[tuple, int] = {(start, flagged): sum(c.penalty for c in chosen)}
        if any(ends[n] < 0 and x > 0 for n, x in zip(names, start, strict=True)):
            return None
        for k, ((cell, flag), sums) in enumerate(zip(order, costs, strict=True)):
            at = [place[i, v] for i, v in enumerate(cell)]
            closing = [place[n] for n in names if ends[n] == k]
            after: dict[tuple, int] = {}
            for (open_, flags), cost in layer.items():
                for n in range(min(len(sums) - 1, *(open_[a] for a in at)) + 1):
                    self.left -= 1
                    if self.left < 0:
                        raise Unproven
                    rest = list(open_)
                    for a in at:
                        rest[a] -= n
                    if any(rest[c] for c in closing):
                        continue
                    key = tuple(rest), max(0, flags - n * flag)
                    if cost + sums[n] < after.get(key, 1 << 60):
                        after[key] = cost + sums[n]
            layer = after
        done = [cost for (open_, flags), cost in layer.items() if not any(open_) and flags == 0]
        return min(done, default=None)


def choose(pool: Sequence[Candidate], quotas: Quotas, node_limit: int = NODE_LIMIT) -> Selection:
    """Feasible first, then the least total penalty, then the lexicographically smallest sorted ranks."""
    search = Search(quotas, node_limit)
    try:
        best = search.least(pool, [])
        if best is None:
            return Selection("infeasible")
        chosen: list[Candidate] = []
        rest = sorted(pool, key=lambda c: (c.rank, str(c.id)))
        # by rank alone: a member that fits an optimal completion makes the smallest vector
        for k, c in enumerate(rest):
            if len(chosen) == quotas.slots:
                break
            if search.least(rest[k + 1 :], [*chosen, c]) == best:
                chosen.append(c)
        return Selection("feasible", [c.id for c in chosen], best)
    except Unproven:
        return Selection("infeasible_or_unproven")


def choosable(pool: Sequence[Candidate], quotas: Quotas) -> list[Candidate]:
    """The candidates that an optimal choice can have: of those alike but for their rank, as many of the first as the tightest quota of their cell."""
    seen: dict[tuple, int] = {}
    out = []
    for c in sorted(pool, key=lambda c: (c.rank, str(c.id))):
        key = c.cell, c.penalty, c.flag
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= min(d.get(v, 0) for d, v in zip(quotas.exact, c.cell, strict=True)):
            out.append(c)
    return out


def bounded(pool: DataFrame, limit: int = POOL_LIMIT) -> list:
    """The rows of a pool whose size is checked; a larger one is an error, not a sample."""
    rows = pool.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the eligible pool has more than {limit} rows; narrow it before the exact search")
    return rows


def select_entities(pool: DataFrame, id_col: str, dimensions: list[str], quotas: Quotas, penalty: str = "penalty", flag: str | None = None, seed: str = "20260725", node_limit: int = NODE_LIMIT) -> DataFrame:
    """id_col, status, total_penalty, nth of the chosen entities; one row without an id when there is no proven choice."""
    ranked = pool.select(id_col, *dimensions, F.col(penalty).cast("int").alias("penalty"), seeded_rank(seed, F.col(id_col)).alias("rank"), (F.col(flag) if flag else F.lit(False)).alias("flag"))
    # members alike but for their rank: no choice has more of them than slots, and the smallest ranks win
    alike = Window.partitionBy(*dimensions, "penalty", "flag").orderBy("rank", F.col(id_col).cast("string"))
    ranked = ranked.withColumn("orrery_nth", F.row_number().over(alike)).where(F.col("orrery_nth") <= quotas.slots)
    found = choose(choosable([Candidate(r[id_col], r["penalty"], r["rank"], tuple(str(r[c]) for c in dimensions), r["flag"]) for r in bounded(ranked)], quotas), quotas, node_limit)
    rows = [(m, found.status, found.penalty, k + 1) for k, m in enumerate(found.members)] or [(None, found.status, None, 0)]
    return pool.sparkSession.createDataFrame(rows, f"{id_col} {pool.schema[id_col].dataType.simpleString()}, status string, total_penalty int, nth int")


@dataclass(frozen=True)
class Filing:
    id: object
    entity: object
    role: str  # base, stress, support or control
    penalty: int
    rank: str
    units: frozenset  # of (quota, unit)


def choose_filings(pool: Sequence[Filing], required: Mapping[str, int], base_per_entity: int = 4, base: int = 96, stress: int = 24, total: int = 120, floors: Sequence[object] = (), node_limit: int = NODE_LIMIT) -> Selection:
    """The least (penalty, base count, stress count, sorted ranks) that meets quotas, floors and caps.

    `required`: quota -> distinct units; a unit counts once however many filings witness it.
    `floors`: entities of which each needs a base filing. Depth first over filings in the
    order of their ranks, bounded by the objective so far.
    """
    order = sorted(pool, key=lambda f: (f.rank, str(f.id)))
    best, nodes = None, node_limit
    later: list[dict[str, set]] = [{}]
    bases: list[set] = [set()]
    for f in reversed(order):
        units = {q: set(s) for q, s in later[-1].items()}
        for q, u in f.units:
            units.setdefault(q, set()).add(u)
        later.append(units)
        bases.append(bases[-1] | ({f.entity} if f.role == "base" else set()))
    later.reverse()
    bases.reverse()

    def visit(k: int, chosen: list[Filing], key: tuple[int, int, int], have: dict[str, set], has_base: set) -> None:
        nonlocal best, nodes
        nodes -= 1
        if nodes < 0:
            raise Unproven
        if best is not None and key > best[0][:3]:
            return
        open_ = {q: n - len(have.get(q, ())) for q, n in required.items()}
        if all(n <= 0 for n in open_.values()) and set(floors) <= has_base:
            full = (*key, tuple(f.rank for f in chosen))
            if best is None or full < best[0]:
                best = full, [f.id for f in chosen]
            if any(f.penalty < 0 for f in order):
                raise ValueError("penalties may not be negative")
            return
        if k == len(order) or len(chosen) == total:
            return
        if any(n > 0 and len(later[k].get(q, set()) - have.get(q, set())) < n for q, n in open_.items()) or not set(floors) <= has_base | bases[k]:
            return
        f = order[k]
        n_base, n_stress = sum(c.role == "base" for c in chosen), sum(c.role == "stress" for c in chosen)
        allowed = not (f.role == "base" and (n_base >= base or sum(c.role == "base" and c.entity == f.entity for c in chosen) >= base_per_entity)) and not (f.role == "stress" and n_stress >= stress)
        if allowed:
            more = {q: set(s) for q, s in have.items()}
            for q, u in f.units:
                more.setdefault(q, set()).add(u)
            visit(k + 1, [*chosen, f], (key[0] + f.penalty, key[1] + (f.role == "base"), key[2] + (f.role == "stress")), more, has_base | ({f.entity} if f.role == "base" else set()))
        visit(k + 1, chosen, key, have, has_base)

    try:
        visit(0, [], (0, 0, 0), {}, set())
    except (Unproven, RecursionError):
        return Selection("infeasible_or_unproven")
    return Selection("feasible", best[1], best[0][0]) if best else Selection("infeasible")


def quota_counts(units: DataFrame, quota: str, unit: str, required: Mapping[str, int]) -> DataFrame:
    """quota, achieved (distinct units), required, met; a quota without a unit has 0."""
    spark = units.sparkSession
    want = spark.createDataFrame(list(required.items()), "quota string, required long")
    have = units.groupBy(F.col(quota).alias("quota")).agg(F.count_distinct(unit).alias("achieved"))
    out = want.join(have, "quota", "left")
    out = out.withColumn("achieved", F.coalesce("achieved", F.lit(0)).cast("long"))
    return out.withColumn("met", F.col("achieved") >= F.col("required"))


def cap_usage(filings: DataFrame, entity: str, role: Column, caps: Mapping[str, int]) -> DataFrame:
    """role, total, most_per_entity, cap, over: per-entity maxima and totals by role."""
    by = filings.groupBy(role.alias("role"), F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("role").agg(F.sum("n").alias("total"), F.max("n").alias("most_per_entity"))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("role"))
    return out.withColumn("cap", cap.cast("long")).withColumn("over", F.coalesce(F.col("most_per_entity") > F.col("cap"), F.lit(False)))


def reserves(selected: DataFrame, pool: DataFrame, id_col: str, signature: list[str], rank: Column) -> DataFrame:
    """id_col, reserve, outcome: for each selected entity the first other pool entity in rank order with an equal signature.

    The pool is reduced to two entities a signature first, so one signature may hold any share:
    the second is for a selected entity that is the first itself.
    """
    one = pool.groupBy(*signature, F.col(id_col).alias("reserve")).agg(F.min(rank).alias("rank"))
    first = one.groupBy(*signature).agg(F.min(F.struct("rank", "reserve")).alias("m"))
    second = one.join(first, signature).where(F.col("reserve") != F.col("m.reserve")).groupBy(*signature).agg(F.min(F.struct("rank", "reserve")).alias("m2"))
    two = first.join(second, signature, "left").select(*signature, F.col("m.reserve").alias("first"), F.col("m2.reserve").alias("second"))
    out = selected.join(two, signature, "left").withColumn("reserve", F.when(F.col("first") == F.col(id_col), F.col("second")).otherwise(F.col("first")))
    return out.select(id_col, "reserve", F.when(F.col("reserve").isNull(), "no_compatible_reserve").otherwise("reserve").alias("outcome"))


def first_per_kind(rows: DataFrame, kind: str, order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each kind; the engine limits each group before it is dealt."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("nth") <= n)
