"""Graph patterns over edge DataFrames (src, dst, properties).

Every pattern is a chain of equi-joins; EXISTS is a left semi join, OPTIONAL a left join.  Lists are cut
by rank before they are collected, so no entity, however many rows it has, fills a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import materialize

#: Order states that do not count as active.
INACTIVE = ("discontinued", "hold")


def hop(rows: DataFrame, edges: DataFrame, at: str, to: str, optional: bool = False, reverse: bool = False) -> DataFrame:
    """[J07, J08] Follow ``edges`` from column ``at``; the other end becomes ``to``, properties come along."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    step = edges.withColumnsRenamed({here: "__from", there: to})
    return rows.join(step, F.col(at) == F.col("__from"), "left" if optional else "inner").drop("__from")


def active(state: Column, inactive: tuple[str, ...] = INACTIVE) -> Column:
    """Not in an inactive state; a null state is not active either."""
    return ~state.isin(*inactive)


def having(rows: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """[J11] Rows for which ``evidence`` has the same keys."""
    return rows.join(evidence.select(*keys), keys, "left_semi")


def lacking(rows: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """[J18] Rows for which ``evidence`` has no such keys."""
    return rows.join(evidence.select(*keys), keys, "left_anti")


#: Rows of values that a task folds and sorts where their number is known.
ROWS_A_TASK = 400_000
#: Tasks that the values of one owner are dealt to there: enough for a hot owner, few enough for ranks to be cut.
OWNER_PARTS = 16


def _once(rows: DataFrame, owner: str, expected: int | None) -> DataFrame:
    """Distinct ``rows``.  Where they seldom repeat and about so many are ``expected``, they are dealt to so many tasks as they come.

    Folding them before the shuffle would hold nearly all rows of a task, and the optimizer joins the partitions
    of such a shuffle until there are few tasks: what one holds then grows with the input.
    """
    if expected is None:
        return rows.distinct()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, expected // ROWS_A_TASK + 1)
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(OWNER_PARTS)))
    return dealt.repartition(tasks, owner, "__part").distinct().drop("__part")


def collected(rows: DataFrame, owner: str, limits: dict[str, int], expected: int | None = None) -> DataFrame:
    """[A01, A02, A20] (owner, lists): for each column named, the first so many distinct values, sorted.

    A row has a value in one of the columns at most (``unionByName(allowMissingColumns=True)`` makes such
    rows); nulls are skipped.  Repeats are folded and ranks cut map-side before anything is collected;
    ``expected``: see ``_once``.
    """
    names = list(limits)
    once = _once(rows.select(owner, *names), owner, expected)
    which = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])
    place = F.row_number().over(Window.partitionBy(owner, "__which").orderBy(*names))
    ranked = once.withColumn("__which", which).where("__which is not null").withColumn("__place", place).where(F.col("__place") <= max(limits.values()))
    kept = ranked.where(F.col("__place") <= F.element_at(F.array(*map(F.lit, limits.values())), F.col("__which") + 1))
    return kept.groupBy(owner).agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in names])


#: Rows of an owner beyond which they are not one task's work.
HOT_ROWS = 100_000


def hot_apart(rows: DataFrame, owner: str, counted: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of usual owners, and of those that have over HOT_ROWS in one of the ``counted`` tables (None: there are none).

    There are few hot owners, as each has so many rows, so they are broadcast.
    """
    hot = together(*[t.groupBy(owner).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS).select(owner) for t in counted]).distinct()
    hot = materialize(hot)
    if not hot.count():
        return rows, None
    return rows.join(F.broadcast(hot), owner, "left_anti"), rows.join(F.broadcast(hot), owner, "left_semi")


#: Columns that values of many lists share, in the order in which they are compared.
SLOTS = {"s0": "string", "d0": "double", "l0": "bigint", "l1": "bigint", "s1": "string", "s2": "string"}


def slotted(which: int, when: Column | None = None, **values: Column) -> Column:
    """A value of the list numbered ``which`` as one narrow struct; null where ``when`` is not true or all are null."""
    made = F.struct(F.lit(which).alias("which"), *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in SLOTS.items()])
    only = next(iter(values.values())).isNotNull() if len(values) == 1 else F.lit(True)
    return F.when(only if when is None else when & only, made)


def collected_slots(rows: DataFrame, owner: str, lists: dict[str, tuple[int, dict[str, str]]]) -> DataFrame:
    """[A01, A02, A20] ``collected`` for values in SLOTS: (owner, which, slots) rows, ``which`` numbering ``lists``.

    ``lists``: name to (limit, field to slot); a list of one field has its values, others structs.  One sort key,
    however many lists there are.
    """
    slots = list(SLOTS)
    once = rows.select(owner, "which", *slots).distinct()
    place = F.row_number().over(Window.partitionBy(owner, "which").orderBy(*slots))
    limit = F.element_at(F.array(*[F.lit(n) for n, _ in lists.values()]), F.col("which") + 1)
    most = max(n for n, _ in lists.values())
    kept = once.withColumn("__place", place).where(F.col("__place") <= most).where(F.col("__place") <= limit)

    def value(fields: dict[str, str]) -> Column:
        parts = [F.col(slot).alias(field) for field, slot in fields.items()]
        return parts[0] if len(parts) == 1 else F.struct(*parts)

    return kept.groupBy(owner).agg(*[F.array_sort(F.collect_list(F.when(F.col("which") == i, value(fields)))).alias(name) for i, (name, (_, fields)) in enumerate(lists.items())])


def listed(rows: DataFrame, owner: str, value: Column | list[Column], limit: int, name: str = "v") -> DataFrame:
    """[A01, A02] (owner, list) of one kind of value; several columns make a struct."""
    packed = F.struct(*value) if isinstance(value, list) else value
    return collected(rows.select(owner, packed.alias(name)), owner, {name: limit})


def with_lists(entities: DataFrame, key: str, rows: DataFrame, owner: str, limits: dict[str, int], expected: int | None = None) -> DataFrame:
    """[C01-C11, A20] ``entities`` with all lists of ``collected``; an empty list where there is none."""
    lists = collected(rows, owner, limits, expected).withColumnRenamed(owner, "__key")
    out = entities.join(lists, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumns({n: F.coalesce(F.col(n), F.array().cast(dict(out.dtypes)[n])) for n in limits})


def with_counts(entities: DataFrame, key: str, rows: DataFrame, owner: str, names: list[str], expected: int | None = None) -> DataFrame:
    """[A15] ``entities`` with ``n_<name>``: how many distinct values the rows of ``collected`` have in each column, none left out.

    Nothing is collected, so an owner with most of the values is only rows; ``expected``: see ``_once``.
    """
    counts = _once(rows.select(owner, *names), owner, expected).groupBy(F.col(owner).alias("__key")).agg(*[F.count(n).alias(f"n_{n}") for n in names])
    out = entities.join(counts, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.na.fill(0, [f"n_{n}" for n in names])


def together(*frames: DataFrame) -> DataFrame:
    """Rows of several frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def diamond(orders: DataFrame, links: DataFrame) -> DataFrame:
    """[J12] Pairs of linked items that the same owner has both, one row for each pair of orders.

    orders(owner, item, state), links(item_a, item_b, properties); inactive orders do not count.
    """
    live = orders.where(active(F.col("state"))).select("owner", "item")
    first = live.join(links, live["item"] == links["item_a"]).drop("item")
    second = live.select(F.col("owner").alias("__owner"), F.col("item").alias("__item"))
    return first.join(second, (F.col("owner") == F.col("__owner")) & (F.col("item_b") == F.col("__item"))).drop("__owner", "__item")


def paths(edges: DataFrame, depth: int) -> DataFrame:
    """[J16] (src, dst, hops, path): all directed paths of 1 to ``depth`` edges; no edge repeats in a path."""
    step = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    level = edges.select("src", "dst", F.lit(1).alias("hops"), F.array("src", "dst").alias("path"))
    levels = [level]
    for n in range(2, depth + 1):
        longer = level.join(step, F.col("dst") == F.col("__src"))
        pairs = F.arrays_zip(F.slice(F.col("path"), F.lit(1), F.size("path") - 1), F.slice(F.col("path"), F.lit(2), F.size("path") - 1))
        repeated = F.exists(pairs, lambda p: (p["0"] == F.col("__src")) & (p["1"] == F.col("__dst")))
        level = longer.where(~repeated).select("src", F.col("__dst").alias("dst"), F.lit(n).alias("hops"), F.concat("path", F.array("__dst")).alias("path"))
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def journey(edge_tables: dict[str, DataFrame]) -> DataFrame:
    """[C37] (src, relation, dst) over edge tables of every type."""
    out = None
    for relation, edges in edge_tables.items():
        typed = edges.select(F.col("src").cast("string").alias("src"), F.lit(relation).alias("relation"), F.col("dst").cast("string").alias("dst"))
        out = typed if out is None else out.unionByName(typed)
    return out


def two_hops(rows: DataFrame, first: DataFrame, second: DataFrame, at: str, middle: str, to: str) -> DataFrame:
    """[J09] From ``at`` over ``first`` to ``middle`` and over ``second`` to ``to``."""
    return hop(hop(rows, first, at, middle), second.select("src", "dst"), middle, to)


def restricted(rows: DataFrame, key: str, wanted: DataFrame | list) -> DataFrame:
    """Rows whose key is wanted: a short list becomes a pushed filter, a table a semi join."""
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select(key), key, "left_semi")
    return rows.where(F.col(key).isin(wanted))


def without(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without ``columns``, which the scan then does not read."""
    return rows.drop(*columns)


def listed_in_order(rows: DataFrame, owner: str, value: Column, order: Column, limit: int, name: str = "v") -> DataFrame:
    """[A03, O05] (owner, list): the first ``limit`` values by ``order``, repeats included."""
    placed = rows.select(owner, order.alias("__order"), value.alias("__value"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy("__order", "__value"))
    first = placed.withColumn("__place", place).where(F.col("__place") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct("__place", "__value")))
    return first.groupBy(owner).agg(F.transform(pairs, lambda p: p["__value"]).alias(name))


def involved(*ids: Column) -> Column:
    """[O07, U05] The distinct ids of several lists and values, sorted; nulls are left out."""
    return F.array_sort(F.array_compact(F.array_distinct(F.concat(*ids))))


def history(rows: DataFrame, owner: str, order: list[str], previous: str | None = None, size: Column | None = None) -> DataFrame:
    """[W01, W05] ``rows`` with ``step`` (place in the owner's history), ``previous`` (that column's value one
    step before) and ``used`` (sum of ``size`` so far), as far as they are asked for.

    Two levels, so that an owner with most of the rows is not one task's work: rows are dealt to ranges of
    (owner, order), each range is numbered alone, and what lies before it is added.  A range begins
    inside one owner at most, so what is added is at most a row for each range, and is broadcast.
    """
    sized = rows.withColumns({"__size": size if size is not None else F.lit(0)})
    ranged = materialize(sized.repartitionByRange(owner, *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy(owner, "__range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by(F.struct(F.col(previous or owner).alias("v")), F.struct(*order))
    parts = ranged.groupBy(owner, "__range").agg(F.count("*").alias("n"), F.sum("__size").alias("s"), last.alias("last"))
    before = Window.partitionBy(owner).orderBy("__range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col(owner).alias("__owner"), F.col("__range").alias("__at"), F.sum("n").over(earlier).alias("__n"), F.sum("s").over(earlier).alias("__s"), F.lag("last").over(before).alias("__last"))
    starts = starts.where("__n is not null")
    met = ranged.withColumns({"__step": F.row_number().over(inside), "__used": F.sum("__size").over(so_far), "__lag": F.lag(F.struct(F.col(previous or owner).alias("v"))).over(inside)})
    met = met.join(F.broadcast(starts), F.col(owner).eqNullSafe(F.col("__owner")) & (F.col("__range") == F.col("__at")), "left")
    wanted = {"step": (F.col("__step") + F.coalesce("__n", F.lit(0))).cast("int")}
    if previous:
        wanted["previous"] = F.coalesce("__lag", "__last")["v"]
    if size is not None:
        wanted["used"] = F.coalesce("__used", F.lit(0)) + F.coalesce("__s", F.lit(0))
    return met.select(*rows.columns, *[c.alias(n) for n, c in wanted.items()])


def lifecycle(events: DataFrame, owner: str, order: str, kind: str = "event_type") -> DataFrame:
    """[W05] ``step``, the event's place in its owner's history, and ``previous`` type (null at first)."""
    return history(events, owner, [order], previous=kind)
