"""The shared shapes most operators are made of.

Every kernel keeps a hot key spread over many tasks:

* lookups are reduced to one row per key with map-side partial aggregates before
  they are joined, so a join never multiplies rows;
* ordered work (row numbers, previous row, running sums, carried values) runs per
  *slice* of the order column and is stitched together with one small table of slice
  totals, so that no task ever sorts a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from formspark.session import cut_lineage

SLICE = 1 << 16


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """One row per key: the first one in ``order`` (partial aggregate, no sort)."""
    picked = F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """One row per key: the last one in ``order``."""
    picked = F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that moves both sides by their key. Spark plans by the size of files, and rows
    that are exploded or derived from them may take many times as much: a side that it takes for small
    would pass the driver whole, and is not planned again when it turns out large."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has, for rows that take far more work than their bytes tell: Spark
    cuts files by bytes and row groups, so that a file of many short texts may be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _dealt(df: DataFrame, keys: Sequence[str], slice_by: Column | None, order: Sequence[Column] = (), room: int = 0) -> tuple[DataFrame, Column]:
    """``df`` dealt by its key and slice, and an aggregate that looks at every column.

    Rows and slice totals are two branches over the same rows. The aggregate makes both need the same
    columns, so that Spark moves them once and reuses the exchange; without it the totals would read
    and move their own narrow copy, and every scan on top of another would double what is below.
    ``_slice`` is a struct of keys and slice: it is never NULL, so no branch gets a filter of its own,
    and NULL keys are keys like any other."""
    if slice_by is None:
        df, slice_by = _ranged(df, keys, order), F.col("_range")
    sliced = df.withColumn("_slice", F.struct(*keys, slice_by.alias("_at"))).drop("_range")
    parts = [room * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if room else []
    return sliced.repartition(*parts, "_slice"), _look(sliced)


def _look(df: DataFrame) -> Column:
    """an aggregate that looks at every column"""
    return F.bit_xor(F.xxhash64(*[c for c, kind in df.dtypes if "variant" not in kind and "map<" not in kind])).alias("_seen")


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_range``, the number of the range of (keys, order) that a row falls into. Spark draws the
    bounds from a sample, so ranges hold about as many rows each, however the order values lie, and a
    key has no more slices than there are ranges. The rows are written down: bounds drawn again would differ."""
    # rows of equal order go to one range; ranges follow the order inside a key and between keys
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))


#: Holds for every row; it keeps the aggregate of ``_dealt`` alive.
_SEEN = "_seen >= -9223372036854775807 OR _seen < 0"


def _across(totals: DataFrame, keys: Sequence[str], within: str | None = None) -> tuple[DataFrame, WindowSpec]:
    """slice totals with their keys, and the window over the slices of a key in order"""
    named = totals.select("*", *[F.col(f"_slice.{k}").alias(k) for k in keys if k != within], F.col("_slice._at").alias("_slice_at"))
    return named, Window.partitionBy(*keys).orderBy("_slice_at")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column | None,
    *,
    number: str | None = None,
    previous: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    carried: dict[str, Column] | None = None,
    carried_before: dict[str, Column] | None = None,
    whole: dict[str, Column] | None = None,
    room: int = 0,
    within: str | None = None,
) -> DataFrame:
    """Add ordered columns per key without sorting a whole key in one task.

    ``order`` lists ascending columns that give a total order inside a key (negate a
    number for descending); ``slice_by`` must never decrease along that order, e.g.
    ``floor(ord / 65536)``, a day, or a struct of page and band. Where values lie far apart (hashes,
    timestamps), so that such slices would hold a row each, None cuts the order into ranges of
    about as many rows, at the price of a sample and of writing the rows down.

    number    1-based row number
    previous  value of the column in the previous row (NULL on the first)
    running   inclusive running sum
    carried   last non-NULL value at or before the row
    carried_before  last non-NULL value before the row
    whole     sum over all rows of the key, without a join of its own
    room      keep ``_slice``, by which the rows are dealt, for a scan with ``within``; they go to this many times the
              usual number of tasks, as each may be exploded into many
    within    a last key that parts the slices of such a scan further, into few values each: the rows are not moved
              again, whatever they were exploded into since, only slice totals are
    """
    previous, running, carried, whole = previous or {}, running or {}, carried or {}, whole or {}
    earlier = carried_before or {}
    carried_any = {**carried, **earlier}
    sliced, seen = (df, _look(df)) if within else _dealt(df, keys, slice_by, order, room)
    part = ["_slice", *([within] if within else [])]
    rank = F.struct(*order)
    inside = Window.partitionBy(*part).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)

    totals = [seen, F.count(F.lit(1)).alias("_n")]
    totals += [F.max_by(c, rank).alias(f"_p_{k}") for k, c in previous.items()]
    totals += [F.sum(c).alias(f"_r_{k}") for k, c in running.items()]
    totals += [F.max_by(c, F.when(c.isNotNull(), rank)).alias(f"_c_{k}") for k, c in carried_any.items()]
    totals += [F.sum(c).alias(f"_w_{k}") for k, c in whole.items()]
    named, across = _across(sliced.groupBy(*part).agg(*totals), keys, within)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.select(
        *part, "_seen",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.lag(f"_p_{k}").over(across).alias(f"_p_{k}") for k in previous],
        *[F.sum(f"_r_{k}").over(before).alias(f"_r_{k}") for k in running],
        *[F.last(f"_c_{k}", True).over(before).alias(f"_c_{k}") for k in carried_any],
        *[F.sum(f"_w_{k}").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_w_{k}") for k in whole],
    )

    local = sliced.select("*", F.row_number().over(inside).alias("_rn"),
                          *[F.lag(c).over(inside).alias(f"_lp_{k}") for k, c in previous.items()],
                          *[F.sum(c).over(so_far).alias(f"_lr_{k}") for k, c in running.items()],
                          *[F.last(c, True).over(so_far).alias(f"_lc_{k}") for k, c in carried.items()],
                          *[F.last(c, True).over(past).alias(f"_lc_{k}") for k, c in earlier.items()])
    if within:
        # totals of a slice meet its rows by the slice alone: with ``within`` in the key of the join all rows would move
        held = F.struct(*[c for c in offsets.columns if c not in part])
        offsets = offsets.groupBy("_slice").agg(F.map_from_entries(F.collect_list(F.struct(within, held))).alias("_totals"))
        joined = local.join(offsets, "_slice").select(*local.columns, F.col("_totals")[F.col(within)].alias("_o")).select(*local.columns, "_o.*").where(_SEEN)
    else:
        joined = local.join(offsets, "_slice").where(_SEEN)
    out = []
    if number:
        out.append((F.col("_rn") + F.col("_n")).alias(number))
    out += [F.when(F.col("_rn") == 1, F.col(f"_p_{k}")).otherwise(F.col(f"_lp_{k}")).alias(k) for k in previous]
    out += [(F.coalesce(f"_lr_{k}", F.lit(0)) + F.coalesce(f"_r_{k}", F.lit(0))).alias(k) for k in running]
    out += [F.coalesce(f"_lc_{k}", f"_c_{k}").alias(k) for k in carried_any]
    out += [F.col(f"_w_{k}").alias(k) for k in whole]
    made = {*([number] if number else []), *previous, *running, *carried_any, *whole}
    return joined.select(*[F.col(c) for c in df.columns if c not in made], *out, *([F.col("_slice")] if room else []))


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column | None,
    previous: dict[str, Column],
    starts: Column,
    current: Sequence[str],
    name: str = "island",
    count: str | None = None,
) -> DataFrame:
    """Number the runs of each key: a run starts on the first row and wherever ``starts``
    holds. ``starts`` may use the ``previous`` columns (NULL on the first row, kept in the
    result) and the ``current`` columns of the row. ``count`` names a column for the number of rows of the key.

    Rows are compared and counted inside their slice; only the first row of a slice meets
    the last row of the slice before, in the small table of slice totals.
    """
    inside = Window.partitionBy("_slice").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    sliced, seen = _dealt(df, keys, slice_by, order)
    local = sliced.select(
        "*", F.row_number().over(inside).alias("_rn"), *[F.lag(c).over(inside).alias(k) for k, c in previous.items()])
    local = local.withColumn("_start", F.when(F.col("_rn") == 1, 0).otherwise(begins))
    local = local.withColumn("_runs", F.sum("_start").over(so_far))

    totals = local.groupBy("_slice").agg(
        seen, F.sum("_start").alias("_sum"), *[F.max_by(c, F.col("_rn")).alias(f"_last_{k}") for k, c in previous.items()],
        *[F.min_by(c, "_rn").alias(f"_now_{c}") for c in current], *([F.count(F.lit(1)).alias("_rows")] if count else []))
    named, across = _across(totals, keys)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    firsts = named.select("_slice", "_slice_at", *keys, "_seen", "_sum", F.row_number().over(across).alias("_sn"),
                           *[F.col(f"_now_{c}").alias(c) for c in current if c not in keys],
                           *[F.lag(f"_last_{k}").over(across).alias(k) for k in previous],
                           *([F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows")] if count else []))
    firsts = firsts.withColumn("_first", F.when(F.col("_sn") == 1, 1).otherwise(begins))
    offsets = firsts.select("_slice", "_seen", *(["_rows"] if count else []), *[F.col(k).alias(f"_prior_{k}") for k in previous],
                            (F.coalesce(F.sum(F.col("_sum") + F.col("_first")).over(before), F.lit(0)) + F.col("_first")).alias("_base"))
    out = local.join(offsets, "_slice").where(_SEEN)
    kept = [c for c in df.columns if c not in (name, count) and c not in previous]
    return out.select(*kept, *[F.when(F.col("_rn") == 1, F.col(f"_prior_{k}")).otherwise(F.col(k)).alias(k) for k in previous],
                      (F.col("_base") + F.col("_runs")).alias(name), *([F.col("_rows").alias(count)] if count else []))


def ranked_join(
    left: DataFrame,
    left_id: Sequence[str],
    attempts: Sequence[tuple[int, str, Column]],
    right: DataFrame,
    right_keys: Sequence[tuple[str, Column]],
    right_cols: Sequence[str],
    right_order: Sequence[str],
    scope: Sequence[str] = (),
    last_wins: bool = False,
    rank_name: str = "match_rank",
    how: str = "left",
    rounds: Sequence[Sequence[int]] = (),
    passing: Sequence[int] = (),
) -> DataFrame:
    """Try ordered lookups and keep the first that hits, in one equi-join.

    ``attempts`` are (rank, index, key) on the left, ``right_keys`` are (index, key) on
    the right. Each index holds one row per key (first or last in ``right_order``), so
    the join cannot multiply rows and a hot key meets a single right row.

    ``rounds`` are lists of ranks, one after the other: the first hit of a round ends it, and counts
    only if its rank is in ``passing``; else the next round is tried.
    """
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("_idx"), k.alias("_key")) for i, k in right_keys])).alias("_e")
    index = right.select(*scope, *right_order, *[c for c in right_cols if c not in right_order], entry)
    index = index.select("*", "_e._idx", "_e._key").drop("_e").where(F.col("_key") != "")
    pick = last_by if last_wins else first_by
    hit_cols = [F.col(c).alias(f"_v_{c}") for c in right_cols]
    index = pick(index.select(*scope, "_idx", "_key", *right_order, *hit_cols), [*scope, "_idx", "_key"], right_order,
                 [f"_v_{c}" for c in right_cols])
    tries = F.explode(F.array(*[
        F.struct(F.lit(r).alias("_rank"), F.lit(i).alias("_idx"), k.alias("_key")) for r, i, k in attempts
    ])).alias("_e")
    ids = [*scope, *[c for c in left_id if c not in scope]]
    probe = left.select(*ids, tries).select(*ids, "_e.*").where(F.col("_key") != "")
    hits = probe.join(by_key(index), [*scope, "_idx", "_key"])
    hit = F.struct("_rank", *[f"_v_{c}" for c in right_cols])
    if rounds:
        ends = [F.min_by(hit, F.when(F.col("_rank").isin(*ranks), F.col("_rank"))).alias(f"_end_{n}") for n, ranks in enumerate(rounds)]
        kept = [F.when(F.col(f"_end_{n}._rank").isin(*passing), F.col(f"_end_{n}")) for n in range(len(rounds))]
        best = hits.groupBy(*ids).agg(*ends).select(*ids, F.coalesce(*kept).alias("_hit")).where(F.col("_hit").isNotNull())
    else:
        best = hits.groupBy(*ids).agg(F.min_by(hit, "_rank").alias("_hit"))
    best = best.select(*ids, F.col("_hit._rank").alias(rank_name),
                       *[F.col(f"_hit._v_{c}").alias(c) for c in right_cols])
    return left.join(by_key(best), ids, how)


def carry_above(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, slice_by: Column,
                values: dict[str, Column], ties: Sequence[str] = ()) -> DataFrame:
    """As-of join: for each point and each of ``values`` the value (where it is not NULL) of the
    mark with the greatest ``at`` strictly below the point's ``at``. (``at`` ascends in reading
    order: strictly above on a page is a smaller ``-y``.) Of marks at the same place the greatest
    in ``ties`` wins. All values are carried in one scan."""
    cols = points.columns
    tagged = points.select(*cols, F.lit(0).alias("_kind"), *[F.lit(None).cast(marks.schema[t].dataType).alias(f"_t_{t}") for t in ties])
    flat = marks.select(*keys, at, F.lit(1).alias("_kind"), *[F.col(t).alias(f"_t_{t}") for t in ties], *[c.alias(f"_m_{n}") for n, c in values.items()])
    both = tagged.unionByName(flat, allowMissingColumns=True)
    # points sort before marks at the same place, which makes the comparison strict
    order = [F.col(at), F.col("_kind"), *[F.col(f"_t_{t}") for t in ties]]
    scanned = ordered_scan(both, keys, order, slice_by, carried={n: F.col(f"_m_{n}") for n in values})
    return scanned.where(F.col("_kind") == 0).select(*cols, *values)


def ancestors(path: Column) -> Column:
    """Every proper container of a path: cut before each ``.`` or ``[``."""
    cut = F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.when(
        (i > 1) & F.substring(path, i, F.lit(1)).isin(".", "["), F.substring(path, F.lit(1), i - 1)))
    return F.when(F.length(path) > 0, F.array_distinct(F.filter(cut, lambda p: p.isNotNull())))


def suffixes(path: Column, at_least: int = 2) -> Column:
    """Every trailing run of dot segments, as (segments, text), longest included."""
    parts = F.split(path, r"\.")
    size = F.size(parts)
    return F.when(size >= at_least, F.transform(F.sequence(F.lit(at_least), size), lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice(parts, size - n + 1, n), ".").alias("text"))))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (u, v: bigint); the label is the least node that is joined to it.

    Labels move to the least label next to a node and then to that label's own label, so rounds grow
    as the logarithm of a chain's length. Each round is materialised; only a flag reaches the driver.
    """
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        near = cut_lineage(labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("least")))
        # a node's former label hears of the better one too
        heard = near.select("node", "least").unionByName(near.select(F.col("label").alias("node"), "least")).groupBy("node").agg(F.min("least").alias("label"))
        heard = cut_lineage(heard)
        jumped = cut_lineage(heard.join(heard.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("node", F.least("label", "top").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped
        if not changed:
            return labels
