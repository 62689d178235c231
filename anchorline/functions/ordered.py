"""Ranks, running totals and exact quantiles that never put a whole group into one task.

A window partitioned by group alone sends a group holding a third of the table to one task. Here the
order key is cut into buckets first. The cuts come from the whole table, so a (group, bucket) cell
holds about 1/buckets of all rows however the groups are sized. Each cell is ranked or summed on its
own, and the totals of the earlier cells of the group (at most ``buckets`` rows) are added. The cuts
are approximate, the result is exact: any cuts give the same answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from anchorline.session import cut_lineage, stored_small

BUCKET = "__bucket"
CELL = "__cell"  # group and bucket in one struct, so that rows with a null group have a cell like all others
HEX_DIGITS, LEAST_BUCKETS, ROWS_PER_BUCKET = 8, 256, 200_000


def with_order_bucket(df: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """Add the number of cuts that are <= ``order``; ``buckets`` is a power of two."""
    fractions = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(order, fractions, 10 * buckets)).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length() - 1))])

    def advance(low: Column, step: Column) -> Column:
        return F.when(F.get("__cuts", low + step - 1) <= F.col(order), low + step).otherwise(low)

    return (
        df.withColumn("__cuts", cuts)
        .withColumn(BUCKET, F.aggregate(steps, F.lit(0), advance))
        .drop("__cuts")
    )


SAMPLED_PER_BUCKET = 100
TIE_PARTS = 64


def with_tie_bucket(df: DataFrame, order: str, tie: str) -> DataFrame:
    """A bucket that preserves (order, tie), of stored rows; ``tie`` is a number.

    The number of cuts follows that of the rows; they are taken from a bounded sample of about SAMPLED_PER_BUCKET rows
    a bucket. A value that several cuts fall on holds more than a bucket's share: its rows are cut again by ``tie``,
    into TIE_PARTS parts for every such cut, and what follows it in its bucket comes after them.
    """
    n = df.count()
    buckets = max(LEAST_BUCKETS, 1 << max(0, (n // ROWS_PER_BUCKET)).bit_length())
    sample = df.sample(min(1.0, SAMPLED_PER_BUCKET * buckets / max(n, 1)), 11)
    fractions = [i / buckets for i in range(1, buckets)]
    cuts = sample.agg(F.percentile_approx(order, fractions, 10 * buckets)).first()[0] or []
    hot = [v for v, times in Counter(cuts).items() if times > 1]
    kind = df.schema[order].dataType
    ends = [_literal(v, kind) for v in sorted(set(cuts))]
    bucketed = _bucketed(df, order, ends)
    if not hot:
        return bucketed
    each = {v: TIE_PARTS * times for v, times in Counter(cuts).items() if times > 1}
    most = max(each.values())
    shares = [i / most for i in range(1, most)]
    inside = sample.where(F.col(order).isin([_literal(v, kind) for v in hot])).groupBy(order).agg(F.percentile_approx(tie, shares, 10 * most).alias("cuts"))
    found = {r[0]: sorted(set(r["cuts"])) for r in inside.collect()}
    ties = F.create_map(*[x for v, some in found.items() for x in (_literal(v, kind), F.array(*map(F.lit, some)))])
    # the hot value is the lower end of its bucket
    low = F.get(F.array(*ends), F.col(BUCKET) - 1)
    own = F.size(F.filter(F.element_at(ties, low), lambda c: c <= F.col(tie)))
    part = F.when(F.element_at(ties, low).isNull(), 0).when(F.col(order) == low, own).otherwise(most)
    return bucketed.withColumn(BUCKET, F.col(BUCKET) * (most + 1) + F.coalesce(part, F.lit(0)))


def _literal(value: object, kind: T.DataType) -> Column:
    """A collected value as a literal; times go as text, as a literal time would be moved to a zone."""
    return F.lit(str(value) if isinstance(value, date) else value).cast(kind)


def _bucketed(df: DataFrame, order: str, cuts: list[Column]) -> DataFrame:
    """The number of cuts that are <= ``order``, found by halving."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    size = 1 << len(cuts).bit_length()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length() - 1))])
    held = F.array(*cuts)

    def advance(low: Column, step: Column) -> Column:
        return F.when(F.get(held, low + step - 1) <= F.col(order), low + step).otherwise(low)

    return df.withColumn(BUCKET, F.aggregate(steps, F.lit(0), advance))


def with_hash_bucket(df: DataFrame, ids: Sequence[str], seed: int | str) -> DataFrame:
    """Add the md5 sort key ``__hash`` of the ids and, as the bucket, its leading digits scaled to a number of
    buckets that follows the number of rows. Ids are separated by a bar; a null id counts as an empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]
    text = F.concat(F.concat_ws("|", *parts), F.lit(str(seed)))
    buckets = F.greatest(F.lit(LEAST_BUCKETS), df.agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET)).scalar())
    digits = F.conv(F.substring("__hash", 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)
    return df.withColumn("__hash", F.md5(text)).withColumn(BUCKET, F.floor(digits * buckets).cast("long"))


def _with_cell(bucketed: DataFrame, group: Sequence[str]) -> DataFrame:
    return bucketed.withColumn(CELL, F.struct(*group, BUCKET))


def _earlier_cells(cells: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals of the earlier buckets and of the whole group, over one small row per cell."""
    keys = [F.col(f"{CELL}.{g}") for g in group] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(f"{CELL}.{BUCKET}").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return cells.select(
        CELL,
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )


def _attach(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Join per-cell values back. The cell struct is never null, and equality on it keeps the hash partitioning of the
    cell windows, so only the small side moves and rows with a null group stay."""
    return df.join(cells, CELL).drop(CELL)


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    descending: bool = False,
    buckets: int = 256,
) -> DataFrame:
    """Add inclusive running totals of ``sums`` (output name -> column), and ``<name>_total``.

    ``order`` must be unique within a group; callers pre-aggregate by (group, order) first.
    """
    bucketed = with_order_bucket(df, order, buckets)
    if descending:
        bucketed = bucketed.withColumn(BUCKET, -F.col(BUCKET))
    bucketed = _with_cell(bucketed, group)
    cells = bucketed.groupBy(CELL).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = (
        Window.partitionBy(CELL)
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = bucketed.withColumns({f"__in_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    joined = _attach(within, _earlier_cells(cells, group, list(sums)))
    return joined.withColumns({n: F.col(f"__in_{n}") + F.col(f"{n}_before") for n in sums}).drop(
        BUCKET, *[f"__in_{n}" for n in sums], *[f"{n}_before" for n in sums]
    )


def row_numbers(
    bucketed: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Exact ``row_number`` per group of a frame that already carries an order-preserving bucket."""
    bucketed = _with_cell(bucketed, group)
    cells = bucketed.groupBy(CELL).agg(F.count(F.lit(1)).alias("__n"))
    within = bucketed.withColumn("__in", F.row_number().over(Window.partitionBy(CELL).orderBy(*order)))
    joined = _attach(within, _earlier_cells(cells, group, ["__n"]))
    joined = joined.withColumn(name, F.col("__in") + F.col("__n_before"))
    if total:
        joined = joined.withColumn(total, F.col("__n_total"))
    return joined.drop(BUCKET, "__in", "__n_before", "__n_total")


def hash_ranks(
    df: DataFrame,
    ids: Sequence[str],
    seed: int | str,
    group: Sequence[str] = (),
    at_most: int | None = None,
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Rank rows of each group by md5 of their ids: a seeded shuffle that any engine can repeat.

    With ``at_most`` only rows of buckets that can still hold such a rank are ranked, so a sample of
    n rows shuffles about n rows and not the table.
    """
    bucketed = with_hash_bucket(df, ids, seed)
    order = ["__hash", *ids]
    if at_most is None:
        return row_numbers(bucketed, group, order, name, total).drop("__hash")
    bucketed = _with_cell(bucketed, group)
    cells = bucketed.groupBy(CELL).agg(F.count(F.lit(1)).alias("__n"))
    cells = _earlier_cells(cells, group, ["__n"]).where(F.col("__n_before") < at_most)
    ranked = (
        bucketed.join(cells, CELL)
        .withColumn(name, F.row_number().over(Window.partitionBy(CELL).orderBy(*order)) + F.col("__n_before"))
        .where(F.col(name) <= at_most)
        .drop(CELL)
    )
    if total:
        ranked = ranked.withColumn(total, F.col("__n_total"))
    return ranked.drop(BUCKET, "__hash", "__n_before", "__n_total")


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-null value of a group: what quantiles and moments need."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _picks(running: DataFrame, group: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of rows (group, value, whole, upto), and whether all came from ``whole`` rows.

    A row that is not ``whole`` stands for several values and only keeps their number.
    """
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("upto_total") - 1)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("upto") > index, F.struct("value", "whole"))).alias(f"__{name}_{side}"))
    found = running.groupBy(*group).agg(F.max("upto_total").alias("__n"), *picks)
    out, sound = [], F.lit(True)
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.col(f"__{name}_lo.value"), F.col(f"__{name}_hi.value")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
        sound = sound & F.col(f"__{name}_lo.whole") & F.col(f"__{name}_hi.whole")
    return found.select(*group, *out, sound.alias("__sound"))


def quantiles_of_counts(
    counts: DataFrame, group: Sequence[str], probabilities: Mapping[str, float], buckets: int = 256
) -> DataFrame:
    """Exact linearly interpolated quantiles per group of a (group, value, n) table."""
    running = running_sums(counts.withColumn("whole", F.lit(True)), group, "value", {"upto": "n"}, buckets=buckets)
    return _picks(running, group, probabilities).drop("__sound")


SAMPLE_VALUES = 200_000  # values that the brackets are taken from, over all groups
DEVIATIONS, SPARE = 5.0, 3  # half width of a bracket: standard errors of a rank in the sample, and places


def _brackets(sampled: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Per cell the sampled values between which each quantile is all but certain to lie; null where open."""
    m = F.size("__values")
    ends = []
    for i, p in enumerate(probabilities):
        reach = DEVIATIONS * F.sqrt(m * (p * (1 - p))) + SPARE
        low, high = F.floor(p * (m - 1) - reach).cast("int"), F.ceil(p * (m - 1) + reach).cast("int")
        ends.append(F.when(low >= 0, F.get("__values", low)).alias(f"__low{i}"))
        ends.append(F.when(high < m, F.get("__values", high)).alias(f"__high{i}"))
    return sampled.groupBy(CELL).agg(F.sort_array(F.collect_list("value")).alias("__values")).select(CELL, *ends)


def bracketed_counts(rows: DataFrame, brackets: DataFrame, number: int) -> DataFrame:
    """Counts per cell and value inside the brackets; what lies between two brackets is counted as one row, which
    stands at its least value and is not ``whole``. Tasks send values inside the brackets and a few numbers per cell."""
    value = F.col("value")
    joined = rows.join(brackets, CELL, "left")
    below = [F.coalesce(value < F.col(f"__low{i}"), F.lit(False)) for i in range(number)]
    above = [F.coalesce(value > F.col(f"__high{i}"), F.lit(False)) for i in range(number)]
    inside = F.lit(False)
    for b, a in zip(below, above, strict=True):
        inside = inside | ~(b | a)
    zone = sum((a.cast("int") for a in above), F.lit(0))
    keyed = joined.select(
        CELL, "value", inside.alias("whole"), F.when(inside, -1).otherwise(zone).alias("__zone"),
        F.when(inside, value).alias("__value"),
    )
    counts = keyed.groupBy(CELL, "whole", "__zone", "__value").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    return counts.drop("__zone", "__value")


def exact_quantiles(
    long: DataFrame, group: Sequence[str], value: str, probabilities: Mapping[str, float], sample_values: int = SAMPLE_VALUES,
    seed: int = 7,
) -> DataFrame:
    """Exact linearly interpolated quantiles of the non-null values per group; groups without values are left out.

    A bounded sample brackets every quantile. One pass counts the values outside the brackets where they lie and sends
    only those inside, a share of about 10 standard errors a quantile. The counts prove whether the brackets held; the
    groups in which one did not are counted again in full. Few values are counted in full at once. ``long`` is read
    three times, so callers store it if it is dear.
    """
    order = dict(sorted(probabilities.items(), key=lambda x: x[1]))
    rows = long.where(F.col(value).isNotNull()).select(F.struct(*group).alias(CELL), F.col(value).alias("value"))
    n = rows.count()
    names = [F.col(f"{CELL}.{g}").alias(g) for g in group]

    def found(counts: DataFrame) -> DataFrame:
        stored = cut_lineage(counts.select(*names, "value", "n", "whole"))
        return _picks(running_sums(stored, group, "value", {"upto": "n"}), group, order)

    def in_full(some: DataFrame) -> DataFrame:
        return some.groupBy(CELL, "value").agg(F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(True))

    if n <= sample_values:
        return found(in_full(rows)).select(*group, *probabilities)
    brackets = stored_small(_brackets(rows.sample(sample_values / n, seed), list(order.values())))
    first = cut_lineage(found(bracketed_counts(rows, brackets, len(order))))
    missed = first.where(~F.col("__sound")).select(F.struct(*group).alias(CELL))
    if missed.isEmpty():
        return first.select(*group, *probabilities)
    again = found(in_full(rows.join(stored_small(missed), CELL, "left_semi")))
    return first.where("__sound").unionByName(again).select(*group, *probabilities)
