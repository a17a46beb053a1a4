"""Error-rate reports over chunk and sample tables: ratio-of-sums aggregates, pivots, factor grids, box-plot statistics.

Every rate is a ratio of sums and null where its denominator is zero. All functions are lazy and need one shuffle on the
group keys, after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versemill.scratch import written

RATES = ("wer", "sub_rate", "del_rate", "ins_rate", "hal_rate", "del_nl_rate", "del_bv_rate")


def length_of(typ: str) -> Column:
    return F.when(F.col("typ") == typ, F.col("len")).otherwise(0)


def edit_counts(chunks: DataFrame, hallucination: str = "short") -> DataFrame:
    """Adds hit/sub/ins/del lengths, the tagged deletions, and ``hal``: insertions over 10 words, for ``long`` reports also
    substitutions over 10 words."""
    over = lambda typ: F.when(length_of(typ) > 10, F.col("len")).otherwise(0)
    hal = over("ins") if hallucination == "short" else over("ins") + over("sub")
    return chunks.select(
        "*", *[length_of(t).alias(t) for t in ("hit", "sub", "ins", "del")], *[F.when(F.col("typ") == "del", F.col(t)).otherwise(0).alias(f"del_{t}") for t in ("nl", "bv")], hal.alias("hal")
    )


def rates(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds ref_len and the seven rates to summed counts."""
    df = df.withColumn("ref_len", F.col("sub") + F.col("hit") + F.col("del"))
    tops = {"wer": F.col("sub") + F.col("del") + F.col("ins")} | {f"{c}_rate": F.col(c) for c in ("sub", "del", "ins", "hal", "del_nl", "del_bv")}
    return df.select("*", *[(F.try_divide(tops[r] * F.lit(scale), F.col("ref_len"))).alias(r) for r in RATES])


def error_table(chunks: DataFrame, keys: Sequence[str], hallucination: str = "short") -> DataFrame:
    """Sums and rates in percent for each group; ``short`` and ``long`` reports differ in what counts as hallucination."""
    sums = [F.sum(c).alias(c) for c in ("hit", "sub", "ins", "del", "hal", "del_nl", "del_bv")]
    return rates(edit_counts(chunks, hallucination).groupBy(*keys).agg(*sums), 100.0)


def error_pivot(chunks: DataFrame, index: Sequence[str], column: str, values: Sequence, hallucination: str = "short") -> DataFrame:
    """The error table with ``column`` spread out: one column ``<value>_<rate>`` for each listed value and rate."""
    table = error_table(chunks, [*index, column], hallucination)
    return table.groupBy(*index).pivot(column, list(values)).agg(*[F.first(r).alias(r) for r in RATES])


def combined_wer() -> Column:
    """(ins + sub + del) / (hit + sub + del) from typ and len of chunks; a missing typ counts as zero."""
    total = lambda *types: sum((F.sum(length_of(t)) for t in types[1:]), F.sum(length_of(types[0])))
    return F.try_divide(total("ins", "sub", "del").cast("double"), total("hit", "sub", "del"))


def wer_pivot(chunks: DataFrame, index: Sequence[str], column: str, values: Sequence, scale: float = 1.0) -> DataFrame:
    return chunks.groupBy(*index).pivot(column, list(values)).agg((combined_wer() * scale).alias("wer"))


def without_hallucinations(chunks: DataFrame, longest: int = 15) -> DataFrame:
    """Drops inserted and substituted chunks of more than ``longest`` words."""
    return chunks.where(~(F.col("typ").isin("ins", "sub") & (F.col("len") > longest)))


def language_wer(chunks: DataFrame, keys: Sequence[str] = ("audio", "algo", "language")) -> DataFrame:
    return without_hallucinations(chunks).groupBy(*keys).agg(combined_wer().alias("wer"))


def headline(samples: DataFrame, by: str | None = "dataset") -> DataFrame:
    """Totals over all samples and for each group, in one pass: err, len, dur and rates as ratios of sums. The overall row
    has a null group."""
    frame = samples.rollup(by) if by else samples.groupBy()
    sums = frame.agg(*[F.sum(c).alias(c) for c in ("ins", "sub", "del", "hit")], F.sum("duration").alias("dur"), *([F.grouping(by).alias("overall")] if by else []))
    length = F.col("hit") + F.col("sub") + F.col("del")
    top = {"wer": F.col("ins") + F.col("sub") + F.col("del"), "ins_rate": F.col("ins"), "sub_rate": F.col("sub"), "del_rate": F.col("del")}
    return sums.select("*", length.alias("len"), top["wer"].alias("err"), *[F.try_divide(v.cast("double"), length).alias(k) for k, v in top.items()])


def report_totals(samples: DataFrame, by: str = "dataset") -> DataFrame:
    """The summary page's rates (wer, dr, sr, ir); an undefined rate is shown as 0. The overall row has a null group."""
    table = headline(samples, by)
    return table.select(by, "overall", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("wer", "wer"), ("del_rate", "dr"), ("sub_rate", "sr"), ("ins_rate", "ir"))])


def song_totals(samples: DataFrame, keys: Sequence[str] = ("uid", "dataset")) -> DataFrame:
    """Per-song counts and rates, undefined rates 0, sorted by wer, then uid."""
    sums = samples.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("hit", "sub", "del", "ins")])
    ref = F.col("hit") + F.col("sub") + F.col("del")
    rate = lambda top: F.coalesce(F.try_divide(top.cast("double"), ref), F.lit(0.0))
    return sums.select("*", rate(F.col("sub") + F.col("del") + F.col("ins")).alias("wer"), *[rate(F.col(c)).alias(f"{c[0]}r") for c in ("del", "sub", "ins")]).orderBy("wer", keys[0])


def segment_statistics(samples: DataFrame, keys: Sequence[str] = ("dataset", "level"), value: Column | None = None) -> DataFrame:
    """mean, sample standard deviation, min, max and count of the segment length."""
    x = F.col("end") - F.col("start") if value is None else value
    return samples.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count"))


def factor_grid(spark: SparkSession, **factors: Sequence) -> DataFrame:
    """Cartesian product of small literal factor lists, with the position of each label in ``<name>_ord``."""
    frames = [spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{name} string, {name}_ord int") for name, values in factors.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)


def on_grid(table: DataFrame, grid: DataFrame, keys: Sequence[str], stats: Sequence[str], keep_empty: bool = False) -> DataFrame:
    """Reindexes a table to a grid of labels, in its order; rows with all statistics null are dropped unless kept."""
    out = F.broadcast(grid).join(table, list(keys), "left") if keep_empty else grid.join(table, list(keys), "left").dropna("all", subset=list(stats))
    return out


def dataset_summary(samples: DataFrame, by: str = "dataset") -> DataFrame:
    """Distinct songs, minutes, and the shares of non-lexical and backing words in percent."""
    words = F.sum(F.col("hit") + F.col("sub") + F.col("del"))
    share = lambda tag: F.try_divide(100.0 * F.sum(F.col(f"hit_{tag}") + F.col(f"sub_{tag}") + F.col(f"del_{tag}")), words)
    return samples.groupBy(by).agg(F.countDistinct("uid").alias("num_unique_uid"), (F.sum("duration") / 60).alias("total_duration_mins"), share("nl").alias("nl_len_percent"), share("bv").alias("bv_len_percent"))


EXACT_ROWS, BINS, BROADCAST_ROWS = 1_000_000, 4096, 100_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, n, q): the number of values and the interpolated quantiles, as an array, of each group's finite values; nulls are left out.

    Ranks are sought by histograms: each round counts the values between two bounds in BINS bins with their least and
    greatest value, and goes on in the bin of the rank, until that holds one value only, however often. Counts are
    partially aggregated, so no task holds a group; a task holds a few bins of each group at most, whatever its size. The
    column is read once a round, some three times for usual values.
    """
    keys = list(keys)
    told = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    at = F.array(*[F.lit(float(s)) for s in shares])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda s: F.array(F.floor(s * (F.col("n") - 1)), F.ceil(s * (F.col("n") - 1))))))
    now = written(told.select(*keys, "n", F.explode(ranks).alias("rank"), "lo", "hi").withColumn("left", F.col("rank")))
    while not (sought := now.where("lo < hi")).isEmpty():
        few = sought.count() <= BROADCAST_ROWS
        joined = rows.select(*keys, F.col(value).cast("double").alias("_v")).join(F.broadcast(sought) if few else sought, keys).where("_v between lo and hi")
        place = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin")
        bins = joined.groupBy(*keys, "n", "rank", "left", place).agg(F.count("*").alias("here"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        order = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("until", F.sum("here").over(order)).withColumn("before", F.col("until") - F.col("here"))
        found = bins.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("until")))
        now = written(now.where("lo = hi").unionByName(found.select(*keys, "n", "rank", "lo", "hi", (F.col("left") - F.col("before")).alias("left"))))
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "lo")))
    values = now.groupBy(*keys, "n").agg(by_rank.alias("v"))

    def quantile(s: Column) -> Column:
        h = s * (F.col("n") - 1)
        low, high = F.element_at("v", F.floor(h)), F.element_at("v", F.ceil(h))
        return low + (h - F.floor(h)) * (high - low)

    return values.select(*keys, "n", F.transform(at, quantile).alias("q"))


def _meet_groups(rows: DataFrame, groups: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one row of their group. Rows are not shuffled where groups are few, and never those of ``large`` groups,
    which would meet in one task each."""
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys)
    large = F.broadcast(large)
    return rows.join(F.broadcast(groups.join(large, keys, "left_semi")), keys).unionByName(rows.join(large, keys, "left_anti").join(groups, keys))


def boxplot_statistics(samples: DataFrame, keys: Sequence[str], value: str = "wer", reach: float = 1.5, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Quartiles (exact, interpolated), mean, and whiskers: the farthest values within ``reach`` interquartile ranges.

    Groups of up to ``exact_rows`` values have their quartiles from one aggregate, which holds a group's distinct values;
    if any is larger, all come from :func:`exact_quantiles`, with the same result.
    Values meet the bounds of their group where they are; no task sorts a group.
    """
    keys = list(keys)
    shares = (0.25, 0.5, 0.75)
    counted = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    if counted.where(F.col("n") > exact_rows).isEmpty():
        q = samples.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("_q"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    else:
        q = counted.join(exact_quantiles(samples, keys, value, shares).select(*keys, F.col("q").alias("_q")), keys, "left")
    q = written(q.select(*keys, *[F.col("_q")[k].alias(f"q{k + 1}") for k in range(3)], "mean", "n"))
    low, high = F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    bounds = q.select(*keys, low.alias("_low"), high.alias("_high"))
    inside = _meet_groups(samples.select(*keys, value), bounds, q.where(F.col("n") > exact_rows).select(*keys), keys).where(F.col(value).between(F.col("_low"), F.col("_high")))
    whiskers = inside.groupBy(*keys).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return q.join(whiskers, keys, "left")


def best_flags(table: DataFrame, within: Sequence[str], value: str, contenders: Column) -> DataFrame:
    """``best``: whether the row has the least value of its group among the contenders; others are never best."""
    least = F.min(F.when(contenders, F.col(value))).over(Window.partitionBy(*within))
    return table.withColumn("best", F.coalesce(contenders & (F.col(value) == least), F.lit(False)))


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; columns missing on either side are null."""
    return table.unionByName(rows, allowMissingColumns=True)
