"""Ordered sequences in long form: one row per element (item, pos, onset, dur, pitch), no state outside window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def by(item: str, *order: str | Column) -> Window:
    return Window.partitionBy(item).orderBy(*order)


def centred_mean(x: Column, w: Window, half: int, least: int) -> Column:
    """Mean over a centred frame, null with fewer than ``least`` values."""
    f = w.rowsBetween(-half, half)
    return F.when(F.count(x).over(f) >= least, F.avg(x).over(f))


def centred_median(x: Column, w: Window, half: int, least: int) -> Column:
    """Median over a centred frame, null with fewer than ``least`` values."""
    f = w.rowsBetween(-half, half)
    return F.when(F.count(x).over(f) >= least, F.percentile(x, F.lit(0.5)).over(f))


def interpolate(df: DataFrame, item: str, order: str, value: str, most: int) -> DataFrame:
    """Fills gaps between two known values linearly by position: the first ``most`` places of a gap, never outside the known range."""
    w = by(item, order)
    pos = F.row_number().over(w)
    d = df.withColumn("__p", pos)
    known = F.when(F.col(value).isNotNull(), F.struct("__p", value))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumns({"__b": before, "__a": after})
    gap = F.col("__p") - F.col("__b.__p")
    line = F.col(f"__b.{value}") + (F.col(f"__a.{value}") - F.col(f"__b.{value}")) * gap / (F.col("__a.__p") - F.col("__b.__p"))
    filled = F.coalesce(F.col(value), F.when((gap <= most) & F.col("__a").isNotNull(), line))
    return d.withColumn("filled", filled).drop("__p", "__b", "__a")


def runs(df: DataFrame, item: str, order: Sequence[str | Column], value: Column) -> DataFrame:
    """Adds ``run``: the number of the run of equal consecutive values (nulls equal nulls) within the item."""
    w = Window.partitionBy(item).orderBy(*order)
    change = F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def islands(df: DataFrame, item: str, at: str, gap: float) -> DataFrame:
    """Adds ``island``: rows follow each other by at most ``gap``."""
    w = by(item, at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("__n", new).withColumn("island", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def fill_between_equal(df: DataFrame, item: str, order: str, label: str) -> DataFrame:
    """Adds ``filled`` and ``source``: places between two neighbouring anchors of equal label take it (source run), anchors keep theirs (title)."""
    w = by(item, order)
    before = F.last(label, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(label, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumns({"__b": before, "__a": after})
    filled = F.coalesce(label, F.when(F.col("__b") == F.col("__a"), F.col("__b")))
    source = F.when(F.col(label).isNotNull(), "title").when(F.col("__b") == F.col("__a"), "run")
    return d.withColumns({"filled": filled, "source": source}).drop("__b", "__a")


def monophonic(notes: DataFrame, item: str = "item") -> DataFrame:
    """The highest note of each onset, cut at the next onset. (item, onset, dur, pitch) in and out."""
    top = notes.groupBy(item, "onset").agg(F.max_by(F.struct("pitch", "dur"), F.struct("pitch", "dur")).alias("n"))
    w = by(item, "onset")
    return top.select(item, "onset", F.least(F.col("n.dur"), F.coalesce(F.lead("onset").over(w) - F.col("onset"), F.col("n.dur"))).alias("dur"), F.col("n.pitch").alias("pitch"))


def merge_repeats(notes: DataFrame, item: str = "item") -> DataFrame:
    """Consecutive notes of one pitch become one that lasts to the end of the last."""
    r = runs(notes, item, ["onset"], F.col("pitch"))
    g = r.groupBy(item, "run").agg(F.min("onset").alias("onset"), F.max(F.col("onset") + F.col("dur")).alias("end"), F.min("pitch").alias("pitch"), F.count("*").alias("merged"))
    return g.select(item, "onset", (F.col("end") - F.col("onset")).alias("dur"), "pitch", "merged")


def absorb_short(notes: DataFrame, item: str = "item", share: float = 0.5, least: int = 4) -> DataFrame:
    """Notes whose distance to the next onset is under ``share`` of the median positive distance join the kept note before them.
    Whether a note is kept depends on its own distance only, so kept notes are islands; the first is always kept. Items of
    fewer than ``least`` notes stay as they are."""
    w = by(item, "onset")
    n = notes.withColumns({"__ioi": F.lead("onset").over(w) - F.col("onset"), "__n": F.count("*").over(Window.partitionBy(item)), "__r": F.row_number().over(w)})
    median = n.where("__ioi > 0").groupBy(item).agg(F.percentile("__ioi", 0.5).alias("__m"))
    n = n.join(median, item, "left")
    short = F.coalesce((F.col("__ioi") < share * F.col("__m")) & (F.col("__r") > 1) & (F.col("__n") >= least), F.lit(False))
    n = n.withColumn("__k", F.sum(F.when(short, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = n.groupBy(item, "__k").agg(F.min("onset").alias("onset"), F.max(F.col("onset") + F.col("dur")).alias("end"), F.min_by("pitch", "onset").alias("pitch"))
    return g.select(item, "onset", (F.col("end") - F.col("onset")).alias("dur"), "pitch")


def pitch_classes(notes: DataFrame, item: str = "item") -> DataFrame:
    """``(item, pc, weight)``: share of the sounding time of each of the twelve pitch classes that occurs."""
    g = notes.groupBy(item, F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum("dur").alias("t"))
    return g.withColumn("weight", F.col("t") / F.sum("t").over(Window.partitionBy(item))).select(item, "pc", "weight")


def best_rotation(weights: DataFrame, template: dict[int, float], item: str = "item", heavier_tonic: bool = False) -> DataFrame:
    """``(item, tonic, score)``: the rotation of the template that fits the pitch classes best; of equal ones the first, or
    with ``heavier_tonic`` the one whose tonic weighs more."""
    full = weights.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("pc", "weight"))).alias("m"))
    weight = lambda pc: F.coalesce(F.col("m")[pc], F.lit(0.0))
    terms = lambda k: sum((F.lit(t) * weight(F.pmod(k + F.lit(s), F.lit(12))) for s, t in template.items()), F.lit(0.0))
    x = full.select(item, "m", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    x = x.withColumns({"score": F.round(terms(F.col("k")), 9), "w0": F.round(weight(F.col("k")), 9)})
    order = F.struct("score", "w0", -F.col("k")) if heavier_tonic else F.struct(F.col("score"), -F.col("k"))
    return x.groupBy(item).agg(F.max_by(F.struct(F.col("k").alias("tonic"), "score"), order).alias("b")).select(item, "b.tonic", "b.score")


def relative_duration_bin(ioi: Column, dur: Column, median: Column) -> Column:
    """clip(round(log2(distance / median)), -2, 3), rounding half to even; a distance that is not positive is replaced by the note's own length."""
    x = F.when(ioi > 0, ioi).otherwise(dur)
    return F.least(F.greatest(F.bround(F.log2(F.greatest(x, F.lit(1e-4)) / median), 0), F.lit(-2.0)), F.lit(3.0)).cast("int")


def contour_letter(interval: Column) -> Column:
    """S for a repeat, u and U for steps and leaps up, d and D for those down."""
    return F.when(interval == 0, "S").when(interval > 2, "U").when(interval > 0, "u").when(interval < -2, "D").when(interval < 0, "d")


def sliding(n: Column, width: int, stride: int) -> Column:
    """Starts of windows over a sequence of n; the last window ends with the sequence; a shorter sequence has one window."""
    last = F.greatest(n - width, F.lit(0))
    starts = F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(stride))
    return F.when(F.element_at(starts, -1) < last, F.concat(starts, F.array(last.cast("int")))).otherwise(starts)


def proportional_order(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Adds ``progress`` and ``turn``: a round-robin over groups, and one in which each group advances in proportion to its size."""
    w = Window.partitionBy(group)
    return df.withColumns({"turn": F.row_number().over(w.orderBy(*order)), "__s": F.count("*").over(w)}).withColumn("progress", (F.col("turn") - 1) / F.col("__s")).drop("__s")
