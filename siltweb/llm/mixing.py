"""Mixing sources to target weights: raking to three marginals, then calibrated sampling. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

DIMENSIONS = ("source", "lang", "topic")
CELL = tuple(f"{d}_cell" for d in DIMENSIONS)


@dataclass(frozen=True)
class Mixture:
    #: Target shares by dimension, as {value: share}; a dimension without them gets its tempered own shares.
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Exponent on a value's own share where no target is given: 1 keeps it, 0 makes all values equal.
    temper: float = 0.7
    #: Share of all tokens that the sample should hold.
    budget: float = 0.6
    #: Sweeps, at most, until marginals are within the tolerance; else ``NotMet`` is raised. A tolerance of 0 asks for just so many.
    sweeps: int = 400
    tolerance: float = 1e-4
    #: Sweeps are at rest where no cell has grown by more than this share over ``together`` of them.
    settled: float = 1e-6
    together: int = 8
    #: Up to this many cells a sweep is one task's work; more are summed by shuffle, a sweep a job.
    one_task: int = 100_000
    seed: str = "mix"


def topic_of(text: Column) -> Column:
    """Kind of content, by surface marks: the corpora that this runs on carry no topic of their own."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(F.trim(t)) == 0, "empty")
        .when(t.contains(" | "), "table")
        .when(t.rlike(r"Licensed under|[Cc]opyright"), "licensed")
        .when(t.rlike(r"[#$%&*!]{3}|[{};]\s"), "noise")
        .when(F.length(t) < 500, "short")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words, as a stand-in for tokens: it counts white-space runs without building the words."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1), the same on every run and engine: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


class NotMet(RuntimeError):
    """The marginals don't meet their targets after all sweeps."""


def _summed(w: DataFrame, c: str, few: bool, sums: dict[str, Column]) -> DataFrame:
    """``w`` with sums over the rows that share ``c``: over a window within the one task, or pre-aggregated and joined back."""
    if few:
        return w.withColumns({name: F.sum(x).over(Window.partitionBy(c)) for name, x in sums.items()})
    return w.join(w.groupBy(c).agg(*[F.sum(x).alias(name) for name, x in sums.items()]), c, "left")


def _fitted(w: DataFrame, how: Mixture, step, value: str, slack: float, name: str) -> DataFrame:
    """``w`` after sweeps of ``step(w, i, c, few)`` over the dimensions, each of which leaves ``off{i}``, until none is off by ``slack`` or more.

    Every ``together`` sweeps are looked at, however many cells there are. Sweeps that bring no marginal nearer may still
    be on their way, as long as some cell's ``value`` grows by a share of itself; where none does, they are at rest and no
    values of these cells meet the targets. That raises where a dimension with given targets is off, as does the end of
    all sweeps; where only tempered shares, which are a wish, can't be had, the nearest is returned. ``off`` tells how far
    each dimension is off, at most.
    """
    few = w.count() <= how.one_task
    done, off, grown = 0, {}, 0.0
    while done < how.sweeps:
        now = min(how.together, how.sweeps - done)
        done += now
        w = (w.coalesce(1) if few else w).withColumn("was", F.col(value))
        for k in range(now):
            for i, c in enumerate(CELL):
                w = step(w.drop(f"off{i}"), i, c, few)
            if not few or k + 1 == now:
                w = materialize(w if few else w.coalesce(8), f"{name}-{done}")
        growth = F.max(F.when((F.col("was") > 0) & (F.col(value) > 0), F.log(F.col(value) / F.col("was"))))
        *offs, grown = w.agg(*[F.max(f"off{i}") for i in range(len(CELL))], growth).first()
        off = dict(zip(DIMENSIONS, (x or 0.0 for x in offs)))
        resting = (grown or 0.0) < how.settled
        if max(off.values()) < slack or slack > 0 and resting:
            break
    if slack > 0 and any(x >= slack and (not resting or d in how.targets) for d, x in off.items()):
        told = ", ".join(f"{d} by {x:.3g}" for d, x in off.items())
        raise NotMet(f"{name}: after {done} sweeps marginals are still off: {told}" + (", and no cell grows" if resting else ""))
    return w.drop("was").withColumn("off", F.create_map(*[F.lit(x) for pair in off.items() for x in pair]))


def rake(cells: DataFrame, how: Mixture) -> DataFrame:
    """``cells`` with ``weight``: shares of the whole whose marginals meet the targets as far as the cells allow.

    A sweep divides each cell by its marginal and multiplies by the target, one dimension after the other. Marginals of
    more than ``one_task`` cells are pre-aggregated sums joined back, so nothing is gathered, however many sources there
    are. Cells without tokens weigh 0.
    Sweeps go on until all marginals meet their targets; given targets that no weights of these cells meet raise ``NotMet``.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    w = materialize(cells.crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens")), F.lit(0.0))), "cells")
    for i, (d, c) in enumerate(zip(DIMENSIONS, CELL)):
        own = w.where("tokens > 0").groupBy(c).agg(F.sum("weight").alias("own"))
        if d in how.targets:
            given = spark.createDataFrame([(str(k), float(v)) for k, v in how.targets[d].items()], f"{c} string, aim double")
            own = own.join(given, c, "left").withColumn("aim", F.coalesce("aim", F.lit(0.0)))
        else:
            own = own.withColumn("aim", F.pow("own", F.lit(how.temper)))
        norm = own.agg(F.sum("aim").alias("norm"))
        aims = own.crossJoin(F.broadcast(norm)).select(c, F.coalesce(F.try_divide("aim", "norm"), F.lit(0.0)).alias(f"aim{i}"))
        w = w.join(aims, c, "left")

    def step(w: DataFrame, i: int, c: str, few: bool) -> DataFrame:
        moved = _summed(w, c, few, {"now": F.col("weight")}).withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(f"aim{i}", "now"), F.lit(0.0)))
        return moved.withColumn(f"off{i}", F.abs(F.col(f"aim{i}") - F.col("now"))).drop("now")

    return _fitted(materialize(w, "aimed"), how, step, "weight", how.tolerance, "raked").select(*CELL, "tokens", "weight", "off")


def reachable(own: DataFrame, budget: float) -> DataFrame:
    """``own`` with ``goal``: ``aim`` shares of ``budget`` tokens; a value that has fewer gives all it has, and the others make up for it in proportion."""
    scale = budget
    while True:
        sure = F.col("own") <= F.col("aim") * scale
        held, free = own.agg(F.sum(F.when(sure, F.col("own"))), F.sum(F.when(~sure, F.col("aim")))).first()
        new = max(scale, (budget - (held or 0.0)) / free) if free else scale
        if new <= scale * (1 + 1e-12):
            return own.withColumn("goal", F.least("own", F.col("aim") * scale))
        scale = new


def calibrate(cells: DataFrame, how: Mixture) -> DataFrame:
    """``cells`` with ``probability``, with ``weight`` the share of the sample's tokens to expect from the cell, and ``off``, how far each dimension's shares are off at most.

    The sample's expected tokens meet the budget and its marginals those of the raked weights, as far as the tokens
    allow: a value that needs more than all its tokens gives all, and the rest of its share goes to the other values of
    its dimension in proportion. Cells that are taken whole stay so, and the others are raked again around them.
    Only sums reach the driver.
    """
    total, there = cells.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()
    budget = min(how.budget * (total or 0), there or 0)
    if budget <= 0:
        return cells.drop("off").withColumns({"probability": F.lit(0.0), "off": F.create_map().cast("map<string,double>")})
    w = cells.drop("off").withColumn("expected", F.least(F.col("tokens").cast("double"), F.col("weight") * float(budget)))
    for i, c in enumerate(CELL):
        own = materialize(cells.where("weight > 0").groupBy(c).agg(F.sum("tokens").cast("double").alias("own"), F.sum("weight").alias("aim")), "own")
        w = w.join(reachable(own, float(budget)).select(c, F.col("goal").alias(f"goal{i}")), c, "left")
    whole = F.col("expected") >= F.col("tokens") * (1 - 1e-9)

    def step(w: DataFrame, i: int, c: str, few: bool) -> DataFrame:
        goal = F.col(f"goal{i}")
        less = F.col("expected") * goal / F.col("now")
        more = F.when(whole, F.col("expected")).otherwise(F.col("expected") * F.coalesce(F.try_divide(goal - F.col("fixed"), F.col("now") - F.col("fixed")), F.lit(1.0)))
        new = F.when(F.col("now") > goal * (1 + 1e-9), less).when(F.col("now") > 0, more).otherwise(0.0)
        new = F.when(new >= F.col("tokens") * (1 - 1e-9), F.col("tokens").cast("double")).otherwise(new)
        sums = _summed(w, c, few, {"now": F.col("expected"), "fixed": F.when(whole, F.col("expected")).otherwise(0.0)})
        moved = sums.withColumn(f"off{i}", F.abs(goal - F.col("now")))
        return moved.withColumn("expected", F.when(goal.isNull(), 0.0).otherwise(F.coalesce(new, F.lit(0.0)))).drop("now", "fixed")

    w = _fitted(materialize(w, "goals"), how, step, "expected", how.tolerance * budget, "fitted")
    expected = w.agg(F.sum("expected")).first()[0] or 1.0
    return w.select(*CELL, "tokens", (F.col("expected") / expected).alias("weight"), F.coalesce(F.try_divide("expected", F.col("tokens").cast("double")), F.lit(0.0)).alias("probability"), F.transform_values("off", lambda _, x: x / budget).alias("off"))


ADDED = (*CELL, "cell_tokens", "cell_weight", "cell_probability")


def labelled(docs: DataFrame) -> DataFrame:
    """``docs`` with the cell and the tokens of each row."""
    labels = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang")] + [topic_of(F.col("text"))]
    return docs.drop(*ADDED).withColumns(dict(zip(CELL, labels))).withColumn("cell_tokens", tokens_of(F.col("text")))


def sampled(own: DataFrame, how: Mixture = Mixture()) -> DataFrame:
    """The rows of a labelled table that the mixture takes, with its cells' weights and probabilities."""
    cells = materialize(own.groupBy(*CELL).agg(F.sum("cell_tokens").alias("tokens")), "cells")
    cells = materialize(calibrate(rake(cells, how), how), "calibrated")
    out = own.join(cells.select(*CELL, F.col("weight").alias("cell_weight"), F.col("probability").alias("cell_probability")), list(CELL))
    return out.where(uniform(F.col("doc_id"), how.seed) < F.col("cell_probability"))


def mix(docs: DataFrame, how: Mixture = Mixture()) -> DataFrame:
    """Sample ``docs``: the kept rows with all their columns, then ``source_cell, lang_cell, topic_cell, cell_tokens, cell_weight, cell_probability``.

    Null source or lang form a value of their own, ``unknown``. Null and blank texts have no tokens, so their cells weigh
    nothing and they are not sampled. Repeated rows share a doc_id and are kept or left together; a null doc_id draws as
    an empty one. Ties cannot arise, as a row is kept where its own number is below its probability. An empty table gives
    an empty result. A column of ``docs`` with one of the new names is replaced. The labelled rows are written once, so
    that no text is looked at twice.
    """
    return sampled(materialize(labelled(docs), "labelled"), how).select(*docs.drop(*ADDED).columns, *ADDED)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sampled document of the whole table: its cell, tokens, expected share of the sample and probability."""
    out = sampled(materialize(labelled(table(spark, sf_dir, "documents")).select("doc_id", *CELL, "cell_tokens"), "labelled"))
    return out.select("doc_id", F.col("source_cell").alias("source"), F.col("lang_cell").alias("lang"), F.col("topic_cell").alias("topic"), F.col("cell_tokens").alias("tokens"), F.col("cell_weight").alias("weight"), F.col("cell_probability").alias("probability"))
