"""Mixing sources to target weights by entropy balancing.

Every document gets a rate w (how often the mix takes it). Per source, rates are the ones closest to 1 in relative
entropy whose tokens sum to the source's target, with w <= most. The dual has one variable per source and its
solution is exponentially tilted: w = min(most, exp(lambda * size / mean size)). Newton steps on the logarithm of the
dual's gradient, kept inside a bracket, find lambda for all sources at once; each step is one aggregation over a
histogram of sizes, so that documents are read once and a large source is summed on the map side.

Rates then become whole copies. Within a source, sizes are visited from large to small and each size class (documents
of equal size) gets the number of copies that brings the sum so far nearest to its ideal; the smallest sizes absorb
what is left. Within a class, copies are dealt evenly: rank r gets one more if r < copies mod documents, ranks by a
hash of the id, so reruns agree. A source's classes are handled together: they are as many as its different sizes, at
most sqrt(2 * its words), never its documents.

Targets: sources by code point (null last) weigh 1, 2, 3, 1, ...; together they share `share` of all words; a target
stops at `most` times the words of its source and the excess goes to the others by weight, until none is above.

Null text has size 0; documents of size 0 are taken 0 times; a source without words has target 0. Repeated rows are separate
documents, numbered in cells that even a million equal rows are cut into (common.numbered). Very long texts are large sizes: only their number of words is kept. Of documents with equal sizes
and equal hashes of their ids the smaller id comes first. An empty table gives an empty result. A null id is kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, free_name, numbered, spread_join, word_count, written


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds place: the sources' number from 0 by code point, null last. Sorted in many tasks; each task's rows count on from those before it."""
    at = written(sources.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = at.groupBy(task.alias("_task")).agg(F.max(F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_last")).orderBy("_task").collect()  # one row per task
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_task"], total))
        total += r["_last"] + 1
    first = sources.sparkSession.createDataFrame(starts, "_task long, _first long")
    return at.withColumn("_task", task).join(F.broadcast(first), "_task").withColumn("place", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_task", "_first", "_at")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sources: one row (source, source_size) per source. Adds weight and target.

    Targets are min(cap, weight * level); the level rises step by step, each step one aggregation that finds the sources which are full at it,
    until no more are. No task sees all sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = checkpoint(_ranked(sources).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("place"))
    whole, level, before = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        is_full = F.col("cap") / F.col("weight") < F.lit(level)
        found = weighed.agg(F.count_if(is_full).alias("n"), F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)).alias("rest")).first()
        if found.n == before or not found.rest:
            break
        before, level = found.n, (share * whole - found.full) / found.rest
    target = F.least("cap", F.col("weight") * F.lit(level)) if found.rest else F.col("cap")
    return weighed.withColumn("target", target).drop("cap")


def tilts(histogram: DataFrame, targets: DataFrame, most: float, tolerance: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """histogram: (source_key, size, n), sizes above 0; targets: (source_key, target, source_size, n_docs).
    Returns (source_key, tilt) with rates min(most, exp(tilt * size / mean size)); for a target of `most` times the
    source it is null, as no finite tilt is needed."""
    state = targets.join(histogram.groupBy("source_key").agg(F.min("size").alias("low"), F.max("size").alias("high")), "source_key").select(
        "source_key", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.when((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)), F.lit(0.0)).alias("tilt"),
        # at the lower end every rate is so small that even all words would not reach the target
        ((F.log(F.col("target") / F.col("source_size")) - 1) * F.col("source_size") / F.col("n_docs") / F.col("low")).alias("lo"),
        (F.log(F.lit(most)) * F.col("source_size") / F.col("n_docs") / F.col("low") + 1).alias("hi"),
    )
    state = checkpoint(state)
    for _ in range(most_steps):
        x = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("tilt") * x, F.lit(np.log(most))))
        inside = F.when(F.col("tilt") * x < np.log(most), free * x).otherwise(0.0)
        sums = histogram.join(state.select("source_key", "mean", "tilt"), "source_key").groupBy("source_key").agg(F.sum(F.col("n") * F.col("size") * free).alias("g"), F.sum(F.col("n") * F.col("size") * inside).alias("dg"))
        error = F.log(F.col("target") / F.col("g"))
        lo = F.when(error > 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(error < 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + error * F.col("g") / F.col("dg")
        state = checkpoint(
            state.join(sums, "source_key").withColumn("error", F.abs(error)).withColumn("newton", newton).withColumn("lo", lo).withColumn("hi", hi)
            .withColumn("tilt", F.when(F.col("error") <= tolerance, F.col("tilt")).when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2))
            .select("source_key", "target", "mean", "tilt", "lo", "hi", "error")
        )
        if (state.agg(F.max("error")).first()[0] or 0) <= tolerance:
            break
        state = state.drop("error")
    else:
        raise RuntimeError(f"the rates did not settle within {most_steps} steps")
    return state.select("source_key", "tilt", "mean")


def _round(most: int):
    def whole(classes: pa.Table) -> pa.Table:
        classes = classes.sort_by([("size", "descending")])
        copies, wanted, taken = [], 0.0, 0
        for size, n, rate in zip(*(classes[x].to_pylist() for x in ("size", "n", "rate"))):
            wanted += n * size * rate
            copies.append(int(min(most * n, max(0, np.floor((wanted - taken) / size + 0.5)))))
            taken += copies[-1] * size
        return classes.select(["source_key", "size", "n", "rate"]).append_column("copies", pa.array(copies, pa.int64()))

    return whole


def entropy_mix(documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: int = 3) -> DataFrame:
    """One row per row of documents: doc_id, size, source_size, target, rate, copies (0 to most), taken = copies * size."""
    sized = written(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.spark_partition_id().alias("_part")))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sized = sized.withColumn("source_key", key)
    histogram = checkpoint(sized.groupBy("source_key", "source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum("n").alias("n_rows"))
    targets = checkpoint(source_targets(sources, weights, share, most))
    n_rows = targets.agg(F.sum("n_rows")).first()[0] or 0
    positive = histogram.filter("size > 0").select("source_key", "size", "n")
    tilt = tilts(positive, targets.filter("source_size > 0"), most)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(most)).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(np.log(most)))))
    rated = positive.join(tilt, "source_key").join(targets.select("source_key", "target"), "source_key").select("source_key", "size", "n", rate.alias("rate"))
    classes = rated.groupBy("source_key").applyInArrow(_round(most), "source_key string, size long, n long, rate double, copies long")
    dealt = histogram.select("source_key", "size", F.col("n").alias("n_all")).join(classes, ["source_key", "size"], "left").join(targets.select("source_key", "source_size", "target"), "source_key")
    ranked = numbered(sized.withColumn("_mixed", F.xxhash64("doc_id")), ["source_key", "size"], ["_mixed", "doc_id"], n_rows, part="_part")
    copies = F.coalesce(F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") < F.col("copies") % F.col("n"), 1).otherwise(0), F.lit(0)).cast("long")
    joined = spread_join(ranked, dealt.withColumnRenamed("n_all", "_n"), ["source_key", "size"], n_rows, salt=F.col("rank"))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Rows that share an id (null is one too) share its copies as evenly as possible, by the
    hashes of their texts. Null and empty texts are taken 0 times; an empty table gives an empty one. Extra columns are kept, whatever their names."""
    id_, copies, rows, place, rank = (free_name(x, documents) for x in ("mix_id", "mix_copies", "mix_rows", "mix_place", "mix_rank"))
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    plan = checkpoint(entropy_mix(documents, **options).groupBy(key.alias(id_)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)))
    named, number = documents.withColumn(id_, key), F.lit(0)
    total = plan.filter(F.col(rows) > 1).agg(F.sum(rows)).first()[0] or 0
    if total:  # only rows that share an id are numbered, and without their texts
        stored = written(named.withColumn(place, F.monotonically_increasing_id()))
        shared = stored.select(id_, place, F.xxhash64("text").alias(rank)).join(plan.filter(F.col(rows) > 1).select(id_), id_, "left_semi")
        numbers = numbered(shared, [id_], [rank, place], total, place + "_").select(place, F.col(place + "_").alias(rank))
        named, number = stored.join(numbers, place, "left").drop(place), F.coalesce(F.col(rank), F.lit(0))
    times = (F.floor(F.col(copies) / F.col(rows)) + F.when(number < F.col(copies) % F.col(rows), 1).otherwise(0)).cast("int")
    n_rows = plan.agg(F.sum(rows)).first()[0] or 0
    taken = spread_join(named, plan.filter(F.col(copies) > 0).withColumn("_n", F.col(rows)), [id_], n_rows)
    return taken.withColumn(place, F.explode(F.array_repeat(F.lit(1), times))).select(*documents.columns)
