"""Extraction results scored against expected records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The record types that every score table lists.
TYPES = ("decision", "architecture", "convention", "todo", "issue")


def matches(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """(fixture_id, mem_type, outcome) with outcome tp, fp or fn.

    expected has fixture_id, pos, mem_type, must and must_not; extracted fixture_id, pos, mem_type
    and text. A pair fits if the types are equal and the text, in any case, has all of must and
    none of must_not. Expected records in order take the first fitting extracted one that is
    free; which that is depends on the ones before, so a fixture's fitting pairs are one task.
    """
    e = expected.select("fixture_id", F.col("pos").alias("e"), F.col("mem_type").alias("et"), "must", F.coalesce("must_not", F.array().cast("array<string>")).alias("must_not"))
    x = extracted.select("fixture_id", F.col("pos").alias("x"), F.col("mem_type").alias("xt"), F.lower("text").alias("text"))
    fits = F.forall("must", lambda n: F.contains(F.col("text"), F.lower(n))) & ~F.exists("must_not", lambda n: F.contains(F.col("text"), F.lower(n)))
    pairs = e.join(x, "fixture_id").where((F.col("et") == F.col("xt")) & fits).select("fixture_id", "e", "x")

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, es, xs in zip(batch["fixture_id"], batch["es"], batch["xs"]):
                used, done = set(), set()
                for i, v in zip(es, xs):
                    if i not in done and v not in used:
                        used.add(v)
                        done.add(i)
                        out.append((name, i, v))
            yield pd.DataFrame(out, columns=["fixture_id", "e", "x"])

    # many fixtures a batch: a call of Python for each would be most of the time
    whole = pairs.groupBy("fixture_id").agg(F.array_sort(F.collect_list(F.struct("e", "x"))).alias("p")).select("fixture_id", F.col("p.e").alias("es"), F.col("p.x").alias("xs"))
    hit = whole.mapInPandas(greedy, pairs.schema)
    tp = e.join(hit, ["fixture_id", "e"]).select("fixture_id", F.col("et").alias("mem_type"), F.lit("tp").alias("outcome"))
    fn = e.join(hit, ["fixture_id", "e"], "left_anti").select("fixture_id", F.col("et").alias("mem_type"), F.lit("fn").alias("outcome"))
    fp = x.join(hit, ["fixture_id", "x"], "left_anti").select("fixture_id", F.col("xt").alias("mem_type"), F.lit("fp").alias("outcome"))
    return tp.unionByName(fn).unionByName(fp)


def by_type(outcomes: DataFrame) -> DataFrame:
    """(mem_type, tp, fp, fn, precision, recall, f1) for every type and overall; a score without cases is 0."""
    spark = outcomes.sparkSession
    each = outcomes.select("outcome", F.explode(F.array("mem_type", F.lit("overall"))).alias("mem_type"))
    sums = each.groupBy("mem_type").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))
    names = spark.createDataFrame([(t,) for t in (*TYPES, "overall")], "mem_type string")
    full = names.join(sums, "mem_type", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = full.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
