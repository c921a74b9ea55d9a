"""Documents mixed so that each source contributes its target share of tokens.

Every distinct text of a source is a unit of its token count. A mix's total is the largest at
which every source can give its share without a text being used more than max_repeats times. A
source gives as many whole copies of all its texts as fit (the certain part); the rest is a Pareto
order sample with unequal probabilities: a text's inclusion probability grows with its own token
count, so that the expected tokens are the rest; texts whose probability would pass 1 are certain
and the others share what is left. Texts are ranked by the odds of a hashed random number over
the odds of their inclusion probability and taken in that order until the rest is filled. Running
sums go over bins of the rank, so that no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.tokens import with_counts
from skein.operators.neighbours import with_running
from skein.runtime import cut

BINS = 4096
SEED = 20240601


def units(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, digest, doc_id, n_tokens): the distinct texts that each mix can use.

    A text counts once per mix, for the source of its lowest doc_id among the mix's sources, and
    is represented by that document. Texts without tokens and documents without source are left
    out. Texts are tokenized once each, before they meet the mixes.
    """
    texts = documents.where("source is not null and text is not null").select("doc_id", "source", "text", F.md5("text").alias("digest"))
    sized = with_counts(texts.groupBy("digest").agg(F.min_by("text", "doc_id").alias("text")), "text").select("digest", "n_tokens").where("n_tokens > 0")
    holders = texts.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id")).join(sized, "digest")
    sources = targets.where("source is not null and weight > 0 and max_repeats > 0").select("mix_name", "source").distinct()
    held = holders.join(sources, "source")
    return held.groupBy("mix_name", "digest").agg(F.min_by(F.struct("source", "doc_id", "n_tokens"), "doc_id").alias("u")).select("mix_name", "u.source", "digest", "u.doc_id", "u.n_tokens")


def plan(units_: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, tokens, texts, quota, whole, rest): what each source gives.

    target_share is the weight over the sum of the mix's weights. quota is its part of the total;
    whole the certain copies of every text, rest the tokens left for the sample. The total is the
    least capacity over share among the sources that have texts, or total_tokens; a source that
    cannot fill its quota gives all its copies. Repeated rows of a source in a mix add their
    weights; the smallest max_repeats counts.
    """
    goals = targets.where("source is not null and weight > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    by_mix = Window.partitionBy("mix_name")
    goals = goals.withColumn("target_share", F.col("weight") / F.sum("weight").over(by_mix))
    sums = units_.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    joined = goals.join(sums, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"))
    capacity = F.col("tokens") * F.col("max_repeats")
    most = F.min(F.when(F.col("tokens") > 0, capacity / F.col("target_share"))).over(by_mix) if total_tokens is None else F.lit(float(total_tokens))
    quota = F.least(capacity.cast("double"), F.coalesce(most, F.lit(0.0)) * F.col("target_share"))
    out = joined.withColumn("quota", quota)
    whole = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("bigint"), F.floor(F.col("quota") / F.col("tokens") + 1e-9))).otherwise(F.lit(0))
    return out.withColumn("whole", whole.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("whole") * F.col("tokens")))


def slopes(rows: DataFrame) -> DataFrame:
    """(own, slope, certain_from): inclusion probability a token of each source of a mix, and the size from which texts are certain.

    rows has (own, n_tokens, rest). The slope c solves sum(min(1, c * n) * n) = rest. Sums are
    taken per distinct size first; the sizes of a source, no more than the longest text has
    tokens, are then run over from the largest: sizes are certain as long as c * n reaches 1.
    """
    sizes = rows.groupBy("own", "n_tokens").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    up, down = Window.partitionBy("own").orderBy("n_tokens"), Window.partitionBy("own").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n") * F.col("n_tokens")
    left = F.col("rest") - F.coalesce(F.sum(tokens).over(down), F.lit(0))
    cuts = sizes.withColumn("c", left / F.sum((tokens * F.col("n_tokens")).cast("double")).over(up)).where((F.col("c") > 0) & (F.col("c") * F.col("n_tokens") < 1))
    return cuts.groupBy("own").agg(F.max_by("c", "n_tokens").alias("slope"), F.max("n_tokens").alias("open_to"))


def pareto_rank(seed: int):
    """The random odds of a text over the odds of its inclusion probability, as a column; 0 for a certain text."""
    chance = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "digest"), F.lit(2**52)) + 0.5) / float(2**52)
    inclusion = F.least(F.greatest(F.col("inclusion"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.when(F.col("inclusion") >= 1, F.lit(0.0)).otherwise((chance / (1 - chance)) / (inclusion / (1 - inclusion)))


def sampled(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Every unit of every mix with its inclusion probability and rank, and the plan."""
    pool = cut(units(documents, targets))
    goals = cut(plan(pool, targets, total_tokens))
    rows = pool.join(goals.select("mix_name", "source", "tokens", "whole", "rest", "max_repeats"), ["mix_name", "source"]).withColumn("own", F.to_json(F.struct("mix_name", "source")))
    rows = rows.join(slopes(rows), "own", "left")
    certain = F.col("slope").isNull() | (F.col("n_tokens") > F.col("open_to"))
    rows = rows.withColumn("inclusion", F.when(F.col("rest") <= 0, 0.0).when(certain, 1.0).otherwise(F.col("slope") * F.col("n_tokens"))).drop("slope", "open_to")
    rows = rows.withColumn("rank", pareto_rank(seed))
    even = F.col("rank") / (1 + F.col("rank"))
    return cut(rows.withColumn("bin", F.least(F.floor(even * BINS), F.lit(BINS - 1)).cast("int"))), goals


def select(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_name, source, doc_id, n_tokens, copies) and the plan that it follows.

    The sample takes texts in rank order up to the first that would overfill the rest, then goes
    on after it with texts that still fit, until none does: what is left open is less than any
    text that is left.
    """
    rows, goals = sampled(documents, targets, total_tokens, seed)
    open_ = rows.where(F.col("whole") < F.col("max_repeats")).select("own", "digest", "n_tokens", "rank", "bin", F.col("rest").alias("gap"))
    chosen = None
    while True:
        fitting = open_.where(F.col("n_tokens") <= F.col("gap"))
        running = cut(with_running(fitting, "own", F.col("bin"), ["rank", "digest"], F.col("n_tokens"), "so_far").withColumn("taken", F.col("so_far") + F.col("n_tokens") <= F.col("gap")))
        taken = running.where("taken")
        if taken.isEmpty():
            break
        chosen = taken.select("own", "digest") if chosen is None else chosen.unionByName(taken.select("own", "digest"))
        used = taken.groupBy("own").agg(F.sum("n_tokens").alias("used"))
        left = running.where("not taken").join(used, "own", "left")
        open_ = left.select("own", "digest", "n_tokens", "rank", "bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
    extra = rows.withColumn("extra", F.lit(None).cast("int")) if chosen is None else rows.join(chosen.withColumn("extra", F.lit(1)), ["own", "digest"], "left")
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")
    return extra.select("mix_name", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0"), goals


def shares(selection: DataFrame, goals: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, texts, available, max_copies) of every source of every mix.

    actual_share is the source's part of the selected tokens, 0 where the mix selects none.
    available is false for a source without texts, whose share falls to the others.
    """
    sums = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("selected"), F.count("*").alias("n_texts"), F.max("copies").alias("max_copies"))
    joined = goals.join(sums, ["mix_name", "source"], "left")
    selected = F.coalesce("selected", F.lit(0))
    whole = F.sum(selected).over(Window.partitionBy("mix_name"))
    return joined.select(
        "mix_name", "source", "target_share", F.coalesce(selected / F.when(whole > 0, whole), F.lit(0.0)).alias("actual_share"), selected.alias("tokens"),
        F.coalesce("n_texts", F.lit(0)).alias("texts"), (F.col("tokens") > 0).alias("available"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )
