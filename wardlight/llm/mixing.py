"""Temperature mixing of sources, in DataFrame operations only.

A source with token share p gets the weight p^a / sum(p^a). The exponent a is bisected: it is lowered from 1 (natural
shares) towards 0 (equal shares) until the weights' entropy reaches the target, and raised again if a source would be repeated
more often than the limit allows. Weights times the token budget are the sources' budgets. A budget is realised as whole epochs and
a part of one more: a source's documents are dealt by a keyed hash into blocks of about block_tokens, every epoch takes the
blocks in the order of another keyed hash of block and epoch, the last epoch takes whole blocks until the budget and then documents of one block.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from wardlight.llm.common import BROADCAST_BYTES, WORD, hot_join, materialize, scratch, width

#: Exponents tried in one pass over the shares, and passes: the interval shrinks by PROBES + 1 in each.
PROBES, PASSES = 15, 8


def word_count(text: str = "text") -> Column:
    """Words of a text, the tokens that the shares count; none for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def exponent_figures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """(sum of p^a, entropy of the weights, largest and smallest p^(a-1)) for each exponent a, in one pass over a table of shares p > 0."""
    aggs = []
    for i, a in enumerate(exponents):
        w = F.pow("p", F.lit(a))
        aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log("p") * a).alias(f"l{i}"), F.max(w / F.col("p")).alias(f"m{i}"), F.min(w / F.col("p")).alias(f"s{i}")]
    r = shares.agg(*aggs).first()
    return [(z, math.log(z) - wl / z, most, least) for z, wl, most, least in (r[4 * i : 4 * i + 4] for i in range(len(exponents)))]


def bisect_exponent(shares: DataFrame, budget: float | None, total: int, entropy_share: float | None, max_repeats: float | None) -> tuple[float, float, float]:
    """(exponent, sum of p^a, budget in tokens). budget None: just enough that the least drawn source is drawn whole.

    Where the repetition limit leaves no exponent that is flat enough, the limit holds and a warning states the entropy that is met.
    """
    log_n = exponent_figures(shares, [0.0])[0][1]

    def within(exponents: list[float]) -> list[tuple[bool, bool]]:
        out = []
        for z, entropy, most, least in exponent_figures(shares, exponents):
            tokens = total * z / least if budget is None else budget
            out.append((entropy_share is None or entropy >= entropy_share * log_n - 1e-12, max_repeats is None or most / z * tokens / total <= max_repeats))
        return out

    def bisect(low: float, high: float, go_low) -> tuple[float, float]:
        """The interval around the change from not go_low to go_low."""
        for _ in range(PASSES):
            tried = [low + (high - low) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
            first = next((i for i, w in enumerate(within(tried)) if go_low(w)), PROBES)
            low, high = [low, *tried][first], [*tried, high][first]
        return low, high

    # the largest exponent that is flat enough, then the smallest one from there that keeps to the repetition limit
    a = 1.0
    if entropy_share is None:
        a = 0.0
    elif not within([1.0])[0][0]:
        a = bisect(0.0, 1.0, lambda w: not w[0])[0]
    if not within([a])[0][1]:
        a = bisect(a, 1.0, lambda w: w[1])[1]
    z, entropy, most, least = exponent_figures(shares, [a])[0]
    tokens = total * z / least if budget is None else float(budget)
    if entropy_share is not None and entropy < entropy_share * log_n - 1e-6:
        warnings.warn(f"the repetition limit holds, the entropy is {entropy / log_n:.4f} of that of equal weights instead of {entropy_share}", stacklevel=3)
    if max_repeats is not None and most / z * tokens / total > max_repeats + 1e-6:
        warnings.warn(f"no exponent keeps to {max_repeats} repeats under this budget: budgets are cut to it", stacklevel=3)
    return a, z, tokens


def mix(
    docs: DataFrame, tokens_col: str, budget: float | None = None, entropy_share: float | None = 0.97, max_repeats: float | None = 4.0,
    block_tokens: int = 200_000, seed: int = 20_240_229, id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """All columns of docs and mix_weight, mix_epoch, mix_block, mix_place, one row for each time a document is drawn.

    tokens_col is a column of docs. budget: tokens to draw; None covers every source at least once. entropy_share: the target
    entropy as a share of that of equal weights. max_repeats: the most often that a source may be drawn. Sorting by mix_place (from 0 to
    1) interleaves the sources' blocks by their weights. A null source is a source of its own. A source without a token has no weight:
    under budget None its documents are drawn once, otherwise not at all; other documents without tokens go with their block.
    Repeated rows are drawn as often as they stand there; a row with a null id is dealt by its other columns. Clashing names: columns of docs that begin with mix_ are replaced.
    An empty table, or one without tokens, gives its rows under budget None and no rows otherwise.
    """
    out = ["mix_weight", "mix_epoch", "mix_block", "mix_place"]
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    d = docs.select(*kept, F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("mix_t"), F.concat(F.lit("s"), F.col(source_col)).alias("mix_s"))
    d = d.withColumn("mix_s", F.coalesce("mix_s", F.lit("null")))
    plain = [f.name for f in docs.select(*kept).schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    d = d.withColumn("mix_h", F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.lit(seed))).otherwise(F.xxhash64(*plain, F.lit(seed))))
    with scratch():
        totals = materialize(d.groupBy("mix_s").agg(F.sum("mix_t").alias("mix_total"), F.count(F.lit(1)).alias("_n")).coalesce(2))
        n_sources, total, n_rows = totals.agg(F.count(F.lit(1)), F.sum("mix_total"), F.sum("_n")).first()
        if not total:
            idle = docs.select(*kept) if budget is None else docs.select(*kept).limit(0)
            return idle.select(*kept, F.lit(None).cast("double").alias(out[0]), F.lit(0).alias(out[1]), F.lit(0).cast("long").alias(out[2]), F.lit(0.0).alias(out[3]))

        def of_source(rows: DataFrame, of: DataFrame) -> DataFrame:
            if n_sources * width(of) <= BROADCAST_BYTES:
                return rows.join(F.broadcast(of), "mix_s")
            return hot_join(rows, of, "mix_s", counts=totals.select("mix_s", "_n"), total=n_rows)

        shares = totals.where("mix_total > 0").select("mix_s", (F.col("mix_total") / total).alias("p"))
        a, z, budget_tokens = bisect_exponent(shares, budget, total, entropy_share, max_repeats)
        p = F.col("mix_total") / total
        plan = (
            totals.select("mix_s", "mix_total", F.when(p > 0, F.pow(p, F.lit(a)) / z).alias("mix_weight"))
            .withColumn("mix_budget", F.round(F.col("mix_weight") * budget_tokens).cast("long"))
            .withColumn("mix_budget", F.least("mix_budget", F.floor(F.col("mix_total") * max_repeats)) if max_repeats is not None else F.col("mix_budget"))
            .withColumn("mix_full", F.when(F.col("mix_total") > 0, F.floor(F.col("mix_budget") / F.col("mix_total"))).otherwise(F.lit(1 if budget is None else 0)).cast("int"))
            .withColumn("mix_rest", F.coalesce(F.col("mix_budget") - F.col("mix_full") * F.col("mix_total"), F.lit(0)))
            .withColumn("mix_n", F.greatest(F.lit(1), F.ceil(F.col("mix_total") / block_tokens)).cast("long"))
        )
        plan = materialize(plan.coalesce(1))
        block = F.pmod(F.col("mix_h"), F.col("mix_n"))
        # where a block stands in an epoch, as a share of it: a keyed hash
        place = lambda epoch: F.shiftrightunsigned(F.xxhash64(F.col("mix_s"), F.col("mix_block"), epoch, F.lit(seed)), 11) / F.lit(float(1 << 53))

        # the block in which the last epoch ends: tokens of the blocks before each in that epoch's order, by chunks of about sqrt(n) blocks
        blocks = of_source(d.select("mix_s", "mix_t", "mix_h"), plan.select("mix_s", "mix_n", "mix_full", "mix_rest")).withColumn("mix_block", block)
        blocks = blocks.groupBy("mix_s", "mix_block").agg(F.sum("mix_t").alias("bt"), *[F.first(c).alias(c) for c in ("mix_n", "mix_full", "mix_rest")])
        blocks = materialize(blocks.withColumn("pos", place(F.col("mix_full"))).withColumn("chunk", F.floor(F.col("pos") * F.ceil(F.sqrt("mix_n")))))
        earlier = (Window.unboundedPreceding, -1)
        chunks = blocks.groupBy("mix_s", "chunk").agg(F.sum("bt").alias("ct"))
        chunks = chunks.select("mix_s", "chunk", F.coalesce(F.sum("ct").over(Window.partitionBy("mix_s").orderBy("chunk").rowsBetween(*earlier)), F.lit(0)).alias("c0"))
        inside = F.coalesce(F.sum("bt").over(Window.partitionBy("mix_s", "chunk").orderBy("pos", "mix_block").rowsBetween(*earlier)), F.lit(0))
        ends = blocks.join(chunks, ["mix_s", "chunk"]).withColumn("b0", F.col("c0") + inside).where((F.col("b0") <= F.col("mix_rest")) & (F.col("b0") + F.col("bt") > F.col("mix_rest")))
        cuts = ends.groupBy("mix_s").agg(F.min(F.struct("pos", "mix_block", "b0")).alias("mix_cut"))
        plan = materialize(plan.join(cuts, "mix_s", "left").coalesce(1), outer=True)
        d = of_source(d, plan).withColumn("mix_block", block)
    at_end = F.struct(place(F.col("mix_full")).alias("pos"), "mix_block")
    more = F.col("mix_rest") > 0
    whole = more & F.coalesce(at_end < F.struct("mix_cut.pos", "mix_cut.mix_block"), F.lit(True))
    times = F.col("mix_full") + whole.cast("int")
    drawn = d.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    by_place = Window.partitionBy("mix_s", "mix_block").orderBy(F.xxhash64("mix_h", "mix_full"), id_col, *plain)
    last = d.where(more & (F.col("mix_block") == F.col("mix_cut.mix_block"))).withColumn("used", F.sum("mix_t").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where(F.col("mix_cut.b0") + F.col("used") <= F.col("mix_rest")).drop("used").withColumn("mix_epoch", F.col("mix_full"))
    drawn = drawn.unionByName(last)
    through = (F.col("mix_epoch") + place(F.col("mix_epoch"))) * F.col("mix_total")
    at = F.least(F.lit(1.0), F.coalesce(F.try_divide(through, F.col("mix_budget")), F.lit(0.0)))
    return drawn.select(*kept, "mix_weight", "mix_epoch", "mix_block", at.alias("mix_place"))
