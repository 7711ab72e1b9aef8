"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a table of cells (source, language, topic) with their tokens. Cell weights are raked to the
target shares of sources, languages and topics in turn until all three hold; a document is kept with a
probability in proportion to its cell's weight over its cell's tokens, but at most 1. The sample holds a stated
share of all tokens at least: cells too rare for their weight in it are kept whole, all others fill the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import store

SPACE, WORDY = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
MARGINS = ("source", "lang", "topic")
#: Target shares are observed shares to this power, made to sum to 1: 1 keeps the mix, 0 evens it out.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Sweeps at most, those of one job, and the largest error of a margin's share at which raking ends.
SWEEPS, AT_ONCE, TOLERANCE = 40, 5, 1e-6
#: Share of all tokens that the sample holds at least, as expected. Steps to find the scale of probabilities.
SHARE, STEPS = 0.5, 100
RESOLUTION = 1 << 53


def n_tokens(text: Column) -> Column:
    """Words of a text; none in a null text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: licence text, table, markup or symbols, short or long prose."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / size
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(text.contains("Licen"), "licence")
        .when(share("|") > 0.02, "table")
        .when(share("#*$%&<>") > 0.05, "symbols")
        .when(F.length(text) < 1000, "short")
        .otherwise("long")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Default targets of a margin: the observed shares of tokens to a power."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    return shares.select(margin, (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (source, lang, topic: not null; tokens > 0) with a column weight; weights sum to 1.

    targets: for a margin, a table of its values and their share (tempered observed shares where none is
    given). A value without a target gets none of the weight. If the targets contradict each other, the last
    margin's hold and the rest are as near as raking comes in SWEEPS sweeps; gap, the same in all rows, is the
    largest error of a value's share that is left.
    """
    for margin in MARGINS:
        want = (targets or {}).get(margin)
        want = tempered(cells, margin, TEMPER[margin]) if want is None else want
        cells = cells.join(want.select(margin, F.col("share").alias(f"_{margin}")), margin, "left").fillna(0.0, [f"_{margin}"])
    weights = store.table(cells.withColumn("weight", F.col("tokens").cast("double") / F.sum("tokens").over(Window.partitionBy())), "cells")
    gap = 0.0
    for _ in range(SWEEPS // AT_ONCE):
        step = weights
        for margin in MARGINS * AT_ONCE:
            now = F.sum("weight").over(Window.partitionBy(margin))
            step = step.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_{margin}") / now).otherwise(0.0))
        weights, old = store.table(step, "cells"), weights
        off = [weights.groupBy(m, f"_{m}").agg(F.sum("weight").alias("w")).select(F.abs(F.col("w") - F.col(f"_{m}")).alias("d")) for m in MARGINS]
        gap = off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("d")).first()[0] or 0.0
        store.drop(old)
        if gap < TOLERANCE:
            break
    return weights.drop(*[f"_{m}" for m in MARGINS]).withColumn("gap", F.lit(float(gap)))


def scaled(raked: DataFrame, share: float = SHARE) -> tuple[DataFrame, float]:
    """raked (tokens, weight) with probability, raked (the weight given) and weight (that of the sample, as
    expected), and the share of all tokens that the sample is expected to hold.

    A probability is least(1, scale * weight / tokens). The scale is the largest at which no cell lacks tokens
    for its weight, or, if that keeps less than `share` of all tokens, the one that keeps this share: cells
    without enough tokens are then kept whole, and no rare cell lowers the rate of the others. The tokens kept
    grow with the scale along a concave line of straight pieces, so that steps along the piece at hand come to
    the share from below. A share out of reach, as cells of weight 0 are never taken, keeps all others whole.
    """
    weight, tokens = F.col("weight"), F.col("tokens")
    total, most = raked.agg(F.sum("tokens"), F.max(weight / tokens)).first()
    scale = 1 / (most or 1.0)
    for _ in range(STEPS if total else 0):
        full = weight * F.lit(scale) >= tokens
        whole, rest = raked.agg(F.sum(F.when(full, tokens).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(weight))).first()
        better = (share * total - whole) / rest if rest > 0 else 0.0
        if better <= scale * (1 + 1e-12):
            break
        scale = better
    out = raked.withColumnRenamed("weight", "raked").withColumn("probability", F.least(F.lit(1.0), F.col("raked") * F.lit(scale) / tokens))
    kept = out.agg(F.sum(tokens * F.col("probability"))).first()[0] or 0.0
    return out.withColumn("weight", tokens * F.col("probability") / F.lit(kept or 1.0)), kept / total if total else 1.0


def _keyed(docs: DataFrame, topic_of: Column | None, seed: int) -> DataFrame:
    about = topic(F.col("text")) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        about.alias("topic"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"),
        F.coalesce(F.col("text").rlike(WORDY), F.lit(False)).alias("_wordy"),
    )


def _drawn(keyed: DataFrame, targets: dict[str, DataFrame] | None, share: float) -> DataFrame:
    cells = keyed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    cells, kept_share = scaled(rake(store.table(cells, "tokens"), targets), share)
    raked = store.table(cells.select(*MARGINS, "raked", "weight", "probability", "gap"), "raked")
    out = keyed.join(raked, list(MARGINS), "left").fillna({"raked": 0.0, "weight": 0.0, "gap": 0.0})
    out = out.withColumn("probability", F.when(F.col("_wordy") & F.col("probability").isNotNull(), F.col("probability")).otherwise(1.0))
    draw = F.pmod("_h", F.lit(RESOLUTION)) / RESOLUTION
    return out.withColumns({"sampled": draw < F.col("probability"), "kept_share": F.lit(kept_share)}).drop("_h", "_wordy")


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 3, share: float = SHARE, topic_of: Column | None = None) -> DataFrame:
    """Columns row (all of docs, as a struct), source, lang, topic, n_tokens, raked, weight, probability, sampled, kept_share, gap.

    topic_of gives each document's topic, as a topic model or a table of labels may (topic(), by form, if none is
    given). The largest probability is 1: the sample is the largest in which every cell has its share and no
    document is repeated, or, if that is smaller, the one that holds `share` of all tokens (see scaled). Whether a
    document is in the sample depends on a hash of its id and text, so repeated rows share their fate. Null
    sources, languages and topics are values named '' of their own; texts without words are kept with probability 1
    as they weigh nothing. raked is the cell's weight as targets want it, weight its share of the sample's tokens;
    they differ only if some cell is kept whole for want of tokens. kept_share and gap (see rake) are the same in
    all rows.
    """
    return _drawn(_keyed(docs, topic_of, seed), targets, share)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, raked and weight (of the cell), probability, sampled, kept_share, gap for every row of docs.

    Words are counted in one pass over the texts; what the draw needs of them is written and read again.
    """
    keyed = _keyed(docs.select("doc_id", "text", "source", "lang"), None, 3).select("row.doc_id", *MARGINS, "n_tokens", "_h", "_wordy")
    return _drawn(store.table(keyed, "keyed"), None, SHARE).select("doc_id", *MARGINS, "n_tokens", "raked", "weight", "probability", "sampled", "kept_share", "gap")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 3, share: float = SHARE) -> DataFrame:
    """The sampled rows of docs."""
    return calibrated(docs, targets, seed, share).where("sampled").select("row.*")
