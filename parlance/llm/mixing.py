"""Mixing sources to target weights by Poisson replication, in built-in functions only.

Each document is repeated K times, K drawn from a Poisson distribution whose mean is its source's target
repetition rate: target share of the mix x size of the mix / size of the source. The draw inverts the
distribution at a point that a seeded hash of the document fixes, so the same seed gives the same mix
whatever the partitioning. Copies are then dealt to partitions by a seeded hash and ordered by it inside
them: a global shuffle.

Cases: a null source is a source of its own; a null text has size 1, as the empty text; a null id is drawn by its
text; equal rows draw the same K; a source without a target weight has weight 0 where weights are given; an
empty table gives an empty result; further columns travel along unchanged, whatever their names, but for columns named as the
copy and order columns of the result, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.names import free_names
from parlance.session import settle

#: A mean beyond this is drawn as a sum of independent parts, each with a mean of at most so much.
PART_MEAN = 16.0
#: Terms of the distribution function; the rest beyond mean 16 is below 1e-20.
TERMS = 80


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, rate`` with the mean repetitions of a document of each source.

    Sizes are characters plus one per document, over all documents. Without ``weights`` a source's target
    share is its size to the power of ``exponent`` (1: as it is, 0: all alike), divided by the sum. The mix is
    ``epochs`` times the size of the input.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)).cast("double").alias("size")
    )
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(float(exponent))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = settle(sizes, "mix-sizes")  # a row per source
    all_weight, all_size = sizes.agg(F.sum("weight"), F.sum("size")).first()
    share = F.try_divide(F.col("weight"), F.lit(all_weight or 0.0))
    return sizes.select("source", F.coalesce(share * F.lit(float(epochs)) * F.lit(all_size or 0.0) / F.col("size"), F.lit(0.0)).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Values of the Poisson distribution function at 0 .. TERMS."""
    first = F.exp(-mean)
    state = F.struct(first.alias("term"), F.array(first).alias("below"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(s["below"], F.array(F.element_at(s["below"], -1) + term)).alias("below"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, step, lambda s: s["below"])


def _point(seed: int, key: Column, salt: Column) -> Column:
    """A point of [0, 1) with 52 bits, from MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), salt.cast("string"), key)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def replicated(
    docs: DataFrame, rates: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "mix_copy", order_col: str = "mix_order"
) -> DataFrame:
    """All columns of ``docs`` plus ``mix_copy`` (1 .. K) and ``mix_order``, dealt and ordered by ``mix_order``.

    ``rates`` is small (a row per source) and comes from a table, so that Spark knows its size: it broadcasts
    it only below its own threshold and else joins by sorting, splitting a source that is too large.
    """
    docs = docs.drop(copy_col, order_col)
    source, parts, below, count = free_names(docs, "mix_source", "mix_parts", "mix_below", "mix_count")
    needed = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART_MEAN)).cast("int"))
    table = rates.select("source", "rate", needed.alias("parts"))
    table = table.select(F.col("source").alias(source), F.col("parts").alias(parts), _distribution(F.col("rate") / F.col("parts")).alias(below))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)),
        F.lit(0),
        lambda total, part: total + F.size(F.filter(F.col(below), lambda b: b <= _point(seed, key, part))),
    )
    out = docs.join(table, F.col(source_col).eqNullSafe(F.col(source))).withColumn(count, drawn)
    out = out.filter(F.col(count) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(count))))
    order = F.xxhash64(F.lit(seed), key, F.col(copy_col))
    out = out.select(*[docs[c] for c in docs.columns], copy_col, order.alias(order_col))
    return out.repartition(order_col).sortWithinPartitions(order_col)


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: int = 17, copy_col: str = "mix_copy", order_col: str = "mix_order"
) -> DataFrame:
    """``docs`` replicated to the target weights; the rates are settled first."""
    rates = settle(source_rates(docs, weights, exponent, epochs), "mix-rates")
    return replicated(docs, rates, seed, copy_col=copy_col, order_col=order_col)
