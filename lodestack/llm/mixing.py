"""Mixing sources to target shares on a low-discrepancy schedule.

The documents of a source are shuffled by hash and laid end to end, which gives each its token offset; a block is a
stretch of BLOCK_TOKENS. Slot i of a mix has the golden-ratio point frac(i/phi), which falls into one source's part of the
cumulative weights; the slot's rank among the slots of its source says which block it takes, going round the source again
as often as max_repeats allows. Offsets and ranks are two-level prefix sums, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.runtime import cut

BLOCK_TOKENS = 16_384
#: Documents per hash bucket, and slots per chunk, in the two-level prefix sums.
BUCKET_ROWS = 4_096
GOLDEN = 0.6180339887498949


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", source_key(F.col("source")).alias("src"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens"))


def quotas(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of targets: wanted, available and granted tokens, and whether the target can be met."""
    stats = _sized(documents).groupBy("src").agg(F.sum("tokens").alias("src_tokens"), F.count_if(F.col("tokens") > 0).alias("src_rows"))
    everything = stats.agg(F.coalesce(F.sum("src_tokens"), F.lit(0)).alias("t")).scalar()
    wanted = F.coalesce("target_share", F.lit(0.0)) * F.coalesce("budget_ratio", F.lit(0.0)) * F.col("all_tokens")
    t = targets.select("mix_id", "source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "budget_ratio").distinct().withColumn("src", source_key(F.col("source")))
    q = t.join(stats, "src", "left").withColumn("all_tokens", everything)
    q = q.withColumns({"src_tokens": F.coalesce("src_tokens", F.lit(0).cast("long")), "src_rows": F.coalesce("src_rows", F.lit(0).cast("long")), "wanted_tokens": wanted})
    q = q.withColumn("available_tokens", F.col("max_repeats") * F.col("src_tokens"))
    return q.withColumns({"feasible": F.col("wanted_tokens") <= F.col("available_tokens"), "granted_tokens": F.greatest(F.lit(0.0), F.least("wanted_tokens", F.col("available_tokens").cast("double")))})


def _laid_out(documents: DataFrame, q: DataFrame) -> DataFrame:
    """src, doc_id, tokens, offset of each document in its shuffled source."""
    sources = q.where(F.col("src_tokens") > 0).select("src", F.ceil(F.col("src_rows") / BUCKET_ROWS).alias("buckets")).distinct()
    place = (F.xxhash64("doc_id", F.lit(41)) / F.lit(2.0**64) + 0.5).alias("place")
    docs = _sized(documents).where(F.col("tokens") > 0).select("src", "doc_id", "tokens", place).join(sources, "src")
    docs = docs.withColumn("bucket", F.least(F.floor(F.col("place") * F.col("buckets")), F.col("buckets") - 1))
    sums = docs.groupBy("src", "bucket").agg(F.sum("tokens").alias("s"))
    before = F.sum("s").over(Window.partitionBy("src").orderBy("bucket")) - F.col("s")
    docs = docs.join(sums.select("src", "bucket", before.alias("before")), ["src", "bucket"])
    inside = F.sum("tokens").over(Window.partitionBy("src", "bucket").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    return docs.select("src", "doc_id", "tokens", (F.col("before") + inside - F.col("tokens")).alias("offset"))


def _slots(q: DataFrame, block_tokens: int) -> DataFrame:
    """mix_id, slot, source and the slot's rank among those of its source, as many as the grants need."""
    all_granted = F.sum("granted_tokens").over(Window.partitionBy("mix_id"))
    w = q.where(F.col("granted_tokens") > 0).withColumn("w", F.col("granted_tokens") / all_granted)
    rounds = F.floor(F.col("granted_tokens") / F.col("src_tokens"))
    round_blocks = F.floor((F.col("src_tokens") - 1) / block_tokens) + 1
    w = w.withColumn("needed", rounds * round_blocks + F.floor((F.col("granted_tokens") - rounds * F.col("src_tokens")) / block_tokens) + 1)
    # A source of weight w has at least w*n - (3 + 2.1 ln n) of the first n golden-ratio points.
    rough = F.max(F.col("needed") / F.col("w")).over(Window.partitionBy("mix_id"))
    w = w.withColumn("least", F.ceil((F.col("needed") + 6 + 2.5 * F.ln(rough + 2)) / F.col("w")))
    upto = F.sum("w").over(Window.partitionBy("mix_id").orderBy("src"))
    w = w.select("mix_id", "least", F.struct(upto.alias("upto"), "source", "src", "src_tokens", "granted_tokens", round_blocks.alias("round_blocks"), "needed").alias("x"))
    mixes = w.groupBy("mix_id").agg(F.max("least").alias("n"), F.array_sort(F.collect_list("x")).alias("sources"))
    chunks = mixes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET_ROWS))))
    at = chunks.select("mix_id", "sources", "chunk", F.explode(F.sequence(F.col("chunk") * BUCKET_ROWS, F.least((F.col("chunk") + 1) * BUCKET_ROWS, F.col("n")) - 1)).alias("slot"))
    point = (F.col("slot") + 0.5) * GOLDEN
    at = at.withColumn("point", point - F.floor(point))
    hit = F.coalesce(F.get(F.filter("sources", lambda x: F.col("point") < x["upto"]), F.lit(0)), F.element_at("sources", -1))
    at = at.select("mix_id", "chunk", "slot", hit.alias("x")).select("mix_id", "chunk", "slot", "x.source", "x.src", "x.src_tokens", "x.granted_tokens", "x.round_blocks", "x.needed")
    counts = at.groupBy("mix_id", "source", "src", "chunk").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("mix_id", "source", "src").orderBy("chunk")) - F.col("c")
    at = at.join(counts.select("mix_id", "source", "src", "chunk", before.alias("before")), ["mix_id", "source", "src", "chunk"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("mix_id", "source", "src", "chunk").orderBy("slot")) - 1
    return at.withColumn("rank", rank).where(F.col("rank") < F.col("needed"))


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(records, report). records: mix_id, slot, slot_offset, source, doc_id, repeat, tokens, in the order (slot, slot_offset).

    report: per row of targets mix_id, source, target_share, max_repeats, wanted_tokens, available_tokens, taken_tokens, records, actual_share,
    feasible. Each source gives the documents that begin within its granted tokens (the wanted, at most max_repeats rounds),
    so it goes over by less than one document; actual shares are of the tokens taken. Sources are compared trimmed and in lower
    case; a NULL source belongs to none but counts in the total; NULL or empty texts have no tokens and are not drawn; NULL
    max_repeats is 1, other NULLs in a target are 0. Repeated target rows count once. Empty inputs give empty records.
    """
    q = cut(quotas(documents, targets))
    docs = _laid_out(documents, q).withColumn("block", F.floor(F.col("offset") / block_tokens))
    slots = _slots(q, block_tokens).withColumns({"repeat": F.floor(F.col("rank") / F.col("round_blocks")), "block": F.col("rank") % F.col("round_blocks")})
    got = slots.join(docs, ["src", "block"]).where(F.col("repeat") * F.col("src_tokens") + F.col("offset") < F.col("granted_tokens"))
    records = got.select("mix_id", "slot", (F.col("offset") - F.col("block") * block_tokens).alias("slot_offset"), "source", "doc_id", F.col("repeat").cast("int").alias("repeat"), "tokens")
    taken = records.groupBy(F.col("mix_id").alias("taken_mix"), F.col("source").alias("taken_source")).agg(F.sum("tokens").alias("taken_tokens"), F.count("*").alias("records"))
    same = F.col("mix_id").eqNullSafe(F.col("taken_mix")) & F.col("source").eqNullSafe(F.col("taken_source"))
    none = F.lit(0).cast("long")
    r = q.join(taken, same, "left").select(
        "mix_id", "source", "target_share", "max_repeats", "wanted_tokens", "available_tokens", F.coalesce("taken_tokens", none).alias("taken_tokens"), F.coalesce("records", none).alias("records"), "feasible"
    )
    share = F.round(F.try_divide(F.col("taken_tokens"), F.sum("taken_tokens").over(Window.partitionBy("mix_id"))), 6)
    return records, r.withColumn("actual_share", share)


def unmet(report: DataFrame) -> DataFrame:
    """mix_id and source of the targets that the schedule did not fill, all rounds of their sources used up."""
    return report.where(F.col("taken_tokens") < F.col("wanted_tokens")).select("mix_id", "source")
