"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is its weight's share of the budget, held at ``max_epochs`` times its size; what a held source can't take
is shared among the others by weight, until none is above its cap. Each document is then taken a whole number of times, and
the fraction left is drawn in a seeded order: documents in front take one more repetition until the target is met, and the
one on the border takes the part of a repetition that is missing.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source of size 0 takes nothing;
repeated rows and null ids are documents of their own; very long texts count whole; an empty table gives an empty mix; extra
columns are passed on, but columns of the names that ``mix`` adds (size, source_size, target, taken) are replaced by its own,
and ``repeat_documents`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, Scratch, task_width

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_601
#: Buckets of all sources up to which their sums are broadcast, else joined by shuffle.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(seed: int) -> Column:
    """60 bits of the MD5 of seed, id and text: the place of a document in the draw. Any engine can compute it."""
    content = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("long")


def source_order(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``place``: 0, 1, 2 ... by the source's code points, null last, from a range partitioning and bucket offsets."""
    dealt = scratch.keep(sizes.repartitionByRange(task_width(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__from"))  # a row per partition
    own = Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(F.broadcast(offsets), F.col("__p") == F.col("__q")).withColumn("place", F.col("__from") + F.row_number().over(own) - 1).drop("__p", "__q", "__from")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to sources (source_size, weight): min(cap, level * weight), the level found in rounds.

    Each round reads two sums; the level only rises, and a round that holds no further source ends it.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, held = 0.0, -1
    while True:
        over = (cap < F.lit(level) * F.col("weight")) if held >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(over, cap)).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r.n == held or not r.w:
            break
        held, level = r.n, max(level, (budget - (r.c or 0.0)) / r.w)
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))


def mix(docs: DataFrame, max_epochs: float = 3.0, budget_share: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = SEED) -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes) to documents with columns doc_id, text and source.

    Weights repeat over the sources in code point order. Reruns agree: the order of a draw is the hash of the document's
    content and the seed. A source is dealt to hash buckets, whose totals tell which of them lie before and behind the border of
    the draw; only the rows of the border's bucket are put in order.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(*[F.col(f"`{c}`") for c in names if c not in ("size", "source_size", "target", "taken")])
    sized = sized.withColumn("size", word_count(F.col("text"))).withColumn("__h", draw_key(seed))
    thin = scratch.keep(sized.select("source", "size", "__h"))
    per_source = scratch.keep(source_order(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n")), scratch))
    totals = per_source.agg(F.sum("source_size").alias("s"), F.sum("__n").alias("n")).first()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = water_fill(per_source.withColumn("weight", weight), float(totals.s or 0) * budget_share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = filled.withColumn("__whole", F.floor(rate + 1e-12)).withColumn("__extra", F.round(F.col("target") - F.col("__whole") * F.col("source_size")).cast("long"))
    filled = filled.select(F.col("source").alias("__s"), "source_size", "target", "__whole", "__extra")

    buckets = max(1, -(-int(totals.n or 0) // BUCKET_ROWS))
    bucket = F.shiftright(F.shiftright("__h", 30) * F.lit(buckets), 30)  # in the order of the keys
    sums = thin.groupBy("source", bucket.alias("__b")).agg(F.sum("size").alias("__n"))
    ahead = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("__t"), F.col("__b").alias("__c"), "__n", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__from"))
    plan = scratch.keep(starts.join(filled, F.col("__t").eqNullSafe(F.col("__s"))).drop("__s"))
    side = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    joined = sized.withColumn("__b", bucket).join(side, F.col("source").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__c")))
    # whole buckets in front of the border take one more repetition, those behind it none; only the border's rows are numbered
    full, none = F.col("__from") + F.col("__n") <= F.col("__extra"), F.col("__from") >= F.col("__extra")
    settled = joined.where(full | none).withColumn("__more", F.when(full, F.col("size")).otherwise(F.lit(0)))
    inner = Window.partitionBy("__t", "__b").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__from") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    border = joined.where(~(full | none)).withColumn("__more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__extra") - before)))
    out = settled.unionByName(border).withColumn("taken", (F.col("__whole") * F.col("size") + F.col("__more")).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in names if c not in ("size", "source_size", "target", "taken")], "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as taken, the last copy of a border document cut at a word's end.

    Columns are those of ``docs``; n_chars, where it is one, counts the new text.
    """
    thin = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    mixed = mix(thin, **options)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rows = mixed.where(times > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    rows = rows.withColumn("__words", F.least(F.col("size"), F.col("taken") - (F.col("__k") - 1) * F.col("size")))
    part = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(__words as int)), '')")
    text = F.when(F.col("__words") == F.col("size"), F.col("text")).otherwise(part)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__words") == F.col("size"), F.col("__row")["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("__row")[c].alias(c) for c in docs.columns])
