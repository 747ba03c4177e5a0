"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of times the mix takes each of its documents: the whole
part of it as certain copies, the rest as an inclusion probability p. Documents draw u from a hash of id
and text and are ranked by their odds ``u/(1-u)`` divided by the inclusion odds ``p/(1-p)``; the source
takes whole documents in this order as long as they fit into the words that are missing. Two more documents
may fill the gap that is left: the largest that fits, then the one whose size is nearest to the rest. The
sample size is thus fixed while inclusion keeps to p.

The cut in a source's order is found by summing sizes in bins of the rank, then in bins within the one
bin that holds it; only the documents of that last bin (one in 2^32 of the ranks) are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymart.session import stage

WEIGHTS = (1.0, 2.0, 3.0)
#: A source gives its size this many times at most.
MOST = 3.0
#: Bits of the hash that make u, of the rank, and of a bin of the rank.
DRAW_BITS, RANK_BITS, BIN_BITS = 52, 48, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draws(id_col: Column, text: Column) -> list[Column]:
    """Two numbers of 52 bits from a hash of id and text."""
    digest = F.md5(F.encode(F.concat_ws("#", F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))), "UTF-8"))
    return [F.conv(F.substring(digest, start, 13), 16, 10).cast("long") for start in (1, 14)]


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, whole, part``: ``sizes`` has ``source, source_size``.

    Weights repeat in the order of source names (by code point, null last) and share all words. A
    source's target stops at MOST times its size and the rest goes to the others by weight: the common
    level of target per weight is found in one pass over the sources ordered by the level at which
    they stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    weighed = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    stops = weighed.withColumn("stop", MOST * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The level of the first source that does not stop below it holds for all from there on.
    first_open = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("place", "level"))).over(everything)
    open_level = (
        stops.withColumn("level", level)
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", first_open["level"])
    )
    target = F.when(F.col("level").isNull() | (F.col("stop") <= F.col("level")), MOST * F.col("source_size")).otherwise(
        F.col("level") * F.col("weight")
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.greatest("source_size", F.lit(1))).otherwise(F.lit(0.0))
    return (
        open_level.withColumn("target", target.cast("double"))
        .withColumn("whole", F.floor(share).cast("long"))
        .withColumn("part", share - F.floor(share))
        .select("source", "source_size", "target", "whole", "part")
    )


def rank_of(draw: Column, part: Column) -> Column:
    """Odds of the draw over the odds of inclusion, mapped to 0..1 and counted in 2^RANK_BITS steps."""
    u = (draw + 0.5) / float(1 << DRAW_BITS)
    odds = (u / (1 - u)) / (part / (1 - part))
    return F.when(part > 0, F.least(F.floor(odds / (1 + odds) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1))).cast("long")


def same(a: DataFrame, b: DataFrame, column: str) -> Column:
    return a[column].eqNullSafe(b[column])


def cut_points(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """What decides the rows of each source whose inclusion is a chance: a row is taken when its rank is
    under ``below``, when its (rank, draw, second) is not above the three of ``cut``, or is a filler.
    ``rows``: source, size, draw, second."""
    small = targets.select(
        F.col("source").alias("of"), "part", (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing")
    ).where("part > 0")
    ranked = rows.join(small, F.col("source").eqNullSafe(F.col("of"))).select("of", "size", "missing", rank_of(F.col("draw"), F.col("part")).alias("rank"), "draw", "second")

    def crossing(inside: DataFrame, bits: int) -> DataFrame:
        """The first bin (rank >> bits) of each source whose running size passes what is missing."""
        bins = inside.groupBy("of", F.shiftright("rank", bits).alias("bin")).agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
        running = bins.withColumn("until", F.sum("words").over(Window.partitionBy("of").orderBy("bin")))
        return running.where("until > missing").groupBy("of").agg(
            F.min("bin").alias("bin"), F.min_by(F.col("missing") - (F.col("until") - F.col("words")), "bin").alias("left")
        )

    def within(inside: DataFrame, found: DataFrame, bits: int) -> DataFrame:
        names = found.select(F.col("of").alias("o"), F.col("bin").alias("b"), "left")
        hit = F.col("of").eqNullSafe(F.col("o")) & (F.shiftright("rank", bits) == F.col("b"))
        return inside.join(names, hit).select("of", "size", F.col("left").alias("missing"), "rank", "draw", "second")

    high = RANK_BITS - BIN_BITS
    first = within(ranked, crossing(ranked, high), high)
    second_bins = crossing(first, high - BIN_BITS)
    last = within(first, second_bins, high - BIN_BITS)
    # Rows alike in all three are the same text under the same id; they are taken together or not at all.
    alike = last.groupBy("of", "rank", "draw", "second").agg(F.sum("size").alias("size"), F.first("missing").alias("missing"))
    running = F.sum("size").over(Window.partitionBy("of").orderBy("rank", "draw", "second"))
    fits = F.col("until") <= F.col("missing")
    cuts = (
        alike.withColumn("until", running)
        .groupBy("of")
        .agg(
            F.max(F.when(fits, F.struct("rank", "draw", "second"))).alias("cut"),
            (F.first("missing") - F.coalesce(F.max(F.when(fits, F.col("until"))), F.lit(0))).alias("gap"),
        )
    )
    bins = second_bins.select(F.col("of").alias("o"), F.shiftleft("bin", high - BIN_BITS).alias("below"))
    points = stage(bins.join(cuts, F.col("o").eqNullSafe(F.col("of"))).select(F.col("o").alias("cut_source"), "below", "cut", "gap"))
    none = F.array().cast("array<struct<rank:bigint,draw:bigint,second:bigint>>")
    points = points.withColumn("fillers", none)
    mine, off = F.struct("rank", "draw", "second"), F.abs(F.col("gap") - F.col("size"))
    for useful, least in ((F.col("size").between(1, F.col("gap")), -F.col("size")), (off < F.col("gap"), off)):
        beside = ranked.join(points, F.col("of").eqNullSafe(F.col("cut_source")))
        rest = beside.where(useful).where(~before_cut(mine, "below", "cut") & ~F.array_contains("fillers", mine))
        best = rest.groupBy("of").agg(F.min_by(F.struct("rank", "draw", "second", "size"), F.struct(least, "rank", "draw", "second")).alias("best"))
        one = F.when(F.col("best").isNotNull(), F.array(F.struct("best.rank", "best.draw", "best.second"))).otherwise(none)
        points = stage(
            points.join(best, F.col("cut_source").eqNullSafe(F.col("of")), "left").select(
                "cut_source", "below", "cut", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"), F.concat("fillers", one).alias("fillers")
            )
        )
    return points.drop("gap")


def before_cut(mine: Column, below: str, cut: str) -> Column:
    return (mine["rank"] < F.col(below)) | F.coalesce(mine <= F.col(cut), F.lit(False))


def planned(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, list[Column]]:
    """One row for each source with all that decides its rows, and the row's own size and draws."""
    text = F.col(text_col).cast("string")
    own = [F.col(source_col).alias("source"), word_count(text).alias("size"), *(d.alias(n) for d, n in zip(draws(F.col(id_col), text), ("draw", "second")))]
    rows = stage(docs.select(*own))  # 30 bytes a row: read once for each step of the plan
    targets = stage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    cuts = cut_points(rows, targets)
    plan = targets.join(cuts, targets["source"].eqNullSafe(cuts["cut_source"]), "left").drop("cut_source")
    return stage(plan.select([F.col(c).alias(f"mix_{c}") for c in plan.columns])), own


def copies() -> Column:
    """Copies of a row that stands beside its source's plan and its own size and draws."""
    rank = rank_of(F.col("mix_draw"), F.col("mix_part")).alias("rank")
    mine = F.struct(rank, F.col("mix_draw").alias("draw"), F.col("mix_second").alias("second"))
    chosen = before_cut(mine, "mix_below", "mix_cut") | F.coalesce(F.array_contains("mix_fillers", mine), F.lit(False))
    # A source without a cut is too small to miss a word.
    chosen = (F.col("mix_part") > 0) & F.col("mix_below").isNotNull() & chosen
    return F.col("mix_whole") + F.when(chosen, 1).otherwise(0)


def beside_plan(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    plan, own = planned(docs, id_col, source_col, text_col)
    names = ["mix_of", "mix_size", "mix_draw", "mix_second"]
    marked = docs.select("*", *(c.alias(n) for c, n in zip(own, names)))
    return marked.join(plan, marked["mix_of"].eqNullSafe(plan["mix_source"])).withColumn("mix_copies", copies())


def mix_table(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_col, size, source_size long, target double, taken long`` for each row of ``docs``.

    Size counts words, a null text has none. Sources are nullable and the null source is one of them;
    rows of the same id and text are taken together; other columns are ignored; an empty table gives an
    empty one. Draws are hashes, so reruns agree.
    """
    lean = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return beside_plan(lean, "id", "source", "text").select(
        F.col("id").alias(id_col),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, of any name, each as often as the mix takes it."""
    # The caller's columns travel as one, so that their names meet none of those used here.
    lean = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    taken = beside_plan(lean, "id", "source", "text").where("mix_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")
