"""Interaction audit of document filters: every order of applying them, from counts of failure masks, by a recursive query."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written

_BLANK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter; ``text`` is not null.

    A: under 200 words; B: fewer distinct words than half of all; C: more than 3 % capitals A-Z; D: a sign of ``#$%&*|``.
    """
    found = F.filter(F.split(text, _BLANK), lambda w: w != "")

    def words(w: Column) -> Column:
        return F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct"))

    counts = F.get(F.transform(F.array(found), words), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": counts["all"] < 200,
        "B": 100 * counts["distinct"].cast("long") < 50 * counts["all"].cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", copies: str = "E"
) -> tuple[DataFrame, list[str]]:
    """``(id, part, mask)``: one row for each input row, a bit for each filter it fails; and the filters' letters.

    Bits follow :func:`text_filters`, and the last one, ``copies``, is set where the text equals that of a smaller id. A
    null text counts as empty, a null part as the empty string. A null id is a copy of nothing and has no copies; rows
    that repeat id and text are no copies of each other. The texts are read once; what goes on is a digest, an id and a
    mask. Copies are told by their first id, a minimum that is pre-aggregated, and rows meet the firsts by id and digest,
    so a text that a third of the rows share gathers nowhere.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    conditions = text_filters(F.col("_text"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.alias("_text"),
    ).select("id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("own"))
    narrow = written(narrow, "masks")
    firsts = narrow.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    rows = narrow.join(firsts.withColumn("first", F.lit(True)), ["id", "digest"], "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(bits)).otherwise(0)
    return rows.select("id", "part", (F.col("own") + copy).alias("mask")), [*conditions, copies]


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and failure mask, and how many are labelled good or toxic.

    ``labels(doc_id, quality, toxic)``: a label of 1 in any row of the id counts once; ids without labels are neither.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks.join(known, "id", "left")
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


# Each level adds an unused letter to every prefix, meets the part's cells and appends that step's counts.
_WALK = """
    WITH RECURSIVE walk(part, filter_order, applied, steps) AS (
        SELECT part, '', 0, CAST(array() AS {steps}) FROM {{cells}}
        UNION ALL
        SELECT w.part, concat(w.filter_order, l.letter), w.applied | l.bit, array_append(w.steps, named_struct(
            'kept', {n}(x -> x.mask & (w.applied | l.bit) = 0){n_end},
            'removed', {n}(x -> x.mask & w.applied = 0 AND x.mask & l.bit <> 0){n_end},
            'redundant', {n}(x -> x.mask & w.applied <> 0 AND x.mask & l.bit <> 0){n_end},
            'unique_fails', {n}(x -> x.mask = l.bit){n_end},
            'good_lost', {good}(x -> x.mask & w.applied = 0 AND x.mask & l.bit <> 0){good_end},
            'toxic_lost', {toxic}(x -> x.mask & w.applied = 0 AND x.mask & l.bit <> 0){toxic_end}
        ))
        FROM walk w
        JOIN VALUES {letters} AS l(letter, bit) ON w.applied & l.bit = 0
        JOIN {{cells}} c ON c.part = w.part
    )
    SELECT part, filter_order, pos + 1 AS step, s.* FROM walk LATERAL VIEW posexplode(steps) AS pos, s
    WHERE length(filter_order) = {most}
"""


def audit_orders(cells: DataFrame, letters: list[str]) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    One row for each part, order of all ``letters`` and step. ``cells`` are counts by part and mask, whose bit i stands for
    letter i. A recursive query extends prefixes of orders by letters not yet used, from the empty one: each level joins
    the cells of the part, carries the bits applied so far and appends its step's counts, so a prefix is counted once
    for all orders that begin with it. ``shapley`` is what the step's filter removes, summed over all orders.

    A part has at most 2^letters cells, held in one row; the work is 326 short rows for each part with five letters,
    whatever the number of documents. The result is written, so that the recursion's row limit, raised to fit the parts,
    is restored before the result is used. No cells give no rows.
    """
    spark = cells.sparkSession
    cell = F.struct("mask", "n", "good", "toxic")
    by_part = written(cells.groupBy("part").agg(F.collect_list(cell).alias("cells")), "cells")

    def total(field: str) -> dict[str, str]:
        return {field: "aggregate(filter(c.cells, ", f"{field}_end": f"), 0L, (a, x) -> a + x.{field})"}

    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    query = _WALK.format(
        steps=f"ARRAY<STRUCT<{', '.join(f'{f}: BIGINT' for f in fields)}>>",
        letters=", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters)),
        most=len(letters),
        **total("n"), **total("good"), **total("toxic"),
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        walked = written(spark.sql(query, cells=by_part), "orders")
    finally:
        spark.conf.set(limit, before)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = walked.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return walked.withColumn("letter", letter).join(shares, ["part", "letter"]).drop("letter")
