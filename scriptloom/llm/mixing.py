"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is dealt in blocks of documents. With weight w = quanta / H, block i (from 1) of a source is released at
slot floor((i - 1) / w) and due at slot ceil(i / w); in each slot the released block with the earliest deadline goes
(ties: the source's name). On one line of slots with weights that add up to 1, earliest deadline first meets every
such window, so no source is ever a whole block ahead of or behind its weight. The schedule repeats after H slots, so
one period is folded once (H * sources steps) and is then a small table; each block finds its slot by arithmetic.

All documents are kept: when a source has run out, its slots close up and the others go on in the same proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leading hex digits of md5(key) that deal a source's documents into cells before they are ranked.
CELL_DIGITS = 3


def temperature_quanta(n: Column, power: float, resolution: int) -> Column:
    """Quanta in proportion to count ** power, one at least."""
    share = F.pow(n, F.lit(power))
    return F.greatest(F.lit(1), F.round(F.lit(resolution) * share / F.sum(share).over(W.partitionBy(F.lit(0)))).cast("long"))


def schedule(quanta: DataFrame) -> DataFrame:
    """One period: quanta has one row: q (array of quanta, in order of sources). Rows: turn (the source's index), i (its
    block in the period, from 1), slot, before (blocks of every source that went in earlier slots of the period)."""
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    due = lambda c, q: F.ceil((c + 1) * F.col("h") / q).cast("long")
    free = lambda c, q: F.floor(c * F.col("h") / q).cast("long")

    def step(state: Column, slot: Column) -> Column:
        ready = F.transform(F.arrays_zip(state["done"].alias("c"), F.col("q")), lambda x, i: F.when((free(x["c"], x["q"]) <= slot) & (x["c"] < x["q"]), F.struct(due(x["c"], x["q"]).alias("d"), i.alias("i"))))
        turn = F.array_min(ready)["i"]
        mark = F.struct(turn.alias("turn"), slot.alias("slot"), state["done"].alias("before"))
        return F.struct(F.transform(state["done"], lambda c, i: F.when(i == turn, c + 1).otherwise(c)).alias("done"), F.concat(state["out"], F.array(mark)).alias("out"))

    start = F.struct(F.transform("q", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<turn:int,slot:long,before:array<bigint>>>").alias("out"))
    folded = quanta.withColumn("h", total).select("h", F.explode(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), start, step, lambda s: s["out"])).alias("m"))
    return folded.select("h", "m.turn", "m.slot", "m.before", (F.element_at("m.before", F.col("m.turn") + 1) + 1).alias("i"))


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, block: int = 16, power: float = 0.5, resolution: int = 1000, key: str = "doc_id", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc_id, source, block (from 1), release, deadline, slot, position (from 0, without gaps), and
    `carried`, a struct of the columns in carry, if there are any.

    weights gives each source's target; where there are none, they go by the source's count ** power. Sources that
    weights leaves out get the least weight (one quantum), as none is dropped. A null source is a source of its own.
    A source's documents go by md5 of the key, then the key; rows that repeat a key take neighbouring positions. Rows without
    a key go by md5 of the whole row, so that they are spread like others.
    The table of sources (one row each) is broadcast; it and the period (about `resolution` slots) must fit in memory.
    No rows give no rows. Extra columns are ignored.
    """
    order = F.coalesce(F.md5(F.col(key).cast("string")), F.md5(F.to_json(F.struct(*docs.columns))), F.md5(F.lit("")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), order.alias("o"), *([F.struct(*carry).alias("carried")] if carry else [])).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("cell", F.substring("o", 1, CELL_DIGITS))
    cells = rows.select("s", "cell").groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = cells.select("s", "cell", (F.sum("n").over(W.partitionBy("s").orderBy("cell")) - F.col("n")).alias("ahead"))
    sizes = cells.groupBy("s").agg(F.sum("n").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("quanta", temperature_quanta(F.col("n"), power, resolution))
    else:
        known = sum(weights.values())
        pairs = [x for k, v in weights.items() for x in (F.lit(f"={k}"), F.lit(max(1, round(resolution * v / known))))]
        sizes = sizes.withColumn("quanta", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("s")), F.lit(1)).cast("long"))
    line = sizes.agg(F.array_sort(F.collect_list(F.struct("s", "n", "quanta"))).alias("x")).filter("size(x) > 0").select(F.col("x.s").alias("names"), F.col("x.n").alias("counts"), F.col("x.quanta").alias("q"))
    period = schedule(line)
    turns = line.select("counts", "q", F.posexplode("names").alias("turn", "s"))
    plan = period.join(F.broadcast(turns), "turn")  # a row for each slot of the period
    ranked = rows.join(ahead, ["s", "cell"]).withColumn("rank", F.col("ahead") + F.row_number().over(W.partitionBy("s", "cell").orderBy("o", "doc_id")) - 1)
    quanta = turns.select("s", F.element_at("q", F.col("turn") + 1).alias("quanta"))
    at = ranked.join(F.broadcast(quanta), "s").withColumn("block", F.floor(F.col("rank") / block).cast("long") + 1).withColumn("round", F.floor((F.col("block") - 1) / F.col("quanta")).cast("long")).withColumn("i", F.col("block") - F.col("round") * F.col("quanta"))
    out = at.join(F.broadcast(plan.select("s", "i", "slot", "h", "before", "counts", "q")), ["s", "i"])
    earlier = F.aggregate(F.transform(F.arrays_zip("before", "q", "counts"), lambda x: F.least(x["counts"], (x["before"] + F.col("round") * x["q"]) * block)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id", "source", "block",
        F.floor((F.col("block") - 1) * F.col("h") / F.col("quanta")).cast("long").alias("release"),
        F.ceil(F.col("block") * F.col("h") / F.col("quanta")).cast("long").alias("deadline"),
        (F.col("slot") + F.col("round") * F.col("h")).alias("slot"),
        (earlier + F.col("rank") - (F.col("block") - 1) * block).alias("position"), *(["carried"] if carry else []),
    )


#: The same for the default parameters: a recursive query goes through the slots of one period.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
 n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
 q AS (SELECT s, n, greatest(1, round(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ()))::BIGINT AS q, row_number() OVER (ORDER BY s) AS turn FROM n),
 l AS (SELECT list(q ORDER BY s) AS qs, list(n ORDER BY s) AS ns, sum(q)::BIGINT AS h FROM q),
 run AS (
  SELECT 0::BIGINT AS slot, list_transform(qs, lambda x: 0::BIGINT) AS done, 0::BIGINT AS turn FROM l
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda c, k: CASE WHEN k = pick THEN c + 1 ELSE c END), pick FROM (
    SELECT slot, done, h, list_min(list_filter(list_transform(range(1, len(qs) + 1), lambda k: CASE WHEN done[k] < qs[k] AND floor(done[k] * h / qs[k]) <= slot
      THEN {'d': ceil((done[k] + 1) * h / qs[k])::BIGINT, 'k': k} END), lambda x: x IS NOT NULL)).k AS pick FROM run, l WHERE slot < h)),
 period AS (SELECT slot - 1 AS slot, turn, done[turn] AS i, list_transform(done, lambda c, k: CASE WHEN k = turn THEN c - 1 ELSE c END) AS before FROM run WHERE slot > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, doc_id) - 1 AS rank FROM d),
 b AS (SELECT r.*, q.q, q.turn, rank // 16 + 1 AS block, rank // 16 // q.q AS round FROM r JOIN q USING (s))
SELECT doc_id, source, block, floor((block - 1) * h / q)::BIGINT AS release, ceil(block * h / q)::BIGINT AS deadline, p.slot + round * h AS slot,
  list_sum(list_transform(range(1, len(qs) + 1), lambda k: least(ns[k], (before[k] + round * qs[k]) * 16)))::BIGINT + rank - (block - 1) * 16 AS position
FROM b JOIN period p ON p.turn = b.turn AND p.i = b.block - b.round * b.q, l
"""
