"""Mixing sources to target weights by Pfair scheduling, with Spark expressions only.

The documents of each source, in a hash order, are cut into blocks.  Target
weights are whole numbers of slots in a period.  Block k of a source that has n
of the period's T slots is released at floor(k * T / n) and due at
ceil((k + 1) * T / n); in every slot the released block that is due first goes
next (ties: the lower source).  With all slots given away no block is ever
late or early, so at every slot each source is less than one block away from
its share.  The schedule repeats with the period, so only one period is worked
out and every document computes its place from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import numbered, written


def target_slots(sources: DataFrame, weights: dict[str, float] | None, temperature: float, period: int) -> DataFrame:
    """(key, i, n): for each source its place in key order and its slots in the period.

    Without ``weights`` a source weighs rows ** temperature; with them, a source
    that they don't name weighs nothing.  The period has ``period`` slots, or
    eight for each source if that is more.  Shares are rounded to whole slots,
    and a source of any weight has one at least, which is at most an eighth of
    the period given away.  A source without weight has none, unless no source
    weighs anything: then each has one."""
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(temperature))
    else:
        weight = F.coalesce(*[F.when(F.col("key") == "=" + k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    whole = sources.select("key", weight.alias("weight")).select(
        "key", "weight", F.sum("weight").over(Window.partitionBy()).alias("all"), F.count("*").over(Window.partitionBy()).alias("of"),
        F.row_number().over(Window.orderBy("key")).alias("i"))
    share = F.greatest(F.lit(1.0), F.round(F.col("weight") / F.col("all") * F.greatest(F.lit(period), 8 * F.col("of"))))
    return whole.select("key", "i", F.when(F.col("all") <= 0, 1).when(F.col("weight") <= 0, 0).otherwise(share).cast("long").alias("n"))


def schedule(targets: DataFrame) -> DataFrame:
    """(slot, i, nth, total): block ``nth`` of source ``i`` has this slot of the period.

    Sources with equally many slots have the same releases and deadlines, so
    they wait in one line, in key order.  A step looks at the head of each line:
    a period of T slots has at most sqrt(2 T) lines."""
    lines = targets.filter("n > 0").groupBy("n").agg(F.count("*").alias("m"), F.sort_array(F.collect_list("i")).alias("who"))
    one = lines.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("total"), F.collect_list(F.struct("n", "m", "who")).alias("lines"))
    slots = "array<struct<slot: bigint, i: int, nth: bigint>>"
    # ``given`` counts the blocks that each line has had; the one-element array binds the pick
    step = """transform(array(array_min(transform(lines, (l, j) -> if((now.given[j] div l.m) * total div l.n <= t,
                  struct(((now.given[j] div l.m + 1) * total + l.n - 1) div l.n as due, l.who[cast(now.given[j] % l.m as int)] as i, j as j), null)))),
              pick -> struct(transform(now.given, (g, j) -> if(j = pick.j, g + 1, g)) as given,
                             array_append(now.out, struct(t as slot, pick.i as i, now.given[pick.j] div lines[pick.j].m as nth)) as out))[0]"""
    # in runs of 1000 slots, as an appended array is copied each time
    run = one.withColumn("out", F.expr(f"""aggregate(if(total > 0, sequence(0L, (total - 1) div 1000), cast(array() as array<bigint>)),
        struct(transform(lines, l -> 0L) as given, cast(array() as array<{slots}>) as outs),
        (state, r) -> transform(array(aggregate(sequence(r * 1000, least(total, (r + 1) * 1000) - 1),
                struct(state.given as given, cast(array() as {slots}) as out), (now, t) -> {step})),
            done -> struct(done.given as given, array_append(state.outs, done.out) as outs))[0],
        state -> flatten(state.outs))"""))
    return run.select("total", F.explode("out").alias("x")).select("x.*", "total")


def placed(docs: DataFrame, keep: Column, weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int = 16, period: int = 1000) -> DataFrame:
    """``keep`` (as column ``kept_as``) of every document, with its block of the
    source, the block's release, deadline and slot (null for a source without
    weight), and (lane, line, at), whose order is the mix."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(keep.alias("kept_as"), key.alias("key"), place.alias("place"))
    targets = written(target_slots(rows.groupBy("key").agg(F.count("*").alias("rows")), weights, temperature, period), "targets")
    own = schedule(targets).groupBy("i").agg(F.max("total").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("nth", "slot"))), lambda x: x["slot"]).alias("slots"))
    # one row for each source; written, so that its size decides how it is joined
    plan = written(targets.join(own, "i", "left").select("key", "i", "n", "total", "slots"), "slots")
    # the first three of the hash's hexadecimal digits cut every source into 4096 runs
    ranked = numbered(rows, ["key"], [F.col("place")], "rank", cut=F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    here = ranked.join(plan, "key").withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("at", F.expr(f"rank % {block_rows}"))
    here = here.withColumn("slot", F.expr("if(n > 0, (block div n) * total + slots[cast(block % n as int)], null)"))
    return here.select("kept_as", "block", F.expr("if(n > 0, block * total div n, null)").alias("release"),
                       F.expr("if(n > 0, ((block + 1) * total + n - 1) div n, null)").alias("deadline"), "slot",
                       F.expr("if(n > 0, 0, i)").alias("lane"), F.coalesce("slot", "block").alias("line"), "at")


def _totals_before(runs: DataFrame, lane: str, run: str) -> DataFrame:
    """(lane, run, before): the rows of all runs before this one, from (lane, run, count)."""
    wide = runs.withColumn("part", F.expr(f"{run} div 4096"))
    starts = (wide.groupBy(lane, "part").agg(F.sum("count").alias("count"))
              .select(lane, "part", F.coalesce(F.sum("count").over(Window.orderBy(lane, "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    inner = Window.partitionBy(lane, "part").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    return (wide.withColumn("before", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(starts, [lane, "part"])
            .select(lane, run, (F.col("before") + F.col("start")).alias("before")))


def mix(docs: DataFrame, keep: Column, weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int = 16, period: int = 1000) -> DataFrame:
    """``keep`` (as column ``kept_as``) of every document, with its block of the
    source, the block's release, deadline and slot, and its position in the mix.

    Positions run from 0 without gaps.  No document is dropped or repeated: a
    source that has run out leaves its slots empty and the others keep theirs,
    so up to any slot each source that is not used up has within one block of
    its share of the slots so far.  Sources without weight take no share: they
    follow the mix one by one, in key order, without slots.  There may be any
    number of sources; a null source is one.  Documents keep a hash order of
    (doc_id, text) inside their source, equal rows in any order.  An empty
    table gives no row."""
    here = placed(docs, keep, weights, temperature, block_rows, period).withColumn("run", F.expr("line div 4096"))
    before = _totals_before(here.groupBy("lane", "run").count(), "lane", "run")
    nth = F.row_number().over(Window.partitionBy("lane", "run").orderBy("line", "at")) - 1
    return (here.withColumn("nth", nth).join(before, ["lane", "run"])
            .select("kept_as", "block", "release", "deadline", "slot", (F.col("before") + F.col("nth")).alias("position")))


def mix_query(docs: DataFrame) -> DataFrame:
    return (mix(docs, F.struct("doc_id", "source"))
            .select("kept_as.doc_id", "kept_as.source", "block", "release", "deadline", "slot", "position"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, laid out in the order of the mix:
    range-partitioned by their places and sorted, so that the files written
    from them, in name order, hold the mix."""
    order = ["lane", "line", "at"]
    return placed(docs, F.struct("*")).repartitionByRange(*order).sortWithinPartitions(*order).select("kept_as.*")


MIX_SQL = """
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents
), ranked AS (
  SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS rank FROM r
), sources AS (
  SELECT key, count(*) AS n_rows FROM r GROUP BY key
), targets AS (
  SELECT key, n_rows, row_number() OVER (ORDER BY key) AS i, greatest(1, round(pow(n_rows, 0.5) / sum(pow(n_rows, 0.5)) OVER () * greatest(1000, 8 * count(*) OVER ())))::BIGINT AS n FROM sources
), lists AS (
  SELECT list(n ORDER BY i) AS n_of, list(n_rows ORDER BY i) AS rows_of, sum(n)::BIGINT AS total FROM targets
), state AS (
  SELECT 0::BIGINT AS t, list_transform(n_of, lambda n: 0::BIGINT) AS before, n_of, rows_of, total,
         list_min(list_transform(n_of, lambda n, i: ((total + n - 1) // n) * 1000000000 + i)) % 1000000000 AS pick
  FROM lists WHERE total > 0
  UNION ALL
  SELECT t, before, n_of, rows_of, total,
         list_min(list_transform(before, lambda k, i: CASE WHEN k * total // n_of[i] <= t THEN (((k + 1) * total + n_of[i] - 1) // n_of[i]) * 1000000000 + i END)) % 1000000000
  FROM (SELECT t + 1 AS t, list_transform(before, lambda k, i: CASE WHEN i = pick THEN k + 1 ELSE k END) AS before, n_of, rows_of, total FROM state WHERE t + 1 < total)
), slots AS (
  SELECT *, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM state
), placed AS (
  SELECT doc_id, source, key, rank, i, n, rank // 16 AS block, rank // 16 // n AS cycle FROM ranked JOIN targets USING (key)
)
SELECT doc_id, source, block, block * total // n AS release, ((block + 1) * total + n - 1) // n AS deadline, cycle * total + t AS slot,
       (list_sum(list_transform(rows_of, lambda x, j: least(x, 16 * (cycle * n_of[j] + before[j])))) + rank % 16)::BIGINT AS position
FROM placed JOIN slots ON pick = i AND nth = block % n
"""
