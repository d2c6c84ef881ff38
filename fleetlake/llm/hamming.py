"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments and every segment value is indexed.  Round r
looks up, for each query still open, all segment values at distance r from its
own segments.  After round r every code within m * (r + 1) - 1 bits has been
found (a code further off in each segment than r is further off in all than
that), so a query whose k-th best distance is no greater is done.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import written


def sign_code(vector: Column, segment_bits: int = 16) -> Column:
    """The signs of a vector's values (1: above 0), as an array of segments."""
    bits = lambda part: F.aggregate(F.transform(part, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, b: a + b)
    segments = F.filter(F.sequence(F.lit(0), F.size(vector)), lambda s: s * segment_bits < F.size(vector))
    return F.transform(segments, lambda s: bits(F.slice(vector, s * segment_bits + 1, segment_bits)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segment_bits: int = 16) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) from codes (id, code) and
    queries (id, code): the k nearest codes of each query other than its own
    id, by (distance, id), exactly.

    Null codes and ids are not searched or found.  Rows with one id and code
    count once; an id with several codes is several entries.  Codes with
    another number of segments are never compared.  Fewer than k others give
    fewer rows, and empty tables none.

    Equal codes are one entry of the index with their k + 1 least ids, more of
    which no result can hold, so a code that a third of all rows have costs no
    more than any other."""
    rows = codes.filter("id is not null and size(code) > 0").select("id", "code").distinct()
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("nth") <= k + 1)
    entries = written(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    index = written(entries.select("code", "ids", F.posexplode("code").alias("segment", "value")), "index")
    asked = written(queries.filter("id is not null and size(code) > 0").select("id", "code").distinct(), "queries")
    every = written(asked.select(F.col("code").alias("query")).distinct(), "open")
    # a query's bound is its worst distance so far, once it has k + 1 entries
    best, still = None, every.withColumn("bound", F.lit(2**30))
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for radius in range(segment_bits + 1):
        masks = [sum(1 << b for b in ones) for ones in combinations(range(segment_bits), radius)]
        # the open queries may be one small file, and each has many probes
        probes = (still.repartition(tasks, "query").select("query", "bound", F.posexplode("query").alias("segment", "own"))
                  .select("query", "bound", "segment", F.explode(F.transform(F.from_json(F.lit(str(masks)), "array<int>"), lambda m: F.col("own").bitwiseXOR(m))).alias("value")))
        apart = F.zip_with("query", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        # the planner takes the probes for as few rows as the queries, so it is told not to broadcast them
        met = (probes.hint("merge").join(index, ["segment", "value"]).filter(F.size("query") == F.size("code"))
               .withColumn("apart", apart)
               .filter(F.aggregate("apart", F.lit(0), lambda s, x: s + x) <= F.col("bound"))
               # each pair counts once: in the first of its nearest segments
               .filter((F.array_min("apart") == radius) & (F.array_position("apart", F.lit(radius)) == F.col("segment") + 1)))
        found = met.select("query", F.aggregate("apart", F.lit(0), lambda s, x: s + x).alias("distance"), F.explode("ids").alias("id"))
        found = _best(found, k + 1)
        best = written(found if best is None else _best(best.unionByName(found), k + 1), "best")
        covered = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        still = written(every.join(covered, "query", "left").filter(
            (F.coalesce("n", F.lit(0)) <= k) | (F.col("worst") > F.size("query") * (radius + 1) - 1))
            .select("query", F.when(F.col("n") > k, F.col("worst")).otherwise(2**30).alias("bound")), "open")
        if still.isEmpty():
            break
    others = best.join(asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")), "query").filter("query_id != id")
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias("neighbor_id"), F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


def search_query(embeddings: DataFrame) -> DataFrame:
    """Ten nearest sign codes for every row whose vec_id is divisible by 20."""
    codes = embeddings.filter("embedding is not null").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.filter("id % 20 = 0"))


SEARCH_SQL = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM c AS q JOIN c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank
FROM p QUALIFY rank <= 10
"""
