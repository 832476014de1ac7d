"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code holds the signs of its components, 64 at most; a wider vector stops the query with an error. Codes are cut into m segments, m = ceil(64 / log2 n), and
each segment of each distinct code is an index entry. Queries probe in rounds: round r looks up the segment values at
exactly r bits from the query's, and adds what it finds to what the rounds before found. If two codes are within
m*r + m - 1 bits, some segment is within r bits, so after round r all neighbours up to that distance are known; a query is
done as soon as its k-th verified neighbour is no farther. A pair is found once: in the round of its closest segment, by
the first such segment. Of what is found, a query carries on the rows up to its k-th distance only, which also bounds what
later rounds look for.

Ties are broken by id. Distinct codes carry their k smallest ids only, and equal queries are searched once, so that
large groups of copies neither meet in one task nor multiply. Edge cases: vectors that are null or empty are neither
searched for nor found; null and NaN components count as not positive; rows with a null id are left out; a repeated row
counts once per id; with fewer than k rows all of them are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrolith.llm.common import cut, table

K = 10
BITS = 64
QUERY_EVERY = 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sign_code(vector: str) -> Column:
    """64 sign bits of an array column as a long; wider arrays are an error."""
    wide = F.raise_error(F.format_string(f"vectors of over {BITS} components are not supported: %d", F.size(vector))).cast("long")
    bit = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(F.coalesce(x, F.lit(0)).cast("double").between(5e-324, float("inf")), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) > BITS, wide).when(F.size(vector) > 0, F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segment_masks(m: int) -> list[int]:
    edges = [BITS * j // m for j in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def flips(mask: int, radius: int) -> list[int]:
    """All patterns of ``radius`` bits inside ``mask``."""
    return [sum(c) for c in combinations([1 << p for p in range(BITS) if mask >> p & 1], radius)]


def nearest_rows(found: DataFrame, k: int) -> DataFrame:
    """Of each query the rows up to the distance at which it has k ids."""
    closer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_closer", F.sum(F.size("ids")).over(closer)).where(F.coalesce("_closer", F.lit(0)) < k).drop("_closer")


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """codes (id long, code long), queries (code long) to (query, code, distance, ids) of at least the k nearest ids."""
    first = Window.partitionBy("code").orderBy("id")
    least = codes.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    index = cut(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = index.count()
    m = min(BITS // 4, max(2, ceil(BITS / max(1.0, log2(max(n, 2))))))
    masks = segment_masks(m)
    entries = index.select("code", "ids", F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), F.col("code").bitwiseAND(F.lit(signed(s))).alias("value")) for j, s in enumerate(masks)])).alias("e")).select("code", "ids", "e.seg", "e.value")
    waiting = cut(queries.where("code is not null").select(F.col("code").alias("query"), F.lit(BITS).alias("most")).distinct())
    found = None
    for r in range(ceil(BITS / m) + 1):
        left = waiting.count()
        if not left or not n:
            break
        probes = None
        for j, s in enumerate(masks):
            flip = F.explode(F.lit([signed(x) for x in flips(s, r)]).cast("array<bigint>")).alias("flip")
            part = waiting.select("query", "most", flip).select("query", "most", F.lit(j).alias("seg"), F.col("query").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(signed(s))).alias("value"))
            probes = part if probes is None else probes.union(part)
        apart = F.col("query").bitwiseXOR(F.col("code"))
        on = (F.col("p.seg") == F.col("e.seg")) & (F.col("p.value") == F.col("e.value")) & (F.bit_count(apart) <= F.col("p.most"))
        for j, s in enumerate(masks):
            own = F.bit_count(apart.bitwiseAND(F.lit(signed(s))))
            on &= (F.col("e.seg") == j) | (own > r) | ((own == r) & (F.col("e.seg") < j))
        near = probes.alias("p").join(entries.alias("e"), on).select("query", "code", "ids", F.bit_count(apart).cast("int").alias("distance"))
        found = cut(nearest_rows(near if found is None else found.union(near), k))
        state = found.groupBy("query").agg(F.sum(F.size("ids")).alias("_have"), F.max("distance").alias("_far"))
        known = waiting.drop("most").join(state, "query", "left").where(~(F.coalesce("_have", F.lit(0)) >= k) | (F.col("_far") >= m * (r + 1)))
        waiting = cut(known.select("query", F.when(F.col("_have") >= k, F.col("_far")).otherwise(BITS).alias("most")))
    return found if found is not None else waiting.sparkSession.createDataFrame([], "query long, code long, ids array<long>, distance int")


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """vectors (id, code); (query_id, neighbor_id, rank, distance) for every row that ``is_query`` selects."""
    coded = cut(vectors.where("id is not null and code is not null"))
    asked = coded.where(is_query).distinct()
    found = search(coded, asked.select("code"), k)
    each = found.select("query", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(best, "query").select("query_id", "neighbor_id", "rank", "distance")


def op4_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes, itself included, of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), sign_code("embedding").alias("code"))
    return nearest(vectors, F.col("id") % QUERY_EVERY == 0)


OP4_SQL = f"""
WITH bits AS (
  SELECT DISTINCT vec_id, list_transform(range(1, {BITS + 1}), lambda i: CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN 1 ELSE 0 END) AS b FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(range(1, {BITS + 1}), lambda i: abs(q.b[i] - v.b[i]))) AS INTEGER) AS distance
  FROM bits q, bits v WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, neighbor_id, rank, distance FROM ranked WHERE rank <= {K}
"""
