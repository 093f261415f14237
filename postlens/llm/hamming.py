"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code holds the signs of its elements (1 where positive), up to 64 of them in one long.
Codes are cut into m segments, four of 16 bits at every size of the table. In round r every open
query looks up the segment values that differ from its own in exactly r bits. After round r all
codes within distance m * (r + 1) - 1 have been seen, as a nearer one differs by at most r bits in
some segment; a query is closed when its k-th verified distance is within that. A pair counts in one
round and one segment only (the least differing segment, the first of those), and only if it is no
farther than the k-th nearest found so far, so no round repeats work or needs a distinct.

Equal codes are one entry of the index, with its ``k + 1`` smallest ids (ties go to the smaller id, so
no further id of the code can be an answer), and equal query codes are searched once.

Defined results: rows with a null id or null vector are neither indexed nor searched; null elements
count as not positive; vectors of other lengths are padded with 0 bits, and over 64 elements is an
error; ties are broken by id; repeated rows (one id twice) count once; a query is not its own
neighbour; with fewer than k other rows all are returned; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import stage

BITS = 64
SEGMENTS = 4


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code of every row that has both; one row per id."""
    signs = F.aggregate(F.col(vector_col), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    short = F.raise_error(F.lit("vectors of more than 64 elements"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.when(F.size(vector_col) > BITS, short.cast("long")).otherwise(signs).alias("code")).groupBy("id").agg(F.min("code").alias("code"))


def segments() -> list[tuple[int, int]]:
    """Shift and width of each segment: the same for every size of the index, so that a query's probes depend on how far its neighbours are alone."""
    cuts = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(code: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(code), shift).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(rows: DataFrame, width: int, r: int) -> DataFrame:
    """Every row once for each mask of r of width bits: one bit after the other, each above the last, so no list of masks is held."""
    out = rows.withColumn("mask", F.lit(0).cast("long")).withColumn("above", F.lit(0))
    for left in range(r, 0, -1):
        out = out.withColumn("bit", F.explode(F.sequence("above", F.lit(width - left))))
        out = out.withColumn("mask", F.col("mask").bitwiseOR(F.expr("shiftleft(1L, bit)"))).withColumn("above", F.col("bit") + 1).drop("bit")
    return out.drop("above")


def top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index and queries have id and code. Gives query_id, rank (from 1), id, distance."""
    spark = index.sparkSession
    index, queries = stage(index, "mih-codes"), stage(queries, "mih-queries")
    per_code = Window.partitionBy("code").orderBy("id")
    members = stage(index.withColumn("nth", F.row_number().over(per_code)).where(F.col("nth") <= k + 1), "mih-members")
    entries = stage(members.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("n")), "mih-entries")
    n_codes = entries.count()
    parts = segments()
    m = len(parts)
    lookup = stage(entries.select("code", "least", "n", F.posexplode(F.array(*[_value("code", *p) for p in parts])).alias("seg", "val")), "mih-lookup")
    open_ = stage(queries.select(F.col("code").alias("q"), F.lit(BITS).alias("most")).distinct(), "mih-open")
    widest = max(w for _, w in parts)
    best = spark.createDataFrame([], "q long, code long, least long, n long, distance int")
    closed = None
    nearest = Window.partitionBy("q").orderBy("distance", "least")
    for r in range(widest + 1):
        diffs = F.array(*[F.bit_count(_value("q", *p).bitwiseXOR(_value("code", *p))) for p in parts])
        probes = None
        for s, (shift, width) in enumerate(parts):
            if r > width:
                continue
            own = _flipped(open_.select("q", "most", F.lit(s).alias("seg")), width, r)
            own = own.select("q", "most", "seg", _value("q", shift, width).bitwiseXOR(F.col("mask")).alias("val"))
            probes = own if probes is None else probes.unionByName(own)
        # the exploded probes look as small to the planner as what they were exploded from: never broadcast them
        p, i = probes.hint("merge").alias("p"), lookup.alias("i")
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        same = (F.col("p.seg") == F.col("i.seg")) & (F.col("p.val") == F.col("i.val"))
        # this round's own pairs, and of those only what can still be among the nearest
        met = p.join(i, same & (F.array_min(diffs) == r) & (F.array_position(diffs, r) == F.col("p.seg") + 1) & (distance <= F.col("most")))
        verified = met.select("q", "code", "least", "n", distance.alias("distance"))
        both = best.join(open_, "q", "left_semi").unionByName(verified)
        best_now = stage(both.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1).drop("place"), f"mih-best-{r}")
        reach = m * (r + 1) - 1
        sure = best_now.groupBy("q").agg(F.sum(F.when(F.col("distance") <= reach, F.col("n")).otherwise(0)).alias("within"), F.count("*").alias("found"))
        done = (F.col("within") >= k + 1) | (F.col("found") >= min(n_codes, k + 1) if n_codes <= k + 1 else F.lit(False))
        if r == widest:
            done = F.lit(True)
        over = stage(sure.where(done).select("q"), f"mih-over-{r}")
        ready = best_now.join(over, "q", "left_semi")
        closed = ready if closed is None else closed.unionByName(ready)
        # the distance of the nearest codes with k + 1 ids so far: nothing beyond it can be an answer
        fill = best_now.withColumn("sum", F.sum("n").over(nearest)).where(F.col("sum") >= k + 1).groupBy("q").agg(F.min("distance").alias("bound"))
        open_ = stage(open_.join(over, "q", "left_anti").join(fill, "q", "left").select("q", F.least("most", F.coalesce("bound", "most")).alias("most")), f"mih-open-{r}")
        best = best_now
        if not open_.take(1):
            break
    flat = closed.join(members.select("code", "id"), "code").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("place") <= k + 1)
    answers = stage(flat.select("q", F.col("id").alias("found_id"), "distance"), "mih-answers")
    rows = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(answers, "q").where("found_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "found_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("found_id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


def oracle(k: int) -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as c from embeddings where embedding is not null),
p as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.c, v.c), lambda z: case when z[1] = z[2] then 0 else 1 end)) as bigint) as distance
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p)
select query_id, rank, vec_id, distance from r where rank <= {k}
"""
