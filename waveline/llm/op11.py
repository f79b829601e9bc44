"""Query of centroid clustering and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.catalog import query
from waveline.llm.centroids import clusters
from waveline.llm.common import table

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1


def _sql() -> str:
    assign = """
a{i} as materialized (
  select r, vec_id, v, min_by(c, (d, c)) as c, min(d) as d
  from (select x.r, x.vec_id, x.v, y.c, list_sum(list_transform(range(1, {n}), lambda j: (x.v[j] - y.v[j]) * (x.v[j] - y.v[j])))::bigint as d
        from v x, c{i} y)
  group by r, vec_id, v)"""
    move = """
c{j} as materialized (
  select p.c, coalesce(q.v, p.v) as v
  from c{i} p left join (
    select c, list(((t - ((t % m) + m) % m) // m)::bigint order by k) as v
    from (select c, k, sum(v[k])::hugeint as t, count(*)::hugeint as m from a{i}, range(1, {n}) w(k) group by c, k) group by c) q using (c))"""
    steps = [f"""
v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {COMPONENTS}),
c0 as materialized (
  select row_number() over (order by sha256('{SEED}:' || vec_id), vec_id, v) - 1 as c, v
  from v order by c limit {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        steps.append(assign.format(i=i, n=COMPONENTS + 1))
        if i < ROUNDS:
            steps.append(move.format(i=i, j=i + 1, n=COMPONENTS + 1))
    return f"""with {",".join(steps)}
select a.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia,
       (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c using (c)"""


@query("op11_centroids", _sql())
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return clusters(table(spark, sf_dir, "embeddings"), COMPONENTS, CENTROIDS, ROUNDS, SCALE, start)
