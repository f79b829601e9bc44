"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at many places. A key goes to the next place
clockwise of its hash, up to the shard's bound. Bounds add up to the number of
rows and are at most one apart, so the shards end at most one row apart. A
shard keeps the first of its own keys (places in ring order, keys of one place
in the order of a hash); the others go on clockwise, in ring order, to the first
shard with room. Only the excess over the bound ever moves.

How many keys of a place go where depends on counts per place alone. A row then
needs its rank within its place: rows are cut into cells of about ``CELL`` rows,
whose counts are summed up, and ranked inside. Equal rows are counted first and
written out again in pieces, so neither a hot key nor a group of copies lands in
one task.

Absent ids hash as an empty text, absent texts count as empty (one byte, crc32
0). Repeated rows are rows of their own with slots of their own. Texts of any
length are only measured. An empty table gives no rows; with fewer rows than
shards some shards stay empty. Ties of the hash go by id, size and checksum.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveline.llm.common import Scratch

#: Hex digits of a hash that make a place on the ring, and its bits.
DIGITS, BITS = 15, 60
#: Bits of the cells by which places are looked up.
LOOKUP_BITS = 12
#: Rows to a window, about; more cells make room for more rows.
CELL = 2**20
#: A group of more equal rows is written out by several tasks.
PIECE = 10_000


def place(text: Column) -> Column:
    """Place of a text on the ring."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """(arc, shard, lo, hi, others) of each virtual node: it takes places in (lo, hi].

    ``others`` lists the shards in the order in which they follow clockwise. The
    table has ``shards * replicas`` rows whatever the data.
    """
    nodes = spark.range(0, shards * replicas, 1, 1).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    nodes = nodes.withColumn("hi", place(F.concat_ws("#", "shard", "replica")))
    order = Window.orderBy("hi", "shard")
    after = F.collect_list("shard").over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.collect_list("shard").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return nodes.select(
        (F.row_number().over(order) - 1).alias("arc"),
        "shard",
        F.coalesce(F.lag("hi").over(order), F.lit(-1)).alias("lo"),
        "hi",
        F.array_except(F.array_distinct(F.concat(after, before)), F.array("shard")).alias("others"),
    )


def _lookup(nodes: DataFrame) -> DataFrame:
    """(near, lo, hi, arc): the arcs that meet a cell of the ring; what lies behind the last node belongs to the first."""
    arcs = nodes.select("lo", "hi", "arc")
    wrapped = nodes.agg(F.max("hi").alias("lo")).select("lo", F.lit(2**BITS - 1).alias("hi"), F.lit(0).alias("arc")).filter("lo < hi")
    shift = BITS - LOOKUP_BITS
    return arcs.unionAll(wrapped).withColumn("near", F.explode(F.sequence(F.shiftright(F.col("lo") + 1, shift), F.shiftright("hi", shift))))


#: Room of each shard after its own keys, walked through arc by arc.
_WALK = """
aggregate(
  arcs,
  named_struct('room', room, 'out', cast(array() as array<struct<arc: int, shard: int, lo: bigint, hi: bigint, slot: bigint>>)),
  (acc, x) -> aggregate(
    x.others,
    named_struct('rest', x.rest, 'room', acc.room, 'out', acc.out),
    (c, s) -> named_struct(
      'rest', c.rest - least(c.rest, c.room[s]),
      'room', transform(c.room, (r, i) -> if(i = s, r - least(c.rest, r), r)),
      'out', if(least(c.rest, c.room[s]) > 0,
        concat(c.out, array(named_struct('arc', x.arc, 'shard', s, 'lo', x.n - c.rest, 'hi', x.n - c.rest + least(c.rest, c.room[s]), 'slot', bound[s] - c.room[s]))),
        c.out)),
    c -> named_struct('room', c.room, 'out', c.out)),
  acc -> acc.out)
"""


def _segments(nodes: DataFrame, counts: DataFrame, rows: int, shards: int) -> DataFrame:
    """(arc, shard, lo, hi, slot): keys of an arc with rank in [lo, hi) go to the shard, the first of them to that slot."""
    bound = F.lit(rows // shards).cast("long") + (F.col("shard") < rows % shards).cast("long")
    so_far = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = nodes.join(counts, "arc", "left").select("arc", "shard", "others", F.coalesce("n", F.lit(0).cast("long")).alias("n"), bound.alias("bound"))
    arcs = arcs.withColumn("slot", F.coalesce(F.sum("n").over(so_far), F.lit(0).cast("long")))
    arcs = arcs.withColumn("home", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("bound") - F.col("slot"))))
    own = arcs.filter("home > 0").select("arc", "shard", F.lit(0).cast("long").alias("lo"), F.col("home").alias("hi"), "slot")

    by_shard = arcs.groupBy("shard").agg(F.first("bound").alias("bound"), F.sum("home").alias("held"))
    ordered = by_shard.agg(F.array_sort(F.collect_list(F.struct("shard", "bound", "held"))).alias("s"))
    ordered = ordered.select(F.transform("s", lambda x: x.bound).alias("bound"), F.transform("s", lambda x: x.bound - x.held).alias("room"))
    excess = arcs.filter("n > home").agg(F.array_sort(F.collect_list(F.struct("arc", "n", (F.col("n") - F.col("home")).alias("rest"), "others"))).alias("arcs"))
    walked = ordered.join(excess).select(F.explode(F.expr(_WALK)).alias("x")).select("x.*")
    return own.unionAll(walked)


def _copies(classes: DataFrame) -> DataFrame:
    """Every counted row as often as it stands, with its rank; large groups by several tasks."""
    here = F.least(F.lit(PIECE).cast("long"), F.col("m") - F.col("at"))
    few = classes.filter(F.col("m") <= PIECE).withColumn("at", F.lit(0).cast("long"))
    many = classes.filter(F.col("m") > PIECE).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PIECE).cast("long"))))
    pieces = few.unionAll(many.repartition("doc_id", "size", "text_crc32", "at"))
    return pieces.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), here - 1))).withColumn("rank", F.col("rank") + F.col("at") + F.col("i"))


def assign(docs: DataFrame, shards: int, replicas: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home) of each row of ``docs``: its shard, its place there, the shard of its hash."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = counted.withColumn("place", place(key)).withColumn("o", place(F.concat_ws(":", key, "size", "text_crc32")))

    nodes = scratch.put(ring(spark, shards, replicas))
    found = F.broadcast(_lookup(nodes))
    classes = counted.withColumn("near", F.shiftright("place", BITS - LOOKUP_BITS)).join(found, "near").filter("place > lo and place <= hi")
    classes = scratch.put(classes.select("doc_id", "size", "text_crc32", "m", "arc", "o"))

    total = classes.agg(F.sum("m")).first()[0] or 0
    # The upper 40 bits of o, in as many cells as hold about CELL rows each if one arc has them all.
    cells = -(-total // CELL) or 1
    classes = classes.withColumn("cell", F.shiftright(F.shiftright("o", BITS - 40) * cells, 40))
    sizes = classes.groupBy("arc", "cell").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    counts = sizes.groupBy("arc").agg(F.sum("n").alias("n"))
    # At most shards * (replicas + shards) rows.
    segments = scratch.put(_segments(nodes, counts, total, shards))

    inside = Window.partitionBy("arc", "cell").orderBy("o", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = classes.join(starts, ["arc", "cell"]).withColumn("rank", F.col("start") + F.coalesce(F.sum("m").over(inside), F.lit(0).cast("long")))
    ranked = scratch.put(ranked.select("doc_id", "size", "text_crc32", "m", "arc", "rank"))
    placed = _copies(ranked).join(F.broadcast(segments), "arc").filter("rank >= lo and rank < hi")
    home = F.broadcast(nodes.select("arc", F.col("shard").alias("home")))
    return placed.join(home, "arc").select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"), "home")
