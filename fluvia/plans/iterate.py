"""Fixed points over DataFrames. Every round's rows are written in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_ROUNDS = 10_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a private one on this machine, for local runs only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            there = tempfile.mkdtemp(prefix="fluvia-")
            atexit.register(shutil.rmtree, there, True)
        context.setCheckpointDir(there)
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and without lineage, as a table in the shared folder.

    Spark's own checkpoints keep the estimates and constraints of the plan that they cut. Constraints grow with every
    join of a table with itself, and planning with them; estimates know nothing of what rounds do to sizes.
    """
    return Rounds(df.sparkSession, df.schema).append(df)


class Rounds:
    """Rows that rounds append to, as a table in the shared folder: what is there is never written again.

    With by, the rows lie in a folder for each value of that column, so one value's rows are read alone.
    """

    def __init__(self, spark: SparkSession, schema: StructType, by: str | None = None):
        self.spark, self.by, self.schema = spark, by, schema
        self.path = f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.rounds = 0

    def append(self, df: DataFrame) -> DataFrame:
        """Write rows as the next round's, and give them back as they were read again."""
        rows = df.select(self.schema.names)
        (rows.write.partitionBy(self.by) if self.by else rows.write).parquet(f"{self.path}/round={self.rounds}")
        self.rounds += 1
        return self.round(self.rounds - 1)

    def round(self, k: int) -> DataFrame:
        """What the k-th call appended."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={k}").select(self.schema.names)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)

    def where(self, value: int) -> DataFrame:
        """The rows with that value of the column by, of all rounds."""
        return self.all().filter(F.col(self.by) == value)


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(start, id): all that each (start, id) row of seeds reaches along (src, dst) edges, itself included.

    Semi-naive: only what the last round found is joined with the edges again, and only that is written.
    """
    first = seeds.select("start", "id").distinct()
    seen = Rounds(seeds.sparkSession, first.schema)
    frontier = seen.append(first)
    for _ in range(max_rounds):
        if frontier.isEmpty():
            return seen.all()
        step = frontier.join(edges.select("src", "dst"), F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        frontier = seen.append(step.join(seen.all().hint("merge"), ["start", "id"], "left_anti"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def reach_set(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id): all that the ids of seeds reach along (src, dst) edges, themselves included."""
    found = reach(edges, seeds.select(F.lit(0).alias("start"), "id"), max_rounds)
    return found.select("id")


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst): every pair with a path, by squaring; as many rounds as the logarithm of the longest path."""
    pairs = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    count = pairs.count()
    for _ in range(max_rounds):
        a, b = pairs.select("src", F.col("dst").alias("mid")), pairs.select(F.col("src").alias("mid"), "dst")
        after = cut(pairs.union(a.join(b, "mid").select("src", "dst")).distinct())
        if (now := after.count()) == count:
            return after
        pairs, count = after, now
    raise RuntimeError("the closure didn't end")


def walk_to_root(nodes: DataFrame, sums: list[str] | None = None) -> DataFrame:
    """(id, root, depth, *sums) of a forest of (id, parent, *sums), by pointer doubling.

    A parent that is null or no id ends the path. sums are totals over the path, both ends included.
    As many rounds as the logarithm of the deepest path; a loop is an error.
    """
    sums = sums or []
    ids = nodes.select(F.col("id").alias("known"))
    # A missing parent looks for the id itself, so that such rows don't all meet under one key.
    now = nodes.join(ids.hint("merge"), F.coalesce("parent", "id") == F.col("known"), "left").select(
        "id", F.when(F.col("parent").isNotNull(), F.col("known")).alias("ptr"), F.when(F.col("parent").isNotNull(), F.col("known")).alias("root"), *sums
    )
    now = now.select("id", "ptr", F.coalesce("root", "id").alias("root"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("depth"), *sums)
    # A row without ptr is at its root and isn't written again; only the others go on.
    rows = Rounds(nodes.sparkSession, now.schema)
    now = rows.append(now)
    limit = now.count()
    for k in range(66):
        going = now.filter("ptr is not null")
        if going.isEmpty():
            return rows.all().filter("ptr is null").drop("ptr")
        if 1 << k > 2 * limit:
            break
        far = rows.all().filter("ptr is null").union(going).select(
            F.col("id").alias("at"), F.col("ptr").alias("far_ptr"), F.col("root").alias("far_root"), F.col("depth").alias("far_depth"),
            *[F.col(s).alias(f"far_{s}") for s in sums],
        )
        now = rows.append(
            going.join(far.hint("merge"), F.col("ptr") == F.col("at")).select(
                "id", F.col("far_ptr").alias("ptr"), F.col("far_root").alias("root"), (F.col("depth") + F.col("far_depth")).alias("depth"),
                *[(F.col(s) + F.coalesce(f"far_{s}", F.lit(0))).alias(s) for s in sums],
            )
        )
    raise ValueError("the network has loops")


def forest_sums(nodes: DataFrame, names: list[str], how=F.sum) -> DataFrame:
    """(id, *names) of a forest of (id, parent, *names): each column summed up over all that flows to a node, its own included.

    how is an aggregate that may join parts in any order (sum, max, bit_xor and the like). As many rounds
    as the logarithm of the depth: each adds what is twice as far. A parent that is no id ends a path.
    """
    joined = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.bit_xor: lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))}[how]
    ids = nodes.select(F.col("id").alias("_k"))
    now = nodes.join(ids.hint("merge"), F.coalesce("parent", "id") == F.col("_k"), "left")
    now = cut(now.select("id", F.when(F.col("parent").isNotNull(), F.col("_k")).alias("ptr"), *names))
    for _ in range(66):
        going = now.filter("ptr is not null")
        if going.isEmpty():
            return now.select("id", *names)
        given = going.groupBy(F.col("ptr").alias("_to")).agg(*[how(c).alias(f"_{c}") for c in names])
        hop = going.select(F.col("id").alias("_at"), F.col("ptr").alias("_next"))
        hop = going.select(F.col("id").alias("_i"), "ptr").join(hop.hint("merge"), F.col("ptr") == F.col("_at")).select("_i", "_next")
        now = cut(
            now.join(given.hint("merge"), F.col("id") == F.col("_to"), "left").join(hop.hint("merge"), F.col("id") == F.col("_i"), "left")
            .select("id", F.col("_next").alias("ptr"), *[joined(F.col(c), F.col(f"_{c}")).alias(c) for c in names])
        )
    raise ValueError("the network has loops")


def peeled(edges: DataFrame) -> DataFrame:
    """(src, dst) edges without those that start at an id nothing flows to, or end at one that flows nowhere."""
    ahead, behind = edges.select(F.col("src").alias("n")).distinct(), edges.select(F.col("dst").alias("n")).distinct()
    return cut(edges.join(ahead, F.col("dst") == F.col("n"), "left_semi").join(behind, F.col("src") == F.col("n"), "left_semi"))


#: At this level edges are peeled off to see whether there are loops, which would go on for as many levels as there are ids.
PATIENCE = 24


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest path of (src, dst) edges from each id to one without edges out; 0 there.

    Where no id is the dst of several edges, these are a forest, and the rounds follow the logarithm of its
    depth: an id's level is how much deeper the deepest id below it lies. Else a round for every level,
    which writes that level's ids alone. A loop is an error: it is what is left once both ends are peeled off, a
    round for each level as well.
    """
    ids = nodes.select("id").distinct()
    back = cut(edges.select("src", "dst").distinct())
    if back.groupBy("dst").count().filter("count > 1").isEmpty():
        parents = ids.join(back, F.col("id") == F.col("dst"), "left").select("id", F.col("src").alias("parent"))
        deep = walk_to_root(parents).select("id", "depth")
        below = forest_sums(parents.join(deep, "id").select("id", "parent", F.col("depth").alias("most")), ["most"], F.max)
        return cut(deep.join(below, "id").select("id", (F.col("most") - F.col("depth")).alias("level")))
    first = ids.join(back.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("level"))
    found, level = Rounds(nodes.sparkSession, first.schema), 0
    frontier = found.append(first)
    while not frontier.isEmpty():
        level += 1
        if level == PATIENCE:
            left, count = back, back.count()
            while count:
                left, before = peeled(left), count
                count = left.count()
                if count == before:
                    raise ValueError("the network has loops")
        frontier = found.append(
            frontier.join(back, F.col("id") == F.col("dst")).select(F.col("src").alias("id")).distinct().withColumn("level", F.lit(level).cast("long"))
        )
    return cut(found.all().groupBy("id").agg(F.max("level").alias("level")))


def by_levels(facts: DataFrame, edges: DataFrame, step) -> DataFrame:
    """Values of ids level by level, from those without (src, dst) edges in.

    step(rows, given) gets a level's facts (id, ...) and what their edges bring (dst and the values of src), or None
    for the first level, and returns (id, values...). Every row is written once and read once: edges lie by the
    level of their src, and what they bring by that of their dst.
    """
    spark = facts.sparkSession
    placed = cut(facts.join(levels(facts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("id").alias("_i"), "level"), F.col("id") == F.col("_i")).drop("_i"))
    top = placed.agg(F.max("level")).first()[0]
    rows = Rounds(spark, placed.schema, "level")
    rows.append(placed.repartition("level"))
    at = placed.select(F.col("id").alias("_n"), "level")
    known = edges.join(at.withColumnRenamed("level", "from"), F.col("src") == F.col("_n")).drop("_n").join(at.withColumnRenamed("level", "to"), F.col("dst") == F.col("_n")).select("src", "dst", "to", "from")
    ways = Rounds(spark, known.schema, "from")
    ways.append(known.repartition("from"))
    done = given = None
    for k in range((top if top is not None else 0) + 1):
        here = rows.where(k).drop("level")
        values = step(here, None if not k else given.where(k).drop("to"))
        if done is None:
            done = Rounds(spark, values.schema)
        fresh = done.append(values)
        if top is None or k == top:
            break
        brought = ways.where(k).join(fresh.withColumnRenamed("id", "_i"), F.col("src") == F.col("_i")).drop("src", "from", "_i")
        if given is None:
            given = Rounds(spark, brought.schema, "to")
        given.append(brought)
    return done.all()


def positions(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """df with the place of each row in the global order, without bringing all rows into one partition.

    Rows are range-partitioned and sorted; a partition's rows are counted from the sum of the counts before it.
    """
    placed = cut(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()))
    part, at = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, offsets = start, []
    for row in counts:
        offsets.append((row["part"], before))
        before += row["count"]
    if not offsets:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_mark")
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = placed.join(F.broadcast(table), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + at).drop("_mark", "_part", "_before")
