"""What several operators share: durable intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; words are the runs of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_fallback: list[str] = []
#: Where :func:`durable` notes the tables of the work at hand, if anybody collects them.
collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)
#: Paths of tables that :func:`durable` wrote and :func:`forget` has not deleted.
written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="quillvec-"))
        folder = _fallback[0]
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most ``rows`` rows from now on: texts may be long, and a batch is held by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def lean(spark: SparkSession) -> None:
    """Executors collect their garbage and hand back memory that only the work so far has needed; a task for each core."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    if (mine := collecting.get()) is not None:
        mine.append(path)
    spark._jvm.System.gc()  # Spark deletes shuffle files once the driver has forgotten their plan, which a full heap would else put off
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by :func:`durable`; nothing may read it afterwards."""
    forget_paths(df.sparkSession, [df._durable_path])


def forget_paths(spark: SparkSession, paths: list[str]) -> None:
    for p in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in written:
            written.remove(p)


#: Rows (of a few numbers each) up to which a table is broadcast.
FEW = 200_000


def few(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join with ``other``, a written table of a few numbers a row, which is broadcast if it has at most ``FEW`` rows; those are counted."""
    return df.join(F.broadcast(other) if other.count() <= FEW else other, on, how)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else ``df`` holds, also names that differ in case only."""
    have = df.columns
    return df.toDF(*[f"k_{i}" for i in range(len(have))]).select(*[F.col(f"k_{have.index(n)}").alias(n) for n in names])


def shielded(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``df`` with columns k_0, k_1, ..., which nothing clashes with; the true names in order; and the new name of each."""
    names = df.columns
    return df.toDF(*[f"k_{i}" for i in range(len(names))]), names, {n: f"k_{i}" for i, n in reversed(list(enumerate(names)))}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with _doc (the key; null sorts first) and _turn, which tells rows of one key apart by their text."""
    made = df.withColumn("_doc", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    twice = made.groupBy("_doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    turn = F.row_number().over(Window.partitionBy("_doc").orderBy(F.coalesce(text, F.lit("")))) - 1 if twice else F.lit(0)
    return made.withColumn("_turn", turn.cast("int"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component), component the smallest node of each.

    Alternates the large-star and small-star steps, which bound the rows by the edges and never gather
    a node's neighbours in one task: the smallest neighbour is a plain minimum, combined before the shuffle.
    Each round's edges are written to the shared folder. Nodes without an edge do not appear; nulls are dropped.
    """
    spark = edges.sparkSession
    now = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = durable(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        # All stars: no node is both the larger end of one edge and the smaller end of another, and each has one centre.
        n = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        done = not n and not after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        forget(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
