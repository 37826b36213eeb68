"""A vector store on Parquet: parts that are only ever added, and numbered files of facts that name the parts which count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillvec.functions.text import entry_path
from quillvec.functions.vectors import l2_normalize_batches
from quillvec.operators import cluster, search

SCHEMA = "id long, vector array<float>, file_path string, text string"
MARKS = 1000  # delete marks that the facts hold; more are applied by a rewrite
BUCKET = 50_000  # rows that are put in order in one task


class VectorStore:
    """Entries (id, vector, file_path, text, cluster_id) of one dimension. Ids count from 0 in order of insertion and are not used again after a delete.

    A store that is there is opened as it is; ValueError if it has another dimension. An insert writes one more part, a delete writes a mark; loading, indexing,
    and every ``MARKS`` deletes write all entries anew. Each change ends with a new file of facts, numbered one higher, which must not be there yet; the last one that
    can be read holds. So a failure at any time leaves the store as it was, and of two writers at once one fails. An index
    holds for the entries it was built on; :meth:`search_clustered` builds it anew if some were added since.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, directory: str = "db"):
        if dim < 1:
            raise ValueError("the dimension must be positive")
        self.spark, self.path, self.dim, self.directory = spark, path.rstrip("/"), dim, directory
        self.number, self.next_id, self.stale = -1, 0, False
        self.parts: list[str] = []
        self.deleted: list[int] = []
        self.centroids: list[list[float]] = []
        self.batches: dict[str, int] = {}
        facts = self._read_facts(self.path)
        if facts:
            if facts["dim"] != dim:
                raise ValueError(f"the store has dimension {facts['dim']}, not {dim}")
            self._take(facts)

    # -- content

    def entries(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], SCHEMA + ", cluster_id int")
        rows = self._read(self.path, self.parts)
        return rows.where(~F.col("id").isin(self.deleted)) if self.deleted else rows

    def _read(self, path: str, parts: list[str]) -> DataFrame:
        made = None
        for p in parts:  # each is a folder of its own, by cluster
            one = self.spark.read.schema(SCHEMA + ", cluster_id int").parquet(f"{path}/data/{p}")
            made = one if made is None else made.unionByName(one)
        return made

    def _part(self, rows: DataFrame, centroids: list[list[float]]) -> str:
        """Writes a part."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("cluster_id", cluster.homes(centroids)(F.col("vector")) if centroids else F.lit(0))
        placed.write.partitionBy("cluster_id").parquet(f"{self.path}/data/{name}")
        return name

    def _replace(self, rows: DataFrame, next_id: int, centroids: list[list[float]], stale: bool) -> None:
        """Writes all entries anew; the parts before go once the facts are written."""
        old = self.parts
        self._write_facts(parts=[self._part(rows, centroids)], deleted=[], next_id=next_id, centroids=centroids, stale=stale)
        for p in old:
            self._fs().delete(self._hadoop(f"{self.path}/data/{p}"), True)

    def add(self, df: DataFrame, vector: str = "vector", text: str | None = None, order: str | None = None, once: tuple[str, int] | None = None) -> int:
        """Appends rows; returns how many were refused: null vectors and those of another dimension. Vectors are normalised.

        Ids go by ``order`` (a column; else the order of the frame's own ids is not defined). ``once`` is (name of a stream, number of its batch): a batch whose number
        the store has seen is not added again. ``df`` is read twice, first to count.
        """
        if once and self.batches.get(once[0], -1) >= once[1]:
            return 0
        good = df.where(F.size(vector) == self.dim)
        key = F.col(order) if order else F.monotonically_increasing_id()
        rows = good.select(key.alias("_o"), l2_normalize_batches(vector).cast("array<float>").alias("vector"), (F.col(text) if text else F.lit(None).cast("string")).alias("text"))
        total = df.count()
        ranked, added = numbered(rows, "_o", good.select(key.alias("_o")))
        made = ranked.select((F.col("_n") + self.next_id).alias("id"), "vector", "text")
        made = made.select("id", "vector", entry_path(self.directory, "id").alias("file_path"), "text")
        batches = self.batches | ({once[0]: once[1]} if once else {})
        if added:
            self._write_facts(parts=[*self.parts, self._part(made, [])], next_id=self.next_id + added, stale=True, batches=batches)
        elif once:
            self._write_facts(batches=batches)
        return total - added

    def delete(self, id_: int) -> bool:
        """Whether the id was there. A mark in the facts hides it; row groups without the id are not read to find it."""
        if not self.entries().where(F.col("id") == id_).limit(1).count():
            return False
        self._write_facts(deleted=[*self.deleted, int(id_)])
        if len(self.deleted) >= MARKS:
            self._replace(self.entries().drop("cluster_id"), self.next_id, self.centroids, self.stale)
        return True

    def count(self) -> int:
        return self.entries().count()

    def current_id(self) -> int:
        return self.next_id

    # -- search

    def build_index(self, k: int = cluster.CLUSTERS, iterations: int = cluster.ITERATIONS, seed: int | None = None, compat: str = "intended") -> None:
        """K-means over all entries; they are stored by cluster from then on."""
        rows = self.entries().drop("cluster_id")
        self._replace(rows, self.next_id, cluster.fit(rows, k, iterations, seed=seed, compat=compat, normalized=True), False)

    def search(self, query: list[float], k: int) -> DataFrame:
        return search.knn_exact(self.entries() if len(query) == self.dim else self.entries().limit(0), query, k, normalized=True)

    def search_clustered(self, query: list[float], k: int) -> DataFrame:
        if self.stale:
            self.build_index()
        if not self.centroids:
            return self.search(query, k)
        return search.knn_clustered(self.entries(), self.centroids, query, k, normalized=True)

    def search_batch(self, queries: DataFrame, k: int, clustered: bool = False, query_key: str = "query_id", vector: str = "vector") -> DataFrame:
        """(query_key, rank, id, similarity) for many queries at once; ``clustered`` looks into each query's nearest cluster only."""
        if clustered and self.stale:
            self.build_index()
        if not clustered or not self.centroids:
            return search.knn_join(queries, self.entries(), k, query_key=query_key, vector=vector)
        asked = queries.withColumn("cluster_id", cluster.homes(self.centroids)(F.col(vector)))
        return search.knn_join(asked, self.entries(), k, query_key=query_key, vector=vector, cluster="cluster_id")

    def search_text(self, query: list[float], k: int) -> str:
        return search.search_text(self.entries(), query, k, normalized=True) if len(query) == self.dim else ""

    # -- files

    def save(self, path: str) -> None:
        """A copy of entries, centroids and facts at ``path``, in place of what is there."""
        other = VectorStore.__new__(VectorStore)
        other.__dict__ |= self.__dict__ | {"path": path.rstrip("/"), "number": -1, "parts": [], "batches": {}}
        there = self._read_facts(other.path)
        if there:
            other.number, other.parts = there["number"], there["parts"]
        other._replace(self.entries().drop("cluster_id"), self.next_id, self.centroids, self.stale)

    def load(self, path: str) -> None:
        """Takes a saved store's content. ValueError for another dimension; this store stays as it is then. The next id never falls."""
        path = path.rstrip("/")
        facts = self._read_facts(path)
        if not facts:
            raise ValueError(f"no store at {path}")
        if facts["dim"] != self.dim:
            raise ValueError(f"the store has dimension {facts['dim']}, not {self.dim}")
        rows = self._read(path, facts["parts"]) if facts["parts"] else self.spark.createDataFrame([], SCHEMA)
        if facts["deleted"]:
            rows = rows.where(~F.col("id").isin(facts["deleted"]))
        self._load(rows.select("id", "vector", "file_path", "text"), facts["centroids"], facts["stale"])

    def load_entries(self, rows: DataFrame) -> None:
        """Replaces the content with (id, vector, file_path[, text]), as from a ``vecbin`` file; nothing is indexed then."""
        if rows.where(F.size("vector") != self.dim).limit(1).count():
            raise ValueError(f"vectors must have dimension {self.dim}")
        if "text" not in rows.columns:
            rows = rows.withColumn("text", F.lit(None).cast("string"))
        self._load(rows.select(F.col("id").cast("long").alias("id"), "vector", "file_path", "text"), [], False)

    def _load(self, rows: DataFrame, centroids: list, stale: bool) -> None:
        most = rows.agg(F.max("id")).first()[0]
        self._replace(rows, self.next_id if most is None else max(self.next_id, most + 1), centroids, stale)

    def export(self, path: str) -> None:
        """A ``vecbin`` file, by id; its ids have 32 bits."""
        self.entries().select(F.col("id").cast("int").alias("id"), "vector", "file_path").orderBy("id").write.format("vecbin").mode("overwrite").option("dim", self.dim).save(path)

    def export_texts(self, directory: str) -> None:
        """One text file per entry, ``{id}.txt``, in a folder that every worker can write."""

        def write(rows):
            import os

            os.makedirs(directory, exist_ok=True)
            for r in rows:
                with open(f"{directory}/{r['id']}.txt", "w", encoding="utf-8", newline="") as f:
                    f.write(r["text"] or "")

        self.entries().select("id", "text").foreachPartition(write)

    def _take(self, facts: dict) -> None:
        self.number, self.next_id, self.stale = facts["number"], facts["next_id"], facts["stale"]
        self.parts, self.deleted, self.centroids, self.batches = facts["parts"], facts["deleted"], facts["centroids"], facts["batches"]

    def _read_facts(self, path: str) -> dict | None:
        """The last facts at ``path`` that can be read; None if there are none."""
        fs, folder = self._hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration()), self._hadoop(f"{path}/facts")
        if not fs.exists(folder):
            return None
        for name in sorted((f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")), reverse=True):
            file = fs.open(self._hadoop(f"{path}/facts/{name}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            finally:
                file.close()
            try:
                return json.loads(text) | {"number": int(name[:-5])}
            except ValueError:
                continue  # its writer did not get to the end
        return None

    def _write_facts(self, **changed) -> None:
        """The next facts: those that hold now, with some changed. The files of two changes ago go."""
        facts = {"dim": self.dim, "next_id": self.next_id, "parts": self.parts, "deleted": self.deleted, "centroids": self.centroids, "stale": self.stale, "batches": self.batches} | changed
        number, fs = self.number + 1, self._fs()
        out = fs.create(self._hadoop(f"{self.path}/facts/{number:012d}.json"), False)  # fails if another writer was first
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        if number > 1:
            fs.delete(self._hadoop(f"{self.path}/facts/{number - 2:012d}.json"), False)
        self._take(facts | {"number": number})

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())


def numbered(df: DataFrame, order: str, keys: DataFrame, to: str = "_n") -> tuple[DataFrame, int]:
    """``df`` with positions from 0 by ``order``, without gaps, and the number of rows. ``keys`` is its order column alone, cheap to read.

    Rows are cut into buckets (4096 at most) at keys of a hashed sample, counted by bucket from the keys, and numbered inside their buckets: one shuffle of the
    rows, and buckets of about ``BUCKET`` rows as long as these suffice.
    """
    n = keys.count()
    buckets = max(1, min(n // 1000, max(-(-n // BUCKET), df.sparkSession.sparkContext.defaultParallelism), 4096))
    bounds: list = []
    if buckets > 1:
        every = max(1, n // (64 * buckets))
        some = [r[0] for r in keys.where(F.pmod(F.xxhash64(order), F.lit(every)) == 0).orderBy(order).collect()]  # about 64 a bucket
        bounds = sorted({some[i * len(some) // buckets] for i in range(1, buckets)} - {None}) if some else []
    at: Column = F.lit(0)
    if bounds:
        cuts = F.array(*map(F.lit, bounds))
        at = F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col(order))), F.lit(0)) if len(bounds) < 256 else F.coalesce(_place(cuts, len(bounds), order), F.lit(0))
    counts = dict(map(tuple, keys.groupBy(at.alias("b")).count().collect()))  # a row for each bucket
    before, total = [], 0
    for b in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(b, 0)
    start = F.get(F.array(*map(F.lit, before)), F.col("_b"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(F.asc_nulls_first(order))) - 1
    return df.withColumn("_b", at).withColumn(to, (own + start).cast("long")).drop("_b"), total


def _place(cuts: Column, n: int, order: str) -> Column:
    """How many of ``n`` sorted values are at most the row's, by halving."""
    step = lambda s, _: F.when(s["a"] >= s["z"], s).when(F.get(cuts, F.floor((s["a"] + s["z"]) / 2).cast("int")) <= F.col(order), F.struct((F.floor((s["a"] + s["z"]) / 2) + 1).cast("int").alias("a"), s["z"].alias("z"))).otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["z"]) / 2).cast("int").alias("z")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("a"), F.lit(n).alias("z")), step, lambda s: s["a"])
