"""CSV, JSON-lines and plain-text files as rows of three strings.

All readers give (row_num long, c1, c2, c3). ``row_num`` counts kept rows from 0 in file order. Files are read in splits, whatever their size: a line's place is that of its split
in the file and its own in the split, and offsets come from counts by split. The ``_unordered`` readers leave row_num out and need no second pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillvec.functions.text import without_return

MISSING = "N/A"


@dataclass(frozen=True)
class Loaded:
    """Rows and the number of columns that the file itself has, which may differ from three."""

    rows: DataFrame
    columns: int

    def size(self) -> tuple[int, int]:
        return self.rows.count(), self.columns

    def get(self, i: int) -> tuple[str, str, str]:
        """The row at a position; IndexError outside."""
        got = self.rows.where(F.col("row_num") == i).select("c1", "c2", "c3").first()
        if got is None:
            raise IndexError(f"no row {i}")
        return tuple(got)

    def append(self, other: Loaded) -> Loaded:
        """Both files' rows, the other's after these."""
        n = self.rows.count()
        return Loaded(self.rows.unionByName(other.rows.withColumn("row_num", F.col("row_num") + n)), other.columns)


def csv_fields(line: Column) -> Column:
    """Fields of a line: every quote toggles quoting and vanishes, also a doubled one; commas part outside of quotes; nothing is trimmed."""
    # What stands between quotes goes on with the last field; elsewhere the first part does, and the others are fields of their own.
    runs = F.transform(F.split(line, '"', -1), lambda s, i: F.when(i % 2 == 0, F.split(s, ",", -1)).otherwise(F.array(s)))
    on = lambda done, run: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.element_at(run, 1))), F.slice(run, F.lit(2), F.size(run)))
    return F.aggregate(runs, F.array(F.lit("")), on)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, line) in splits; what follows the last line feed counts as a line if it is not empty."""
    read = spark.read.text(path, lineSep="\n")
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _whole_lines(spark: SparkSession, path: str, end: str = "") -> DataFrame:
    """(file, block, pos, line, n) of whole files, each in one row, with ``end`` after it: for the legacy rules about what follows the last line feed."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.concat("value", F.lit(end)), "\n", -1).alias("l"))
    return whole.select("file", F.lit(0).cast("long").alias("block"), F.posexplode("l").alias("pos", "line"), F.size("l").alias("n"))


def _numbered(df: DataFrame) -> DataFrame:
    """Positions over files in order of their names. Offsets come from the counts by split, so no task sees all rows."""
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos")) - 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = df.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", before.alias("before"))  # one row per split
    return df.withColumn("own", own).join(offsets, ["file", "block"]).select((F.col("own") + F.col("before")).cast("long").alias("row_num"), "c1", "c2", "c3")


def csv_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` without those that have not exactly three fields, with c1, c2, c3."""
    made = lines.withColumn("_f", csv_fields(without_return(line))).where(F.size("_f") == 3)
    return made.withColumns({f"c{i + 1}": F.col("_f")[i] for i in range(3)}).drop("_f")


def read_csv3(spark: SparkSession, path: str, compat: str = "intended") -> Loaded:
    """The first line of each file is its header and gives the number of columns. ``compat="legacy"`` loses a last line without a line feed."""
    if compat == "legacy":
        lines = _whole_lines(spark, path).where(F.col("pos") < F.col("n") - 1).drop("n")
    else:
        lines = _lines(spark, path)
    heads = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("pos", "line")).alias("_h"))  # one row per file
    head = heads.orderBy("file").select(F.size(csv_fields(without_return("_h.line")))).first()
    rest = lines.join(heads.select(F.col("file").alias("_file"), F.col("_h.pos").alias("_pos")), (F.col("file") == F.col("_file")) & (F.col("block") == 0) & (F.col("pos") == F.col("_pos")), "left_anti")
    return Loaded(_numbered(csv_rows(rest)), head[0] if head else 0)


def read_csv3_unordered(spark: SparkSession, path: str) -> DataFrame:
    """(c1, c2, c3) of splittable files; a line equal to the header of the first file is a header."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))
    head = lines.first()
    return csv_rows(lines.where(F.col("line") != (head[0] if head else ""))).select("c1", "c2", "c3")


def read_txt3(spark: SparkSession, path: str, compat: str = "intended") -> Loaded:
    """Each line that is not empty; blanks and carriage returns stay. ``compat="legacy"`` adds the NUL that ended the buffer to what follows the last line feed."""
    lines = _whole_lines(spark, path, "\0") if compat == "legacy" else _lines(spark, path)
    kept = lines.where("line != ''").select("file", "block", "pos", F.col("line").alias("c1"), F.lit(MISSING).alias("c2"), F.lit(MISSING).alias("c3"))
    return Loaded(_numbered(kept), 1)


def read_txt3_unordered(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n").where("value != ''")
    return lines.select(F.col("value").alias("c1"), F.lit(MISSING).alias("c2"), F.lit(MISSING).alias("c3"))


def json_text(value: Column, path: str) -> Column:
    """The string at a path of a variant, else the sentinel: numbers, booleans, nulls and nested values count as missing."""
    got = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(value, path, "string")), F.lit(MISSING))


def json_rows(lines: DataFrame, shape: str, keys: list[str], line: str = "line") -> DataFrame:
    """``lines`` whose JSON value is of ``shape`` (OBJECT or ARRAY), with c1, c2, c3 from the first three keys or positions."""
    value = F.try_parse_json(line)
    made = lines.withColumn("_v", value).where(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith(shape))
    quoted = [f"$[{i}]" if shape == "ARRAY" else "$['" + k.replace("'", "\\'") + "']" for i, k in enumerate(keys)]
    cols = [json_text(F.col("_v"), p) for p in quoted[:3]] + [F.lit(MISSING)] * 3
    return made.withColumns({f"c{i + 1}": cols[i] for i in range(3)}).drop("_v")


def _json_shape(first) -> tuple[str, list[str]]:
    """Shape and keys that the first row that parses (line, shape) fixes."""
    shape = next((x for x in ("OBJECT", "ARRAY") if first["shape"].startswith(x)), None)
    if shape is None:
        raise ValueError("the first JSON line is neither an object nor an array")
    spark = SparkSession.getActiveSession()
    got = spark.range(1).select(F.json_object_keys(F.lit(first["line"])) if shape == "OBJECT" else F.json_array_length(F.lit(first["line"]))).first()[0]
    return shape, list(got or []) if shape == "OBJECT" else [str(i) for i in range(got or 0)]


def read_jsonl3(spark: SparkSession, path: str) -> Loaded:
    """The first line that parses fixes the shape, the keys and their order; later lines of another shape, empty and malformed lines are skipped.

    Only top-level keys count. ValueError if that first line is neither an object nor an array.
    """
    lines = _lines(spark, path).where("line != ''").withColumn("line", F.regexp_replace("line", "\0+$", ""))
    first = lines.where(F.try_parse_json("line").isNotNull()).orderBy("file", "block", "pos").select("line", F.schema_of_variant(F.try_parse_json("line")).alias("shape")).first()
    if first is None:
        return Loaded(_numbered(lines.limit(0).withColumns({c: F.lit(MISSING) for c in ("c1", "c2", "c3")})), 0)
    shape, keys = _json_shape(first)
    return Loaded(_numbered(json_rows(lines, shape, keys).select("file", "block", "pos", "c1", "c2", "c3")), len(keys))


def read_jsonl3_unordered(spark: SparkSession, path: str) -> DataFrame:
    """(c1, c2, c3) without row numbers, in one pass after the first line that parses; no rows if none does."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\0+$", "").alias("line")).where("line != ''")
    first = lines.where(F.try_parse_json("line").isNotNull()).select("line", F.schema_of_variant(F.try_parse_json("line")).alias("shape")).first()
    if first is None:
        return spark.createDataFrame([], "c1 string, c2 string, c3 string")
    return json_rows(lines, *_json_shape(first)).select("c1", "c2", "c3")
