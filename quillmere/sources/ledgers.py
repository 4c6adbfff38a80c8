"""File inventories, and ledgers of what became of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ENDINGS = (".csv", ".geojson", ".json", ".jsonl", ".md", ".py", ".toml", ".txt", ".yaml", ".yml")


def file_inventory(spark: SparkSession, path: str, endings: tuple[str, ...] = TEXT_ENDINGS) -> DataFrame:
    """file (relative to `path`), n_bytes, sha256 and text_sha256 of all files below `path`, which must be a folder.

    text_sha256 is that of a text file (by its ending) with CRLF and CR as LF, so that it does not change with the system a file was checked out on; of other files it
    is sha256. Spark's file scan reads and hashes the files, each whole in one row, so one file may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = system.makeQualified(folder).toUri().getPath().rstrip("/")
    files = files.select("path", "length", "content").unionByName(_empty_files(spark, system, folder))
    is_text = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*endings)
    as_hex = F.hex("content")
    # on hex digits, two a byte: a CR is 0D at an even place
    even = F.regexp_replace(as_hex, "(..)", "$1 ")
    lines = F.unhex(F.replace(F.replace(F.replace(even, F.lit("0D 0A"), F.lit("0A")), F.lit("0D "), F.lit("0A ")), F.lit(" "), F.lit("")))
    file = F.substring("path", F.instr("path", root) + len(root) + 1, F.length("path"))
    return files.select(file.alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.sha2(F.when(is_text, lines).otherwise(F.col("content")), 256).alias("text_sha256"))


def _empty_files(spark: SparkSession, system, folder) -> DataFrame:
    """The files without content, which Spark's scan passes over: their names come from the folder's listing, as Spark's own do."""
    found, listing = [], system.listFiles(folder, True)
    while listing.hasNext():
        status = listing.next()
        if not status.getLen():
            found.append((status.getPath().toUri().getPath(), 0, b""))
    return spark.createDataFrame(found, "path string, length long, content binary")


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file and status of each file of two inventories: added, removed, changed, line_endings (other bytes, the same text) or same."""
    a, b = (d.select("file", F.struct("sha256", "text_sha256").alias(n)) for d, n in ((before, "a"), (after, "b")))
    rows = a.join(b, "file", "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.sha256") == F.col("b.sha256"), "same").when(F.col("a.text_sha256") == F.col("b.text_sha256"), "line_endings").otherwise("changed")
    return rows.select("file", status.alias("status"))


def routed(rows: DataFrame, reasons: dict[str, Column], member: Column | None = None) -> DataFrame:
    """rows with ledger_status and ledger_reason: excluded for the first of `reasons` (name: condition) that holds, member where `member` holds (a row that a kept one stands for), or accepted. A condition that is null does not hold."""
    reason = F.coalesce(*[F.when(c, n) for n, c in reasons.items()], F.lit(None).cast("string"))
    status = F.when(F.col("ledger_reason").isNotNull(), "excluded").when(member if member is not None else F.lit(False), "member").otherwise("accepted")
    return rows.withColumn("ledger_reason", reason).withColumn("ledger_status", status)


def write_ledger(rows: DataFrame, path: str) -> DataFrame:
    """Writes routed rows into a folder for each status and reason, in one pass, and returns the manifest read back from there: ledger_status, ledger_reason and n_rows."""
    rows.withColumn("ledger_reason", F.coalesce("ledger_reason", F.lit("none"))).write.partitionBy("ledger_status", "ledger_reason").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    return back.groupBy("ledger_status", "ledger_reason").agg(F.count("*").alias("n_rows"))


def reconciled(rows: DataFrame, path: str, key: str) -> DataFrame:
    """n_in, n_out, n_lost and n_twice: whether what a ledger at `path` holds is what went in, row by row of a unique key."""
    back = rows.sparkSession.read.parquet(path).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    both = rows.select(key).join(back, F.col(key) == F.col("_key"), "left")
    counts = both.agg(F.count("*").alias("n_in"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_out"), F.count_if(F.col("_n").isNull()).alias("n_lost"), F.count_if(F.col("_n") > 1).alias("n_twice"))
    return counts
