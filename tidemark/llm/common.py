"""Shared pieces of the corpus operators: text rules, durable intermediates, global row numbers, joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    If it is unset and all run in this process (master local), a temporary folder of this machine; else an error, as
    executors of a cluster would each write to a disk of their own.
    """
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_folder


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, distinct: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages and retries see one fixed set of rows.

    distinct: most values are told apart, so that no dictionaries of them are tried.
    The files go by discard(), at the latest when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(not distinct).lower()).parquet(path)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_tidemark_path", None)
        if path:
            at, files = _hadoop(table.sparkSession, path)
            files.delete(at, True)


#: A key is hot if more than one in HOT of a table's rows have it, and more than HOT rows; so there are at most HOT hot keys.
HOT, SALTS = 1000, 32


def hot_keys(counts: DataFrame, key: str, rows: int, n: str = "count") -> list:
    """The hot keys of a table of `rows` rows, from counts(key, n); they are HOT at most."""
    if rows <= HOT:
        return []
    return [r[0] for r in counts.filter((F.col(n) > max(rows // HOT, HOT)) & F.col(key).isNotNull()).select(key).collect()]


def hot_join(big: DataFrame, small: DataFrame, key: str, by: str, hot: list | None = None, rows: int | None = None) -> DataFrame:
    """big.join(small, key) where small has one row per key; a hot key's rows of big are dealt over SALTS tasks by `by`.

    Without `hot` big is a materialized table (of `rows` rows) whose hot keys are looked up. At most HOT keys reach the driver,
    and their rows of small are copied SALTS times.
    """
    if hot is None:
        rows = big.count() if rows is None else rows
        hot = hot_keys(big.groupBy(key).count(), key, rows) if rows > HOT else []
    if not hot:
        return big.join(small, key)
    spark = big.sparkSession
    named = F.broadcast(spark.createDataFrame([(h,) for h in hot], big.select(F.col(key).alias("__hot")).schema))
    dealt = big.join(named, big[key] == F.col("__hot"), "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))).drop("__hot")
    copied = small.join(named, small[key] == F.col("__hot"), "left")
    last = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.lit(SALTS - 1))
    copied = copied.withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("__hot")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


#: Least and most bits of a map; a map of n values has about 16 n of them.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


class BitMap:
    """A map of the hashes of a table's column, broadcast as MOST_BITS / 64 rows at most, whatever its size.

    It drops most other rows of a large table where they are read; the fuller it is the less it saves, and an exact join
    follows always.
    """

    def __init__(self, values: DataFrame, name: str, n: int | None = None):
        """n: how many values there are at most; counted if it is not given."""
        self.bits = LEAST_BITS
        n = values.count() if n is None else n
        while self.bits < min(16 * n, MOST_BITS):
            self.bits *= 2
        cell, flag = self._place(F.col(name))
        self.cells = values.select(cell.alias("__cell"), flag.alias("__f")).groupBy("__cell").agg(F.bit_or("__f").alias("__set"))

    def _place(self, value: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(value), F.lit(self.bits))
        return F.shiftright(bit, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))

    def split(self, df: DataFrame, value: Column) -> DataFrame:
        """df with __in: whether the value may be in the table."""
        cell, flag = self._place(value)
        own = df.withColumns({"__cell": cell, "__f": flag}).join(F.broadcast(self.cells), "__cell", "left")
        return own.withColumn("__in", F.coalesce(F.col("__set").bitwiseAND(F.col("__f")) != 0, F.lit(False))).drop("__cell", "__f", "__set")

    def within(self, df: DataFrame, value: Column) -> DataFrame:
        """The rows of df whose value may be in the table."""
        return self.split(df, value).filter("__in").drop("__in")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words. Gaps are squeezed to one space first, so nothing is allocated per word."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with column `name`: 0-based rank of each row in the order of keys, over the whole table.

    The range exchange splits hot keys as far as the keys tell rows apart; the id of the scan (last key) parts
    equal rows.
    """
    order, rid = f"__{name}_order", f"__{name}_rid"
    names = [f"k{i}" for i in range(len(keys))]
    # nulls last
    parts = [x for n, k in zip(names, keys) for x in (k.isNull().alias(f"{n}_null"), k.alias(n))]
    keyed = df.withColumn(order, F.struct(*parts, F.monotonically_increasing_id().alias(rid)))
    return ranked(keyed, order, name, keep=False)


def ranked(df: DataFrame, order: str, name: str, keep: bool = True, by: list[Column] | None = None, distinct: bool = False) -> DataFrame:
    """df with column `name`: 0-based rank of each row by the column `order`, which tells all rows apart, or by the equal order `by`.

    Ranks within a partition of the range exchange come from the position after the local sort; one row per partition
    gives the offsets. The positions are written out before they are used: a recomputed partition could differ.
    """
    spark = df.sparkSession
    mid, pid = f"__{name}_mid", f"__{name}_pid"
    by = [F.col(order).asc()] if by is None else by
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    fixed = materialize((ranged if keep else ranged.drop(order)).withColumn(mid, F.monotonically_increasing_id()), distinct)
    sizes = fixed.groupBy(F.shiftright(mid, 33).alias(pid)).agg(F.count(F.lit(1)).alias("__n")).collect()
    # one row per partition of the exchange
    at, offsets = 0, []
    for row in sorted(sizes):
        offsets.append((row[0], at))
        at += row[1]
    starts = spark.createDataFrame(offsets, f"{pid} long, __start long")
    mask = (1 << 33) - 1
    return (
        fixed.withColumn(pid, F.shiftright(mid, 33))
        .join(F.broadcast(starts), pid)
        .withColumn(name, F.col("__start") + F.col(mid).bitwiseAND(F.lit(mask).cast("long")))
        .drop(mid, pid, "__start")
    )
