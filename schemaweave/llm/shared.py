"""Session settings, shared folders and small helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of local sessions, by application; a running session takes no new spark.checkpoint.dir.
_own: dict[str, str] = {}
#: Python workers see this much text at once, however large a partition is.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2000
#: A side with more rows than this isn't broadcast.
BROADCAST_ROWS = 10_000
#: With more tasks than this, partitions aren't put together.
PACKED = 1000
#: A value with more than one in HOT of all rows is hot, so there are fewer than HOT hot ones.
HOT = 1 << 16
#: Bits of a bitmap for each key, and its 64-bit words at least and at most.
_BITS_A_KEY = 8
_BITMAP_WORDS = (1 << 10, 1 << 20)


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set; executors need a folder that they share")
        app = spark.sparkContext.applicationId
        place = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-")
    return place.rstrip("/")


def free_name(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores before it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame) -> DataFrame:
    """`df` in fewer partitions: a quarter of the shuffle partitions, or four a core if that is more, so that small tables make few files.

    A task goes through its parts one by one, so none of it needs more memory. Where that would still be more
    than PACKED tasks, the tables aren't small: all partitions stay, so no task has more than its share.
    """
    spark = df.sparkSession
    few = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    return df.coalesce(few) if few <= PACKED else df


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage and outlives lost executors.

    zstd makes texts smaller, but its native buffers stay until the JVM collects its garbage.
    """
    path = shared_path(df.sparkSession, name)
    packed(df).write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete what stored() has written for `df`, which must not be read any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; -1 for a null id, which no fold takes."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)), F.lit(-1))


def bounded_sample(df: DataFrame, by: str, doc_id: str, bound: int) -> DataFrame:
    """About `bound` rows of each value of `by`, chosen by a hash of the id, so the same for any partitioning.

    Counts per value are gathered first; a row stays if its hash lies below bound / count.
    """
    rate = free_name("rate", df)
    rates = df.groupBy(by).agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count("*")).alias(rate))
    few = rates.limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows <= BROADCAST_ROWS:  # else a plain join
        rates = F.broadcast(df.sparkSession.createDataFrame(few)) if few.num_rows else rates
    share = F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 24)) / float(1 << 24)
    return df.join(rates, by).where(share < F.col(rate))


def divided(rows: DataFrame, key: str, side: DataFrame, side_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may occur in `side`, and all others, by a bitmap of about eight bits for each key.

    It saves shuffling: the first are joined as usual. The bitmap is broadcast, so it has 64 million
    bits at most; with more keys it lets more rows pass, and all when it is full. `side` should be stored.
    """
    most = side.count() * _BITS_A_KEY >> 6
    words = min(max(_BITMAP_WORDS[0], 1 << most.bit_length()), _BITMAP_WORDS[1])
    name, bits = free_name("word", rows), free_name("bits", rows)
    word = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(words - 1))
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64(F.col(side_key), F.lit(11))
    map_ = side.groupBy(word(h).alias(name)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(h))).alias(bits))
    h = F.xxhash64(F.col(key), F.lit(11))
    found = rows.join(F.broadcast(map_), word(h) == F.col(name), "left")  # at most _BITMAP_WORDS[1] rows
    on = F.coalesce(F.call_function("shiftright", bits, bit(h)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return found.where(on).select(*every(rows)), found.where(~on).select(*every(rows))


def matching(rows: DataFrame, key: str, side: DataFrame, side_key: str) -> DataFrame:
    """The rows whose key may occur in `side`: see divided()."""
    return divided(rows, key, side, side_key)[0]


def lacking(rows: DataFrame, key: str, side: DataFrame, side_key: str) -> DataFrame:
    """The rows whose key isn't in `side`; rows with a null key stay."""
    gone = free_name("gone", rows)
    keys = stored(side.select(F.col(side_key).alias(gone)).distinct(), "gone")
    maybe, rest = divided(rows, key, keys, gone)
    return rest.unionByName(maybe.join(keys, F.col(key) == F.col(gone), "left_anti"))


def with_group(rows: DataFrame, by: str, groups: DataFrame, size: str) -> DataFrame:
    """Each row with the columns of the group that has its value of `by`, nulls if there is none; a null value equals a null.

    groups: one row per value, with `by`, the number `size` of its rows, and other columns that `rows` hasn't.
    Hot groups are broadcast, fewer than HOT of them whatever the input; rows of other groups are joined as usual,
    so no task gets all rows of a hot one. `groups` is read three times and `rows` twice: store what is dear.
    """
    key, more = free_name("group", rows, groups), [c for c in groups.columns if c not in (by, size)]
    found = free_name("found", rows, groups)
    sides = groups.withColumn(found, F.lit(True)).withColumnRenamed(by, key)
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = sides.where(F.col(size) * HOT > total)
    looked_up = rows.join(F.broadcast(hot.drop(size)), F.col(by).eqNullSafe(F.col(key)), "left")
    rest = looked_up.where(F.col(found).isNull()).select(*every(rows))
    joined = rest.join(sides.where(F.col(size) * HOT <= total).drop(size), F.col(by).eqNullSafe(F.col(key)), "left")
    columns = [*every(rows), *[F.col("`" + c.replace("`", "``") + "`") for c in more]]
    return looked_up.where(F.col(found)).select(*columns).unionByName(joined.select(*columns))
