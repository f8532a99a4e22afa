"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 25_000
EXCLUDED = "spark.sql.optimizer.excludedRules"
GENERATE_FILTERS = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"
_OWN_DIRS: dict[str, str] = {}  # of local sessions that name none


def build_session(app: str = "eligo", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the operators here; cluster settings win over these.

    AQE does the run-time work: it coalesces small shuffle partitions, turns a
    shuffled side that proves small into a broadcast and splits partitions that
    a hot key has blown up.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # plans here are wide: do not look up the call site of every column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators need of any session, also one made elsewhere.

    The record columns depend on each other many levels deep. Deriving filters
    from them takes the optimizer minutes and finds none that prune a scan, so
    that one rule is off; predicate and column push-down are not affected.

    So is the rule that asks for a filled array before it is exploded: such a filter is pushed below the projections that
    make the array, and works all of them out once more, over and over where they build on each other.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    rules = [r for r in spark.conf.get(EXCLUDED, "").split(",") if r]
    if GENERATE_FILTERS not in rules:
        spark.conf.set(EXCLUDED, ",".join([*rules, GENERATE_FILTERS]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the session names it.

    Only a local session without that setting gets a temporary folder of its
    own; a cluster session without it is an error, since executors could not
    see a folder on the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="eligo-")
    return _OWN_DIRS[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df, key: str, rows: int = ROWS_PER_TASK):
    """``df`` dealt by ``key`` over tasks of about ``rows`` rows, if it has more than one task should take.

    For tables whose rows are small as stored and grow a hundredfold on the way: Spark cuts its input by bytes, so that
    millions of them would come in one task, with the time and the sorts of all. ``df`` should be a plain scan, which is
    counted from its file footers.

    The condition on the task's number always holds. It keeps filters over later columns where they are: below the
    shuffle they would work those columns out for all rows in the few tasks of the scan.
    """
    found = df.count()
    if found <= rows:
        return df
    dealt = df.repartition(-(-found // rows), key)
    return dealt.select(*(F.when(F.spark_partition_id() >= 0, dealt[x]).alias(x) for x in dealt.columns))


def cut_lineage(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, and its file sizes give the
    optimizer real statistics for the joins that follow.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
