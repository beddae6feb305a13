"""Session set-up and the folder shared by all executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


_LOCAL_FOLDERS: dict = {}
# bytes of a row beside its values, and the share (1 in so many) of Spark's broadcast limit that one table may take
ROW_BYTES = 16
BROADCAST_SHARE = 4


def build_session(app="armlight", master="local[8]", shuffle_partitions=None, memory=None):
    """A session for tests and benchmarks; on a cluster use the one it gives."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own;
    on a cluster a machine-local folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="armlight-")
    return _LOCAL_FOLDERS[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_folder(spark)}/armlight/{label}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _unpacked_bytes(df: DataFrame) -> int:
    """Rows of ``df`` times the bytes of a row as a broadcast holds it, with the true number of array elements."""
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    sizes = [F.coalesce(F.sum(F.greatest(F.size(f.name), F.lit(0))), F.lit(0)) for f in arrays]
    n, *elements = df.agg(F.count(F.lit(1)), *sizes).first()
    row = ROW_BYTES + df._jdf.schema().defaultSize() + 8 * len(df.columns)
    return n * row + sum(8 * found for found in elements)


def fits_broadcast(df: DataFrame, copies: int = 1) -> bool:
    """True if ``df`` as rows in memory is within its share of the broadcast limit.

    Catalyst's estimate of a scan is the size of its files. Packed files are a
    fraction of their rows, so the estimate can only rule a broadcast out; what
    it leaves is counted, which reads no column of a scan. All broadcasts of a
    query pass through the driver, so one gets a share of the limit only.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) * copies > limit:
        return False
    return _unpacked_bytes(df) * copies <= limit // BROADCAST_SHARE


def sized(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is merged unless ``df`` truly fits; Spark alone would go by the size of files."""
    return df if fits_broadcast(df) else df.hint("merge")
