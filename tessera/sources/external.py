"""External sources as DataFrames. Every reader takes a schema where the format has none, so nothing is inferred by a pass
over the data; connectors that need a jar fail with Spark's own message where it is missing."""

from __future__ import annotations

import re
import urllib.request
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.engines import Engine
from tessera.scratch import shared_dir
from tessera.types import spark_type

_KEEP = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# Names of formats, Spark's reader and its options.
FORMATS: dict[str, tuple[str, dict[str, str]]] = {
    "CSV": ("csv", _KEEP), "CSVWithNames": ("csv", {"header": "true", **_KEEP}), "TSV": ("csv", {"sep": "\t", **_KEEP}), "TabSeparated": ("csv", {"sep": "\t", **_KEEP}), "TSVWithNames": ("csv", {"sep": "\t", "header": "true", **_KEEP}), "TabSeparatedWithNames": ("csv", {"sep": "\t", "header": "true", **_KEEP}),
    "JSONEachRow": ("json", {}), "JSON": ("json", {"multiLine": "true"}), "Parquet": ("parquet", {}), "ORC": ("orc", {}), "Avro": ("avro", {}), "Text": ("text", {}),
}
COMPRESSIONS = {"none": "none", "gzip": "gzip", "gz": "gzip", "zstd": "zstd", "lz4": "lz4", "bz2": "bzip2"}


def schema_of(columns: dict[str, str] | str | T.StructType | None) -> T.StructType | None:
    """From names and type strings, from ``a Int32, b String``, or as it is."""
    if columns is None or isinstance(columns, T.StructType):
        return columns
    if isinstance(columns, str):
        from tessera.types import _split

        columns = dict(re.fullmatch(r"`?(\w+)`?\s+(.+)", c, re.S).groups() for c in _split(columns))
    return T.StructType([T.StructField(n, spark_type(k)) for n, k in columns.items()])


def read(spark: SparkSession, path: str | list[str], format: str = "Parquet", columns: Any = None, **options: Any) -> DataFrame:
    if format == "Arrow":
        import pyarrow as pa
        import pyarrow.ipc as ipc

        with pa.memory_map(path) as f:
            return spark.createDataFrame(ipc.open_file(f).read_all(), schema_of(columns))
    if format == "JSONCompact":
        # Each line is an array of the columns' values in order.
        kind = schema_of(columns)
        parsed = spark.read.text(path).select(F.from_json("value", "array<string>").alias("v")).where("v is not null")
        return parsed.select(*[F.col("v")[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; known: {', '.join(FORMATS)}, Arrow, JSONCompact")
    reader, own = FORMATS[format]
    kind = schema_of(columns)
    if kind is None and reader in ("csv", "json"):
        raise ValueError(f"{format} needs its columns, lest they be inferred by reading everything")
    made = spark.read.format(reader).options(**own).options(**{k: str(v) for k, v in options.items()})
    return (made.schema(kind) if kind is not None else made).load(path)


def write(df: DataFrame, path: str, format: str = "Parquet", mode: str = "append", compression: str | None = None, partition_by: list[str] = (), **options: Any) -> None:
    if format == "Null":
        df.write.format("noop").mode("overwrite").save()
        return
    writer, own = FORMATS[format]
    made = df.write.format(writer).mode(mode).options(**own).options(**{k: str(v) for k, v in options.items()})
    if compression:
        made = made.option("compression", COMPRESSIONS[compression])
    (made.partitionBy(*partition_by) if partition_by else made).save(path)


def file(spark: SparkSession, path: str, format: str = "Parquet", columns: Any = None, **options: Any) -> DataFrame:
    return read(spark, path, format, columns, **options)


def s3(spark: SparkSession, path: str, format: str = "Parquet", columns: Any = None, access_key: str | None = None, secret_key: str | None = None, endpoint: str | None = None, **options: Any) -> DataFrame:
    """``s3://`` becomes ``s3a://``; credentials are set for this path's bucket only."""
    path = re.sub(r"^s3n?://", "s3a://", path)
    m = re.match(r"s3a://([^/]+)", path)
    if not m:
        raise ValueError(f"{path} is no S3 path")
    conf = spark._jsc.hadoopConfiguration()
    for name, value in (("access.key", access_key), ("secret.key", secret_key), ("endpoint", endpoint)):
        if value is not None:
            conf.set(f"fs.s3a.bucket.{m[1]}.{name}", value)
    return read(spark, path, format, columns, **options)


def s3_cluster(spark: SparkSession, cluster: str, path: str, format: str = "Parquet", columns: Any = None, **options: Any) -> DataFrame:
    """As ``s3``: every read is spread over the cluster."""
    return s3(spark, path, format, columns, **options)


def hdfs(spark: SparkSession, path: str, format: str = "Parquet", columns: Any = None, **options: Any) -> DataFrame:
    if not path.startswith("hdfs://"):
        raise ValueError(f"{path} is no HDFS path")
    return read(spark, path, format, columns, **options)


def url(spark: SparkSession, address: str, format: str = "CSVWithNames", columns: Any = None, folder: str | None = None, timeout: float = 60, **options: Any) -> DataFrame:
    """Downloaded once, by the driver, into a folder that executors see: that of ``spark.checkpoint.dir`` unless given."""
    folder = folder or shared_dir(spark)
    target = f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9.]', '_', address)}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        with urllib.request.urlopen(address, timeout=timeout) as f:
            while block := f.read(1 << 20):
                out.write(bytearray(block))
    finally:
        out.close()
    return read(spark, target, format, columns, **options)


def jdbc_options(kind: str, host: str, database: str, table: str, user: str, password: str, port: int | None = None, **options: Any) -> dict[str, str]:
    ports = {"mysql": 3306, "postgresql": 5432}
    drivers = {"mysql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver"}
    return {"url": f"jdbc:{kind}://{host}:{port or ports[kind]}/{database}", "dbtable": table, "user": user, "password": password, "driver": drivers[kind], **{k: str(v) for k, v in options.items()}}


def mysql(spark: SparkSession, **where: Any) -> DataFrame:
    """``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` spread the read."""
    return spark.read.format("jdbc").options(**jdbc_options("mysql", **where)).load()


def postgresql(spark: SparkSession, schema: str = "public", **where: Any) -> DataFrame:
    where["table"] = where["table"] if "." in where["table"] else f"{schema}.{where['table']}"
    return spark.read.format("jdbc").options(**jdbc_options("postgresql", **where)).load()


def engine_options(engine: Engine) -> dict[str, str]:
    """The JDBC reader's options of a table engine."""
    rest = {k: str(v) for k, v in engine.options if k not in ("url", "table")}
    return {"url": engine.option("url"), "dbtable": engine.option("table"), **rest}


def of_engine(spark: SparkSession, engine: Engine, columns: Any = None) -> DataFrame:
    """The rows behind a table of a File, URL, S3, PostgreSQL or MySQL engine."""
    o = dict(engine.options)
    if engine.name == "File":
        return file(spark, o["path"], o["format"], columns)
    if engine.name == "URL":
        return url(spark, o["url"], o["format"], columns)
    if engine.name == "S3":
        return s3(spark, columns=columns, **o)
    if engine.name in ("PostgreSQL", "MySQL"):
        return spark.read.format("jdbc").options(**engine_options(engine)).load()
    raise ValueError(f"{engine.name} tables hold their own rows")


def values(spark: SparkSession, rows: list, structure: Any) -> DataFrame:
    return spark.createDataFrame(rows, schema_of(structure))


def numbers(spark: SparkSession, count: int, offset: int = 0) -> DataFrame:
    return spark.range(offset, offset + count).withColumnRenamed("id", "number")


def generate_random(spark: SparkSession, structure: Any, rows: int, seed: int = 0, max_string: int = 10, max_array: int = 10) -> DataFrame:
    """Random rows, the same for the same seed and number of rows: every value is a function of the row's number."""

    def bits(n: Column | str, salt: int) -> Column:
        return F.xxhash64(F.lit(seed * 7919 + salt), n)

    def one(kind: T.DataType, n: Any, salt: int) -> Column:
        h = bits(n, salt)
        unit = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
        if isinstance(kind, T.ArrayType):
            size = F.pmod(bits(n, salt + 101), F.lit(max_array + 1)).cast("int")
            every = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
            return F.transform(every, lambda i: one(kind.elementType, F.struct(F.col("id") if isinstance(n, str) else n, i), salt + 1))
        if isinstance(kind, T.StructType):
            return F.struct(*[one(f.dataType, n, salt + 13 * k).alias(f.name) for k, f in enumerate(kind.fields)])
        if isinstance(kind, T.MapType):
            return F.create_map(one(kind.keyType, n, salt), one(kind.valueType, n, salt + 1))
        if isinstance(kind, T.StringType):
            size = F.pmod(bits(n, salt + 103), F.lit(max_string + 1)).cast("int")
            return F.left(F.sha2(h.cast("string"), 256), size)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            span = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31}[kind.simpleString()]
            return (F.pmod(h, F.lit(2 * span)) - span).cast(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return unit.cast(kind)
        if isinstance(kind, T.DecimalType):
            return (unit * min(10 ** (kind.precision - kind.scale), 10**15)).try_cast(kind)
        if isinstance(kind, T.BooleanType):
            return F.pmod(h, F.lit(2)) == 1
        if isinstance(kind, T.DateType):
            return F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(h, F.lit(36525)).cast("int"))
        if isinstance(kind, T.TimestampType):
            return F.timestamp_seconds(F.pmod(h, F.lit(3155760000)))
        return h.cast(kind)

    kind = schema_of(structure)
    return spark.range(rows).select(*[one(f.dataType, "id", 1000 * k).alias(f.name) for k, f in enumerate(kind.fields)])
