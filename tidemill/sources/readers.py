"""One reader over the batch formats, and the readers with rules of their own."""

from __future__ import annotations

import io
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.paths import open_path

# Formats whose package is not part of Spark itself.
EXTERNAL = {"avro": "spark-avro", "delta": "delta-spark", "kafka": "spark-sql-kafka-0-10"}


def read(spark: SparkSession, kind: str, path: str | None = None, schema: str | None = None,
         names: str | None = None, **options) -> DataFrame:
    """Read csv, json, parquet, orc, xml, text, avro or jdbc. ``names`` (comma separated) names the
    columns of a file without header."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", str(names is None).lower())
        if not schema and "inferSchema" not in options:
            reader = reader.option("inferSchema", "true")
    reader = reader.format(kind)
    try:
        df = reader.load(path) if path else reader.load()
    except Exception as error:
        if kind in EXTERNAL and ("find data source" in str(error) or "DATA_SOURCE_NOT_FOUND" in str(error)
                                 or "external" in str(error)):
            raise ValueError(f"reading {kind} needs the {EXTERNAL[kind]} package on the classpath") from error
        raise
    return df.toDF(*[n.strip() for n in names.split(",")]) if names else df


def read_partitions(spark: SparkSession, path: str, wanted: dict[str, list]) -> DataFrame:
    """Only the given partition values; values that do not exist are skipped. One pruned scan."""
    df = spark.read.option("basePath", path).parquet(path)
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(kv[1])), wanted.items(), df)


def _literal(value) -> str:
    """A key value as SQL text."""
    return str(value) if isinstance(value, (int, float, Decimal)) else "'" + str(value).replace("'", "''") + "'"


def slices(key: str, bounds: list) -> list[str]:
    """Predicates that cut a key at ascending bounds; together they hold every row once, null keys in the first."""
    if not bounds:
        return ["1 = 1"]
    texts = [_literal(b) for b in bounds]
    middle = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(texts[:-1], texts[1:], strict=True)]
    return [f"{key} < {texts[0]} OR {key} IS NULL", *middle, f"{key} >= {texts[-1]}"]


def quantile_query(query: str, key: str, parts: int, ordered_window: bool = True) -> str:
    """SQL for the key values at about every 1/parts of the rows; databases without ordered windows number an ordered subquery."""
    if ordered_window:
        numbered = f"SELECT {key} AS k, ROW_NUMBER() OVER (ORDER BY {key}) AS r FROM ({query}) q WHERE {key} IS NOT NULL"
    else:
        numbered = f"SELECT k, ROW_NUMBER() OVER () AS r FROM (SELECT {key} AS k FROM ({query}) q WHERE {key} IS NOT NULL ORDER BY {key}) o"
    step = f"(SELECT CASE WHEN COUNT(*) < {parts} THEN 1 ELSE COUNT(*) / {parts} END FROM ({query}) c WHERE {key} IS NOT NULL)"
    return f"SELECT DISTINCT k FROM ({numbered}) n WHERE MOD(r, {step}) = 0"


def read_jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None, partition: str | None = None,
              bounds: tuple | None = None, partitions: int = 8, **options) -> DataFrame:
    """Run a query in the database. With ``partition``, a column as the database writes it, it is read in parallel slices: of equal width between ``bounds``, or without
    them of about equal row counts, between quantiles of the column that the database is asked for once."""
    options |= {"driver": driver} if driver else {}
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition and bounds:
        return reader.options(dbtable=f"({query}) q", partitionColumn=partition, lowerBound=bounds[0],
                              upperBound=bounds[1], numPartitions=partitions).load()
    if partition:
        asked = quantile_query(query, partition, partitions, not url.startswith("jdbc:derby"))
        found = sorted(r[0] for r in reader.option("query", asked).load().collect())  # about as many rows as slices
        return spark.read.jdbc(url, f"({query}) q", predicates=slices(partition, found), properties=options)
    return reader.option("query", query).load()


def read_with_rejects(spark: SparkSession, path: str, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the raw text of those that do not."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("_row", F.from_csv("value", f"{schema}, _reject string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_reject", **options}))
    good = parsed.where(F.col("_row._reject").isNull()).select("_row.*").drop("_reject")
    return good, parsed.where(F.col("_row._reject").isNotNull()).select(F.col("value").alias("_reject"))


def by_field_count(lines: DataFrame, shapes: dict[str, list[str]], sep: str = "~", column: str = "value") -> dict[str, DataFrame]:
    """One frame per record shape, told apart by the number of fields; ``_reject`` holds the lines that fit no shape."""
    parts = lines.select(F.split(column, sep, -1).alias("p"), F.col(column).alias("line"))
    known = F.size("p").isin(*map(len, shapes.values())) & F.col("line").isNotNull()
    found = {name: parts.where(F.size("p") == len(fields)).select(*[F.col("p")[i].alias(f) for i, f in enumerate(fields)])
             for name, fields in shapes.items()}
    return found | {"_reject": parts.where(~known).select(F.col("line").alias("_reject"))}


def line_ends(read_at: Callable[[int, int], bytes], size: int, chunk: int = 4096) -> tuple[bytes, bytes]:
    """First and last line of a text of ``size`` bytes, read from its ends: ``read_at(length, offset)`` is asked for twice as much until a line end is seen."""
    def upto(n: int) -> bytes:
        data = read_at(n, 0)
        places = [i for i in (data.find(b"\n"), data.find(b"\r")) if i >= 0]
        return data[:min(places)] if places else data if n >= size else upto(min(size, 2 * n))

    def since(n: int) -> bytes:
        data = read_at(n, size - n)
        for end in (b"\r\n", b"\n", b"\r"):
            if data.endswith(end):
                data = data[:-len(end)]
                break
        place = max(data.rfind(b"\n"), data.rfind(b"\r"))
        return data[place + 1:] if place >= 0 or n >= size else since(min(size, 2 * n))
    return upto(min(size, chunk)), since(min(size, chunk))


def _ends_of_files(batches):
    for batch in batches:
        rows = []
        for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            system, name = open_path(path)
            if name.endswith((".gz", ".bz2")):  # no way into the middle of these: read through, a line held at a time
                first = last = None
                with system.open_input_stream(name, compression="detect") as raw, io.BufferedReader(raw) as lines:
                    for line in lines:
                        last = line.rstrip(b"\r\n")
                        first = last if first is None else first
            else:
                with system.open_input_file(name) as file:
                    first, last = line_ends(lambda n, at, file=file: bytes(file.read_at(n, at)), size)
            if first is not None:
                rows.append((path, first.decode("utf-8", "replace"), last.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["file", "first", "last"])


def first_and_last_line(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last: the first and last line of every file under a path that is not empty, read by range from the ends of the file; bytes read do not grow with the
    file, unless it is compressed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    return files.mapInArrow(_ends_of_files, "file string, first string, last string")


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Text lines; gzip is decoded by extension. Asks for at least ``min_partitions`` partitions."""
    lines = spark.read.text(path)
    return lines.repartition(min_partitions) if min_partitions else lines


def union_with_origin(spark: SparkSession, paths: list[str], schema: str, origin: str = "origin", **options) -> DataFrame:
    """Many delimited files as one frame, each row tagged with the name of its file."""
    df = spark.read.schema(schema).options(**options).csv(paths)
    return df.withColumn(origin, F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]+)?$", 1))


# The fixed columns of a variant call file.
VCF_COLUMNS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant call text: header lines skipped, INFO as a map, sample columns as an array."""
    parts = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    named = [F.get("p", F.lit(i)).alias(c) for i, c in enumerate(VCF_COLUMNS)]
    df = parts.select(*named, F.slice("p", 9, F.greatest(F.size("p") - 8, F.lit(0))).alias("SAMPLES"))
    return (df.withColumn("POS", F.col("POS").try_cast("bigint")).withColumn("QUAL", F.col("QUAL").try_cast("double"))
            .withColumn("INFO", F.str_to_map("INFO", F.lit(";"), F.lit("="))))


def sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Run a SQL text over named frames and catalog tables."""
    return spark.sql(text, **views)


def parse_xml(df: DataFrame, column: str, schema: str, **options) -> DataFrame:
    """An XML text column spread into fields; attributes are ``_name`` and mixed text ``_VALUE``."""
    return df.withColumn("_x", F.from_xml(column, schema, options)).select("*", "_x.*").drop("_x")


# Layout of a team document: attributes of a driver start with an underscore.
TEAMS = ("Teams struct<team: array<struct<teamName: string, constructorPoints: int, constructorStanding: string,"
         " drivers: struct<driver: array<struct<_raceEntries: int, _nationality: string, driverName: string,"
         " avgFinishPosition: int, points: int>>>>>>")


def team_rows(documents: DataFrame, column: str) -> DataFrame:
    """Team documents to one row per driver; points not made by the drivers count as pit-stop points."""
    teams = parse_xml(documents, column, TEAMS).select(F.explode("Teams.team").alias("t"))
    made = F.aggregate("t.drivers.driver", F.lit(0), lambda s, d: s + F.coalesce(d["points"], F.lit(0)))
    rows = teams.select("t.teamName", "t.constructorPoints", "t.constructorStanding", made.alias("teamPoints"),
                        F.explode("t.drivers.driver").alias("d"))
    return rows.select("teamName", "constructorPoints", "constructorStanding", F.col("d.driverName").alias("driverName"),
                       F.col("d._nationality").alias("nationality"), F.col("d._raceEntries").alias("raceEntries"),
                       F.col("d.avgFinishPosition").alias("avgFinishPosition"), F.col("d.points").alias("driverPoints"),
                       "teamPoints", F.greatest(F.col("constructorPoints") - F.col("teamPoints"), F.lit(0)).alias("pitStopPoints"))
