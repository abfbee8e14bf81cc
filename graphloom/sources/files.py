"""Files of the graph jobs: entity CSVs, triples, entity messages, class schemas and pattern logs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PROP, SINGLE

MESSAGE = "gid BIGINT, host STRING, boltport STRING, data ARRAY<STRING>"
CLASSES = "data MAP<STRING, STRUCT<objectProperty: MAP<STRING, STRUCT<domain: ARRAY<STRING>, range: ARRAY<STRING>>>, datatypeProperty: MAP<STRING, STRUCT<domain: ARRAY<STRING>, range: ARRAY<STRING>>>>>"


def entity_rows(nodes: DataFrame) -> DataFrame:
    """``(:ID, name, label)``: one row per node and label."""
    return nodes.select(F.col("id").alias(":ID"), F.col("props")["name"]["str"].alias("name"), F.explode("labels").alias("label"))


def write_entity_csv(nodes: DataFrame, path: str) -> None:
    """A folder of CSV files per label, with the header ``:ID,name``."""
    entity_rows(nodes).write.mode("overwrite").partitionBy("label").option("header", True).csv(path)


def read_entity_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("`:ID` BIGINT, name STRING, label STRING").option("header", True).csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject STRING, predicate STRING, object STRING").option("header", True).csv(path)


def triples_to_graph(triples: DataFrame, label: str = "Resource") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of distinct triples; a term's id is a hash of it. Two terms with one id are an error. Rows with a null are left out."""
    rows = triples.select("subject", "predicate", "object").where("subject is not null and predicate is not null and object is not null").distinct()
    terms = rows.select(F.col("subject").alias("term")).unionByName(rows.select(F.col("object").alias("term"))).distinct()
    ids = terms.select(F.xxhash64("term").alias("id"), "term")
    if not ids.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("two terms have one id")
    none = lambda t: F.lit(None).cast(t)
    name = F.struct(F.lit("str").alias("kind"), none("double").alias("num"), F.col("term").alias("str"), none("boolean").alias("bool"), none(f"ARRAY<{SINGLE}>").alias("arr"))
    nodes = ids.select("id", F.array(F.lit(label)).alias("labels"), F.create_map(F.lit("name"), name).cast(f"MAP<STRING, {PROP}>").alias("props"))
    edges = rows.select(F.concat_ws("|", "predicate", "subject", "object").alias("edge_id"), F.xxhash64("subject").alias("src"), F.xxhash64("object").alias("dst"), F.col("predicate").alias("type"))
    return nodes, edges


def message_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(value, arrival)`` of the lines of a folder of files, as a stream: files by time and name, and parts of files by their place."""
    place = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return spark.readStream.options(**options).text(path).select("value", place.alias("arrival"))


def decode_messages(lines: DataFrame, value: str = "value", *more: str) -> DataFrame:
    """``(gid, host, boltport, data, reason, value)``: entity messages from JSON text, entities as JSON text of their own. ``reason`` is
    null for a good message: malformed, no gid, or no entities otherwise. ``more``: columns of ``lines`` to keep."""
    raw = F.try_parse_json(F.col(value))
    get = lambda path, t: F.try_variant_get(F.col("v"), path, t)
    rows = lines.select(F.col(value).alias("value"), raw.alias("v"), *more).select("value", "v", *more, get("$.gid", "bigint").alias("gid"), get("$.host", "string").alias("host"), get("$.boltport", "string").alias("boltport"), F.transform(get("$.data", "array<variant>"), lambda x: F.to_json(x)).alias("data"))
    reason = F.when(F.col("v").isNull(), "malformed").when(F.col("gid").isNull(), "no gid").when(F.coalesce(F.size("data"), F.lit(-1)) < 1, "no entities")
    return rows.select("gid", "host", "boltport", "data", reason.alias("reason"), "value", *more)


def flatten_schema(classes: DataFrame, value: str = "value") -> DataFrame:
    """``(gid, class, kind, prop, domain, range)`` of class schemas. ``classes``: (gid, JSON text)."""
    data = classes.select("gid", F.explode(F.from_json(value, CLASSES)["data"]).alias("class", "c"))
    kinds = data.select("gid", "class", F.explode(F.create_map(F.lit("object"), F.col("c.objectProperty"), F.lit("datatype"), F.col("c.datatypeProperty"))).alias("kind", "props"))
    return kinds.select("gid", "class", "kind", F.explode("props").alias("prop", "p")).select("gid", "class", "kind", "prop", F.col("p.domain").alias("domain"), F.col("p.range").alias("range"))


def class_schema(schema: DataFrame, gid: int, classes: list[str]) -> DataFrame:
    """The rows of some classes of one graph."""
    return schema.where((F.col("gid") == gid) & F.col("class").isin(classes))


# A fixed pattern of the log format.
PATTERN_LINE = r"logPattern, round: (.*), patternType: (.*), hashCode: (.*), startRelType"


def parse_pattern_logs(lines: DataFrame, run: Column | str, value: str = "value") -> DataFrame:
    """``(run, round, pattern_type, hash_code)`` of the lines that log a pattern; others give nothing."""
    text = F.col(value)
    part = lambda i: F.regexp_extract(text, PATTERN_LINE, i)
    return lines.where(text.rlike(PATTERN_LINE)).select((F.lit(run) if isinstance(run, str) else run).alias("run"), part(1).cast("int").alias("round"), part(2).alias("pattern_type"), part(3).alias("hash_code"))


def read_pattern_logs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Pattern logs of several runs: run name to path."""
    parts = [parse_pattern_logs(spark.read.text(path), run) for run, path in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
