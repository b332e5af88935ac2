"""What findings are written as: SARIF, Markdown, comments, reports in several formats, cache entries, pushed events.

A log comes in pieces, other documents as one row, made by nested aggregates;
only writers and puts touch storage, each by the committer of Spark's own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import text as tx
from veridelta.operators.core import severity_rank
from veridelta.operators.report import normal_severity
from veridelta.shared import Tables

#: Fixed values of the SARIF format.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
FORMATS = ("parquet", "json")



def sarif_level(severity: Column) -> Column:
    """error from high, warning for medium, note for low."""
    s = normal_severity(severity)
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")


#: A piece of a log holds results of about so many bytes.
PIECE = 1 << 20


def sarif(signals: DataFrame, by: list[str], tool: str = "veridelta", piece_bytes: int = PIECE) -> DataFrame:
    """A SARIF log for each key, in pieces (key, piece, text): its rules, one for each kind, and a result for each signal (id, kind, path, line, end_line, severity, summary).

    The texts of a key's pieces, in order, are its log; no row holds more than
    about ``piece_bytes`` of results. Results come by rule, path, line and id: they are
    dealt out by ranges of that order, so a key with any number of them is
    written by many tasks. One without a line has no region, one without a path
    no location; texts are masked. Keys without signals have no log.
    """
    tables = Tables(signals.sparkSession)
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.greatest("line", "end_line").alias("endLine")))
    place = F.when(F.coalesce("path", F.lit("")) != "", F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))).otherwise(F.array())
    result = F.struct(
        F.col("kind").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(tx.redact(F.col("summary")).alias("text")).alias("message"), place.alias("locations"),
        F.struct(F.col("id").alias("veridelta/v1")).alias("partialFingerprints"),
    )
    order = ["kind", "path", "line", "id"]
    rows = signals.select(*by, *order, F.to_json(result).alias("_v")).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id().cast("bigint"))
    rows = tables.save(rows)  # which part a row is in stays as it is
    before = F.sum(F.octet_length("_v") + 1).over(Window.partitionBy(*by, "_part").orderBy(*order, "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = rows.withColumn("piece", F.shiftleft("_part", 24) + F.floor(before / piece_bytes))
    bodies = cut.groupBy(*by, "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_v"))), lambda x: x["_v"]), ",").alias("text"))
    bodies = tables.save(bodies)
    first = bodies.groupBy(*(F.col(k).alias(f"_of_{k}") for k in by)).agg(F.min("piece").alias("_first"))
    bodies = bodies.join(first, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by]).select(*by, "piece", F.when(F.col("piece") == F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(","), F.col("text"))).alias("text"))
    rule = F.struct(F.col("kind").alias("id"), F.struct(F.regexp_replace("kind", "_", " ").alias("text")).alias("shortDescription"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.array_sort(F.collect_set(rule)).alias("rules")).alias("driver"))
    start = f'{{"$schema":{json.dumps(SARIF_SCHEMA)},"version":{json.dumps(SARIF_VERSION)},"runs":[{{"tool":'
    keys = signals.groupBy(*by).agg(F.to_json(driver).alias("_tool"))
    heads = keys.select(*by, F.lit(-1).cast("bigint").alias("piece"), F.concat(F.lit(start), "_tool", F.lit(',"results":[')).alias("text"))
    tails = keys.select(*by, F.lit((1 << 63) - 1).alias("piece"), F.lit("]}]}").alias("text"))
    return heads.unionByName(bodies).unionByName(tails)


def write_pieces(pieces: DataFrame, by: list[str], path: str) -> None:
    """Write pieces in order, each a line: the files of a key's folder, by name, are its text, since logs are cut where white space may stand."""
    pieces.repartitionByRange(*by, "piece").sortWithinPartitions(*by, "piece").select(*by, "text").write.partitionBy(*by).text(path)


def joined(pieces: DataFrame, by: list[str]) -> DataFrame:
    """The text of each key (key, log), for those that fit into a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"])
    return pieces.groupBy(*by).agg(F.array_join(parts, "").alias("log"))


def escaped(c: Column) -> Column:
    """A text that Markdown shows as it is, on one line."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"([\\`*_\[\]<>|#])", r"\\$1")


def markdown(signals: DataFrame, by: list[str], per_section: int = 50) -> DataFrame:
    """A report for each key: a heading with the counts, a section for each severity in falling order, and its findings by path, line and id.

    A section shows ``per_section`` findings and says how many more there are.
    """
    name = normal_severity("severity")
    place = F.concat("path", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    item = F.concat(F.lit("- `"), place, F.lit("` "), escaped(tx.redact(F.col("summary"))))
    s = signals.select(*by, name.alias("name"), F.struct("path", "line", "id", item.alias("v")).alias("r"))
    w = Window.partitionBy(*by, "name")
    cut = s.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("r"))).where(F.col("k") <= per_section)
    section = cut.groupBy(*by, "name").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["v"]).alias("l"), F.max("n").alias("n"))
    more = F.when(F.col("n") > F.size("l"), F.concat(F.lit("\n- and "), (F.col("n") - F.size("l")).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.lit("## "), F.initcap("name"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), F.array_join("l", "\n"), more)
    rank = (-severity_rank("name")).alias("rank")
    doc = section.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, text.alias("v")))), lambda x: x["v"]).alias("sections"), F.sum("n").alias("n"))
    return doc.select(*by, F.concat(F.lit("# Findings\n\n"), F.col("n").cast("string"), F.lit(" in all\n\n"), F.array_join("sections", "\n\n"), F.lit("\n")).alias("text"))


def comment(signals: DataFrame, by: list[str], most: int = 20, budget: int = 400) -> DataFrame:
    """A comment for each key: findings in rank order up to the first that passes the count or the bytes, and how many are hidden."""
    line = F.concat(F.lit("- "), "id", F.lit(" "), escaped(F.col("summary")))
    s = signals.withColumn("_r", -severity_rank("severity")).withColumn("_t", line)
    w = Window.partitionBy(*by).orderBy("_r", "ord")
    p = s.withColumn("_n", F.row_number().over(w)).withColumn("_used", F.sum(F.octet_length("id") + F.octet_length("summary")).over(w)).withColumn("_in", (F.col("_used") <= budget) & (F.col("_n") <= most))
    g = p.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("_n", "_t")))).alias("l"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.array_join(F.transform("l", lambda x: x["_t"]), "\n").alias("text"), F.size("l").cast("bigint").alias("shown"), (F.col("n") - F.size("l")).alias("hidden"))


def write_report(signals: DataFrame, path: str, formats: tuple[str, ...] = FORMATS) -> list[str]:
    """Write signals, texts redacted, in each format; the folders written. A folder appears whole or, if its job fails, without its success mark."""
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"unknown formats {sorted(unknown)}")
    texts = [f.name for f in signals.schema if f.dataType.simpleString() == "string" and f.name not in ("id", "path", "kind", "severity")]
    clean = signals.withColumns({c: tx.redact(F.col(c)) for c in texts}) if texts else signals
    for f in formats:
        getattr(clean.write.mode("overwrite"), f)(f"{path}/{f}")
    return [f"{path}/{f}" for f in formats]


def put_entries(entries: DataFrame, path: str, most_bytes: int = 1 << 20) -> None:
    """Add cache entries (content) under the hash of their content; what is stored already stays, and too large ones are passed over.

    Entries are dealt to folders by the first two digits of their key, so a
    lookup by key reads one folder, and a put reads the keys of those folders
    only that it writes to. A folder gets few files: large ones are split.
    """
    spark = entries.sparkSession
    keyed = entries.select(F.sha2("content", 256).alias("key"), "content").where(F.octet_length("content") <= most_bytes).dropDuplicates(["key"]).withColumn("shard", F.substring("key", 1, 2))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        keyed = Tables(spark).save(keyed)
        shards = [r["shard"] for r in keyed.select("shard").distinct().collect()]  # 256 at most
        keyed = keyed.join(read_entries(spark, path).where(F.col("shard").isin(shards)).select("key"), "key", "left_anti")
    keyed.hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(path)


def read_entries(spark, path: str) -> DataFrame:
    return spark.read.schema("key string, content string, shard string").parquet(path)


def graph_key(commit: Column, limits: Column, version: str = "v1") -> Column:
    """The key of a graph: of its commit, the limits it was built under and the schema."""
    return F.sha2(F.concat_ws("|", F.lit(version), commit, limits), 256)


def put_graph(nodes: DataFrame, edges: DataFrame, commit: str, limits: str, path: str) -> str:
    """Store a commit's graph, whole or not at all, and return its folder; one that is stored isn't written again."""
    spark = nodes.sparkSession
    key = spark.range(1).select(graph_key(F.lit(commit), F.lit(limits))).first()[0]
    at = f"{path}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{at}/edges/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        nodes.write.mode("overwrite").parquet(f"{at}/nodes")
        edges.write.mode("overwrite").parquet(f"{at}/edges")  # last: its mark says that both are there
    return at


def delivered(events: DataFrame, room: int = 32) -> DataFrame:
    """Of each user: events published, delivered to a channel with so much room, and dropped on overflow, oldest delivered."""
    g = events.groupBy("user_key").agg(F.count(F.lit(1)).alias("published"))
    return g.select("user_key", "published", F.least("published", F.lit(room)).alias("delivered"), F.greatest(F.col("published") - room, F.lit(0)).alias("dropped"))
