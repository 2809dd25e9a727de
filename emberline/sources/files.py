"""Files: manifests, classification and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import columns as C

from .looks import PREVIEW_CHARS

#: Rules in order: artifact type, then what must hold: extension, exact name, a folder above, or a pattern.
SIGNATURES = (
    ("evtx", {"extension": ".evtx"}), ("prefetch", {"extension": ".pf", "parent": "prefetch"}), ("amcache", {"name": "amcache.hve"}),
    ("registry_system", {"name": "system", "parent": "config"}), ("registry_software", {"name": "software", "parent": "config"}), ("registry_sam", {"name": "sam", "parent": "config"}),
    ("registry_security", {"name": "security", "parent": "config"}), ("registry_default", {"name": "default", "parent": "config"}), ("registry_ntuser", {"name": "ntuser.dat"}), ("usrclass", {"name": "usrclass.dat"}),
    ("registry_transaction_log", {"pattern": r"(?i)\.log[12]$"}), ("mft", {"name": "$mft"}), ("usn", {"name": "$j", "parent": "$extend"}), ("logfile", {"name": "$logfile"}), ("boot", {"name": "$boot"}),
    ("scheduled_task", {"parent": "tasks"}), ("sru", {"name": "srudb.dat"}), ("ese_support", {"parent": "sru"}), ("defender_log", {"name": "mpcmdrun.log"}), ("ransom_note", {"name": "readme_for_decryption.txt"}),
    ("lnk", {"extension": ".lnk"}), ("jumplist", {"extension": ".automaticdestinations-ms"}), ("jumplist", {"extension": ".customdestinations-ms"}),
    ("browser", {"name": "history", "parent": "chrome"}), ("browser", {"name": "history", "parent": "edge"}), ("browser", {"name": "places.sqlite", "parent": "firefox"}),
)
PARSED = ("evtx", "prefetch", "amcache", "registry_system", "registry_software", "registry_sam", "registry_security", "registry_default", "registry_ntuser", "usrclass", "mft", "usn", "scheduled_task", "sru", "lnk", "jumplist", "browser")
MARKDOWN, CSV, JSON, XML, SQLITE = (".md", ".markdown"), (".csv", ".tsv"), (".json",), (".xml",), (".sqlite", ".sqlite3", ".db")
TEXTS = (".txt", ".ini", ".cfg", ".conf")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified of all files below the folder; their content is not read. Times of creation and access are not known to Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def name_of(path: str | Column) -> Column:
    return F.lower(C.basename(path))


def extension_of(path: str | Column) -> Column:
    """From the last dot that is not the first letter; empty if there is none."""
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]*)$", 1)


def artifact_type(path: str | Column = "path") -> Column:
    """The first rule that holds; NULL if none."""
    above = F.transform(F.split(F.lower(C.col(path)), r"[\\/]"), lambda p: p)
    folders = F.slice(above, F.lit(1), F.size(above) - 1)
    holds = {"extension": lambda v: extension_of(path) == v, "name": lambda v: name_of(path) == v, "parent": lambda v: F.array_contains(folders, v), "pattern": lambda v: name_of(path).rlike(v)}
    rules = []
    for kind, need in SIGNATURES:
        test = F.lit(True)
        for what, value in need.items():
            test = test & holds[what](value)
        rules.append(F.when(test, kind))
    return F.coalesce(*rules)


def inventory(classified: DataFrame) -> DataFrame:
    """artifact_type, n, and a row TOTAL."""
    by = classified.where("artifact_type IS NOT NULL").groupBy("artifact_type").agg(F.count("*").alias("n"))
    return by.union(by.agg(F.lit("TOTAL"), F.coalesce(F.sum("n"), F.lit(0))))


def unknown_extensions(classified: DataFrame) -> DataFrame:
    """extension, n of files that no rule knows."""
    rows = classified.where("artifact_type IS NULL").select(F.coalesce(C.truthy(extension_of("path")), F.lit("<no_extension>")).alias("extension"))
    return rows.groupBy("extension").agg(F.count("*").alias("n"))


def unparsed(classified: DataFrame, parsed: tuple[str, ...] = PARSED) -> DataFrame:
    """Files of a known type that no parser reads."""
    return classified.where(F.col("artifact_type").isNotNull() & ~F.col("artifact_type").isin(*parsed))


def category(path: str | Column = "path", head: str | Column | None = None) -> Column:
    """What kind of file it is, by name, extension, and the first bytes."""
    name, ext = name_of(path), extension_of(path)
    of = lambda group: ext.isin(*group)
    magic = F.substring(C.col(head), 1, 16) == F.lit(b"SQLite format 3\0") if head is not None else F.lit(False)
    text = ~F.hex(F.substring(C.col(head), 1, 512)).rlike("^(?:..)*00") if head is not None else F.lit(False)
    return F.when(name.contains("readme") | of(MARKDOWN), "markdown").when(of(CSV), "csv").when(of(JSON), "json").when(of(XML), "xml").when(of(SQLITE) | F.coalesce(magic, F.lit(False)), "sqlite").when(name.contains("log"), "log").when(of(TEXTS) | F.coalesce(text, F.lit(False)), "text").otherwise("binary")


def json_context(text: str | Column) -> Column:
    """valid, kind, keys (sorted) or length, preview."""
    t = C.col(text)
    v = F.try_parse_json(t)
    kind = F.schema_of_variant(v)
    return F.struct(v.isNotNull().alias("valid"), F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(v.isNotNull(), "scalar").alias("kind"), F.array_sort(F.json_object_keys(F.when(kind.startswith("OBJECT"), t))).alias("keys"), F.json_array_length(F.when(kind.startswith("ARRAY"), t)).alias("length"), F.substring(t, 1, PREVIEW_CHARS).alias("preview"))


def inventory_context(files: DataFrame, most: int = 3) -> DataFrame:
    """category, n, artifacts: files (path, name, category, seq and more) with equal paths, or else names, taken once; the first three found, by path and name."""
    key = F.coalesce(F.concat(F.lit("p:"), C.truthy("path")), F.concat(F.lit("n:"), C.truthy("name")), F.concat(F.lit("s:"), F.col("seq").cast("string")))
    once = files.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*files.columns), "seq").alias("f")).select("f.*")
    sizes = once.groupBy("category").agg(F.count("*").alias("n"))
    head = once.withColumn("_at", F.row_number().over(Window.partitionBy("category").orderBy("seq"))).where(F.col("_at") <= most)
    shown = head.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("name", F.lit("")).alias("name")))).alias("artifacts"))
    return sizes.join(shown, "category")
