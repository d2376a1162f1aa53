"""Readers of episode files, JSON lines, logs and seed lists."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import opened


def json_files(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.json") -> DataFrame:
    """One row a JSON file, with `_file` and `_modified`; the schema is given, never inferred."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(path)
    return raw.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, allow_blank: bool = True) -> DataFrame:
    """One row a line; with allow_blank=False a blank line fails the query instead of being passed over."""
    lines = spark.read.text(path)
    blank = F.trim("value") == ""
    if allow_blank:
        kept = lines.where(~blank)
    else:
        kept = lines.withColumn("value", F.when(blank, F.raise_error(F.lit("blank line"))).otherwise(F.col("value")))
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, line) of log text without terminal colours."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("_file"), F.regexp_replace("value", "\x1b\\[[0-9;]*m", "").alias("line"))


def misnamed(files: DataFrame) -> DataFrame:
    """Rows of json_files() whose name is not `<id>--sample-<trajectory_sample_id>.json`."""
    return files.where(F.col("_file") != F.concat("id", F.lit("--sample-"), "trajectory_sample_id", F.lit(".json")))


def seeds(df: DataFrame, column: str, out: str = "seed") -> DataFrame:
    """One row a seed of expressions such as `0,1,14-16`."""
    part = F.explode(F.split(F.regexp_replace(column, "\\s", ""), ",")).alias("_part")
    ends = F.split("_part", "-")
    return df.select("*", part).withColumn(out, F.explode(F.sequence(ends[0].cast("long"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).cast("long")))).drop("_part")


def chronological(files: DataFrame) -> DataFrame:
    """Rows of json_files() with their `_place` by (modification time, file name): files of one instant are ordered by name."""
    from pyspark.sql import Window

    # one row a file, and only its two short columns are needed for the order
    return files.withColumn("_place", F.row_number().over(Window.orderBy("_modified", "_file")).cast("long"))


def labelled_files(spark: SparkSession, path: str, schema: StructType | str, name: str) -> DataFrame:
    """Rows of `<path>/<label>/<name>`, the label being the folder's name."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/*/{name}")
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("label"), *[c for c in raw.columns])


def partial_scan(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(_file, names...) of whole files by regular expressions alone: nothing is parsed but the groups found. A file without one of them is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")
    found = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    missing = lambda n: F.raise_error(F.concat(F.lit(f"no {n} in "), F.col("_file")))
    return raw.select("_file", *(F.coalesce(found(p), missing(n)).alias(n) for n, p in patterns.items()))


def level_files(spark: SparkSession, path: str) -> DataFrame:
    """(_file, width, height, tiles) of level texts: `# name value` lines ahead, then rows of whole numbers between the start and end marks.

    Missing sizes, another number of rows, or a row of another length are errors that name the file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")
    size = lambda n: F.nullif(F.regexp_extract("value", f"(?m)^\\s*#\\s+{n}\\s+(\\d+)", 1), F.lit("")).cast("int")
    body = F.regexp_extract("value", "(?s)# startleveldata\\s*\\n(.*?)# endleveldata", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.select("_file", size("lvlwidth").alias("width"), size("lvlheight").alias("height"), F.transform(lines, lambda x: F.split(x, "\\s+").cast("array<int>")).alias("tiles"))
    fine = (F.col("width") > 0) & (F.col("height") > 0) & (F.size("tiles") == F.col("height")) & F.forall("tiles", lambda r: F.size(r) == F.col("width"))
    return rows.withColumn("tiles", F.when(F.coalesce(fine, F.lit(False)), F.col("tiles")).otherwise(F.raise_error(F.concat(F.lit("not a level: "), F.col("_file")))))


def level_tiles(levels: DataFrame) -> DataFrame:
    """(_file, r, c, tile) of level_files()."""
    rows = levels.select("_file", F.posexplode("tiles").alias("r", "_row"))
    return rows.select("_file", "r", F.posexplode("_row").alias("c", "tile"))


def grid_block(text: Column, symbols: str = "#PGX. ") -> Column:
    """The rows of symbols under a `Grid:` line, up to the first empty or other line; null if there are none."""
    lines = F.split(F.regexp_extract(text, "(?s)(?:^|\n)\\s*Grid:\\s*\n(.*)$", 1), "\n")
    fine = lambda x: (x != "") & (F.length(F.translate(x, symbols, "")) == 0)
    bad = F.array_position(F.transform(lines, fine), F.lit(False))
    rows = F.when(bad > 0, F.slice(lines, F.lit(1), (bad - 1).cast("int"))).otherwise(lines)
    return F.when(F.size(rows) > 0, rows)


#: Bytes that a tensor file's header has at most.
MAX_HEADER = 100 << 20


def _header(path: str, length: int) -> str:
    """The header of a tensor file, as JSON with the bytes of its data: eight bytes and the header are read, whatever the file's length."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        size = int.from_bytes(f.read(8), "little")
        if size > min(MAX_HEADER, length - 8):
            raise ValueError(f"{path}: a header of {size} bytes")
        found = json.loads(f.read(size))
    tensors = [{"name": k, "dtype": v["dtype"], "begin": v["data_offsets"][0], "end": v["data_offsets"][1]} for k, v in found.items() if k != "__metadata__"]
    return json.dumps({"size": length - 8 - size, "tensors": tensors})


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """(_file, tensor, dtype, begin, end, contiguous) of files that start with eight bytes of header length and a JSON header; whether each tensor begins where the one before ends, from 0 to the file's end.

    Files are listed by Spark, without their content; a task reads each one's header by itself.
    """

    def run(batches):
        for b in batches:
            paths, lengths = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_header, paths, lengths), pa.string())], names=["path", "header"])

    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    raw = listed.mapInArrow(run, "path string, header string")
    kind = "size long, tensors array<struct<name: string, dtype: string, begin: bigint, end: bigint>>"
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("_file"), F.from_json("header", kind).alias("h"))
    ordered = F.array_sort(F.transform("h.tensors", lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"), t["name"].alias("name"), t["dtype"].alias("dtype"))))
    rows = rows.select("_file", F.col("h.size").alias("size"), ordered.alias("t"))
    # a file's end is the last tensor's; one without tensors has no data
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("t", lambda t: t["end"]))
    begins = F.concat(F.transform("t", lambda t: t["begin"]), F.array("size"))
    return rows.select("_file", (ends == begins).alias("contiguous"), F.explode("t").alias("x")).select("_file", F.col("x.name").alias("tensor"), "x.dtype", "x.begin", "x.end", "contiguous")


def yaml_settings(spark: SparkSession, path: str, pattern: str = "*.yaml") -> DataFrame:
    """(_file, key, value) of YAML files: a row for each leaf, its keys joined by points, places in lists as numbers, its value as JSON.

    An empty mapping or list is a leaf. A document that is no mapping, a key with a point in it and a file that is no YAML are errors that name the file.
    """

    def leaves(at: str, value, file: str):
        pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        if not pairs:
            yield at, json.dumps(value, sort_keys=True, default=str)
        for key, inner in pairs:
            if "." in str(key):
                raise ValueError(f"{file}: a point in key {key}")
            yield from leaves(f"{at}.{key}" if at else str(key), inner, file)

    def run(batches):
        import yaml  # not among what every installation has

        for b in batches:
            rows = []
            for file, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    found = yaml.safe_load(text)
                except yaml.YAMLError as e:
                    raise ValueError(f"{file} is no YAML: {e}") from e
                if not isinstance(found, dict):
                    raise ValueError(f"{file} is no mapping")
                rows += [{"_file": file, "key": k, "value": v} for k, v in leaves("", found, file) if k]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("_file", "key", "value")]))

    texts = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")
    return texts.mapInArrow(run, "_file string, key string, value string")


def nested(settings: DataFrame, section: str) -> dict[str, dict]:
    """For each file of yaml_settings() the mapping under a section, names to values; a driver's view of a few files' settings."""
    out: dict[str, dict] = {}
    for r in settings.where((F.col("key") == section) | F.col("key").startswith(f"{section}.")).collect():
        own = out.setdefault(r["_file"], {})
        if r["key"] != section:
            own[r["key"][len(section) + 1 :]] = json.loads(r["value"])
    return out
