"""Question sets, responses and results: readers with stated schemas, cleaning, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

QUESTIONS = "unique_id string, question_id string, category string, question string, options string, images array<binary>, ground_truth string"
REQUIRED = ("unique_id", "question_id", "category", "question", "options", "images", "ground_truth")
SAMPLE = "feature string, validation_accuracy double, test_accuracy double"


def ordered(files: DataFrame, dataset: str) -> DataFrame:
    """Rows of a file source with ``src_ord``: their place by file name and row, numbered inside the dataset.

    The row number comes from counts of the files before (a table with a row a file) and the row index inside the file.
    """
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    start = sizes.select("_file", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_file")) - F.col("_n")).alias("_start"))
    return rows.join(start, "_file").withColumns({"dataset": F.lit(dataset), "src_ord": F.col("_start") + F.col("_row")}).drop("_file", "_row", "_start")


def read_parquet(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return ordered(spark.read.parquet(path), dataset)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; blank lines are skipped, a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image bytes by base name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(T.file_name(F.col("path")).alias("name"), F.col("content").alias("image"))


def conformed(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The required columns in order; a missing one raises."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*required)


def build(rows: DataFrame, path: str, force: bool = False) -> None:
    """Write as Parquet; what exists stays unless forced."""
    conformed(rows).write.mode("overwrite" if force else "ignore").parquet(path)


def cleaned(rows: DataFrame) -> DataFrame:
    """Null category and options become empty; images of any form become a list of bytes, empty if unreadable."""
    kind = dict(rows.dtypes)["images"]
    if kind == "string":  # a JSON list of base64, or one
        listed = F.from_json("images", "array<string>")
        images = F.coalesce(F.transform(F.filter(listed, lambda x: x.isNotNull()), F.unbase64), F.array().cast("array<binary>"))
    elif kind == "binary":
        images = F.when(F.col("images").isNull(), F.array().cast("array<binary>")).otherwise(F.array("images"))
    else:
        images = F.coalesce("images", F.array().cast("array<binary>"))
    return rows.withColumns({"category": F.coalesce("category", F.lit("")), "options": F.coalesce("options", F.lit("")), "images": images})


def registered(builders: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The sets that can be built, and what failed for the others."""
    built, failed = {}, {}
    for name, make in builders.items():
        try:
            built[name] = make()
        except (ValueError, OSError) as e:
            failed[name] = str(e)
    return built, failed


def first_found(spark: SparkSession, *paths: str) -> DataFrame:
    """The first path that holds a table: the clean copy, else the raw one."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(", ".join(paths))


def choices(raw: Column) -> Column:
    """Options given as a JSON object, a JSON list or a list literal with single quotes, as letter to text."""
    as_map = F.from_json(raw, "map<string,string>")
    as_list = F.coalesce(F.from_json(raw, "array<string>"), F.from_json(F.regexp_replace(raw, "'", '"'), "array<string>"))
    lettered = F.map_from_entries(F.transform(F.slice(as_list, 1, 10), lambda x, i: F.struct(F.substring(F.lit(T.LETTERS), i + 1, F.lit(1)).alias("key"), F.regexp_replace(x, r"^\s*[A-J]\s*[:.)]\s*", "").alias("value"))))
    return F.when(raw.startswith("{"), as_map).otherwise(lettered)


def label_of(answer: Column, options: Column) -> Column:
    """The letter of an answer given as a letter, as ``X: text`` or as the text of an option."""
    plain = F.upper(F.btrim(answer))
    lead = T.found(answer, r"^\s*([A-J])\s*[:.)]")
    by_text = F.try_element_at(F.filter(F.map_entries(options), lambda e: F.lower(F.btrim(e["value"])) == F.lower(F.btrim(answer))), F.lit(1))["key"]
    return F.coalesce(T.normal_letter(F.when(F.length(plain) == 1, plain)), lead, by_text)


def write_json(rows: DataFrame, path: str) -> None:
    """One folder a dataset."""
    rows.write.mode("overwrite").partitionBy("dataset").json(path)


def write_results(rows: DataFrame, summary: DataFrame, settings: dict[str, str], path: str) -> None:
    """Below ``path``: ``datasets`` (a folder a dataset), ``overall`` (all rows), ``summary`` and ``metadata`` (the settings and counts)."""
    write_json(rows, f"{path}/datasets")
    rows.write.mode("overwrite").json(f"{path}/overall")
    summary.write.mode("overwrite").json(f"{path}/summary")
    counts = rows.groupBy().agg(F.count("*").alias("n_rows"), F.count_distinct("dataset").alias("n_datasets"))
    counts.select("*", *(F.lit(v).alias(k) for k, v in settings.items())).write.mode("overwrite").json(f"{path}/metadata")


def store_mismatches(store: DataFrame, model_path: str, cache_type: str) -> DataFrame:
    """Rows by whether their constants differ from what is asked for."""
    bad = ~(F.col("model_path").eqNullSafe(F.lit(model_path)) & F.col("cache_type").eqNullSafe(F.lit(cache_type)))
    return store.groupBy(bad.alias("mismatch")).agg(F.count("*").alias("n"))


def result_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Result files below a folder, as whole texts with their path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def payload_rows(files: DataFrame, schema: str = SAMPLE) -> DataFrame:
    """Rows of a payload in any of three shapes: a list, a list under ``feature_probe_accuracies``, a map by feature."""
    row = "struct<" + ",".join(p.strip().replace(" ", ":") for p in schema.split(",")) + ">"
    listed = F.coalesce(F.from_json(F.when(F.ltrim("payload").startswith("["), F.col("payload")), f"array<{row}>"), F.from_json("payload", f"struct<feature_probe_accuracies:array<{row}>>")["feature_probe_accuracies"])
    mapped = F.from_json("payload", f"map<string,{row}>")
    names = [p.split()[0] for p in schema.split(",")]
    keyed = F.transform(F.map_entries(mapped), lambda e: F.struct(*(F.coalesce(e["value"][n], e["key"]).alias(n) if n == "feature" else e["value"][n].alias(n) for n in names)))
    return files.select("path", F.explode(F.coalesce(listed, keyed)).alias("r")).select("path", "r.*")


def path_columns(files: DataFrame) -> DataFrame:
    """Stage, benchmark mode and model from the path; ``all`` inside ``all_examples`` is no mode."""
    mode = T.found(F.col("path"), r"(?:^|[/_])(vqa_rad|mmmu_pro|medxpertqa_mm|all(?!_examples))(?=[/_.]|$)")
    return files.withColumns({"stage": T.found(F.col("path"), r"(?:^|/)(\d\d_[a-z_]+?)/"), "mode": mode, "model": T.found(F.col("path"), r"(ovis|qwen3_vl_32b_instruct|glm_4_6v_flash)")})
