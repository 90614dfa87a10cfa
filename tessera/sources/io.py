"""Text tables, result lists, feature caches, vocabularies, dictionaries, models, experiment logs and reports. Paths are Spark's: any file system it knows."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.boost import Boosted

RAW = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: Iterable[str] = RAW) -> DataFrame:
    """The named columns, wherever the header has them, as trimmed strings; an empty field is '', and 'NA' or 'null' are words."""
    first = spark.read.text(path).limit(1).collect()
    names = [x.strip().lstrip("\ufeff") for x in (first[0][0] if first else "").split("\t")]
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    df = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", escape="", nullValue="\0", mode="PERMISSIVE", enforceSchema=True)
    return df.select(*(F.coalesce(F.trim(f"c{names.index(c)}"), F.lit("")).alias(c) for c in columns))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path).withColumnsRenamed({"business_name": "name", "business_address": "addr"})


def lost_lines(spark: SparkSession, path: str, df: DataFrame) -> int:
    """Lines with text, less the header and the parsed rows: above 0 if the reader lost some."""
    return spark.read.text(path).where(r"value rlike '\\S'").count() - 1 - df.count()


def write_lists(s1: DataFrame, pairs: DataFrame, path: str | None = None, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """A row for each record of s1 (entity_id), with its ids by rank, comma-separated; '' for none. pairs: s1, id, rank."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("ids"))
    out = s1.select(F.col("entity_id").alias("s1")).join(lists, "s1", "left").select(F.col("s1").alias(header[0]), F.coalesce("ids", F.lit("")).alias(header[1]))
    if path:
        out.write.csv(path, sep="\t", header=True, quote="", emptyValue="", mode="overwrite")
    return out


def read_lists(lists: DataFrame, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """s1, id of each id in a list."""
    return lists.select(F.col(key).alias("s1"), F.explode(F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("id"))


def read_ids(spark: SparkSession, path: str, header: str = "entity_id") -> DataFrame:
    """The first column, without header and blank lines."""
    first = F.trim(F.get(F.split("value", "\t"), F.lit(0)))
    return spark.read.text(path).select(first.alias("id")).where((F.col("id") != "") & (F.col("id") != header))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and where it stands: file and an increasing number."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))


def cache_features(df: DataFrame, path: str, key: str = "qi", buckets: int = 64) -> None:
    """Features by bucket of the query; a later write replaces only the buckets it holds."""
    df.withColumn("qbucket", F.pmod(F.col(key), F.lit(buckets))).write.option("partitionOverwriteMode", "dynamic").partitionBy("qbucket").parquet(path, mode="overwrite")


def join_extras(spark: SparkSession, pairs: DataFrame, paths: Iterable[str]) -> DataFrame:
    """Side features, each a table with qi and pj."""
    for p in paths:
        pairs = pairs.join(spark.read.parquet(p), ["qi", "pj"], "left")
    return pairs


def save_embeddings(df: DataFrame, encode, path: str, key: str, text: str) -> None:
    """Vectors of a text column as array<float>. encode: list of texts -> matrix; it runs in Arrow batches on executors."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            vectors = [[float(x) for x in v] for v in encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "vec"])

    kind = df.schema[key].dataType.simpleString()
    df.select(key, text).mapInArrow(run, f"{key} {kind}, vec array<float>").write.parquet(path, mode="overwrite")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file; it appears whole or not at all."""
    fs, p = _file(spark, path)
    part = p.suffix(".tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def save_json(spark: SparkSession, obj, path: str) -> None:
    write_text(spark, json.dumps(obj, ensure_ascii=False, indent=1), path)


def load_json(spark: SparkSession, path: str, default=None):
    text = read_text(spark, path)
    return default if text is None else json.loads(text)


def log_result(spark: SparkSession, path: str, exp: str, variant: str, **metrics) -> None:
    """A line of a log (a folder with a file for each line, so that runs may write at once); NaN becomes null."""
    row = {"exp": exp, "variant": variant, "time": time.time()} | {k: None if isinstance(v, float) and v != v else v for k, v in metrics.items()}
    write_text(spark, json.dumps(row) + "\n", f"{path}/{time.time_ns()}-{uuid.uuid4().hex}.jsonl")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_table(df: DataFrame, path: str) -> None:
    """A vocabulary (country, token, df, idf, idf_default), a dictionary (field, native, latin, score) or another table."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
    """A saved table; made and saved first, if there is none."""
    fs, p = _file(spark, f"{path}/_SUCCESS")
    if make is not None and not fs.exists(p):
        save_table(make(), path)
    return spark.read.parquet(path)


def dictionary_map(dictionary: DataFrame, field: str) -> DataFrame:
    """One row with the dictionary of a field as a map column, native to latin; a dictionary has some ten thousand words at most."""
    rows = dictionary.where(F.col("field") == field).groupBy("native").agg(F.max_by("latin", F.struct("score", "latin")).alias("latin"))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("native", "latin"))).alias(f"{field}_words"))


def save_models(spark: SparkSession, models: dict, decision: dict, path: str) -> None:
    """Fitted pipelines and boosted trees by name, and the decision that uses them."""
    trees = {name: dataclasses.asdict(model) for name, model in models.items() if isinstance(model, Boosted)}
    for name in models.keys() - trees.keys():
        models[name].write().overwrite().save(f"{path}/{name}")
    save_json(spark, trees, f"{path}/trees.json")
    save_json(spark, decision | {"models": sorted(models)}, f"{path}/decision.json")


def load_models(spark: SparkSession, path: str) -> tuple[dict, dict]:
    from pyspark.ml import PipelineModel

    decision = load_json(spark, f"{path}/decision.json", {})
    trees = load_json(spark, f"{path}/trees.json", {})
    return {name: Boosted(**trees[name]) if name in trees else PipelineModel.load(f"{path}/{name}") for name in decision.get("models", ())}, decision


@contextlib.contextmanager
def run_log(spark: SparkSession, path: str):
    """A function that prints lines with seconds since the start; they are written to path at the end, also after an error."""
    began, lines = time.time(), []

    def log(*words) -> None:
        lines.append(f"[{time.time() - began:8.1f}] " + " ".join(map(str, words)))
        print(lines[-1], flush=True)

    try:
        yield log
    finally:
        write_text(spark, "\n".join(lines) + "\n", path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def markdown(df: DataFrame, columns: list[str] | None = None, digits: int = 4, most: int = 1000) -> str:
    """A report table; for small results."""
    columns = columns or df.columns
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[shown(r[c]) for c in columns] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *rows])


def report(sections: dict[str, DataFrame | str], title: str = "Report", digits: int = 4) -> str:
    """A text with a table, or words, for each section."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n{body if isinstance(body, str) else markdown(body, digits=digits)}")
    return "\n\n".join(parts) + "\n"


def find_data_dir(spark: SparkSession, candidates: Iterable[str], variable: str = "TESSERA_DATA", needs: str = "") -> str | None:
    """The first folder that holds ``needs``; the environment's comes first."""
    for p in [os.environ.get(variable, ""), *candidates]:
        if p:
            fs, at = _file(spark, f"{p}/{needs}" if needs else p)
            if fs.exists(at):
                return p
    return None
