"""File listings: image folders and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions.text import file_name, file_suffix
from folio.sources.tree import file_tree

IMAGE = r"(?i)\.(png|jpe?g)$"
MAX_UPLOAD = 20 << 20


def image_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(arquivo, path, length[, content]) of the images right in a folder, by path; suffixes in any
    case. None is an error. Without content only the listing is read."""
    found = _images(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder))
    if not found.select("path").head(1):
        raise FileNotFoundError(f"no PNG or JPEG in {folder}")
    return found.select("arquivo", "path", "length", *(["content"] if content else [])).orderBy("path")


def _images(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(IMAGE)).withColumn("arquivo", file_name(F.col("path")))


def listed_images(spark: SparkSession, paths: list[str], content: bool = True) -> DataFrame:
    """As image_files(), of an explicit list of paths; a path that isn't there is an error."""
    return _images(spark.read.format("binaryFile").load(paths)).select("arquivo", "path", "length", *(["content"] if content else [])).orderBy("path")


def uploads(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """(pos, arquivo, content) of files handed over in memory, in their order."""
    return spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c) in enumerate(contents.items())], "pos bigint, arquivo string, content binary")


def labelled_images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(rotulo, arquivo, path, length[, content]) of images in folders named after their labels.
    Without content only the listing is read. Ordered by path is the dataset's order; numbered() of
    the evaluation operators gives positions."""
    found = _images(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
    return found.select(F.element_at(F.split("path", "/"), -2).alias("rotulo"), "arquivo", "path", "length", *(["content"] if content else []))


def all_files(spark: SparkSession, folder: str, without: list[str] | None = None) -> DataFrame:
    """(caminho, length): every file below a folder, hidden ones too, by its path from there; contents
    aren't read. Folders with a name in without are not entered: for packages, D.EXCLUDED_DIRS."""
    return file_tree(spark, folder, without).select("caminho", "length")


def exported_files(spark: SparkSession, folder: str) -> DataFrame:
    """(arquivo, path, length) of the .csv and .json files right in a folder, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).filter(F.col("path").rlike(r"\.(csv|json)$"))
    return found.select(file_name(F.col("path")).alias("arquivo"), "path", "length").orderBy("path")


def acceptable(uploads: DataFrame) -> DataFrame:
    """uploads(content) with aceito: not empty, not over the limit, and PNG or JPEG by first bytes."""
    start = F.hex(F.substring("content", 1, 4))
    size = F.octet_length("content")
    kind = F.when(start == "89504E47", "png").when(start.startswith("FFD8FF"), "jpeg")
    return uploads.withColumn("tipo", kind).withColumn("aceito", F.coalesce(kind.isNotNull() & (size > 0) & (size <= MAX_UPLOAD), F.lit(False)))


def set_aside(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad ones with motivo: empty, too large, neither PNG nor JPEG, or cut off (without
    the mark that ends such a file)."""
    d = acceptable(uploads)
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    tail = F.hex(F.expr("substring(content, greatest(1, octet_length(content) - 15), 16)"))
    ends = F.when(F.col("tipo") == "png", tail.contains("49454E44")).otherwise(tail.contains("FFD9"))
    why = F.when(size == 0, "vazio").when(size > MAX_UPLOAD, "grande demais").when(F.col("tipo").isNull(), "nem PNG nem JPEG").when(~ends, "incompleto")
    d = d.withColumn("motivo", why)
    return d.filter("motivo IS NULL").drop("motivo", "aceito"), d.filter("motivo IS NOT NULL").drop("aceito")


def package_files(paths: DataFrame, column: str = "caminho", report: str | None = None) -> DataFrame:
    """The relative paths that belong into a package."""
    p, name = F.col(column), file_name(F.col(column))
    literals = lambda values: F.array(*map(F.lit, values))
    out = F.arrays_overlap(F.split(p, "/"), literals(D.EXCLUDED_DIRS)) | name.isin(D.EXCLUDED_FILES) | name.startswith("~$") | file_suffix(p).isin(D.EXCLUDED_SUFFIXES)
    if report is not None:
        out |= p == report
    return paths.filter(~out)


def leaks(paths: DataFrame, column: str = "caminho") -> DataFrame:
    """Paths that should never be in a package."""
    return paths.filter(F.col(column).endswith(".env") | F.col(column).endswith("historico.db"))


def top_level(paths: DataFrame, column: str = "caminho") -> DataFrame:
    return paths.select(F.substring_index(column, "/", 1).alias("entrada")).distinct()
