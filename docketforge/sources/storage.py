"""Listings of stored objects: filters, search, keys, types and checks of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types by extension.
FILE_TYPES = {
    "pdf": "PDF Document", "docx": "Word Document (DOCX)", "doc": "Word Document (DOC)", "txt": "Text Document", "rtf": "Rich Text Document", "html": "HTML Document", "htm": "HTML Document",
    "xml": "XML Document", "json": "JSON Document",
}
MIME_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "txt": "text/plain", "rtf": "application/rtf",
    "html": "text/html", "htm": "text/html", "xml": "application/xml", "json": "application/json",
}
ALLOWED = "pdf docx doc txt rtf json xml html htm jpg jpeg png gif bmp tiff tif webp".split()


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base(path), r"\.([^.]*)$", 1))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """All objects under a folder, however many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def described(objects: DataFrame) -> DataFrame:
    return objects.select("path", "size", "last_modified", extension(F.col("path")).alias("file_type"), base(F.col("path")).alias("filename"))


def documents(objects: DataFrame, file_type: str = "", min_size: int = 0, max_size: int = 0) -> DataFrame:
    """Objects that are documents: no folders, no system files, at least 100 bytes."""
    name = base(F.col("path"))
    junk = F.col("path").endswith("/") | name.contains("__MACOSX") | name.contains(".DS_Store") | name.endswith(".tmp") | name.endswith(".log")
    out = objects.where(~junk & (F.col("size") >= max(100, min_size)))
    if max_size > 0:
        out = out.where(F.col("size") <= max_size)
    return out.where(F.concat(F.lit("."), extension(F.col("path"))).endswith(file_type.lower())) if file_type else out


def by_name(objects: DataFrame, name: str, exact: bool = False, limit: int = 20) -> DataFrame:
    n = F.lower(base(F.col("path")))
    bare = F.regexp_replace(n, r"\.[^.]*$", "")
    hit = (n == name.lower()) | (bare == name.lower()) if exact else n.contains(name.lower())
    return objects.where(hit).orderBy("path").limit(min(limit, 100))


def parsed_key(path: Column) -> Column:
    parts = F.split(path, "/")
    ok = (F.size(parts) >= 4) & (parts[0] == "documents")
    return F.struct(ok.alias("is_valid"), F.when(ok, parts[1]).alias("category"), F.when(ok, parts[2]).alias("date"), F.when(ok, F.array_join(F.slice(parts, 4, 1_000_000), "/")).alias("filename"))


def storage_key(name: Column, category: Column, day: Column) -> Column:
    clean = F.translate(base(name), " ", "_")
    return F.concat(F.lit("documents/"), F.coalesce(F.nullif(category, F.lit("")), F.lit("uncategorized")), F.lit("/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), clean)


def path_error(path: Column) -> Column:
    """What is wrong with a path; null if nothing is."""
    ext = extension(path)
    return (
        F.when(F.trim(path) == "", "empty").when(path.contains(".."), "traversal").when(path.contains("\x00"), "null_byte").when(path.rlike(r'[|<>:*?"]'), "invalid_character")
        .when(F.octet_length(path) > 500, "too_long").when(path.startswith("/") | path.startswith("\\"), "leading_separator").when((ext != "") & ~ext.isin(*ALLOWED), "extension")
        .when(F.octet_length(base(path)) > 255, "name_too_long")
    )


def recover(objects: DataFrame, wanted: str) -> DataFrame:
    """The object most likely meant by a path: candidates by prefix, then exact name, then name within the path, then the only one."""
    name = wanted.rsplit("/", 1)[-1]
    bare = name.rsplit(".", 1)[0] if "." in name else name
    parts = name.split("_")
    stems = [name, bare]
    if len(parts) >= 3 and parts[0].startswith("doc"):
        rest = "_".join(parts[2:])
        stems = ["_".join(parts[:2]), rest, rest.rsplit(".", 1)[0]]
    cand = F.array_compact(F.array(*[F.when(F.col("path").startswith(f"documents/{s}"), F.lit(i)) for i, s in enumerate(stems)]))
    c = objects.select("path", F.explode(cand).alias("prefix_no"))
    alone = c.groupBy("prefix_no").agg(F.count("*").alias("n"))  # a row a prefix
    c = c.join(alone, "prefix_no")
    rank = F.when(F.lower(base(F.col("path"))) == name.lower(), 1).when(F.lower("path").contains(name.lower()), 2).when(F.col("n") == 1, 3)
    return c.withColumn("match_rank", rank).where("match_rank is not null").orderBy("prefix_no", "match_rank", "path").limit(1).select("path", "match_rank")
