"""Sources other than Parquet tables, and the writes of the record store.

Files are read by Spark's readers only, so any store that Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, skip: str = r"/(node_modules|dist|\.git)/") -> DataFrame:
    """(path, content): one row for each file that matches ``pattern`` outside skipped folders."""
    read = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    return read.select(F.input_file_name().alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(skip))


#: What stands between two commits of a log.
_NEXT_COMMIT = "\ncommit\t"


def _commits(text: DataFrame) -> DataFrame:
    """(hash, subject, date, file) of rows that hold a commit each, the first of a file with its mark."""
    lines = text.select(F.split(F.regexp_replace("value", r"\A(?:commit\t)?", ""), "\n").alias("lines")).where(F.get("lines", F.lit(0)) != "")
    lines = lines.select(F.split(F.get("lines", F.lit(0)), "\t").alias("head"), F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x != "").alias("files"))
    return lines.select(F.get("head", F.lit(0)).alias("hash"), F.get("head", F.lit(1)).alias("subject"), F.get("head", F.lit(2)).alias("date"), F.explode_outer("files").alias("file"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, subject, date, file) from ``git log --name-only --pretty=format:'commit%x09%H%x09%s%x09%aI'``.

    Commits are the reader's records, so files stay with their commit and a long log is read by many tasks.
    """
    return _commits(spark.read.option("lineSep", _NEXT_COMMIT).text(path))


def commit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same from log files as they come into a folder; the stream's checkpoint knows which were read."""
    return _commits(spark.readStream.option("lineSep", _NEXT_COMMIT).text(folder))


def frontmatter(files: DataFrame) -> DataFrame:
    """(path, name, description, body) of Markdown files with a ``---`` header; others are left out."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n?(.*)\Z", 1)
    body = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n?(.*)\Z", 2)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    return files.where(head != "").select("path", field("name").alias("name"), field("description").alias("description"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def imports(files: DataFrame) -> DataFrame:
    """(path, target): modules that a source file imports, relative ones put in place of the file's folder."""
    found = F.regexp_extract_all("content", F.lit(r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]"), 1)
    e = files.select("path", F.explode(found).alias("raw"))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    near = F.concat(folder, F.lit("/"), F.regexp_replace("raw", r"^\./", ""))
    up = F.concat(F.regexp_replace(folder, r"/[^/]*$", ""), F.lit("/"), F.regexp_replace("raw", r"^\.\./", ""))
    return e.select("path", F.when(F.col("raw").startswith("./"), near).when(F.col("raw").startswith("../"), up).otherwise(F.col("raw")).alias("target")).distinct()


def note_lines(files: DataFrame, marks: tuple[str, ...] = ("TODO", "FIXME", "HACK")) -> DataFrame:
    """(path, line, mark, note) of comment marks in files."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    mark = F.regexp_extract("text", rf"\b({'|'.join(marks)})\b:?\s*(.*)", 1)
    return lines.withColumn("mark", mark).where("mark != ''").select("path", (F.col("line") + 1).alias("line"), "mark", F.trim(F.regexp_extract("text", rf"\b({'|'.join(marks)})\b:?\s*(.*)", 2)).alias("note"))


def append(df: DataFrame, path: str) -> None:
    """Insert: new rows go to new files."""
    df.write.mode("append").parquet(path)


def keep_newest(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The retained rows after a cleanup that keeps the newest ``n`` of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_rn") <= n).drop("_rn")


def xml_rows(df: DataFrame, element: str) -> DataFrame:
    """(xml): each row as an element with escaped attributes, for reports."""

    def quoted(c: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(safe))
        return F.concat(F.lit(f' {c}="'), text, F.lit('"'))

    return df.select(F.concat(F.lit(f"<{element}"), *[quoted(c) for c in df.columns], F.lit("/>")).alias("xml"))
