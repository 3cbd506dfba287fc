"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions import text as tx
from memlake.session import path_exists

# Directories and files a corpus scan skips, media types by extension.
IGNORED_DIRS = [
    ".git", ".obsidian", ".trash", ".stfolder", ".tmp.drivedownload", ".tmp.driveupload", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".venv", "venv", "env", ".idea", ".vscode", "_lint_reports", "_profile_reports", "templates", "memory",
]
IGNORED_FILES = [".DS_Store", "Thumbs.db", ".gitattributes", ".gitignore", ".stignore"]
IGNORED_ENDINGS = r"(\.tmp|\.swp|\.swo|~)$"
MEDIA_TYPES = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".pdf": "application/pdf", ".json": "application/json",
    ".csv": "text/csv", ".yaml": "application/yaml", ".yml": "application/yaml", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".gif": "image/gif", ".tiff": "image/tiff", ".webp": "image/webp", ".svg": "image/svg+xml", ".mp3": "audio/mpeg", ".html": "text/html",
}
MAIL = "id STRING, thread_id STRING, subject STRING, `from` STRING, `to` ARRAY<STRING>, date STRING, body STRING, labels ARRAY<STRING>"


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing: relative path, area, extension, media type, size and time. The
    content column is not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), f"^{root.rstrip('/')}/", "")
    return describe_assets(f.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")))


def describe_assets(files: DataFrame) -> DataFrame:
    """Area, extension and media type by path; hidden and ignored paths left out."""
    parts = F.split("path", "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    ignored = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*IGNORED_DIRS)) | name.startswith(".") | name.isin(*IGNORED_FILES) | name.rlike(IGNORED_ENDINGS)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    media = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return files.where(~ignored).withColumns({
        "filename": name, "area": F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("ROOT"),
        "extension": F.when(ext == "", "(none)").otherwise(ext), "media_type": F.coalesce(F.try_element_at(media, ext), F.lit("application/octet-stream"))})


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Whole text of Markdown files with their relative path."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    rel = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", ""), f"^{root.rstrip('/')}/", "")
    return t.select(rel.alias("path"), F.col("value").alias("text"))


def parse_mail(rows: DataFrame, json: str = "json") -> DataFrame:
    """Message JSON text to mail rows; unreadable messages are dropped."""
    m = rows.select(F.from_json(json, MAIL).alias("m")).where("m.id IS NOT NULL").select("m.*")
    return m.withColumn("sent_at", F.col("date").try_cast("timestamp").cast("timestamp_ntz"))


def read_mail_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Directory of message files, one JSON object each."""
    return parse_mail(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Mailbox files split at their message separator, so one large mailbox is read by many
    tasks; headers and body come from each message's text."""
    return parse_mbox_messages(spark.read.option("lineSep", "\nFrom ").text(path).withColumnRenamed("value", "raw"))


def parse_mbox_messages(messages: DataFrame, raw: str = "raw") -> DataFrame:
    text = F.regexp_replace(F.col(raw), r"^(From )?[^\n]*\n", "")
    cut = F.instr(text, "\n\n")
    head = F.when(cut > 0, F.left(text, cut)).otherwise(text)
    unfolded = F.regexp_replace(head, r"\n[ \t]+", " ")

    def header(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(unfolded, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))

    body = F.when(cut > 0, F.substring(text, cut + 2, F.length(text))).otherwise(F.lit(""))
    m = messages.select(header("Message-ID").alias("id"), header("Subject").alias("subject"), header("From").alias("from"), header("Date").alias("date"),
                        tx.strip(F.regexp_replace(body, r"(?m)^>From ", "From ")).alias("body"))
    return m.where(F.col("id").isNotNull())


def report_lines(rows: DataFrame) -> DataFrame:
    """Report lines of pending items in reading order keys: conversation, item rank, id."""
    line = F.format_string("- **%s** · %s · %d turns · `%s`: %s", F.col("label"), F.col("reasoning_kind"), F.col("n_evidence"), F.col("memory_id"), F.left(F.trim("statement"), F.lit(160)))
    return rows.select("best", "n_priority", "conversation_id", "label_rank", "memory_id", line.alias("line"))


def write_review_report(rows: DataFrame, path: str) -> None:
    """Ordered text files: range-partitioned on the reading order, so a conversation of any
    size spreads over files that concatenate in order."""
    order = [F.col("best"), F.desc("n_priority"), F.col("conversation_id"), F.col("label_rank"), F.col("memory_id")]
    report_lines(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def append_events(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Append the events a journal folder does not hold yet, partitioned by day."""
    from memlake.operators.journal import new_events

    day = F.to_date("observed_at")
    held = spark.read.parquet(path) if path_exists(spark, path) else None
    fresh = incoming.dropDuplicates(["event_id"]) if held is None else new_events(held, incoming)
    fresh.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def write_json_lines(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)
