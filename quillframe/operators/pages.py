"""What happens to a page's recognised lines, as one chain of frames: calibrate, keep what is informative, number anew, replace, export, set the status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import calibrated, edge_stripped_words, informative, valid_shape
from quillframe.operators import exports, metrics, relational, sequence
from quillframe.operators.distance import corrected_lines


@dataclass(frozen=True)
class Tables:
    lines: DataFrame
    exports: DataFrame
    pages: DataFrame


def ingest(files: DataFrame, documents: DataFrame, pages: DataFrame, author: str = "default") -> tuple[DataFrame, DataFrame]:
    """documents and pages with a document of one page for each file (path, length, modificationTime; see files.uploads), as uploaded.

    A document's id comes from its path and time, so a file that is known adds nothing. Contents are not read."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    kind = F.lower(F.regexp_extract(name, "[.]([^.]+)$", 1))
    new = files.select(
        F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256).alias("id"),
        F.regexp_replace(name, "[.][^.]+$", "").alias("title"), F.lit(author).alias("author"), name.alias("original_filename"), F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"), F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").otherwise(kind)).alias("mime_type"),
        F.lit("UPLOADED").alias("status"), F.col("modificationTime").alias("created_at"), F.col("modificationTime").alias("updated_at"),
    ).join(documents.select("id"), "id", "left_anti")
    page = new.select(F.sha2(F.concat("id", F.lit("|1")), 256).alias("id"), F.col("id").alias("document_id"), F.lit(1).alias("page_number"), F.col("file_path").alias("raw_image_path"), "status", "created_at")
    return relational.insert(documents, new), relational.insert(pages, page)


def calibrate(lines: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """lines (text, confidence) with the confidence calibrated by the lexicon."""
    counted = metrics.lexicon_counts(lines, edge_stripped_words(F.col("text")), lexicon, keys, valid_shape)
    return counted.withColumn("confidence", calibrated(F.col("text"), F.col("confidence"), F.col("n_words"), F.col("n_valid"))).drop("n_words", "n_valid")


def finish(recognised: DataFrame, old: Tables, lexicon: DataFrame, title: str = "Notes") -> Tables:
    """The tables after the pages of `recognised` (page_id, line_index, text, confidence) are done. Doing it again changes nothing but adds exports."""
    keys = ["page_id", "line_index"]
    kept = sequence.renumbered(calibrate(recognised, lexicon, keys).withColumnRenamed("line_index", "_at"), informative(F.col("text")), "page_id", "_at").drop("_at")
    kept = kept.select(*old.lines.columns)
    made = exports.markdown(kept, title, group="page_id", order="line_index").select("page_id", F.lit("MARKDOWN").alias("export_format"), "content")
    status = recognised.select("page_id").distinct().withColumn("status", F.lit("COMPLETED"))
    return Tables(relational.replace_children(old.lines, kept, "page_id"), relational.insert(old.exports, made), relational.patch(old.pages, status, "page_id", ["status"]))


def suggest(lines: DataFrame, vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """page_id, line_index, corrected_text, changed, confidence of the heuristic correction; 0.10 more, to 0.96, where it changed a line."""
    tokens = lines.select("page_id", "line_index", F.posexplode(F.split("text", "\\s+")).alias("k", "token"))
    fixed = corrected_lines(tokens, vocabulary, lexicon, ["page_id", "line_index"]).withColumnRenamed("text", "corrected_text")
    out = lines.select("page_id", "line_index", "confidence").join(fixed, ["page_id", "line_index"])
    return out.withColumn("confidence", F.when(F.col("changed"), F.least(F.lit(0.96), F.col("confidence") + 0.10)).otherwise(F.col("confidence")))


def apply_corrections(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """lines with the text of accepted corrections (page_id, line_index, corrected_text); blank ones are passed over."""
    change = corrections.filter(F.trim("corrected_text") != "").withColumnRenamed("corrected_text", "_t")
    joined = lines.join(change.select("page_id", "line_index", "_t"), ["page_id", "line_index"], "left")
    return joined.withColumn("text", F.coalesce("_t", "text")).select(*lines.columns)
