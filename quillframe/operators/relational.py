"""Relational reads and writes over parent and child tables, as frames in and frames out.

A write returns the table as it is after it; the caller writes that, in full or with dynamic
partition overwrite. Nothing here collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_page(df: DataFrame, order: list, offset: int = 0, limit: int = 100) -> DataFrame:
    """Some rows in a stated order: limit and offset become one take-ordered step."""
    return df.orderBy(*order).offset(offset).limit(limit)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def list_recent(df: DataFrame, order: list, limit: int = 50, offset: int = 0, column: str | None = None, value: object = None) -> DataFrame:
    """Newest first; the equality filter only if its value is given and not empty."""
    return scan_page(df.filter(F.col(column) == F.lit(value)) if column and value else df, order, offset, limit)


def with_total(page: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """The page with the count of the whole table, whatever the page's filter was. One row is joined."""
    return page.join(whole.agg(F.count(key).alias("total")))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs; empty if there are none."""
    rest = [c for c in children.columns if c not in (key, order)]
    some = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))
    empty = F.array().cast(some.schema[name].dataType)
    return parents.join(some, key, "left").withColumn(name, F.coalesce(name, empty))


def insert(df: DataFrame, new: DataFrame, **defaults: Column) -> DataFrame:
    """Rows added; columns that are null or missing in them take their defaults."""
    for name, value in defaults.items():
        new = new.withColumn(name, F.coalesce(F.col(name), value) if name in new.columns else value)
    return df.unionByName(new, allowMissingColumns=True)


def migrated(df: DataFrame, schema: T.StructType, **defaults: Column) -> DataFrame:
    """df with those columns of the schema that it lacks, behind its own: at their default, or null. No column goes or changes; doing it again changes nothing."""
    present = {c.lower() for c in df.columns}
    missing = [f for f in schema.fields if f.name.lower() not in present]
    return df.select("*", *[defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in missing])


def patch(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed update: a column changes where the patch has a value for it. changes: one row a key."""
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(named, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*df.columns)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def cascade_delete(keys: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each table of a chain (table, its key, the column that refers to the table before) when `keys` go from the first."""
    out, gone = [], keys
    for table, key, refers in chain:
        gone = gone.toDF(refers)
        out.append(table.join(gone, refers, "left_anti"))
        gone = table.join(gone, refers, "left_semi").select(key)
    return out


def replace_children(old: DataFrame, new: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """All rows of the parents in `new` give way to its rows; `parents`, if given, names those that lose their rows though they get none."""
    gone = new.select(parent) if parents is None else new.select(parent).union(parents.select(parent))
    return old.join(gone.distinct(), parent, "left_anti").unionByName(new)


def fallback_match(rows: DataFrame, fixes: DataFrame, first: list[str], then: list[str], value: str) -> DataFrame:
    """value of the fix that matches by `first`, else of the one that matches by `then`; null if none does. Fixes are unique in either."""
    a = fixes.filter(F.col(first[-1]).isNotNull()).select(*first, F.col(value).alias("_a"))
    b = fixes.filter(F.col(then[-1]).isNotNull()).select(*then, F.col(value).alias("_b"))
    return rows.join(a, first, "left").join(b, then, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n: rows that break each check; a null breaks none, as in SQL."""
    counts = df.agg(*[F.count_if(~c).alias(k) for k, c in checks.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*checks))).alias("check", "n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def progress(pages: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """lines, done and percent of each parent with `status`: by status, and while in work by its lines with text."""
    n = lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text") != "").alias("done"))
    d = pages.select(key, "status").join(n, key, "left").fillna(0, ["lines", "done"])
    percent = (
        F.when(F.col("status") == "COMPLETED", 100.0)
        .when(F.col("status") == "PROCESSING", F.when(F.col("lines") == 0, 50.0).otherwise(100.0 * F.col("done") / F.greatest("lines", F.lit(1))))
        .when(F.col("status") == "FAILED", 0.0)
        .otherwise(10.0)
    )
    return d.withColumn("percent", F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)))


def stored_or_made(documents: DataFrame, exports: DataFrame, key: str, made: Column) -> DataFrame:
    """content: the stored export if there is one, stale or not, else what is made now."""
    return documents.join(exports.select(key, F.col("content").alias("_stored")), key, "left").withColumn("content", F.coalesce("_stored", made)).drop("_stored")


_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Fixed schemas of the document model.
SCHEMAS = {
    "users": _schema(id=_S, username=_S, email=_S, hashed_password=_S, is_active=_B, created_at=_TS, updated_at=_TS),
    "documents": _schema(id=_S, user_id=_S, title=_S, author=_S, description=_S, original_filename=_S, file_path=_S, file_size_bytes=_L, mime_type=_S, status=_S, error_message=_S, created_at=_TS, updated_at=_TS),
    "pages": _schema(id=_S, document_id=_S, page_number=_I, raw_image_path=_S, processed_image_path=_S, deskewed_image_path=_S, debug_dir_path=_S, width=_I, height=_I, skew_angle=_D, status=_S, created_at=_TS),
    "text_lines": _schema(id=_S, page_id=_S, line_index=_I, bbox_x=_I, bbox_y=_I, bbox_w=_I, bbox_h=_I, cropped_image_path=_S, original_raw_text=_S, recognized_text=_S, confidence=_D, is_header=_B, is_math=_B, indent_level=_I, created_at=_TS),
    "export_documents": _schema(id=_S, document_id=_S, export_format=_S, file_path=_S, content=_S, created_at=_TS),
}
#: Fixed status names.
STATUSES = ("UPLOADED", "PROCESSING", "COMPLETED", "FAILED")
FORMATS = ("MARKDOWN", "TXT", "LATEX", "JSON")


def model_checks(table: str) -> dict[str, Column]:
    """Row constraints of a table of the document model."""
    c = F.col
    return {
        "users": {"username_length": F.length("username") >= 3, "email_pattern": c("email").rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$")},
        "documents": {"status": c("status").isin(*STATUSES), "file_size": c("file_size_bytes") >= 0},
        "pages": {"page_number": c("page_number") >= 1, "size": (c("width") >= 0) & (c("height") >= 0)},
        "text_lines": {"box_place": (c("bbox_x") >= 0) & (c("bbox_y") >= 0), "box_size": (c("bbox_w") > 0) & (c("bbox_h") > 0), "confidence": c("confidence").between(0, 1), "indent": c("indent_level") >= 0},
        "export_documents": {"format": F.upper("export_format").isin(*FORMATS)},
    }[table]
