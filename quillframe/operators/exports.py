"""Documents as text in four formats, from their ordered lines. A document's lines are gathered in one row, which its export is anyway."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.formulas import markdown_line
from quillframe.functions.text import let, strip

#: Formats and the endings of their files; head and foot of a LaTeX file; what stands for a document without text.
ENDINGS = {"MARKDOWN": "md", "TXT": "txt", "LATEX": "tex", "JSON": "json"}
HEAD, FOOT = "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{amsmath,amssymb}\n\\begin{document}\n", "\n\\end{document}\n"
NO_TEXT = "*(no text was recognised)*"
#: What stands for a document that has no lines at all.
NO_LINES = "*(the notes are empty)*"


@dataclass(frozen=True)
class Comparison:
    """A table of two columns: the line that starts it (a pattern), the columns' titles, and the words that put an unparted row in the left column."""

    start: str
    left: str
    right: str
    left_words: tuple[str, ...]


def _joined(lines: DataFrame, group: str, order: str, text: Column, by: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t")))))
    return lines.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), by).alias("body"))


def plain_text(lines: DataFrame, title: str, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """group, content: a title line, a blank line, and the lines that are not blank."""
    s = strip(F.col("text"))
    return _joined(lines, group, order, F.when(s != "", s), "\n").select(group, F.concat(F.lit(f"=== {title} ===\n\n"), F.col("body"), F.lit("\n")).alias("content"))


def table_rows(rows: Column, comparison: Comparison) -> Column:
    """The rows of a two-column table as lines: a row with a bar fills both columns, another one the column of its words; the shorter column is filled up."""

    def parted(r: Column) -> Column:
        at = F.split(r, "\\s*\\|\\s*")
        of_left = F.lit(False)
        for w in comparison.left_words:
            of_left = of_left | F.contains(F.lower(r), F.lit(w))
        both = F.contains(r, F.lit(" | "))
        left = F.when(both, F.get(at, F.lit(0))).when(of_left, r)
        right = F.when(both, F.get(at, F.lit(1))).when(~of_left, r)
        return F.struct(F.coalesce(strip(left), F.lit("")).alias("l"), F.coalesce(strip(right), F.lit("")).alias("r"))

    def side(x: Column, name: str) -> Column:
        return F.filter(F.transform(x, lambda p: p[name]), lambda v: v != "")

    def lined(x: Column) -> Column:
        n = F.greatest(F.size(x["l"]), F.size(x["r"]))
        one = lambda i: F.concat(F.lit("| "), F.coalesce(F.get(x["l"], i), F.lit("")), F.lit(" | "), F.coalesce(F.get(x["r"], i), F.lit("")), F.lit(" |"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<string>"))

    return let(F.transform(rows, parted), lambda p: let(F.struct(side(p, "l").alias("l"), side(p, "r").alias("r")), lined))


def markdown(lines: DataFrame, title: str, domain: str = "general", group: str = "doc_id", order: str = "pos", comparison: Comparison | None = None, documents: DataFrame | None = None) -> DataFrame:
    """group, content: title, subject, then each line as markdown_line() has it; from a comparison's first line on, a table. Documents of blank lines say that they have no text,
    and those of `documents` (group; one row each) without any line that they are empty."""
    s = strip(F.col("text"))
    one = F.struct(F.col(order).alias("o"), s.alias("t"), markdown_line(F.col("text")).alias("m"))
    d = lines.groupBy(group).agg(F.sort_array(F.collect_list(F.when(s != "", one))).alias("x"))
    texts = F.transform("x", lambda x: x["m"])
    if comparison is not None:
        start = F.array_position(F.transform("x", lambda x: F.lower(x["t"]).rlike(comparison.start)), True).cast("int")
        head = F.array(F.lit(f"\n### {comparison.left} / {comparison.right}\n"), F.lit(f"| {comparison.left} | {comparison.right} |"), F.lit("| :--- | :--- |"))
        d = d.withColumn("at", start)
        rows = table_rows(F.transform(F.slice("x", F.col("at") + 1, F.size("x")), lambda x: x["t"]), comparison)
        texts = F.when(F.col("at") > 0, F.concat(F.slice(texts, F.lit(1), F.col("at") - 1), head, rows)).otherwise(texts)
    content = F.concat(F.lit(f"# {title}\n\n> **Subject**: *{domain}*\n\n"), F.array_join(texts, "\n"))
    d = d.select(group, F.when(F.size("x") == 0, F.lit(f"# {title}\n\n{NO_TEXT}\n")).otherwise(F.concat(strip(content), F.lit("\n"))).alias("content"))
    if documents is None:
        return d
    return documents.select(group).join(d, group, "left").select(group, F.coalesce("content", F.lit(f"# {title}\n\n{NO_LINES}\n")).alias("content"))


def latex(lines: DataFrame, title: str, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """The markdown body between a LaTeX head and foot."""
    return markdown(lines, title, group=group, order=order).select(group, F.concat(F.lit(HEAD), F.col("content"), F.lit(FOOT)).alias("content"))


def json_lines(lines: DataFrame, title: str, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """group, content: a JSON object of the title and the lines: line_index, bbox, text, confidence in order."""
    one = F.struct(F.col(order).alias("line_index"), F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox"), "text", "confidence")
    return lines.groupBy(group).agg(F.to_json(F.struct(F.lit(title).alias("title"), F.sort_array(F.collect_list(one)).alias("lines"))).alias("content"))


def export(lines: DataFrame, kind: str, title: str, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """group, export_format, content; kind in any case."""
    kind = kind.upper()
    if kind not in ENDINGS:
        raise ValueError(f"no such format: {kind}")
    made = {"MARKDOWN": markdown, "TXT": plain_text, "LATEX": latex, "JSON": json_lines}[kind]
    return made(lines, title, group=group, order=order).select(group, F.lit(kind).alias("export_format"), "content")


def guide_export(lines: DataFrame, guides: DataFrame, title: str, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """group, export_format, content: what a service wrote of a document (guides: group, guide; one row each) as MARKDOWN and as TXT, both the same; the markdown export where there is none or a blank one."""
    written = guides.select(group, F.when(strip(F.col("guide")) != "", F.col("guide")).alias("_guide"))
    made = markdown(lines, title, group=group, order=order).join(written, group, "left")
    return made.select(group, F.explode(F.array(F.lit("MARKDOWN"), F.lit("TXT"))).alias("export_format"), F.coalesce("_guide", "content").alias("content"))


def front_matter(title: Column, subject: Column, date: Column, text: Column) -> Column:
    """A note with its facts ahead of the text."""
    return F.concat(F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), title), F.concat(F.lit("subject: "), subject), F.concat(F.lit("date: "), date), F.lit("---")), F.lit("\n\n"), text)
