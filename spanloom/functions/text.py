"""Line and path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every break that Python's str.splitlines() knows.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RARE_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SINGLE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def with_line_array(files: DataFrame, out: str = "body") -> DataFrame:
    """Replace ``content`` by the array of its lines; a break at the very end starts no line.

    Two layers, so that the text is split once; texts with no break but ``\\n`` take the plain
    split, which is several times faster than the pattern.
    """
    content = F.col("content")
    split = F.when(content.rlike(RARE_BREAK), F.split(content, LINE_BREAK, -1)).otherwise(
        F.split(content, "\n", -1)
    )
    parts = F.col("_parts")
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.withColumn("_parts", split).withColumn(out, lines).drop("_parts", "content")


def line_count(content: Column) -> Column:
    """Number of lines without building them: breaks, plus an unfinished last line.

    Texts with no break but ``\\n`` are counted by bytes, which is several times faster.
    """
    flat = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    rare = F.length(flat) - F.length(F.translate(flat, SINGLE_BREAKS, ""))
    plain = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit("")))
    breaks = F.when(content.rlike(RARE_BREAK), rare).otherwise(plain)
    open_end = (content != "") & (F.instr(F.lit(SINGLE_BREAKS), F.right(content, F.lit(1))) == 0)
    return (breaks + open_end.cast("int")).cast("int")


def suffix_of(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def node_id(path: Column, line: Column, name: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), name)
