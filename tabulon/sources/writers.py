"""Writers: delimited files, parts of fixed size, and small reports rendered on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, order: list[str], sep: str = "\t", compression: str = "none") -> None:
    """Rows in order, with a header in each file; an empty table is refused."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.orderBy(*order).write.option("sep", sep).option("header", True).option("compression", compression).mode("overwrite").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def parts(df: DataFrame, path: str, index: str, size: int) -> None:
    """Parts of `size` consecutive index values in their order, a folder each."""
    df.withColumn("part", F.floor(F.col(index) / size)).repartition("part").sortWithinPartitions("part", index).write.partitionBy("part").mode("overwrite").parquet(path)


def matrix(df: DataFrame, path: str, order: str) -> None:
    """Numbers without a header."""
    df.orderBy(order).drop(order).write.option("header", False).mode("overwrite").csv(path)


def family(df: DataFrame, path: str, order: list[str]) -> None:
    """One table as TSV, CSV and TeX. For report tables, which are small."""
    held = df.persist()
    delimited(held, f"{path}.tsv", order)
    delimited(held, f"{path}.csv", order, ",")
    atomic(f"{path}.tex", tex_table(held, order))
    held.unpersist()


def tex_table(df: DataFrame, order: list[str], most: int = 1000) -> str:
    rows = _few(df, order, most)
    clean = lambda v: "" if v is None else str(v).replace("\\", r"\textbackslash ").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    return "\n".join(" & ".join(map(clean, r)) + r" \\" for r in [tuple(df.columns), *rows]) + "\n"


def markdown(df: DataFrame, order: list[str], most: int = 1000) -> str:
    rows = _few(df, order, most)
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"


def delimited_digest(df: DataFrame, path: str, order: list[str], sep: str = "\t") -> str:
    """As delimited, and a SHA-256 of what was written: of the digests of its files in the order of their names."""
    delimited(df, path, order, sep)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    digests = files.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("k"), F.sha2("content", 256).alias("sha")).orderBy("k").collect()
    return hashlib.sha256("".join(r.sha for r in digests).encode()).hexdigest()


def like_container(df: DataFrame, order: list[str], path: str, container: dict | list, field: str | None = None, most: int = 1000) -> None:
    """A small result in the shape its source had: a list, or a mapping whose other entries stay and whose field holds the rows."""
    rows = [dict(zip(df.columns, r, strict=True)) for r in _few(df, order, most)]
    atomic(path, json.dumps(rows if isinstance(container, list) else container | {field: rows}, indent=2, ensure_ascii=False, default=str) + "\n")


def rendered(template: str, rows: list[str]) -> str:
    """A template with @@ROW_i@@ for each row: counts must match."""
    for k, row in enumerate(rows):
        if (mark := f"@@ROW_{k}@@") not in template:
            raise ValueError(f"the template lacks {mark}")
        template = template.replace(mark, row)
    if "@@ROW_" in template:
        raise ValueError("the template has more rows than the table")
    return template


def document(df: DataFrame, order: list[str], path: str, most: int = 1000) -> None:
    """A small result as one JSON document with sorted keys."""
    rows = [dict(zip(df.columns, r, strict=True)) for r in _few(df, order, most)]
    atomic(path, json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def _few(df: DataFrame, order: list[str], most: int) -> list[tuple]:
    """A report's rows: an error, not a cut, if there are more than a report has."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return [tuple(r) for r in rows]


def atomic(path: str, text: str) -> None:
    """Replaces a driver's file at once: a reader sees the old one or the new one."""
    fd, new = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)
    held = os.open(os.path.dirname(os.path.abspath(path)), os.O_RDONLY)  # so that the new name lasts too
    os.fsync(held)
    os.close(held)
