"""Digests of rows and columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha_of_rows(order: Column, value: Column, last_newline: bool = False) -> Column:
    """Aggregate: SHA-256 of a group's values in order, one to a line; last_newline ends the last line too. The group must be bounded."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda r: r["v"]), "\n")
    return F.sha2(F.concat(lines, F.lit("\n")) if last_newline else lines, 256)


def canonical(columns: list[str]) -> Column:
    """SHA-256 of a row of strings as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def without_hash_prefixes(name: Column) -> Column:
    """A file name without one or two leading groups of 8 hexadecimal digits and an underscore."""
    return F.regexp_replace(name, r"^(?:[0-9a-f]{8}_){1,2}(?=.)", "")


#: What secrets look like (fixed values).
SECRETS = {
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})\b",
    "hf_token": r"\bhf_[A-Za-z0-9]{30,}\b",
    "openai_token": r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{24,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "signed_url": r"https?://[^\s\"<>]+[?&](?:X-Amz-Signature|sig|token)=[^\s\"<>]{12,}",
    "credential_assignment": r"""(?i)(?:api_key|access_token|password|secret_key)\s*=\s*["']([^"'\n]{16,})["']""",
}


def secrets(text: Column) -> Column:
    """array<struct<type, fingerprint>>: each finding's kind and 12 digits of its SHA-256, never the value."""

    def of(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), F.substring(F.sha2(v, 256), 1, 12).alias("fingerprint")))

    return F.concat(*[of(kind, pattern) for kind, pattern in SECRETS.items()])


#: A credential assignment that holds one of these looks a value up or describes one.
NO_VALUE = ("os.environ", "os.getenv", "YOUR_", "<", "${")


def secret_findings(text: Column) -> Column:
    """array<struct<type, line, fingerprint>>: as secrets, with lines from 1 and without assignments that look a value up. A match's line is counted in the pieces up to it and the matches before it."""
    kinds = "array<struct<type:string,line:int,fingerprint:string>>"
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def of(kind: str, pattern: str) -> Column:
        own = re.compile(pattern).groups
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if own else 0))
        before, inside = F.transform(F.split(text, pattern), feeds), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), feeds)
        each = F.filter(F.arrays_zip(values.alias("v"), before.alias("b"), inside.alias("i")), lambda x: x["v"].isNotNull())

        def step(done: Column, x: Column) -> Column:
            line = (done["line"] + x["b"]).cast("int")
            hit = F.array(F.struct(F.lit(kind).alias("type"), line.alias("line"), F.substring(F.sha2(x["v"], 256), 1, 12).alias("fingerprint"))).cast(kinds)
            if own:
                known = F.lit(False)
                for part in NO_VALUE:
                    known = known | x["v"].contains(part)
                hit = F.when(known, F.array().cast(kinds)).otherwise(hit)
            return F.struct((line + x["i"]).cast("int").alias("line"), F.concat(done["out"], hit).alias("out"))

        start = F.struct(F.lit(1).alias("line"), F.array().cast(kinds).alias("out"))
        return F.when(text.rlike(pattern), F.aggregate(each, start, step, lambda done: done["out"])).otherwise(F.array().cast(kinds))

    return F.concat(*[of(kind, pattern) for kind, pattern in SECRETS.items()])


def signature(content: Column) -> Column:
    """The image kind that a file's first bytes show, else null."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for kind, pattern in {"png": "89504E470D0A1A0A%", "jpeg": "FFD8FF%", "gif": "47494638%", "pdf": "25504446%", "tiff": "49492A00%", "bmp": "424D%", "webp": "52494646________57454250%"}.items():
        out = F.when(head.like(pattern), kind).otherwise(out)
    out = F.when(head.like("4D4D002A%"), "tiff").otherwise(out)
    start = F.lower(F.encode(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "UTF-8").cast("string"))
    return F.when(out.isNull() & start.rlike(r"^\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)?<svg[\s>]"), "svg").otherwise(out)


def image_allowed(content: Column, name: Column, allowed: tuple[str, ...] = ("png", "jpeg", "webp")) -> Column:
    """If a file's first bytes show one of the allowed kinds and its name ends as that kind's does."""
    kind, suffix = signature(content), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(kind.isin(*allowed) & (F.when(suffix == "jpg", "jpeg").otherwise(suffix) == kind), F.lit(False))


def with_record_hash(df: DataFrame, name: str = "record_sha256") -> DataFrame:
    """Adds the SHA-256 of each row's canonical JSON: its columns by name, without the hash itself."""
    return df.withColumn(name, record_hash(df, name))


def record_hash(df: DataFrame, name: str = "record_sha256") -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != name)), {"ignoreNullFields": "false"}), 256)


def record_hash_status(df: DataFrame, name: str = "record_sha256") -> Column:
    """'valid', 'invalid' where the row isn't what was hashed, 'missing' without a hash."""
    return F.when(F.col(name).isNull(), "missing").when(F.col(name) == record_hash(df, name), "valid").otherwise("invalid")


def digest_parts(value: Column) -> Column:
    """array<long>: a value's SHA-256 as four numbers of 60 bits; null without a value."""
    h = F.sha2(value, 256)
    return F.when(h.isNotNull(), F.array(*[F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]))


def part_sums(parts: Column) -> list[Column]:
    """Aggregates of digest_parts(): how many there are, and sums of each number's upper and lower 30 bits, which are longs for up to 2^33 values."""
    low = (1 << 30) - 1
    return [F.count(parts), *[F.coalesce(F.sum(x), F.lit(0)) for k in range(4) for x in (F.shiftright(parts[k], 30), parts[k].bitwiseAND(F.lit(low)))]]


def digest_of_sums(sums: list[Column]) -> Column:
    """The digest that part_sums() stand for; sums of them stand for more values."""
    whole = [(sums[1 + 2 * k].cast("decimal(20,0)") * (1 << 30) + sums[2 + 2 * k].cast("decimal(20,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(",", sums[0].cast("string"), *whole), 256)


def set_digest(value: Column) -> Column:
    """Aggregate: a digest of a group's values in any order, repeats counted.

    Each value's SHA-256 is four numbers of 60 bits; their sums and the count
    are hashed. Sums merge in partial aggregates, so a set of any size passes
    a shuffle as one row a task. Null values count as nothing."""
    return digest_of_sums(part_sums(digest_parts(value)))
