"""Audit of a tree of files before it is released: against a manifest, by content, for secrets. Findings are rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import secret_findings, signature

#: Suffixes of pictures, of files that hold text, and of files that may not be released at all (fixed values).
PICTURES = ("png", "jpg", "jpeg", "gif", "pdf", "tif", "tiff", "bmp", "webp", "svg")
TEXTS = ("py", "md", "yaml", "yml", "json", "tsv", "csv", "txt", "cff", "tex", "html")
#: Names that hold credentials whatever is in them (fixed values).
CREDENTIAL_NAMES = (".env", "id_rsa", "id_ed25519", ".netrc", ".bash_history", ".zsh_history")
FINDING = "path string, kind string, line int, detail string"


@dataclass(frozen=True)
class Policy:
    """What may be in a tree. allowed: classes of pictures that the list of pictures may give; roots: where no picture may stand, whatever the list says."""

    allowed: tuple[str, ...] = ("SYNTHETIC", "AUTHOR_CREATED")
    roots: tuple[str, ...] = ()
    forbidden_suffixes: tuple[str, ...] = ("sqlite", "ttf", "otf", "pt", "safetensors", "jsonl")
    most_bytes: int = 100_000_000


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), bytes, content of every file, folders that begin with a point or underscore included.

    Names are listed; contents are read by the engine. Its reader leaves out
    files whose own name begins so: their content is null, which is a finding.
    It leaves out empty files too, whose content is known."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(where).toString().rstrip("/") + "/"
    found, each = [], fs.listFiles(where, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen()))
    listed = spark.createDataFrame(found, "full string, bytes long")
    visible = [p for p, _ in found if p.rsplit("/", 1)[1][0] not in "._"]
    if not visible:
        return listed.select(F.substring("full", len(top) + 1, 1 << 20).alias("path"), "bytes", F.when(F.col("bytes") == 0, F.lit(b"")).alias("content"))
    content = spark.read.format("binaryFile").load(visible).select(F.regexp_replace("path", r"^file:/+", "file:/").alias("_full"), "content")
    return listed.join(content, F.regexp_replace("full", r"^file:/+", "file:/") == F.col("_full"), "left").select(F.substring("full", len(top) + 1, 1 << 20).alias("path"), "bytes", F.when(F.col("bytes") == 0, F.lit(b"")).otherwise(F.col("content")).alias("content"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def audit(files: DataFrame, manifest: DataFrame, pictures: DataFrame, known: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """path, kind, line, detail: what stands against a release; no rows if nothing does.

    files: path, bytes, content. manifest: path, sha256, bytes. pictures: path,
    sha256, classification. known: sha256 of pictures that may not appear under
    any name. A file is a picture by its first bytes, else by its suffix, and
    must be listed under its exact path and hash in an allowed class. Secrets
    are shown by twelve digits of a hash, never by their value. Each file is
    read once, and only hashes and findings are shuffled. Null contents are
    'unreadable'; an empty tree lacks all that the manifest has."""
    text = F.expr("try_validate_utf8(cast(content as string))")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.coalesce(signature(F.col("content")), F.when(suffix(F.col("path")).isin(*PICTURES), suffix(F.col("path"))))
    plain = suffix(F.col("path")).isin(*TEXTS)
    private = lambda found, pattern: F.when(plain & text.rlike(pattern), F.array(F.struct(F.lit(found).alias("kind"), F.lit(0).alias("line"), F.lit("").alias("detail"))))
    hits = "array<struct<kind:string,line:int,detail:string>>"
    flag = lambda found, when, detail="": F.when(when, F.array(F.struct(F.lit(found).alias("kind"), F.lit(0).alias("line"), F.lit(detail).alias("detail"))))
    own = [
        flag("oversize", F.col("bytes") > policy.most_bytes), flag("forbidden_suffix", suffix(F.col("path")).isin(*policy.forbidden_suffixes)), flag("credential_filename", name.isin(*CREDENTIAL_NAMES), "filename-only"),
        flag("unreadable", F.col("content").isNull()), private("private_absolute_path", r"/(?:home|Users)/[^/\s]+/"), private("private_device_uuid", r"GPU-[a-f0-9-]{30,}"),
        F.transform(secret_findings(text), lambda x: F.struct(x["type"].alias("kind"), x["line"].alias("line"), x["fingerprint"].alias("detail"))),
    ]
    none = F.array().cast(hits)
    read = files.select("path", "bytes", F.sha2("content", 256).alias("sha256"), kind.alias("picture"), F.concat(*[F.coalesce(x.cast(hits), none) for x in own]).alias("hits"))
    # one row a file beside its line of the manifest and of the list of pictures
    met = read.withColumn("there", F.lit(True)).join(manifest.select("path", F.col("sha256").alias("m_sha"), F.col("bytes").alias("m_bytes"), F.lit(True).alias("listed")), "path", "full").join(pictures.select("path", F.col("sha256").alias("p_sha"), "classification", F.lit(True).alias("shown")), "path", "full")
    if known is not None:
        met = met.join(known.select("sha256", F.lit(True).alias("withdrawn")).distinct(), "sha256", "left")
    else:
        met = met.withColumn("withdrawn", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    there, listed = yes(F.col("there")), yes(F.col("listed"))
    barred = yes(F.col("withdrawn"))
    for root in policy.roots:
        barred = barred | F.col("path").startswith(root)
    welcome = yes(F.col("p_sha") == F.col("sha256")) & yes(F.col("classification").isin(*policy.allowed)) & ~barred
    more = [
        flag("missing", listed & ~there), flag("unexpected", there & ~listed), flag("hash_or_size", there & listed & ((F.col("sha256") != F.col("m_sha")) | (F.col("bytes") != F.col("m_bytes")))),
        F.when(there & F.col("picture").isNotNull() & ~welcome, F.array(F.struct(F.lit("forbidden_picture").alias("kind"), F.lit(0).alias("line"), F.col("picture").alias("detail")))), flag("picture_missing", yes(F.col("shown")) & F.col("picture").isNull()),
    ]
    found = F.concat(F.coalesce("hits", none), *[F.coalesce(x.cast(hits), none) for x in more])
    return met.select("path", F.inline(found))
