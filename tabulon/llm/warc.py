"""Operator 6: WARC archives and the resolution of revisit records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import KEY_ROWS
from ..sources.scratch import delete, folder
from .common import forget, table, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: A digest that more than this share of the records have is joined apart: there are at most as many such digests as its inverse.
HOT_SHARE = 1 / 200
#: Bytes of payload in one batch that the reader hands back.
BATCH_BYTES = 4 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: 40 hexadecimal digits are 8 groups of 20 bits, each 4 letters."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column, record_id: Column, page_id: Column, url: Column, digest: Column, size: Column, date: Column, body: Column, refers_to: Column, refers_page: Column) -> Column:
    """A record as text. Control characters of a URL would end its header, so they are percent-encoded away."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    again = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))), line("WARC-Date", date),
        line("WARC-Target-URI", clean), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("X-Payload-Length", size.cast("string")), line("X-Page-Id", page_id.cast("string")),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:uuid:"), refers_to, F.lit(">")))), line("X-Refers-To-Page", F.when(again, refers_page.cast("string"))), line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        line("Content-Type", F.when(again, F.lit("application/http; msgtype=response")).otherwise(F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(records: DataFrame, path: str) -> None:
    """One column of records, as gzip-compressed archives: what ends a record ends a line of Spark's text writer, so any store that Spark writes will do."""
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def records_of(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record. pieces: what an archive has between its empty lines, wherever those stand; one record is held at a time."""
    end, rest = END.encode(), b""
    chunks = (x + end for x in pieces)
    while rest := rest or next(chunks, b""):
        head, _, rest = rest.partition(end)
        if not head:  # an archive whose last payload ends a line has its last piece before no empty line
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {head[:40]!r}")
        headers = {}
        for line in head.decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size, got, have = int(headers["content-length"]), [rest], len(rest)
        while have < size + len(end) and (more := next(chunks, b"")):
            got.append(more)
            have += len(more)
        data = b"".join(got)
        if data[size : size + len(end)] != end:
            raise ValueError(f"record {headers.get('warc-record-id')} doesn't end where its length says")
        yield headers, data[:size]
        rest = data[size + len(end) :]


def read_archives(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to (a page), refers_record and, if asked for, payload of each record.

    Spark's text reader streams the archives piece by piece, so neither an
    archive's size nor its number of records matters; a record is held whole.
    Archives from elsewhere may lack the X- headers: then page_id and refers_to
    are null, and a response's payload_bytes is the length of its body."""
    schema = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_record string" + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    urn = lambda x: x.strip("<>").removeprefix("urn:uuid:") if x else None
    number = lambda x: int(x) if x else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        pieces = (x.as_py() for batch in batches for x in batch.column(0))
        for h, body in records_of(pieces):
            kind = h["warc-type"]
            size = number(h.get("x-payload-length"))
            row = (urn(h["warc-record-id"]), number(h.get("x-page-id")), h.get("warc-target-uri"), len(body) if size is None and kind == "response" else size, (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, kind, number(h.get("x-refers-to-page")), urn(h.get("warc-refers-to")))
            rows.append(row + (body,) * payload)
            held += len(body) * payload + 200
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(parsed, schema)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """An archive record of every row, each a response with its payload and an id of its own; a null payload is empty."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    shaped = pages.select(F.uuid().alias("record_id"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
    none = F.lit(None).cast("string")
    record = _record(F.lit("response"), F.col("record_id"), F.col("page_id"), F.col("url"), base32_sha1(F.col("body")), F.octet_length("body"), F.lit(now()), F.col("body"), none, none)
    write_archives(shaped.select(record.alias("value")), path)


def decisions(heads: DataFrame, least: int) -> DataFrame:
    """record_id, first_page, first_fresh: of the records that revisit another one, the page and the fresh id of that.

    Only responses are originals, and only they become revisits of a smaller
    page with an equal payload. A revisit that is given stays one: of the first
    response of its digest, or where there is none as it is. Digests that more
    records have than a task should meet, or more than a share of all, are few;
    they meet their records by a broadcast."""
    originals = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = originals.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id", "fresh")).alias("first"))
    counts = heads.groupBy("payload_digest").agg(F.count("*").alias("n"))
    first = written(first.join(counts, "payload_digest").where("n > 1").select("payload_digest", "n", F.col("first.page_id").alias("first_page"), F.col("first.fresh").alias("first_fresh")), "first")
    most = min(KEY_ROWS, HOT_SHARE * heads.count())
    hot = F.broadcast(first.where(F.col("n") > most).drop("n"))  # at most 1 / HOT_SHARE rows, or records over KEY_ROWS
    rest = heads.join(hot.select("payload_digest"), "payload_digest", "left_anti").join(first.where(F.col("n") <= most).drop("n"), "payload_digest")
    met = heads.join(hot, "payload_digest").unionByName(rest)
    again = F.when(F.col("record_type") == "revisit", F.lit(True)).otherwise((F.col("page_id") > F.col("first_page")) & (F.col("payload_bytes") >= least))
    decided = written(met.where(again).select("record_id", "first_page", "first_fresh"), "decided")
    forget(first)
    return decided


def resolve(spark: SparkSession, source: str, target: str, least: int = 0) -> None:
    """Writes source's archives anew, under fresh record ids and dates: of responses with equal payloads of at least least bytes, all but the one with the smallest page id become revisits of it.

    Headers alone are shuffled by digest. Payloads move once, by record id, to
    meet their decision, so no payload is a hot key. Records with a null page id
    stay what they are. Revisits in source keep pointing at the response of
    their digest, and at what they pointed at where source has none."""
    heads = written(read_archives(spark, source, payload=False).withColumn("fresh", F.uuid()), "heads")
    # fresh ids are drawn once, so that a revisit can name the record it refers to
    decided = decisions(heads.select("record_id", "fresh", "page_id", "payload_bytes", "payload_digest", "record_type"), least)
    marked = heads.select("record_id", "fresh").join(decided, "record_id", "left")
    found = read_archives(spark, source, payload=True).join(marked, "record_id")
    again = F.col("first_fresh").isNotNull()
    given = F.col("record_type") == "revisit"
    kind = F.when(again | given, F.lit("revisit")).otherwise(F.col("record_type"))
    body = F.when(again | given, F.lit("")).otherwise(F.col("payload").cast("string"))
    record = _record(kind, F.col("fresh"), F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("payload_bytes"), F.lit(now()), body, F.coalesce("first_fresh", "refers_record"), F.coalesce("first_page", "refers_to"))
    write_archives(found.select(record.alias("value")), target)
    forget(heads), forget(decided)


def warc_roundtrip(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", keep_fetched: bool = True) -> DataFrame:
    """Writes pages to path/fetched, resolves revisits into path/resolved and returns what that holds; path/fetched goes unless it is to be kept.

    Empty tables give no archives and no rows. Rows with one id and one payload
    are responses all, as none has a smaller id than another. Extra columns of
    pages play no part."""
    spark = pages.sparkSession
    write_pages(pages, f"{path}/fetched", id_col, url_col, payload_col)
    resolve(spark, f"{path}/fetched", f"{path}/resolved", least)
    if not keep_fetched:
        delete(spark, f"{path}/fetched")
    return read_archives(spark, f"{path}/resolved", payload=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """warc_roundtrip() of all pages in the cluster's shared folder; null and empty payloads are equal ones of no bytes."""
    found = warc_roundtrip(table(spark, sf_dir, "pages"), folder(spark, "warc"), keep_fetched=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
