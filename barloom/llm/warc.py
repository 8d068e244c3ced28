"""WARC writing, and reading by boundary-chain verification (operator 10).

Archives are plain WARC/1.1 files written by Spark's text writer (the record end is the line separator). Reading
splits files anywhere: the version line is the separator, so each task meets *candidate* records, of which some
may be text inside a payload. A task emits each candidate with the offset that its Content-Length gives for the
successor, and with the offset where the chain from it leaves the task's split. Pointer jumping over these exits
from offset 0 finds the true entry of every split; candidates off the chain are rejected.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage
from .exact_dedup import settle

#: Fixed values of the format: version line, end of a record, base-32 letters.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 20_000


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base 32 of a 40-digit hex string: five hex digits make four letters."""
    out = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(LETTERS), F.shiftright(value, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*out)


def records_of(pages: DataFrame, stage: Stage, id_col="page_id", url_col="url", payload_col="html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the records without their end. Of equal payloads of at least ``min_bytes`` bytes the one with the
    largest id is a response, the others are revisits of it, without payload."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    # a digest for each row that may be shared; short payloads keep to themselves
    keyed = pages.select(pages[id_col].alias("id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("n"))
    keyed = stage.table(keyed, "digests")
    groups = settle(keyed.filter(F.col("n") >= min_bytes).select("id", "digest"))
    revisits = groups.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("keep_id").alias("refers"))
    revisits = stage.table(revisits.distinct(), "revisits")
    url = F.regexp_replace(F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(pages[id_col].alias("id"), url.alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    rows = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    response = F.col("r_digest").isNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(response, F.concat(http, "payload")).otherwise(http)
    refers = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers")), F.lit("\r\n"))
    value = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(response, "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "), "url", F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.lower(F.hex("digest"))), F.lit("\r\n"),
        F.when(response, "").otherwise(refers), F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    return rows.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, stage: Stage | None = None, **options) -> None:
    """Write a record for each row of ``pages`` to uncompressed archives under ``path``; null payloads are empty."""
    stage = stage or Stage(pages.sparkSession, "warc")
    records_of(pages, stage, **options).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


#: No record is longer; offsets then fit 64 bits with room to add.
LONGEST = 1 << 61


def _length(digits: bytes) -> int | None:
    """A length in ASCII digits, LONGEST at most; else None."""
    digits = digits.strip(b" \t").lstrip(b"0") or digits.strip(b" \t")[:1]
    if not digits.isdigit() or len(digits) > 19:
        return None
    return n if (n := int(digits)) <= LONGEST else None


def parse(chunk: bytes) -> dict | None:
    """A candidate (what follows the version line): its fields, its end, and its payload if the chunk holds the whole block.

    None for bytes that are no record: without an end of the header, with a header line without colon, without type or id, or with a length
    that is no number or beyond ``LONGEST``. A revisit whose HTTP header has no such length has null bytes.
    """
    head = chunk.find(b"\r\n\r\n")
    if head < 0:
        return None
    fields = {}
    for line in chunk[:head].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip()
    length = _length(fields.get(b"content-length", b""))
    if length is None or not {b"warc-type", b"warc-record-id"} <= fields.keys():
        return None
    text = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in fields.items()}
    out = {"type": text["warc-type"], "name": text["warc-record-id"], "refers": text.get("warc-refers-to"), "uri": text.get("warc-target-uri"), "end": head + 4 + length + 4, "whole": len(chunk) >= head + 4 + length}
    if out["whole"]:
        block = chunk[head + 4 : head + 4 + length]
        http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        if out["type"] == "revisit":  # the payload is that of another record: its length and digest are in the headers
            sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            out["bytes"] = _length(sizes[0]) if sizes else None
            out["digest"] = text.get("warc-payload-digest", "").removeprefix("sha1:")
        else:
            out["bytes"], out["digest"] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out["payload"] = payload
    return out


FIELDS = ["type", "name", "refers", "uri", "whole", "bytes", "digest"]
CANDIDATE = pa.schema(
    [("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("rel", pa.int64()), ("span", pa.int64()), ("succ", pa.int64()), ("exit", pa.int64()), ("type", pa.string()), ("name", pa.string()), ("refers", pa.string()), ("uri", pa.string()), ("whole", pa.bool_()), ("bytes", pa.int64()), ("digest", pa.string())]
)


def _close(split: list[dict]) -> pa.RecordBatch:
    """Exits of one split's candidates: where the chain from each leaves the split; null if it breaks inside."""
    total = split[-1]["rel"] + split[-1]["span"] if split else 0
    exits: dict[int, int | None] = {}
    for row in reversed(split):
        succ = row["succ"]
        row["exit"] = None if succ is None else exits.get(succ) if succ + len(MAGIC) < total else succ
        exits[row["rel"] - len(MAGIC)] = row["exit"]
    return pa.RecordBatch.from_pylist(split, schema=CANDIDATE)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a split come in order, so offsets are relative to the start of its first chunk. ``rel`` is where a
    chunk starts, after the version line; ``succ`` and ``exit`` are offsets of version lines."""
    at, held, rel = None, [], 0
    for batch in batches:
        for file, start, size, value in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if (file, start) != at:
                if held:
                    yield _close(held)
                at, held, rel = (file, start), [], 0
            chunk = value.as_py()
            found = parse(chunk) or {}
            span = len(chunk) + len(MAGIC)
            held.append({"file": file, "split": start, "size": size, "rel": rel, "span": span, "succ": rel + found["end"] if found else None, **{k: found.get(k) for k in FIELDS}})
            rel += span
    if held:
        yield _close(held)


def scan(spark, path: str) -> DataFrame:
    """Chunks between version lines, as bytes, with file, split and file size; one split's rows in order."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Mark the candidates of one split on the chain from its entry."""
    rows = rows.sort_values("offset")
    entry = rows["entry"].dropna()
    here, marked = (int(entry.iloc[0]) if len(entry) else -1), []
    for offset, succ in zip(rows["offset"], rows["succ_at"], strict=True):
        marked.append(offset == here)
        if offset == here:
            here = -1 if pd.isna(succ) else int(succ)
    return rows.assign(reached=marked)[["file", "split", "offset", "reached"]]


def read_archives(spark, path: str, stage: Stage | None = None) -> DataFrame:
    """Records of all archives under ``path``: file, offset, type, name, refers, uri, bytes, digest.

    Only records on the chain from offset 0 are returned. Revisits have the length and digest of the payload that they refer to.
    A file that breaks off gives the records before the break. No files, or empty ones, give no rows.
    """
    stage = stage or Stage(spark, "warc")
    kinds = "file string, split bigint, size bigint, rel bigint, span bigint, succ bigint, exit bigint, type string, name string, refers string, uri string, whole boolean, bytes bigint, digest string"
    found = stage.table(scan(spark, path).mapInArrow(_candidates, kinds), "candidates")
    # splits are few: their lengths give where each one starts
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("file", "split").agg(F.sum("span").alias("length"))
    starts = starts.select("file", "split", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"))
    found = found.join(starts, ["file", "split"])
    offset = F.col("start") + F.col("rel") - len(MAGIC)
    found = found.withColumn("offset", offset).withColumn("succ_at", F.col("start") + F.col("succ")).withColumn("exit_at", F.col("start") + F.col("exit"))
    found = stage.table(found.filter("offset >= 0"), "offsets")  # what precedes the first version line is no candidate
    # entries: offset 0 and every offset at which a chain enters another split
    nodes = found.select("file", "offset", "split", "exit_at")
    goals = nodes.filter("exit_at is not null").select("file", F.col("exit_at").alias("offset")).distinct()
    roots = nodes.filter("offset = 0")
    entries = nodes.join(goals, ["file", "offset"], "left_semi").filter("offset > 0").unionByName(roots)
    jump = stage.table(entries.select("file", "offset", F.col("exit_at").alias("to")), "jump")
    reached, seen = stage.table(roots.select("file", "offset"), "reached"), 0
    while (n := reached.count()) > seen:
        seen = n
        more = reached.join(jump, ["file", "offset"]).filter("to is not null").select("file", F.col("to").alias("offset"))
        grown = stage.table(reached.unionByName(more).distinct(), "reached")
        twice = jump.join(jump.select("file", F.col("offset").alias("to"), F.col("to").alias("next")), ["file", "to"])
        doubled = stage.table(twice.select("file", "offset", F.col("next").alias("to")), "jump")
        stage.drop(reached, jump)
        reached, jump = grown, doubled
    entry = reached.withColumn("entry", F.col("offset"))
    chained = found.select("file", "split", "offset", "succ_at").join(entry, ["file", "offset"], "left")
    marks = chained.groupBy("file", "split").applyInPandas(_walk, "file string, split bigint, offset bigint, reached boolean")
    marks = stage.table(marks.filter("reached"), "marks").select("file", "offset")
    records = found.join(marks, ["file", "offset"])
    columns = ["file", "offset", "type", "name", "refers", "uri", "bytes", "digest"]
    broken = stage.table(records.filter("not whole").select("file", "offset", F.col("succ_at").alias("until")), "broken")
    whole = records.filter("whole").select(*columns)
    if not broken.head(1):
        return whole
    return whole.unionByName(_rejoined(spark, path, found, broken).select(*columns))


def _rejoined(spark, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds version lines: their chunks are read again from the files concerned and put together."""
    order = Window.partitionBy("file").orderBy("offset")
    b = broken.select("file", "offset", "until")
    near = found.join(broken.select("file").distinct(), "file", "left_semi").select("file", "split", "rel", "offset").join(b, ["file", "offset"], "left")
    near = near.withColumn("owner", F.last(F.when(F.col("until").isNotNull(), F.struct("offset", "until")), True).over(order))
    parts = near.filter("owner is not null and offset < owner.until").select("file", "split", "rel", "offset", F.col("owner.offset").alias("owner"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            rels = []
            for file, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (file, start) != at:
                    at, rel = (file, start), 0
                rels.append(rel)
                rel += len(value.as_buffer()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rels, pa.int64())], ["file", "split", "value", "rel"])

    again = scan(spark, path).select("file", "split", "value").mapInArrow(chunks, "file string, split bigint, value binary, rel bigint")
    again = again.join(parts, ["file", "split", "rel"]).groupBy("file", "owner")
    again = again.agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]).alias("values"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, owner, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = parse(MAGIC.join(values))
                if record and record["whole"]:
                    rows.append({"file": file, "offset": owner, **{k: record.get(k) for k in FIELDS if k != "whole"}})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(k, CANDIDATE.field(k).type) for k in FIELDS if k != "whole"]]))

    return again.mapInArrow(joined, "file string, offset bigint, type string, name string, refers string, uri string, bytes bigint, digest string")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "warc")
    path = stage.path("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, stage)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read_archives(spark, path, stage).select(
        whole(F.col("name")).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), whole(F.col("refers")).alias("refers_to")
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keep FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || digest[5 * i + 1:5 * i + 5])::INT) AS fives FROM g)
SELECT page_id, strlen(html) AS payload_bytes, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest
FROM d
"""
