"""Raw messages to rows: byte parsing in Arrow-batched Python, everything after it in Catalyst."""

from __future__ import annotations

import email
import email.policy
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.runtime import ship

PARSED = (
    "path string, block long, ord long, msg_id string, size long, subject string, from_address string, to_address string, reply_to string, date_raw string, "
    "message_id string, text string, html string, attachments array<struct<filename:string,content_type:string,size:long,sha256:string>>, "
    "return_path string, headers array<struct<name:string,value:string>>, error string"
)


def read_mail(spark: SparkSession, path: str, limit: int = 64 << 20) -> DataFrame:
    """path, block, ord, content, length of each message of the .eml and .mbox files under a folder.

    A mailbox of any size is cut at its ``From `` lines by the splittable text reader, so that its messages spread over
    tasks; block is the place of the part of the file that a message was read in, and ord rises within a block. A single
    message over ``limit`` bytes has no content and becomes an error row; the others of its mailbox are read.
    """
    inside = spark.read.option("recursiveFileLookup", "true")
    single = inside.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    single = single.select("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("ord"), "content", "length")
    boxes = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mbox").option("lineSep", "\nFrom ").text(path)
    raw = F.col("value").cast("binary")
    boxes = boxes.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), raw.alias("raw"))
    # Each part begins with the rest of its separator line.
    body = F.when(F.expr("position(X'0A' IN raw)") > 0, F.expr("substring(raw, position(X'0A' IN raw) + 1)")).otherwise(F.lit(b""))
    boxes = boxes.where(F.length("raw") > 0).withColumn("content", body).select("path", "block", "ord", "content", F.length("content").cast("long").alias("length"))
    return single.unionByName(boxes).withColumn("content", F.when(F.col("length") <= limit, F.col("content")))


def numbered(mail: DataFrame) -> DataFrame:
    """mail with ``number``, a message's place in its file from 1, and ``label``, path#number."""
    number = F.row_number().over(Window.partitionBy("path").orderBy("block", "ord"))
    return mail.withColumn("number", number).withColumn("label", F.concat_ws("#", "path", F.col("number").cast("string")))


def kind_of(content: Column) -> Column:
    """msg for an Outlook container, eml for at least two header lines in the first 4 KB, else empty."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    lines = F.regexp_count(head, F.lit(r"(?m)^[A-Za-z][A-Za-z0-9-]*:[ \t]"))
    return F.when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", F.lit("msg")).when(lines >= 2, F.lit("eml")).otherwise(F.lit(""))


def split_mbox(data: bytes) -> list[bytes]:
    """Messages of an mbox: each line that starts with ``From `` opens one; the empty line before it is dropped."""
    out: list[list[bytes]] = []
    for line in data.splitlines(keepends=True):
        if line.startswith(b"From "):
            if out and out[-1] and not out[-1][-1].strip():
                out[-1].pop()
            out.append([])
        elif out:
            out[-1].append(line)
    return [b"".join(m) for m in out]


def header_text(message: email.message.EmailMessage, name: str, value: object) -> str:
    """A header's value unfolded; one of the authentication headers is decoded, and kept as written if that fails."""
    raw = str(value).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    if name.lower() in ("authentication-results", "received-spf"):
        try:
            raw = str(message.policy.header_fetch_parse(name, value))
        except Exception:  # a broken header must not lose the others
            pass
    return " ".join(raw.split())


def attached(part: email.message.EmailMessage) -> bool:
    """Whether a part is a file; nameless text and HTML are the message's body."""
    return part.get_content_type() not in ("text/plain", "text/html") or bool(part.get_filename())


def parse_message(raw: bytes) -> dict:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = {"plain": None, "html": None}
    files = []
    for part in message.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if not attached(part):
            kind = part.get_content_subtype()
            body[kind] = (body[kind] or "") + str(part.get_content())
        else:
            data = part.get_payload(decode=True) or b""
            files.append({"filename": name, "content_type": part.get_content_type(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    headers = [{"name": name, "value": header_text(message, name, value)} for name, value in message.raw_items()]
    header = lambda name: None if message[name] is None else str(message[name])
    address = lambda name: email.utils.parseaddr(header(name) or "")[1].lower() or None
    return {"subject": header("Subject"), "from_address": address("From"), "to_address": address("To"), "reply_to": address("Reply-To"), "date_raw": header("Date"), "message_id": header("Message-ID"), "text": body["plain"], "html": body["html"], "attachments": files, "return_path": address("Return-Path"), "headers": headers}


def read_attachments(files: DataFrame) -> DataFrame:
    """msg_id, part_no, filename, content_type, content of what ``parse_message`` lists as attachments, for ``archives.expand``.

    Messages that can't be parsed have none; ``parse_mail`` has a row with the error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("msg_id string, part_no int, filename string, content_type string, content binary")
    arrow = to_arrow_schema(schema)

    def held(raw: bytes) -> Iterator[dict]:
        try:
            parts = [p for p in email.message_from_bytes(raw, policy=email.policy.default).walk() if not p.is_multipart() and attached(p)]
            for number, part in enumerate(parts):
                yield {"msg_id": hashlib.sha256(raw).hexdigest(), "part_no": number, "filename": part.get_filename(), "content_type": part.get_content_type(), "content": part.get_payload(decode=True) or b""}
        except Exception:  # as in parse_mail
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_pylist([] if raw is None else list(held(raw)), schema=arrow)

    ship(files.sparkSession)
    return files.select("content").mapInArrow(run, schema)


def parse_mail(files: DataFrame) -> DataFrame:
    """One row for each message of ``read_mail``; a message that can't be parsed is a row with an error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PARSED)
    arrow = to_arrow_schema(schema)

    def parsed(row: dict) -> dict:
        raw = row.pop("content")
        base = dict.fromkeys(schema.names) | {"path": row["path"], "block": row["block"], "ord": row["ord"], "size": row["length"]}
        if raw is None:
            return base | {"error": "too large"}
        base["msg_id"] = hashlib.sha256(raw).hexdigest()
        try:
            return base | parse_message(raw)
        except Exception as problem:  # any broken message is a row and no failure of the job
            return base | {"error": f"{type(problem).__name__}: {problem}"[:200]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                yield pa.RecordBatch.from_pylist([parsed(row) for row in batch.slice(i, 32).to_pylist()], schema=arrow)

    ship(files.sparkSession)
    return files.select("path", "block", "ord", "content", "length").mapInArrow(run, schema)
