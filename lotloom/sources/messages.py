"""Messages out of files: pushed JSON records and .eml files, as rows or as a stream."""

from __future__ import annotations

import email
import email.policy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import ship

#: What a pushed message holds; other fields are ignored.
MESSAGE = (
    "tenant_id string, message_id string, from_address string, subject string, body_text string, body_html string, received_at timestamp, "
    "attachments array<struct<filename string, mime_type string, content_base64 string>>"
)


def pushed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON messages, one a line, of a folder; as a stream each new file is a batch. Broken lines are left out."""
    reader = (spark.readStream if stream else spark.read).schema(MESSAGE).option("mode", "DROPMALFORMED")
    return reader.json(path)


def eml_messages(files: DataFrame) -> DataFrame:
    """(path, message_id, from_address, subject, body_text, body_html, attachments) of .eml files (path, content), as Spark's
    binaryFile source gives them. Attachments are name and bytes. A file that cannot be read gives nulls and no attachments.
    """
    ship(files.sparkSession)

    def text(message, kind: str) -> str | None:
        part = message.get_body(preferencelist=(kind,))
        return None if part is None else part.get_content()

    def read(batches):
        names = ["message_id", "from_address", "subject", "body_text", "body_html", "attachments"]
        kinds = [*[pa.string()] * 5, pa.list_(pa.struct([("filename", pa.string()), ("data", pa.binary())]))]
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    m = email.message_from_bytes(data or b"", policy=email.policy.default)
                    files_ = [{"filename": p.get_filename(), "data": p.get_payload(decode=True)} for p in m.iter_attachments() if p.get_filename()]
                    rows.append((m["Message-ID"] and str(m["Message-ID"]), m["From"] and str(m["From"]), m["Subject"] and str(m["Subject"]), text(m, "plain"), text(m, "html"), files_))
                except (ValueError, LookupError, AttributeError):
                    rows.append((None, None, None, None, None, []))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["path", *names])

    return files.select("path", "content").mapInArrow(read, "path string, message_id string, from_address string, subject string, body_text string, body_html string, attachments array<struct<filename:string,data:binary>>")
