"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Each task writes one archive of gzip members and returns an index row per record: file, offset, length, URL, digest. A
task that runs twice writes a second archive under another name; only the index of the attempt that counted names a file.
Reading takes any selection of index rows, sorts them by (file, offset), and fetches neighbouring records in one request.

Of records with equal payloads of at least `min_bytes` bytes, that with the largest id is the response and the others
revisit it. Defined cases: a null payload is empty; empty and short payloads are always responses; rows that repeat the
largest id are responses too; a null id is never the largest unless all ids are null; a null URL has no header; texts of
any length are written whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, stored

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def _record(page, url, payload: bytes, digest: str, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {a.decode(): b.decode() for a, _, b in (x.partition(b": ") for x in raw.split(b"\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """One decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    return {"page_id": number(h["WARC-Record-ID"]), "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-Refers-To")),
            "digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload,
            "payload_bytes": int(_headers(http)["Content-Length"])}


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Write one record per row and return the stored index."""
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    latest = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest") \
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select("digest", "latest")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    marked = rows.join(latest, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        from pyarrow import fs

        out = name = None
        at = 0
        for batch in batches:
            rows = batch.to_pylist()
            if rows and out is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            index = []
            for r in rows:
                raw = _record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                out.write(raw)
                index.append({"page_id": r["page_id"], "url": r["url"], "digest": r["digest"],
                              "record_type": "response" if r["refers_to"] is None else "revisit",
                              "refers_to": r["refers_to"], "file": f"{folder}/{name}", "offset": at, "length": len(raw)})
                at += len(raw)
            yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        if out is not None:
            out.close()

    return stored(marked.mapInArrow(run, INDEX), "warc-index")


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read(index: DataFrame, *, gap: int = 1 << 16, span: int = 1 << 23, payload: bool = True) -> DataFrame:
    """The records of the given index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Records at most `gap` bytes apart are fetched together, up to about `span` bytes a request. The digest of a response
    is taken anew from what was read; a record that doesn't match its index row ends the job with an error.
    """
    near = index.select("file", "offset", "length", "digest").repartition("file", F.expr("offset div 67108864")) \
        .sortWithinPartitions("file", "offset")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def requests(rows):
        group: list = []
        for r in rows:
            end = group[-1]["offset"] + group[-1]["length"] if group else 0
            if group and (r["file"] != group[0]["file"] or r["offset"] > end + gap
                          or r["offset"] + r["length"] - group[0]["offset"] > span):
                yield group
                group = []
            group.append(r)
        if group:
            yield group

    def run(batches):
        from pyarrow import fs

        name = source = None
        for batch in batches:
            for group in requests(batch.to_pylist()):
                if group[0]["file"] != name:
                    if source is not None:
                        source.close()
                    name = group[0]["file"]
                    store, path = fs.FileSystem.from_uri(name)
                    source = store.open_input_file(path)
                first = group[0]["offset"]
                raw = source.read_at(group[-1]["offset"] + group[-1]["length"] - first, first)
                out = []
                for r in group:
                    x = parse(zlib.decompress(raw[r["offset"] - first: r["offset"] - first + r["length"]], 31))
                    digest = hashlib.sha1(x["payload"]).hexdigest() if x["record_type"] == "response" else x["digest"]
                    if digest != r["digest"]:
                        raise ValueError(f"{name} at {r['offset']}: the record is not the one in the index")
                    out.append({**x, "payload_digest": digest})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([kinds[n] for n in names]))

    kinds = {f.name: f for f in (pa.field("page_id", pa.int64()), pa.field("payload_bytes", pa.int64()),
                                 pa.field("payload_digest", pa.string()), pa.field("record_type", pa.string()),
                                 pa.field("refers_to", pa.int64()), pa.field("payload", pa.binary()))}
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return near.mapInArrow(run, schema + (", payload binary" if payload else ""))
