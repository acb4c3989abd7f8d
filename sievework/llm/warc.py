"""Dictionary-compressed WARC archives (.warc.zst).

An archive starts with a skippable frame that holds a Zstandard dictionary, built from the archive's own records;
after it each record is a Zstandard frame of its own, compressed with that dictionary. Archives go to the shared
folder through ``pyarrow.fs``, under a temporary name first, so a task that is run again, or twice, leaves whole
files only; the manifest names the files of the attempt that counted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: the magic number of the skippable frame, and the revisit profile of WARC 1.1.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 16 << 10
#: The dictionary is trained on this many bytes of an archive's records, spread over it.
SAMPLE_BYTES = 2 << 20
REVISIT_LEAST = 1000


def label_revisits(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, url, payload (binary), digest, record_type and refers_to for each row of (page_id, url, html).

    A null html is an empty payload. Of equal payloads of ``least`` bytes or more the largest page_id is the
    response (each row of it, if that row is repeated). A null page_id is smaller than any other. An empty table gives
    no rows; other columns are not read. Shorter records can't match, so they go through the join under keys of their own,
    spread over all tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("long_enough", F.octet_length("payload") >= least)
    # A group of copies of any size comes down to one row for each task before the shuffle.
    groups = rows.where("long_enough").groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # no digest
    found = rows.withColumn("key", F.when(F.col("long_enough"), F.col("digest")).otherwise(alone)).join(groups.select(F.col("digest").alias("key"), "response"), "key", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return found.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, sha1_hex: str, kind: str, refers_to) -> bytes:
    """One WARC 1.1 record. A revisit has the response's HTTP head, with its Content-Length, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%-._~"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from a bounded share of the records; None if they are too few or too short for one."""
    total = sum(map(len, records))
    part = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[:16384] for r in records[::part]]
    while samples:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=256, d=8)
        except zstandard.ZstdError:
            if len(samples) >= 64 or sum(map(len, samples)) < 2048:
                return None
            samples = [s[i : i + 512] for s in samples for i in range(0, len(s), 512)]  # a few long records: their pieces
            if len(samples) < 64:
                return None
    return None


def archive(records: list[bytes], level: int = 3) -> bytes:
    out = io.BytesIO()
    words = trained(records)
    if words is not None:
        body = words.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    press = zstandard.ZstdCompressor(level=level, dict_data=words) if words is not None else zstandard.ZstdCompressor(level=level)
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def _file(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def write_archives(labelled: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of label_revisits as archives below folder; returns the manifest (path, records, bytes)."""

    def save(records: list[bytes]) -> dict:
        body, name = archive(records), f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = _file(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path + ".part", compression=None) as f:
            f.write(body)
        fs.move(path + ".part", path)
        return {"path": name, "records": len(records), "bytes": len(body)}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for page_id, url, payload, digest, kind, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["record_type"], pdf["refers_to"]):
                whole = [None if pd.isna(x) else int(x) for x in (page_id, refers)]
                held.append(record(whole[0], url, bytes(payload), digest, kind, whole[1]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame([save(held)])
                    held, size = [], 0
        if held:
            yield pd.DataFrame([save(held)])

    as_text = labelled.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    manifest = as_text.mapInPandas(task, "path string, records long, bytes long")
    return common.written(manifest, "manifest")


def parse(raw: bytes) -> dict:
    """A record's fields. Raises ValueError if a response's payload does not have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda x: x[len("<urn:page:") : -1] or None
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": urllib.parse.unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def records_of(uri: str) -> Iterator[bytes]:
    """The records of an archive one by one, read in small blocks."""
    fs, path = _file(uri)
    with fs.open_input_stream(path, compression=None) as f:
        head, words = f.read(8), None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
            words, head = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0])), b""
        engine = zstandard.ZstdDecompressor(dict_data=words) if words is not None else zstandard.ZstdDecompressor()
        left = head
        frame, parts = engine.decompressobj(), []
        while left or (left := f.read(1 << 18)):
            parts.append(frame.decompress(left))
            left = b""
            if frame.eof:
                yield b"".join(parts)
                left, parts = frame.unused_data, []
                frame = engine.decompressobj()


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives that the manifest names; payload is null for revisits."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows, size = [], 0
                for raw in records_of(path):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    schema = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    read = manifest.select("path").repartition(n).mapInPandas(task, schema)
    return read.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = label_revisits(common.table(spark, sf_dir, "pages"))
    manifest = write_archives(labelled, common.new_place(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
q as (select page_id, octet_length(body) as n, sha1(body) as digest from p),
g as (select digest, max(page_id) as response, count(*) as n from q where n >= {REVISIT_LEAST} group by 1 having count(*) > 1)
select q.page_id, q.n::bigint as payload_bytes, q.digest as payload_digest,
       case when g.response is not null and g.response <> q.page_id then 'revisit' else 'response' end as record_type,
       case when g.response <> q.page_id then g.response end as refers_to
from q left join g on q.digest = g.digest and q.n >= {REVISIT_LEAST}
"""
