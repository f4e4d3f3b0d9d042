"""Legacy web archives (ARC, versions 1 and 2) converted to WARC 1.1, with repeated payloads as revisits.

An ARC record is a header line, whose fields depend on the version that the file's first record declares,
and as many bytes as the line's last field says. The converter makes what a WARC record needs and ARC does
not have: an identifier (from file and place, so a repeated task makes the same one), a time in ISO form,
a record type, and SHA-1 digests of block and payload.

Archives are gzip files, written by Spark's text writer: a record is one value, and the line separator is
what the format puts after a record. They are read as lines in the order of the file, so that a task holds
one record at a time whatever the size of the archive, on any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.functions.durable import durable, new_folder
from prioscope.functions.ordering import broadcast_if_bounded

#: Fixed values of the formats: fields of a header line by version, and the profile of a revisit.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"
#: Columns of whole numbers that may be null.
NUMBERS = {"page_id", "payload_bytes"}
#: The HTTP header that carries a row's id.
ID_HEADER = "X-Page-Id"
#: The namespace of synthesised identifiers.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class ArchiveConfig:
    """``date`` is the 14-digit time of pages that have none, ``version`` the ARC version, None for both in turn.

    Payloads of at least ``least`` bytes that occur again become revisits. ``compression`` is the level by its
    name in Hadoop's codec.
    """

    date: str = "20000101000000"
    version: int | None = None
    least: int = 0
    compression: str = "BEST_SPEED"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_time(date: str) -> str:
    """An ARC date of 4 to 14 digits as a time; parts that are missing or impossible are the first of their kind."""
    digits = (re.match(r"\d*", date)[0] + "00000000000000")[:14]
    parts = [int(digits[:4]), *(int(digits[k : k + 2]) for k in range(4, 14, 2))]
    try:
        year, month, day = max(parts[0], 1), max(parts[1], 1), max(parts[2], 1)
        made = datetime(year, month, day, *parts[3:], tzinfo=UTC)
    except ValueError:
        made = datetime(max(parts[0], 1), 1, 1, tzinfo=UTC)
    return made.strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


def plain_uri(url: str | None) -> str:
    """The url without characters that would end a header's field; ``about:blank`` for none."""
    out = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return out or "about:blank"


# ------------------------------------------------------------------ reading
class Lines:
    """An archive's bytes, given line by line: a line, or a number of bytes, at a time."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.rest, self.at = lines, b"", 0

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        out = self.rest or next(self.lines, None)
        self.rest = b""
        if out is not None:
            self.at += len(out)
            out = out.removesuffix(b"\n").removesuffix(b"\r")
        return out

    def filled(self) -> bytes | None:
        """The next line that is not empty."""
        while (out := self.line()) == b"":
            pass
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end of the archive."""
        parts, have = [], 0
        while have < n and (part := self.rest or next(self.lines, b"")):
            self.rest = part[n - have :]
            parts.append(part[: n - have])
            have += len(parts[-1])
        self.at += have
        return b"".join(parts)


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows as frames of about ``most`` bytes each, whose first column is their size; one at least."""
    out, size = [], 0
    for own, *row in rows:
        out.append(row)
        size += own + 200
        if size > most:
            yield pd.DataFrame(out, columns=columns).astype(dict.fromkeys(NUMBERS.intersection(columns), "Int64"))
            out, size = [], 0
    yield pd.DataFrame(out, columns=columns).astype(dict.fromkeys(NUMBERS.intersection(columns), "Int64"))


def _by_file(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Lines]]:
    """(file name, its lines) of each archive of a task; lines get the end back that the reader took."""
    rows = (r for b in batches for r in zip(b["file"].tolist(), b["line"].tolist(), strict=True))
    for name, lines in groupby(rows, itemgetter(0)):
        yield name, Lines(line + b"\n" for _, line in lines)


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the gzip archives in ``path``: one task a file, as gzip is not split, so lines keep their order."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("line"))


@dataclass
class ArcRecord:
    """A record of an ARC file; ``fields`` are those of its version's header line."""

    file: str
    at: int
    version: int
    fields: dict[str, str]
    block: bytes
    whole: bool  # whether all declared bytes were there


def arc_records(name: str, lines: Lines) -> Iterator[ArcRecord]:
    """Records of one ARC file. The first, ``filedesc:``, declares the version in its first line.

    Urls may hold blanks, so fields are counted from the right. A header line that does not fit the version
    stops the conversion with its file and place.
    """
    version = 0
    while (line := lines.filled()) is not None:
        at = lines.at
        text = line.decode("utf-8", "replace")
        parts = text.split(" ")
        if not version:
            # the version block's own line has the fields of its version, so try the longer form first
            version = 2 if len(parts) >= len(ARC_FIELDS[2]) else 1
        names = ARC_FIELDS[version]
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"Not an ARC header of version {version} in {name} at byte {at}: {text[:200]!r}")
        values = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        fields = dict(zip(names, values, strict=True))
        block = lines.take(int(fields["length"]))
        if fields["url"].startswith("filedesc:"):
            declared = block.split(b" ", 1)[0]
            if declared not in (b"1", b"2"):
                raise ValueError(f"Unknown ARC version {declared[:20]!r} in {name}")
            version = int(declared)
        yield ArcRecord(name, at, version, fields, block, len(block) == int(fields["length"]))


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its empty line, payload) of an HTTP response; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def page_of(head: bytes) -> int | None:
    """The row's id, where the archive has one."""
    page = header(head, ID_HEADER) or ""
    return int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) else None


# --------------------------------------------------------------- conversion
def warc_fields(record: ArcRecord) -> dict[str, str]:
    """The fields of the equivalent WARC record, but for what makes it a revisit. Types: response of an HTTP
    answer, warcinfo of the version block, else resource (such as ``dns:``)."""
    http = http_parts(record.block)
    info = record.fields["url"].startswith("filedesc:")
    fields = {
        "WARC-Type": "warcinfo" if info else "response" if http else "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record.file}#{record.at}')}>",
        "WARC-Date": iso_time(record.fields["date"]),
    }
    if info:
        fields["WARC-Filename"] = plain_uri(record.fields["url"].removeprefix("filedesc://"))
    else:
        fields["WARC-Target-URI"] = plain_uri(record.fields["url"])
        if re.fullmatch(r"[0-9A-Fa-f.:]{2,45}", record.fields["ip"]) and record.fields["ip"] != "0.0.0.0":
            fields["WARC-IP-Address"] = record.fields["ip"]
        fields["WARC-Payload-Digest"] = f"sha1:{digest(http[1] if http else record.block)}"
    if not record.whole:
        fields["WARC-Truncated"] = "unspecified"
    kind = record.fields["mime"] if re.fullmatch(r"[\w.+-]+/[\w.+-]+", record.fields["mime"]) else "application/octet-stream"
    fields["Content-Type"] = "application/http;msgtype=response" if http else kind
    return fields


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """The record without the two line ends that follow it."""
    last = {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (fields | last).items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def _write(df: DataFrame, path: str, end: str, config: ArchiveConfig) -> None:
    options = {"lineSep": end, "compression": "gzip", "zlib.compress.level": config.compression}
    df.selectExpr("cast(record as string) as value").write.options(**options).text(path)


def write_arc(pages: DataFrame, path: str, config: ArchiveConfig = ArchiveConfig()) -> None:
    """Write (page_id, url, html) as ARC archives, one for each partition, each page as an HTTP response.

    A null html is an empty payload, a null or empty url ``about:blank``, a null id has no header.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        version = config.version or 1 + number % 2

        def record(url: str, mime: str, status: str, block: bytes) -> bytes:
            more = f" {status} {digest(block)} - 0 part-{number}" if version == 2 else ""
            return f"{url} 0.0.0.0 {config.date} {mime}{more} {len(block)}\n".encode() + block

        first: list[bytes] = [record(f"filedesc://part-{number}", "text/plain", "200", f"{version} 0 pages\n{ARC_TITLES[version]}\n".encode())]
        for batch in batches:
            out = []
            for page, url, html in zip(batch["page_id"].tolist(), batch["url"].tolist(), batch["html"].tolist(), strict=True):
                own = "" if page is None else f"{ID_HEADER}: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html or b'')}\r\n\r\n"
                out.append(record(plain_uri(url), "text/html", "200", head.encode() + (html or b"")))
            yield pd.DataFrame({"record": first + out})
            first = []

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    _write(rows.mapInPandas(write, "record binary"), path, "\n", config)


def convert(spark: SparkSession, arc: str, warc: str, config: ArchiveConfig = ArchiveConfig()) -> None:
    """Convert the ARC archives in ``arc`` to WARC archives in ``warc``, file by file.

    Archives are read twice: first for identifiers and digests alone, which say what repeats; then each
    record is written, with what it repeats joined to it. Of equal payloads the one with the largest id is
    the response (of equal ids, and of records without, the smallest identifier), all others revisit it.
    Payloads are not shuffled, unless revisits are too many for a broadcast.
    """

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for name, lines in _by_file(batches):
                for record in arc_records(name, lines):
                    http = http_parts(record.block)
                    if http and len(http[1]) >= config.least:
                        fields = warc_fields(record)
                        yield (
                            0, fields["WARC-Record-ID"], page_of(http[0]), digest(http[1]), len(http[1]),
                            fields["WARC-Target-URI"], fields["WARC-Date"],
                        )

        return _frames(rows(), ["own", "page_id", "sha1", "payload_bytes", "uri", "date"])

    known = durable(archive_lines(spark, arc).mapInPandas(
        facts, "own string, page_id long, sha1 string, payload_bytes long, uri string, date string"
    ))
    rank = F.struct(F.col("page_id").isNull().alias("none"), (-F.col("page_id")).alias("less"), F.col("own").alias("to"))
    first = durable(
        known.groupBy("sha1", "payload_bytes").agg(
            F.min(F.struct(rank.alias("rank"), F.col("uri").alias("to_uri"), F.col("date").alias("to_date"))).alias("first"),
            F.count(F.lit(1)).alias("n"),
        ).filter("n > 1").select("sha1", "payload_bytes", "first.rank.to", "first.to_uri", "first.to_date")
    )
    revisits = durable(
        known.select("own", "sha1", "payload_bytes").join(first, ["sha1", "payload_bytes"])
        .filter("own != to").drop("sha1", "payload_bytes")
    )

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for name, lines in _by_file(batches):
                for record in arc_records(name, lines):
                    fields = warc_fields(record)
                    head, payload = http_parts(record.block) or (record.block, b"")
                    made = "\r\n".join(f"{k}: {v}" for k, v in fields.items())
                    yield len(record.block), fields["WARC-Record-ID"], made, head, payload

        return _frames(rows(), ["id", "fields", "head", "payload"])

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for made, head, payload, to, uri, date in zip(
                *(batch[c].tolist() for c in ("fields", "head", "payload", "to", "to_uri", "to_date")), strict=True
            ):
                fields = dict(line.split(": ", 1) for line in made.split("\r\n"))
                if to is not None:
                    fields |= {
                        "WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": to,
                        "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date,
                    }
                    payload = b""
                out.append(warc_record(fields, head + payload))
            yield pd.DataFrame({"record": out})

    parsed = archive_lines(spark, arc).mapInPandas(
        records, "id string, fields string, head binary, payload binary"
    )
    joined = parsed.join(broadcast_if_bounded(revisits), F.col("id") == F.col("own"), "left")
    _write(joined.mapInPandas(written, "record binary"), warc, WARC_END, config)


# -------------------------------------------------------------- WARC, again
def warc_records(name: str, lines: Lines) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-cased name, block) of each record of one WARC file."""
    while (line := lines.filled()) is not None:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"Not a WARC header in {name} at byte {lines.at}: {line[:200]!r}")
        fields: dict[str, str] = {}
        while line := lines.line():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, lines.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target_uri, date, page_id, payload, payload_bytes, payload_digest, refers_to_id of every record but warcinfo.

    Digests of responses and resources are counted from what was read, and must be those declared; a
    revisit has the declared one, and neither payload nor size.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for name, lines in _by_file(batches):
            for fields, block in warc_records(name, lines):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_parts(block) or (b"", block)
                declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                found = declared if kind == "revisit" else digest(payload)
                if declared not in (None, found):
                    raise ValueError(f"The payload of {fields['warc-record-id']} in {name} is not the one declared")
                yield (
                    len(payload), fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields.get("warc-date"),
                    page_of(head), None if kind == "revisit" else payload, None if kind == "revisit" else len(payload),
                    found, fields.get("warc-refers-to"),
                )

    columns = [
        "record_id string", "record_type string", "target_uri string", "date string", "page_id long", "payload binary",
        "payload_bytes long", "payload_digest string", "refers_to_id string",
    ]
    names = [c.split()[0] for c in columns]
    return archive_lines(spark, path).mapInPandas(lambda batches: _frames(rows(batches), names), ", ".join(columns))


def archived(pages: DataFrame, config: ArchiveConfig = ArchiveConfig()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of ``pages`` (page_id, url, html).

    Pages are written as ARC archives, converted, and read back from the WARC archives. A null html is the
    empty payload, which repeats like any other; repeated rows and ids are a record each, of which one is the
    response; a null id stays null, and comes last for being the response; an empty table gives no rows.
    Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = new_folder(spark)
    write_arc(pages, f"{folder}/arc", config)
    convert(spark, f"{folder}/arc", f"{folder}/warc", config)
    records = durable(read_warc(spark, f"{folder}/warc").drop("payload"))
    again = records.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to_id")
    whole = records.filter("record_type = 'response'")
    to = whole.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(
        again.join(to, F.col("refers_to_id") == F.col("to")).select(*columns)
    )
