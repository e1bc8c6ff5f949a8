"""WARC archives: writing with revisit records, and reading in byte ranges.

Writing: among records with equal payloads of at least ``min_revisit`` bytes the one
with the largest id is a response, the others revisit it.  Each task writes one file.

Reading: files are cut into ranges.  A task takes every place in its range that looks
like a record head as a candidate and emits where that record would end.  Chains
inside a range are followed at once, so a candidate points to the first place beyond
its range.  Starting at byte 0 of each file, pointer doubling over these links (as
many rounds as the logarithm of the ranges in a file) finds the reachable entries of
each range; heads inside payloads are never reached.  The entries are then read.

Nulls: a null payload is empty, a null url is left out, a null id is written empty and
read as null (it never wins over an id; if all are null, all are responses).  Rows
that repeat the winning id are responses too.  Empty tables give empty results.
"""

import hashlib
import itertools
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from .common import fresh_dir, partitions, stage
from .token_files import filesystem

MAGIC = b"WARC/1.1\r\n"
READ_ON = 1 << 16  # first step of reading on behind a range
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages, id_col="page_id", payload_col="html", min_revisit=1000):
    """Adds ``digest`` (SHA-1) and ``refers_to`` (null for responses)."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.withColumn("digest", F.sha1(body))
    groups = (
        rows.filter(F.octet_length(body) >= min_revisit)
        .groupBy("digest")
        .agg(F.max(id_col).alias("winner"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and winner is not null")
        .select("digest", "winner")
    )
    # Staged, so that the planner knows its size and broadcasts it only below its threshold.
    groups = stage(groups, "warc-groups")
    return rows.join(groups, "digest", "left").withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("winner")), F.col("winner"))).drop("winner")


def record(page_id, url, payload, digest, refers_to, date):
    """One record's bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = "" if page_id is None else page_id
    head = [
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http if refers_to is not None else http + payload
    return MAGIC + "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages, id_col="page_id", url_col="url", payload_col="html", min_revisit=1000, date="2024-01-01T00:00:00Z"):
    """Write the archives; returns their table (``path``, ``size``, ``records``)."""
    spark = pages.sparkSession
    root = fresh_dir(spark, "warc")
    picked = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    marked = roles(picked, "page_id", "html", min_revisit).select("page_id", "url", "html", "digest", "refers_to")

    def write(batches):
        fs, path = filesystem(root)
        fs.create_dir(path, recursive=True)
        name, size, n = f"{uuid.uuid4().hex}.warc", 0, 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*batch.columns):
                    raw = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers_to.as_py(), date)
                    out.write(raw)
                    size, n = size + len(raw), n + 1
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})
        else:
            fs.delete_file(f"{path}/{name}")

    files = stage(marked.mapInArrow(write, "name string, size bigint, records bigint"), "warc-files")
    return files.select(F.concat(F.lit(root + "/"), F.col("name")).alias("path"), "size", "records")


class Incomplete(Exception):
    """The head does not end within what was read."""


def parse_head(raw, at):
    """(fields, start of the block, start of the next record), or None if no head is there.
    ``raw[at:]`` starts with the magic bytes; heads may have any length."""
    fields, line = {}, at + len(MAGIC)
    while True:
        end = raw.find(b"\r\n", line)
        if end < 0:
            raise Incomplete
        if end == line:
            break
        key, colon, val = raw[line:end].partition(b":")
        if not colon:
            return None
        fields[key.strip().lower()] = val.strip()
        line = end + 2
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    return fields, end + 2, end + 2 + int(length) + 4


class Lines:
    """The header lines from ``first`` to the blank line behind them, each read once: what decides
    for any of their starts whether a head may begin there."""

    def __init__(self, raw, first):
        self.first, line = first, first
        self.bad = self.typed = self.sized = -1  # starts of the last lines of these kinds
        self.length = b""
        while True:
            end = raw.find(b"\r\n", line)
            if end < 0:
                raise Incomplete
            if end == line:
                break
            key, colon, val = raw[line:end].partition(b":")
            key = key.strip().lower()
            if not colon:
                self.bad = line
            elif key == b"content-length":
                self.sized, self.length = line, val.strip()
            elif key == b"warc-type":
                self.typed = line
            line = end + 2
        self.end = line

    def next_record(self, line):
        """Where the record ends whose header lines start at ``line``; None if none does."""
        if self.bad >= line or self.sized < line or self.typed < line or not self.length.isdigit():
            return None
        return self.end + 2 + int(self.length) + 4


def candidates(raw, start, stop, base, more=lambda: b""):
    """{offset: successor} of what looks like a record head in [start, stop) of the file;
    ``raw`` begins at ``base``, and ``more()`` gives the bytes behind it (none at the end).
    Magics that share the blank line behind their headers share its lines, so a line is read
    once however many magics stand before it."""
    out, at, lines = {}, raw.find(MAGIC, start - base), None
    while 0 <= at < stop - base:
        line = at + len(MAGIC)
        try:
            if lines is None or not lines.first <= line <= lines.end:
                lines = Lines(raw, line)
            after = lines.next_record(line)
            if after is not None:
                out[base + at] = base + after
        except Incomplete:
            if next_bytes := more():
                raw += next_bytes
                continue
            break  # no blank line follows this magic, nor any later one
        at = raw.find(MAGIC, at + 1)
    return out


def links(files, chunk):
    """Candidates of all ranges: ``path``, ``size``, ``chunk``, ``at`` and ``exit``, the first
    place on its chain beyond the range."""

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start, stop = row["chunk"] * chunk, min((row["chunk"] + 1) * chunk, row["size"])
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    raw = f.read(min(stop + len(MAGIC), row["size"]) - start)
                    steps = itertools.count()
                    succ = candidates(raw, start, stop, start, lambda: f.read(READ_ON << next(steps)))
                exits = {}
                for at in sorted(succ, reverse=True):
                    exits[at] = exits.get(succ[at], succ[at])
                n = len(exits)
                if n:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "path": [row["path"]] * n,
                            "size": pa.array([row["size"]] * n, pa.int64()),
                            "chunk": pa.array([row["chunk"]] * n, pa.int64()),
                            "at": pa.array(list(exits), pa.int64()),
                            "exit": pa.array(list(exits.values()), pa.int64()),
                        }
                    )

    ranges = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {chunk}"))).alias("chunk"))
    return ranges.repartition(partitions(files.sparkSession)).mapInArrow(scan, "path string, size bigint, chunk bigint, at bigint, exit bigint")


def entries(files, chunk):
    """The first true record of each range that holds one: ``path``, ``size``, ``chunk``, ``at``."""
    found = stage(links(files, chunk), "warc-candidates")
    targets = found.select("path", F.col("exit").alias("at")).distinct()
    entry = found.filter("at = 0").unionByName(found.filter("at > 0").join(targets, ["path", "at"], "left_semi"))
    jump = stage(entry.select("path", "size", "chunk", "at", "exit"), "warc-jumps")
    reached = jump.filter("at = 0")
    most = files.agg(F.max(F.expr(f"(size - 1) div {chunk} + 1"))).first()[0] or 1
    hop = jump.select("path", "at", "exit")
    for _ in range(max(1, most - 1).bit_length() if most > 1 else 0):
        step = reached.join(hop.select("path", "at", F.col("exit").alias("to")), ["path", "at"]).select("path", F.col("to").alias("at"))
        more = jump.join(step.distinct(), ["path", "at"], "left_semi")
        reached = stage(reached.unionByName(more).dropDuplicates(["path", "at"]), "warc-reached")
        hop = stage(hop.join(hop.select("path", F.col("at").alias("exit"), F.col("exit").alias("next")), ["path", "exit"]).select("path", "at", F.col("next").alias("exit")), "warc-hops")
    return reached.select("path", "size", "chunk", "at")


RECORDS = "path string, at bigint, record_type string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, url string, payload binary"


def read_warc(files, chunk=4 << 20, payloads=True):
    """One row a record that the chain from byte 0 reaches.  A response's digest and
    length come from its payload; a revisit's from its head.  ``payload`` is null for
    revisits, and everywhere with ``payloads=False``."""

    def urn(value):
        text = (value or b"").strip(b"<>").rpartition(b":")[2]
        return int(text) if text else None

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                stop, at = min((row["chunk"] + 1) * chunk, row["size"]), row["at"]
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    raw, base, out, held = f.read(stop - at), at, [], 0
                    while at < stop:
                        need = READ_ON + len(raw)
                        try:
                            head = parse_head(raw, at - base) if raw.startswith(MAGIC, at - base) else None
                            need = head[2] - len(raw) if head else need
                        except Incomplete:
                            head = None
                        if head is None or need > 0:
                            # Only a head or block that is cut off is read on for.
                            if base + len(raw) >= row["size"]:
                                raise ValueError(f"{path} is damaged at byte {at}")
                            raw, base = raw[at - base :], at
                            raw += f.read(need)
                            continue
                        fields, block, end = head
                        http = raw.find(b"\r\n\r\n", block, end) + 4
                        kind = fields[b"warc-type"].decode()
                        if kind == "response":
                            payload = raw[http : end - 4]
                            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                        else:
                            payload = None
                            digest = fields[b"warc-payload-digest"].rpartition(b":")[2].decode()
                            n = int(raw[block:http].lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                        url = fields.get(b"warc-target-uri")
                        out.append((row["path"], at, kind, urn(fields.get(b"warc-record-id")), urn(fields.get(b"warc-refers-to")), digest, n, url and url.decode(), payload if payloads else None))
                        held += len(payload or b"")
                        at = base + end
                        if held > 8 << 20:
                            yield batch_of(out)
                            out, held = [], 0
                    if out:
                        yield batch_of(out)

    def batch_of(rows):
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in RECORDS.split(", ")])

    return entries(files, chunk).repartition(partitions(files.sparkSession)).mapInArrow(read, RECORDS)
