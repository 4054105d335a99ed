"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Reading trusts no magic by itself, as payloads may hold it. Tasks scan byte ranges of the archives, take every record
header that parses as a candidate, and emit the offset of its would-be successor; within its range each candidate is
followed by pointer jumping to the offset where its chain leaves the range. Spark then jumps from the start of each
file along these exits, doubling the distance each round, and keeps only the entries that are reachable; a last pass
walks each range from its entry and reads the records.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import new_path, stash, table

MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
#: Least bytes of a payload that is written once; bytes of a range that one task scans; bytes read beyond it at first; fixed date.
LEAST, RANGE, HEADER, DATE = 1000, 32 << 20, 1 << 16, "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n", re.M)


def record_kinds(pages: DataFrame, id_col: str = "page_id", least: int = LEAST) -> DataFrame:
    """``pages`` with digest, size, and ``response_id``: whom a row revisits (null: it is a response itself)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload).cast("long"))
    once = marked.where(F.col("size") >= least).groupBy(F.col("digest").alias("same"), F.col("size").alias("same_size"))
    # Only digests that come twice: small as a rule, then Catalyst broadcasts them; else it joins by shuffle and splits hot ones.
    kept = stash(once.agg(F.max(id_col).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    joined = marked.join(kept, (F.col("digest") == F.col("same")) & (F.col("size") == F.col("same_size")), "left")
    return joined.withColumn("response_id", F.when(F.col("keeper").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("same", "same_size", "keeper")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", least: int = LEAST, date: str = DATE) -> None:
    """A WARC record per row, in one archive per task, uncompressed. The CRLF pair that ends a record is the line separator."""
    rows = record_kinds(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col("html")), "id", least)
    revisit, crlf = F.col("response_id").isNotNull(), "\r\n"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit(""))))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(crlf))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("response_id"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(crlf),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END.decode()).text(path)


def _open(path: str):
    where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return where.open_input_file(name)


class _Held:
    """The bytes of an archive from ``begin`` on: ``size`` at first, and more where a header or a record goes on."""

    def __init__(self, f, begin: int, size: int):
        f.seek(begin)
        self.f, self.data, self.end = f, f.read(size), -1

    def reach(self, size: int) -> bool:
        """Holds ``size`` bytes at least, if there are so many."""
        parts, n = [self.data], len(self.data)
        while n < size and (more := self.f.read(size - n)):
            parts.append(more)
            n += len(more)
        if len(parts) > 1:
            self.data = b"".join(parts)
        return n >= size

    def find_end(self, at: int) -> int:
        """Where the first END from ``at`` on is, or the file's end; ``at`` doesn't fall from call to call."""
        if self.end < at:
            look = at
            while (end := self.data.find(END, look)) < 0:
                look, n = max(at, len(self.data) - len(END) + 1), len(self.data)
                self.reach(n + max(HEADER, n - at))  # twice as much each time
                if len(self.data) == n:
                    end = n
                    break
            self.end = end
        return self.end


def _header(held: _Held, at: int):
    """(fields, bytes of the header, bytes of the record) of what looks like a record at ``at``, or None."""
    if not held.data.startswith(MAGIC, at):
        return None
    end = held.find_end(at)
    data = held.data
    if end == len(data) or (end - at > HEADER and data.find(b"\r\n" + MAGIC, at, end) >= 0):  # no header has a line of magic
        return None
    fields = {k.lower(): v for k, v in FIELD.findall(data[at + len(MAGIC) : end + 2])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    head = end + len(END) - at
    return fields, head, head + int(length) + len(END)


def _scan(batches):
    """Candidates of each range with successor and exit: the first offset of their chain beyond the range."""
    for pdf in batches:
        for path, begin, end in zip(pdf["path"], pdf["begin"], pdf["end"]):
            with _open(path) as f:
                held, at, after = _Held(f, begin, end - begin + HEADER), [], []
                for m in re.finditer(re.escape(MAGIC), held.data):
                    if m.start() >= end - begin:
                        break
                    if found := _header(held, m.start()):
                        at.append(m.start())
                        after.append(m.start() + found[2])
            off, nxt = np.array(at, np.int64), np.array(after, np.int64)
            n = len(off)
            k = np.searchsorted(off, nxt)
            hit = (k < n) & (off[np.minimum(k, max(0, n - 1))] == nxt) if n else np.zeros(0, bool)
            last = np.where(hit, k, np.arange(n))  # pointer jumping to the last candidate of the chain in this range
            while n and (last[last] != last).any():
                last = last[last]
            yield pd.DataFrame({"path": path, "off": off + begin, "next": nxt + begin, "exit": nxt[last] + begin if n else off})


def _walk(batches):
    """The records of a range from its reachable entry on."""
    for pdf in batches:
        for path, entry, end in zip(pdf["path"], pdf["entry"], pdf["end"]):
            rows = []
            with _open(path) as f:
                held, at = _Held(f, entry, end - entry + HEADER), entry  # one read, but for what goes on beyond the range
                while at < end:
                    found = _header(held, at - entry)
                    if found is None:
                        break
                    fields, head, whole = found
                    held.reach(at - entry + whole)  # the last record of the range
                    data = held.data[at - entry : at - entry + whole]
                    cut = data.find(END, head)
                    payload = data[cut + len(END) : whole - len(END)] if cut >= 0 else b""
                    kind = fields[b"warc-type"].decode()
                    mine, digest = kind == "response", fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    number = lambda key: fields.get(key, b"").decode()[len("<urn:page:") : -1] or None  # noqa: E731, B023
                    rows.append((
                        path, at, number(b"warc-record-id"), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), kind, number(b"warc-refers-to"),
                        len(payload) if mine else int(fields.get(b"x-payload-length", b"0")), hashlib.sha1(payload).hexdigest() if mine else digest, digest,
                    ))
                    at += whole
            yield pd.DataFrame(rows, columns=["path", "off", "id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "said_digest"])


RECORD = "path string, off long, id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, said_digest string"


def candidates(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """(path, off, next, exit) of all that looks like a record in the archives at ``path``."""
    return _dealt(_ranges(spark, path, step), "begin").mapInPandas(_scan, "path string, off long, next long, exit long")


def _dealt(ranges: DataFrame, at: str) -> DataFrame:
    """About a task per range: the rows are tiny, what they stand for isn't, so their number must not be coalesced."""
    return ranges.repartition(max(1, min(20_000, ranges.count())), "path", at)


def _ranges(spark: SparkSession, path: str, step: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "length")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    return files.select("path", "length", begin.alias("begin")).withColumn("end", F.least("length", F.col("begin") + step))


def reachable(found: DataFrame, step: int = RANGE) -> DataFrame:
    """(path, entry, end): the first record of each range that the chain from the start of its file reaches."""
    spark = found.sparkSession
    every = stash(found.select("path", "off", "exit"), "jumps")
    # Only a file's start and what some chain leaves its range for can be an entry: about a row for each range.
    ends = every.select("path", F.col("exit").alias("off")).distinct()
    jumps = stash(every.where("off > 0").join(ends, ["path", "off"], "left_semi").unionByName(every.where("off = 0")), "jumps")
    seen = stash(jumps.where("off = 0").select("path", F.col("off").alias("entry")), "seen")
    n = seen.count()
    while True:
        onward = seen.join(jumps.select("path", F.col("off").alias("entry"), "exit"), ["path", "entry"]).select("path", F.col("exit").alias("entry"))
        seen = stash(seen.union(onward).distinct(), "seen")
        more = seen.count()
        if more == n:
            break
        n = more
        far = jumps.select("path", F.col("off").alias("exit"), F.col("exit").alias("further"))
        jumps = stash(jumps.join(far, ["path", "exit"]).select("path", "off", F.col("further").alias("exit")), "jumps")
    end = (F.floor(F.col("entry") / step).cast("long") + 1) * step
    return seen.select("path", "entry", end.alias("end"))


def read_archives(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """The records of the archives at ``path`` that the chain from the start of their file reaches.

    Columns: path, off, id, url, record_type, refers_to, payload_bytes, payload_digest (of the bytes read; a revisit's as
    it says), said_digest. An archive that doesn't begin with a record has none; a record whose length field runs beyond
    its file ends the chain. No archives give no rows.
    """
    entries = reachable(candidates(spark, path, step), step)
    return _dealt(entries, "entry").mapInPandas(_walk, RECORD)


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """Writes ``pages`` to archives at ``path`` and reads them back: id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Of equal payloads of at least ``LEAST`` bytes, the row with the largest id is the
    response; rows that repeat this id are responses too. Other columns are not read. Fails unless each row comes back.
    """
    write_archives(pages, path, id_col)
    kind = dict(pages.dtypes)[id_col]
    rows = stash(read_archives(pages.sparkSession, path).drop("url"), "records")
    if (n := rows.count()) != (written := pages.count()):
        raise RuntimeError(f"{n} records read of {written} written")
    return rows.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN k USING (d, n)
"""
