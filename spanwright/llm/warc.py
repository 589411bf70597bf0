"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC files, one file per task. Of the pages with
equal payloads of ``LEAST`` bytes or more, the smallest page_id's is a response and the
others revisit it. The index lists captures by reversed-host URL key: sorted lines are
compressed in blocks of ``LINES``, and a sparse directory holds each block's first and last
key and its place; each index file has its own part of the directory beside it. A look-up
searches the directory by halves, reads one block's range, searches its lines by halves, and
reads just the record's range from the archive. :func:`fetch` does so for a table of keys: the
first step finds the blocks, the second reads them, so that a key that fills many blocks is
shared out by block.

Files go to the folder that driver and executors share. A task that runs again writes files
of its own, and only those of the attempt whose rows were kept are ever named, so lost
executors and repeated attempts do no harm.

Defined results: null html is an empty payload; a null url has the empty key and no target
header; rows that repeat the smallest page_id with the same payload are all responses; a null
page_id is no candidate for the response unless all are null; other columns are ignored;
an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_or_arrow_fs, settle, shared_root, small_batches, utf8

LEAST = 100
LINES = 512
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: URL characters that stay as they are in keys and headers; white space, controls and the percent sign don't.
_SAFE = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://a.example.org/x?y becomes org,example,a)/x?y."""
    whole = url or ""
    rest = whole.split("://", 1)[1] if "://" in whole else whole
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, path = rest[:end].lower(), rest[end:].split("#", 1)[0]
    key = f"{','.join(reversed(host.split('.')))}){path or '/'}" if "://" in whole else whole
    return quote(key, safe=_SAFE)


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed. A revisit holds the HTTP header alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says: type, page_id, url, digest, refers_to, payload (None in a revisit) and the full payload's length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    told = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(told["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = told["warc-payload-digest"].split(":", 1)[1]
    out = {"type": told["warc-type"], "page_id": int(told["page-id"]) if "page-id" in told else None, "url": unquote(told["warc-target-uri"]) if "warc-target-uri" in told else None, "digest": digest, "length": length, "refers_to": None, "payload": None}
    if out["type"] == "revisit":
        out["refers_to"] = int(told["warc-refers-to"][len("<urn:page:") : -1])
    else:
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload of page {out['page_id']}")
        out["payload"] = payload
    return out


def _zip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """Open input files of one folder, the last few of them."""

    def __init__(self, folder: str, most: int = 32):
        self.fs, self.path = local_or_arrow_fs(folder)
        self.most, self.open = most, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return self.open[name].read_at(length, offset)

    def unzip(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.read(name, offset, length), 31)

    def lines(self, name: str, offset: int | None = None, length: int | None = None) -> list[str]:
        """The lines of a compressed block, or of a whole file."""
        if offset is None:
            with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as file:
                return zlib.decompress(file.read(), 31).decode().split("\n")[:-1]
        return self.unzip(name, offset, length).decode().split("\n")[:-1]


class _Out:
    """A file that a task writes, opened with its first bytes; its name has the attempt's number."""

    def __init__(self, folder: str, kind: str, name: str | None = None):
        self.folder, self.name, self.at, self.file = folder, name or f"{kind}-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.gz", 0, None

    def write(self, data: bytes) -> int:
        if self.file is None:
            fs, path = local_or_arrow_fs(self.folder)
            fs.create_dir(path, recursive=True)
            self.file = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null in responses."""
    whole = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(html).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = whole.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return whole.join(again, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as WARC files and return their captures: key, page_id, file, offset, length."""
    small_batches(pages.sparkSession, 256)

    def run(batches):
        out = _Out(folder, "warc")
        for b in batches:
            rows = []
            for i, u, p, d, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _zip(make_record(i, u, p, d, r))
                rows.append((url_key(u), i, out.name, out.write(data), len(data)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        out.close()

    return settle(decided(pages, page_id, url, html).mapInArrow(run, "key string, page_id bigint, file string, offset bigint, length bigint"), "captures")


def _directory(index: str) -> str:
    return index.removesuffix(".gz") + ".directory.gz"


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Write the blocks and return the directory: first_key, last_key, file, offset, length, n.

    Ranges are cut by key and page_id, so captures of one key may lie in many blocks.
    """
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        out, held, blocks = _Out(folder, "index"), [], []

        def block():
            data = _zip("".join(held_line + "\n" for held_line in held).encode())
            blocks.append((held[0].split("\t", 1)[0], held[-1].split("\t", 1)[0], out.name, out.write(data), len(data), len(held)))
            held.clear()

        for b in batches:
            for key, i, f, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(f"{key}\t{'' if i is None else i}\t{f}\t{o}\t{n}")
                if len(held) == lines:
                    block()
        if held:
            block()
        out.close()
        if blocks:
            beside = _Out(folder, "directory", _directory(out.name))
            beside.write(_zip("".join(f"{first}\t{last}\t{o}\t{n}\n" for first, last, _, o, n, _ in blocks).encode()))
            beside.close()
        cols = list(zip(*blocks, strict=True)) if blocks else [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["first_key", "last_key", "file", "offset", "length", "n"])

    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset").select("key", "page_id", "file", "offset", "length")
    return settle(ordered.mapInArrow(run, "first_key string, last_key string, file string, offset bigint, length bigint, n bigint"), "directory")


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, lines: int = LINES) -> tuple[str, DataFrame]:
    """Write pages and index; returns the folder and the directory."""
    folder = folder or f"{shared_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return folder, write_index(write_archive(pages, folder, page_id, url, html), folder, lines)


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _records(files: _Files, spots: list[tuple[str, int, int]]) -> pa.RecordBatch:
    rows = [(r["page_id"], r["length"], r["digest"], r["type"], r["refers_to"]) for r in (parse_record(files.unzip(*spot)) for spot in sorted(spots))]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _spots(lines: list[str], key: str | None = None) -> list[tuple[str, int, int]]:
    """Where the records of a block are, or those of one key, found by halves."""
    own = lines if key is None else lines[bisect_left(lines, key + "\t") : bisect_left(lines, key + "\n")]
    return [(f, int(o), int(n)) for _, _, f, o, n in (x.split("\t") for x in own)]


def read_archive(folder: str, directory: DataFrame) -> DataFrame:
    """The columns READ of every capture, block by block; each response's payload is hashed again."""
    parts = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        files = _Files(folder)
        for b in batches:
            for place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield _records(files, _spots(files.lines(*place)))

    return directory.select("file", "offset", "length").repartition(parts).mapInArrow(run, READ)


def keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """(key) of the URLs of ``pages``, each once."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(url).cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def blocks_of(folder: str, directory: DataFrame, asked: DataFrame) -> DataFrame:
    """(file, offset, length, keys): the blocks that may hold keys of ``asked`` (key), each with those keys, ``LINES`` at most a row.

    Every task knows the first and last key of each index file, a row for each partition that
    wrote one, and reads the directory's part of a file when a key leads there. Keys are dealt in
    ranges, so that a task's keys lie in few files and those of a block side by side.
    """
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = sorted((r.first, r.last, r.file) for r in directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect())
    shared = asked.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        files, held, place, out = _Files(folder), [], None, []
        firsts, lasts = [f for f, _, _ in shared.value], [x for _, x, _ in shared.value]
        name, begins, ends, spots = None, [], [], []

        def batch():
            cols = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "offset", "length", "keys"])

        for b in batches:
            for key in b.column(0).to_pylist():
                for _, _, file in shared.value[bisect_left(lasts, key) : bisect_right(firsts, key)]:
                    if file != name:
                        name, rows = file, [x.split("\t") for x in files.lines(_directory(file))]
                        begins, ends, spots = [r[0] for r in rows], [r[1] for r in rows], [(file, int(r[2]), int(r[3])) for r in rows]
                    for spot in spots[bisect_left(ends, key) : bisect_right(begins, key)]:
                        if spot != place or len(held) == LINES:
                            if held:
                                out.append((*place, held))
                            place, held = spot, []
                        held.append(key)
            if len(out) >= 64:
                yield batch()
                out = []
        if held:
            out.append((*place, held))
        yield batch()

    ranged = asked.select("key").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return ranged.mapInArrow(run, "file string, offset bigint, length bigint, keys array<string>")


def fetch(folder: str, directory: DataFrame, asked: DataFrame) -> DataFrame:
    """The columns READ of every capture of the keys ``asked`` (key, each once); each response's payload is hashed again."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        files = _Files(folder)
        for b in batches:
            for *place, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = files.lines(*place)
                yield _records(files, [spot for key in own for spot in _spots(lines, key)])

    return blocks_of(folder, directory, asked).repartition(parts).mapInArrow(run, READ)


def look_up(spark: SparkSession, folder: str, directory: DataFrame, urls: list[str]) -> dict[str, list[dict]]:
    """The records of a few URLs. Only directory rows of blocks that may hold a URL's key are fetched; in a block the lines are searched by halves."""
    keys = {u: url_key(u) for u in urls}
    asked = spark.createDataFrame([(k,) for k in sorted(set(keys.values()))], "key string")
    blocks = directory.join(F.broadcast(asked), (F.col("first_key") <= F.col("key")) & (F.col("key") <= F.col("last_key")), "left_semi").orderBy("first_key", "last_key").collect()
    files, found = _Files(folder), {u: [] for u in urls}
    firsts, lasts = [b.first_key for b in blocks], [b.last_key for b in blocks]
    for u, key in keys.items():
        for b in blocks[bisect_left(lasts, key) : bisect_right(firsts, key)]:
            found[u] += [parse_record(files.unzip(*spot)) for spot in _spots(files.lines(b.file, b.offset, b.length), key)]
    return found


ORACLE = f"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (
  select *, case when payload_bytes >= {LEAST} then min(page_id) over (partition by payload_digest) end as first from p),
r as (select *, case when page_id is distinct from first then first end as refers_to from f)
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from r
"""
