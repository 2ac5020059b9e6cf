"""WARC records out of ZIP-packaged web archives, by range reads.

A package is a ZIP file that holds `archive/*.warc(.gz)` *stored*, i.e. byte for byte, and `indexes/*.cdx(j)(.gz)` that say
where in an archive each record lies. Nothing is extracted:

1. `located`: per package, the end record, the ZIP64 locator and end record where present, and the central
   directory (with ZIP64 extra fields) are range-read and parsed; local headers give where a member's bytes begin; the
   indexes turn into a table of (package, offset, length), absolute in the package. An archive member without an index
   is walked gzip member by gzip member, in one sequential pass.
2. The locators - small rows - are shuffled by (package, stretch of offsets), so one large package is read by many tasks.
3. `records`: each task range-reads its records in offset order, neighbours in one read, and parses them.

A member that isn't stored can't be range-read: it is reported with status `compressed` and no record. A file that is no
ZIP has status `not a zip`, one that can't be opened `unreadable`, an index line that can't be parsed, that points outside its archive or names one that
isn't there or isn't the only one of that name `bad index`, a record that can't be parsed `bad record`; what an index leaves out of its archive is one row
`not in index`, from its first byte on, with its bytes in all. Nothing raises.

`packed` writes such packages from a table of pages, one per task and PACKAGE_BYTES, in the shared folder.

Edge cases: null url or html are kept null (the record says which fields it lacks), a null page_id likewise; empty and very long pages
are ordinary records; repeated rows are each a record; an empty table gives no package and no records; extra columns
aren't packed.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import docs_only, saved, shared

PACKAGE_BYTES = 64 << 20
STRETCH = 16 << 20
GAP = 1 << 16
LOCATED = "path string, member string, offset long, length long, status string"
RECORDS = "path string, member string, offset long, length long, status string, kind string, url string, headers map<string, string>, http map<string, string>, payload binary"


def opened(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


# -- the ZIP directory


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, stored size, where its bytes begin) of each member. Raises ValueError if this is no ZIP."""
    tail_at = max(0, size - 22 - 65535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    i = tail.rfind(b"PK\x05\x06")
    while i >= 0 and i + 22 + struct.unpack_from("<H", tail + b"\0" * 22, i + 20)[0] > len(tail):
        i = tail.rfind(b"PK\x05\x06", 0, i)
    if i < 0:
        raise ValueError("not a zip")
    count, length, start = struct.unpack_from("<HII", tail, i + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        f.seek(tail_at + i - 20)
        signature, _, at, _ = struct.unpack("<4sIQI", f.read(20))
        if signature != b"PK\x06\x07":
            raise ValueError("not a zip")
        f.seek(at)
        end = f.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("not a zip")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    f.seek(start)
    central = f.read(length)
    out, p = [], 0
    for _ in range(count):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("not a zip")
        flags, method = struct.unpack_from("<HH", central, p + 8)
        stored, plain, n, m, k = struct.unpack_from("<IIHHH", central, p + 20)
        local = struct.unpack_from("<I", central, p + 42)[0]
        name = central[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = central[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # 64-bit values, of the fields that are full, in this order
                r = q + 4
                if plain == 0xFFFFFFFF:
                    r += 8
                if stored == 0xFFFFFFFF:
                    stored = struct.unpack_from("<Q", extra, r)[0]
                    r += 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, r)[0]
            q += 4 + width
        f.seek(local)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("not a zip")
        a, b = struct.unpack_from("<HH", head, 26)
        out.append((name, method, stored, local + 30 + a + b))
        p += 46 + n + m + k
    return out


def _index_lines(f, method: int, stored: int, begin: int, name: str) -> Iterator[str]:
    f.seek(begin)
    data = f.read(stored)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    if name.endswith(".gz"):
        data = gzip.decompress(data)
    yield from data.decode("utf-8", "replace").splitlines()


class BadRecord(ValueError):
    """No record can be read at this offset."""


def _walked(f, begin: int, stored: int, zipped: bool) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of each record of an archive without an index."""
    if not zipped:
        at = 0
        while at < stored:
            f.seek(begin + at)
            head, end = b"", -1
            while end < 0:
                more = f.read(min(max(65536, len(head)), stored - at - len(head)))
                if not more:
                    raise BadRecord(at)
                end = (head + more).find(b"\r\n\r\n", max(0, len(head) - 3))
                head += more
            try:
                size = next((int(x.split(b":")[1]) for x in head[:end].split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            except ValueError:
                raise BadRecord(at) from None
            if size < 0 or at + end + 4 + size > stored:
                raise BadRecord(at)
            n = min(end + 4 + size + 4, stored - at)
            yield at, n
            at += n
        return
    f.seek(begin)
    left, at, buf, pos = stored, 0, b"", 0
    z = zlib.decompressobj(31)
    while left or buf:
        if not buf:
            buf = f.read(min(1 << 20, left))
            left = left - len(buf) if buf else 0
        try:
            z.decompress(buf)
        except zlib.error:
            raise BadRecord(at) from None
        if z.eof:
            used = len(buf) - len(z.unused_data)
            pos += used
            yield at, pos - at
            at, buf = pos, z.unused_data
            z = zlib.decompressobj(31)
        else:
            pos += len(buf)
            buf = b""
    if pos > at:
        raise BadRecord(at)


def locate(path: str) -> list[tuple[str, str, int, int, str]]:
    try:
        f = opened(path)
    except (OSError, pa.ArrowInvalid):
        return [(path, None, None, None, "unreadable")]
    with f:
        try:
            members = directory(f, f.size())
        except (ValueError, struct.error):
            return [(path, None, None, None, "not a zip")]
        return list(_located(f, path, members))


def _located(f, path: str, members: list[tuple[str, int, int, int]]) -> Iterator[tuple]:
    archives = {n: (m, s, b) for n, m, s, b in members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    bases: dict[str, list[str]] = {}
    for n in archives:
        bases.setdefault(n.rpartition("/")[2], []).append(n)
    indexed: dict[str, list[tuple[int, int]]] = {}
    for name, method, stored, begin in members:
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            continue
        try:
            lines = list(_index_lines(f, method, stored, begin, name))
        except (OSError, zlib.error, EOFError):
            yield path, name, None, None, "bad index"
            continue
        for line in lines:
            if not line.strip() or line.startswith("!"):
                continue
            try:
                x = json.loads(line[line.index("{") :])
                member = f"archive/{x['filename'].removeprefix('archive/')}"
                if member not in archives:
                    (member,) = bases[x["filename"].rpartition("/")[2]]
                kind, size, at = archives[member]
                offset, length = int(x["offset"]), int(x["length"])
                if offset < 0 or length <= 0 or (kind == zipfile.ZIP_STORED and offset + length > size):
                    raise ValueError(line)
            except (ValueError, KeyError, TypeError, AttributeError):
                yield path, name, None, None, "bad index"
                continue
            indexed.setdefault(member, []).append((offset, length))
            if kind == zipfile.ZIP_STORED:
                yield path, member, at + offset, length, "ok"
    for member, (kind, size, at) in archives.items():
        if kind != zipfile.ZIP_STORED:
            yield path, member, None, None, "compressed"
        elif member not in indexed:
            try:
                for a, n in _walked(f, at, size, member.endswith(".gz")):
                    yield path, member, at + a, n, "ok"
            except BadRecord as bad:
                yield path, member, at + bad.args[0], None, "bad record"
        else:
            first, missing, end = None, 0, 0
            for a, n in [*sorted(indexed[member]), (size, 0)]:
                if a > end:
                    first, missing = end if first is None else first, missing + a - end
                end = max(end, a + n)
            if missing:
                yield path, member, at + first, missing, "not in index"


def located(paths: DataFrame) -> DataFrame:
    """Locators of all records in the packages named in the column path."""

    def run(it):
        for b in it:
            for path in b.column("path").to_pylist():
                if path is not None:
                    rows = locate(path)
                    for i in range(0, len(rows), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50_000]), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "member", "offset", "length", "status"])

    return docs_only(paths, "path").mapInArrow(run, LOCATED)


# -- records


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip(): v.strip() for k, c, v in (x.partition(":") for x in rest) if c}


def parsed(raw: bytes) -> tuple[str, str | None, dict[str, str], dict[str, str], bytes] | None:
    """(kind, url, WARC headers, HTTP headers, payload), or None."""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return None
    head, gap, body = raw.partition(b"\r\n\r\n")
    first, fields = _fields(head)
    low = {k.lower(): v for k, v in fields.items()}
    if not gap or not first.startswith("WARC/") or not low.get("content-length", "").isdigit():
        return None
    body = body[: int(low["content-length"])]
    http: dict[str, str] = {}
    if low.get("warc-type") in ("response", "request") and low.get("content-type", "").startswith("application/http"):
        top, _, body = body.partition(b"\r\n\r\n")
        _, http = _fields(top)
    return low.get("warc-type"), low.get("warc-target-uri"), fields, http, body


def ranges(rows: list[tuple]) -> Iterator[tuple[tuple, bytes]]:
    """Each row (path, member, offset, length, ...) with its bytes; rows that lie close together share a read."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    i = 0
    f, path = None, None
    try:
        while i < len(rows):
            if rows[i][0] != path:
                if f:
                    f.close()
                path = rows[i][0]
                f = opened(path)
            a, b, j = rows[i][2], rows[i][2] + rows[i][3], i + 1
            while j < len(rows) and rows[j][0] == path and rows[j][2] <= b + GAP and b - a < STRETCH:
                b = max(b, rows[j][2] + rows[j][3])
                j += 1
            f.seek(a)
            data = f.read(b - a)
            for r in rows[i:j]:
                yield r, data[r[2] - a : r[2] - a + r[3]]
            i = j
    finally:
        if f:
            f.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, number, headers = pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())
    kinds = (text, text, number, number, text, text, text, headers, headers, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "member", "offset", "length", "status", "kind", "url", "headers", "http", "payload"])


def _read(it):
    for b in it:
        rows = list(zip(*[b.column(c).to_pylist() for c in ("path", "member", "offset", "length", "status")]))
        out = [(*r, None, None, None, None, None) for r in rows if r[4] != "ok"]
        held = 0
        for r, raw in ranges([r for r in rows if r[4] == "ok"]):
            x = parsed(raw)
            if x is None:
                out.append((*r[:4], "bad record", None, None, None, None, None))
            else:
                kind, url, fields, http, body = x
                out.append((*r, kind, url, list(fields.items()), list(http.items()), body))
                held += len(body)
            if held > 4 << 20:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)


def records(locators: DataFrame) -> DataFrame:
    """The records at the locators, range-read."""
    spread = locators.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).repartition("path", "stretch").drop("stretch").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(_read, RECORDS)


# -- packages


def record(page_id, url, html) -> bytes:
    """A gzipped WARC response record."""
    none = [n for n, v in (("page_id", page_id), ("url", url), ("html", html)) if v is None]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8")
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url}"] if url is not None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"X-Null: {','.join(none)}"] if none else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n", 1)


def package(rows: list[tuple], out, zip64: bool = False, compressed: bool = False, index: bool = True) -> None:
    """Writes (page_id, url, html) rows as one package to a binary stream."""
    archive, lines = io.BytesIO(), []
    for page_id, url, html in rows:
        raw = record(page_id, url, html)
        lines.append(f"{url or '-'} 20240101000000 " + json.dumps({"url": url, "offset": str(archive.tell()), "length": str(len(raw)), "filename": "data.warc.gz"}))
        archive.write(raw)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        how = zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED
        with z.open(_info("archive/data.warc.gz", how), "w", force_zip64=zip64) as f:
            f.write(archive.getbuffer())
        if index:
            with z.open(_info("indexes/index.cdx.gz", zipfile.ZIP_STORED), "w", force_zip64=zip64) as f:
                f.write(gzip.compress("\n".join(lines).encode("utf-8"), 1))
        with z.open(_info("datapackage.json", zipfile.ZIP_DEFLATED), "w", force_zip64=zip64) as f:
            f.write(json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}]}).encode())


def _info(name: str, how: int) -> zipfile.ZipInfo:
    x = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
    x.compress_type = how
    return x


def packed(pages: DataFrame) -> DataFrame:
    """path of each package written; only those of tasks that ended well are in the table."""
    folder = f"{shared(pages.sparkSession)}/packages-{uuid.uuid4().hex}"

    def run(it):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)

        def flush(rows):
            name = f"{uuid.uuid4().hex}.wacz"  # an attempt that is repeated writes another file
            with fs.open_output_stream(f"{base}/{name}") as f:
                package(rows, f)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

        rows, size = [], 0
        for b in it:
            for r in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                rows.append(r)
                size += len(r[2] or "")
                if size > PACKAGE_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return saved(docs_only(pages, "page_id", "url", "html").mapInArrow(run, "path string"), "packages")


def pages_of(found: DataFrame) -> DataFrame:
    """page_id, url, html of the records that `packed` wrote."""
    none = F.coalesce(F.col("headers")["X-Null"], F.lit(""))
    return found.where("status = 'ok' and kind = 'response'").select(
        F.col("headers")["X-Page-Id"].cast("long").alias("page_id"), "url", F.when(~none.contains("html"), F.decode("payload", "UTF-8")).alias("html")
    )


def read_back(pages: DataFrame) -> DataFrame:
    return pages_of(records(saved(located(packed(pages)), "locators")))


ORACLE = "SELECT page_id, url, html FROM pages"
