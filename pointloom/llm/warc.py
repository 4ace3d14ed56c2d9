"""WARC archives with payload deduplication, and an external merge of their capture indexes.

Writing: every task fills memory-sized runs, sorts each by URL key and timestamp, and
writes it as one archive (a gzip member per record) with its index rows in the same
order. Merging: the shuffle's range partitioner, from a bounded sample, cuts all runs into
ranges of about equal size, also within one URL key; each range's run slices go
through a loser tree, so the ranges one after the other are the capture histories of
all archives in global order. Reading: records are found by file and offset.

Archives are named at random and only those whose index rows were committed are ever
read, so a repeated task leaves an unused file at worst.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import bound_batches, new_folder, written

RUN_BYTES = 32 << 20
LEVEL = 3
#: Index rows in a merge range.
RANGE_ROWS = 100_000
FIRST_CAPTURE = 1_700_000_000
RECORD_ID = "urn:pointloom:page:"
INDEX = "urlkey string, timestamp long, page_id long, file string, offset long, length long, run string, nth long"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """A sortable key: the host's labels reversed, then path and query; null and broken URLs keep their text."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def file_system(uri: str):
    """The file system and path of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][\w+.-]*:/", uri) else "file://" + uri)


def _uri(uri: str) -> str:
    return re.sub(r"^file:/+", "file:///", uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else int(page_id)}>"


def record(page_id, url: str | None, when: int, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member; with refers_to, a revisit without the payload."""
    date = pd.Timestamp(when, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """A record's type, ids, payload length and digest; the digest of a payload that is there is taken anew."""
    raw = zlib.decompress(member, wbits=31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda s: int(s) if (s := s.strip("<>").removeprefix(RECORD_ID)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": stated, "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload,
    }


def referred(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html) with refers_to: the largest page_id of those with an equal payload of at least ``least`` bytes.

    Null for that page itself, for shorter payloads, and where all equal pages have null ids.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("__sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    last = rows.where(F.octet_length("html") >= least).groupBy("__sha").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n"))
    last = last.where("__n > 1").select("__sha", "__last")  # only payloads that repeat
    rows = rows.join(last, "__sha", "left")
    return rows.select("page_id", "url", "html", F.when(~F.col("__last").eqNullSafe(F.col("page_id")), F.col("__last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, run_bytes: int | None = None) -> DataFrame:
    """Writes a record per row and returns the committed index rows, each run's in order (nth from 0)."""
    base, run_bytes = _uri(folder), run_bytes or RUN_BYTES

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = file_system(base)
        system.create_dir(path, recursive=True)

        def flush(held: list[tuple]) -> pd.DataFrame:
            held.sort(key=lambda r: r[:3])
            run = uuid.uuid4().hex
            name, at, rows = f"{path}/{run}.warc.gz", 0, []
            info = b"software: pointloom\r\nformat: WARC File Format 1.1\r\n"
            head = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (str(uuid.UUID(run)).encode(), len(info))
            packer = zlib.compressobj(LEVEL, wbits=31)
            first = packer.compress(head + info + b"\r\n\r\n") + packer.flush()
            with system.open_output_stream(name, compression=None) as out:  # members are packed already
                out.write(first)
                at = len(first)
                for nth, (key, when, order, member) in enumerate(held):
                    out.write(member)
                    rows.append((key, when, order[1] if order[0] else None, f"{run}.warc.gz", at, len(member), run, nth))
                    at += len(member)
            out = pd.DataFrame(rows, columns=["urlkey", "timestamp", "page_id", "file", "offset", "length", "run", "nth"])
            out["page_id"] = out["page_id"].astype("Int64")
            return out

        held, size = [], 0
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["page_id"]]
            refers = [None if pd.isna(i) else int(i) for i in batch["refers_to"]]
            for i, url, html, to in zip(ids, batch["url"], batch["html"], refers, strict=True):
                when = FIRST_CAPTURE + (i or 0) % 1_000_000_000
                member = record(i, url, when, html.encode("utf-8", "surrogatepass"), to)
                held.append((url_key(url), when, (i is not None, i or 0), member))
                size += len(member)
                if size >= run_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    bound_batches(pages.sparkSession)
    return written(pages.mapInPandas(write, INDEX), "captures")


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges sorted lists: a tree holds the loser of each match, so each next row costs one path of matches."""
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else [])
        return
    nth = [0] * k
    heads = [r[0] if r else None for r in runs]  # None: exhausted, loses to all

    def beats(a: int, b: int) -> bool:
        if heads[a] is None:
            return False
        return heads[b] is None or (heads[a], a) < (heads[b], b)

    losers = [-1] * k
    for leaf in range(k):  # play the leaves in, one by one
        winner, node = leaf, (leaf + k) // 2
        while node and losers[node] >= 0:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[node] = winner  # node 0 holds the winner of all
    while heads[w := losers[0]] is not None:
        yield heads[w]
        nth[w] += 1
        heads[w] = runs[w][nth[w]] if nth[w] < len(runs[w]) else None
        winner, node = w, (w + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def merge_index(index: DataFrame, range_rows: int | None = None) -> DataFrame:
    """The captures of all runs in global order: range_no, then place, by URL key, timestamp and page id (null first)."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, cores, -(-index.count() // (range_rows or RANGE_ROWS)))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = list(batches)  # a range: sorted by run and place in it
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            order = list(zip(rows["urlkey"], rows["timestamp"], rows["page_id"].astype("Int64").fillna(-1 << 63), range(len(rows)), strict=True))
            cut = np.flatnonzero(rows["run"].to_numpy()[1:] != rows["run"].to_numpy()[:-1]) + 1
            runs = [order[a:b] for a, b in zip([0, *cut], [*cut, len(order)], strict=True)]
            out = rows.iloc[[r[3] for r in loser_tree(runs)]].drop(columns=["run", "nth"])
            yield out.assign(range_no=TaskContext.get().partitionId(), place=np.arange(len(out)))

    rows = index.repartitionByRange(ranges, "urlkey", "timestamp", "page_id").sortWithinPartitions("run", "nth")
    return rows.mapInPandas(merge, "urlkey string, timestamp long, page_id long, file string, offset long, length long, range_no int, place long")


def read_archives(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at the captures' files and offsets, parsed and checked."""
    base = _uri(folder)
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = file_system(base)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length, *rest in batch[["file", "offset", "length", "urlkey", "range_no", "place"]].itertuples(index=False):
                if file != name:
                    name, source = file, system.open_input_file(f"{path}/{file}")
                found = parse(source.read_at(length, offset))
                rows.append((*(found[c] for c in columns), *rest))
            out = pd.DataFrame(rows, columns=[*columns, "urlkey", "range_no", "place"])
            for c in ("page_id", "refers_to"):
                out[c] = out[c].astype("Int64")
            yield out

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    near = captures.repartition(captures.sparkSession.sparkContext.defaultParallelism, "file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
    return near.mapInPandas(read, kinds + ", urlkey string, range_no int, place long")


def archive_pages(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages, merges the archives' indexes and reads the archives back: a row per page.

    Null html is an empty payload, null url an empty one, a null page_id comes back null;
    rows that repeat whole are all responses or all revisits of their id; other columns
    are not read; an empty table gives an empty result.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = write_archives(referred(pages, least), folder)
    return read_archives(merge_index(index), folder)
