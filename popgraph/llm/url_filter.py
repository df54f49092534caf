"""URL rules looked up in a sorted array of 64-bit digests.

An index file holds the xxhash64 keys of all rules in ascending order, for each key where the rule's text lies,
and the texts. Executors map it into memory and probe it by vectorised binary search with every rule that could
fit a URL: each suffix of the host that begins at a label, with each path length that rules have. A hit counts
only if the stored text equals the probe, so colliding digests do no harm.

Rules beyond INDEX_BYTES make many such arrays, each with the digests of one range, which Spark sorts; probes go to
the range of their digest and are looked up there in the same way.
"""

from __future__ import annotations

import math
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Bytes of rules up to which the index is one file that every executor fetches; beyond, it is cut by digest into segments.
INDEX_BYTES = 8 << 20
#: Entries of rules of a segment, and URLs whose probes meet it at once.
SEGMENT_ENTRIES = 100_000
_HEAD = struct.Struct("<4sxxxxqqq")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """(host, path) columns of a URL column: both empty if it is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as example.net/en/."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def index_bytes(rules: list[tuple[str, str]]) -> bytes:
    """The index file of (rule, verdict): keys of hosts and of whole rules, sorted, and their texts.

    A host's entry lists the path lengths of its rules; a rule's entry is its verdict. A rule that is given
    both ways is a block.
    """
    verdicts: dict[tuple[str, str], str] = {}
    for rule, verdict in rules:
        key = split_rule(rule)
        verdicts[key] = "block" if "block" in (verdict, verdicts.get(key)) else verdict
    hosts: dict[str, set[int]] = {}
    for host, path in verdicts:
        hosts.setdefault(host, set()).add(len(path.encode()))
    texts = [(h.encode(), ",".join(map(str, sorted(x, reverse=True))).encode()) for h, x in hosts.items()]
    texts += [((h + p).encode() + b"\0", v.encode()) for (h, p), v in verdicts.items()]  # the zero byte tells a rule from a host
    return entries_bytes(texts)


def entries_bytes(texts: list[tuple[bytes, bytes]]) -> bytes:
    """The index file of (text, value)."""
    entries = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in texts)
    keys = np.array([e[0] for e in entries], "<u8")
    blob, at = bytearray(), [0]
    for _, k, v in entries:
        blob += k
        at.append(len(blob))
        blob += v
        at.append(len(blob))
    offsets = np.array(at, "<i8")
    return _HEAD.pack(b"URL1", len(keys), keys.nbytes, offsets.nbytes) + keys.tobytes() + offsets.tobytes() + bytes(blob)


class Index:
    """An index file that is mapped into memory, or its bytes."""

    def __init__(self, path: str | bytes):
        data = np.frombuffer(path, np.uint8) if isinstance(path, bytes) else np.memmap(path, np.uint8, "r")
        magic, self.n, keys, offsets = _HEAD.unpack(data[: _HEAD.size].tobytes())
        if magic != b"URL1":
            raise ValueError("not an index of URL rules")
        at = _HEAD.size
        self.keys, self.offsets, self.blob = data[at : at + keys].view("<u8"), data[at + keys : at + keys + offsets].view("<i8"), data[at + keys + offsets :]

    def find(self, probes: list[bytes]) -> list[bytes | None]:
        """The value stored under each probe."""
        if not probes or not self.n:
            return [None] * len(probes)
        key = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, key)
        out: list[bytes | None] = [None] * len(probes)
        for i in np.flatnonzero(self.keys[np.minimum(at, self.n - 1)] == key):
            k = int(at[i])
            while k < self.n and self.keys[k] == key[i]:  # equal digests of different texts lie side by side
                a, b, c = self.offsets[2 * k : 2 * k + 3]
                if self.blob[a:b].tobytes() == probes[i]:
                    out[i] = self.blob[b:c].tobytes()
                    break
                k += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of the longest rule that fits each URL."""
        suffixes = {}
        for host in dict.fromkeys(hosts):
            h, own = host.encode(), []
            while h:
                own.append(h)
                h = h.partition(b".")[2]
            suffixes[host] = own
        flat = list(dict.fromkeys(s for own in suffixes.values() for s in own))
        lengths = {s: [int(x) for x in v.split(b",")] for s, v in zip(flat, self.find(flat), strict=True) if v is not None}
        ruled = {host: own for host, xs in suffixes.items() if (own := [s for s in xs if s in lengths])}
        rows, probes = [], []
        for i, host in enumerate(hosts):
            if host in ruled:
                path = paths[i].encode()
                for s in ruled[host]:
                    for n in lengths[s]:
                        if n <= len(path):
                            rows.append(i)
                            probes.append(s + path[:n] + b"\0")
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        for i, probe, verdict in zip(rows, probes, self.find(probes), strict=True):
            if verdict is not None:
                text = probe[:-1].decode()
                size = (len(text), len(split_rule(text)[0]))
                if size > best[i]:
                    best[i], out[i] = size, (text, verdict.decode())
        return out


_open: dict[str, Index] = {}


def _index(path: str) -> Index:
    if path not in _open:
        _open[path] = Index(path)
    return _open[path]


#: What each application's executors can fetch already, by name; a name stands for its contents.
_published: set[tuple[str, str]] = set()


def _publish(spark: SparkSession, data: bytes) -> str:
    """Hands the file to all executors, once an application; the name under which they have it."""
    name = f"url-rules-{xxhash.xxh3_128_hexdigest(data)}.bin"
    key = (spark.sparkContext.applicationId, name)
    if key in _published:
        return name
    _published.add(key)
    folder = tempfile.mkdtemp(prefix="spark-rules-")
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", max_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    rules has columns rule (host/path) and verdict (allow or block). A rule fits its host and all subdomains if
    the URL's path starts with the rule's; the longest rule wins, of equals the one with the longer host, and a
    rule given both ways blocks. No rule: rule is null and verdict is default. Null URLs and those without "://"
    have empty host and path, which no rule fits. Repeated rows are judged each; other columns are not looked
    at; an empty table gives no rows. Rules of more than max_bytes are looked up by segments.
    """
    rules = rules.select("rule", "verdict").where("rule is not null and verdict is not null and instr(rule, '/') > 1").distinct()
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    size = rules.agg(F.sum(F.octet_length("rule") + 64)).first()[0] or 0
    if size > max_bytes:
        return judge_by_segments(parts, rules, default)
    C.small_batches(pages.sparkSession)
    name = _publish(pages.sparkSession, index_bytes([tuple(r) for r in rules.collect()]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(SparkFiles.get(name))
        for batch in batches:
            found = index.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rule = pa.array([r for r, _ in found], pa.string())
            verdict = pa.array([v or default for _, v in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _look_up(key: tuple, probes: pa.Table, entries: pa.Table) -> pa.Table:
    """Of one range of digests: probes (segment, probe) with the value of the entry (segment, text, value) that is the same text."""
    index = Index(entries_bytes(list(zip(entries.column("text").to_pylist(), entries.column("value").to_pylist(), strict=True))))
    found = pa.array(index.find(probes.column("probe").to_pylist()), pa.binary())
    out = pa.table({"probe": probes.column("probe").combine_chunks(), "value": found})
    return out.filter(found.is_valid())


def _in_segments(probes: DataFrame, entries: DataFrame, segments: int) -> DataFrame:
    """(probe, value) of the distinct binary probes that entries (text, value) holds."""

    def segment(text: str):
        return F.pmod(F.xxhash64(text), F.lit(segments))

    p = probes.distinct().withColumn("segment", segment("probe")).groupBy("segment")
    return p.cogroup(entries.withColumn("segment", segment("text")).groupBy("segment")).applyInArrow(_look_up, "probe binary, value binary")


def judge_by_segments(parts: DataFrame, rules: DataFrame, default: str = "allow", segment_entries: int = SEGMENT_ENTRIES) -> DataFrame:
    """As judge_urls(), for rules of any number: nothing of them comes to the driver.

    Hosts and URLs are made distinct before their probes are dealt to segments, whose number grows with both tables.
    """
    rules = rules.select("verdict", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("h"), F.expr("substring(rule, instr(rule, '/'))").alias("p"))
    rules = rules.groupBy("h", "p").agg(F.min(F.when(F.col("verdict") == "block", "block")).alias("b"), F.min("verdict").alias("v")).select("h", "p", F.coalesce("b", "v").alias("verdict"))
    rules = C.materialise(rules, "url-rules")
    urls = C.materialise(parts.select("host", "path").where("host != ''").distinct(), "urls")
    segments = max(1, math.ceil(max(rules.count(), urls.count()) / segment_entries))
    lengths = rules.groupBy("h").agg(F.concat_ws(",", F.collect_set(F.octet_length("p").cast("string"))).alias("value"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = urls.select("host").distinct().select("host", F.explode(suffixes).alias("h")).where("h != ''")
    ruled = _in_segments(tails.select(F.col("h").cast("binary").alias("probe")), lengths.select(F.col("h").cast("binary").alias("text"), F.col("value").cast("binary").alias("value")), segments)
    ruled = tails.join(ruled.select(F.col("probe").cast("string").alias("h"), F.explode(F.split(F.col("value").cast("string"), ",").cast("array<int>")).alias("n")), "h")
    path = F.col("path").cast("binary")
    tries = urls.join(ruled, "host").where(F.octet_length("path") >= F.col("n"))
    tries = C.materialise(tries.select("host", "path", "h", F.concat(F.col("h").cast("binary"), F.substring(path, F.lit(1), F.col("n")), F.lit(b"\0")).alias("probe")), "tries")
    entries = rules.select(F.concat(F.col("h").cast("binary"), F.col("p").cast("binary"), F.lit(b"\0")).alias("text"), F.col("verdict").cast("binary").alias("value"))
    hits = tries.join(_in_segments(tries.select("probe"), entries, segments), "probe")
    rule = F.expr("substring(probe, 1, octet_length(probe) - 1)").cast("string")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), F.length("h").alias("own"), rule.alias("rule"), F.col("value").cast("string").alias("v"))).alias("m"))
    out = parts.join(best.select("host", "path", "m.rule", "m.v"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))
