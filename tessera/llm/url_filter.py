"""URL filter over a sorted digest array: the rules' 64-bit XXH64 keys are memory-mapped, probed by vectorised binary
search, and confirmed against the stored rule strings."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, spread_join

#: Up to so many bytes of rules go to the executors as one array; beyond it the rules are joined.
MAX_DIGEST_BYTES = 256 << 20


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Digest:
    """Rules in the order of their keys. blob: keys, ends of the strings, verdicts, then the strings."""

    def __init__(self, rules: list[tuple[str, str]]):
        kept = sorted({rule: verdict for verdict, rule in rules}.items(), key=lambda x: xxhash.xxh64_intdigest(x[0]))
        raw = [rule.encode() for rule, _ in kept]
        self.n = len(kept)
        #: The lengths that rules' paths have; no other prefix of a path can be in the array.
        self.lengths = sorted({len(rule) - rule.find("/") if "/" in rule else 0 for rule, _ in kept})
        #: The most labels that a rule's host has; no longer suffix of a host can be in the array.
        self.labels = max((rule.split("/", 1)[0].count(".") + 1 for rule, _ in kept), default=0)
        keys = np.array([xxhash.xxh64_intdigest(x) for x in raw], np.uint64)
        ends = np.cumsum([0, *map(len, raw)], dtype=np.int64)
        verdicts = np.array([v == "block" for _, v in kept], np.uint8)
        self.blob = keys.tobytes() + ends.tobytes() + verdicts.tobytes() + b"".join(raw)
        self.id = xxhash.xxh3_128_hexdigest(self.blob)


_open: dict[str, tuple] = {}


def opened(digest: Digest) -> tuple:
    """The arrays over a mapped file of this worker, which has no name and goes with the process."""
    if digest.id not in _open:
        file = tempfile.TemporaryFile()
        file.write(digest.blob or b"\0")
        file.flush()
        whole = np.memmap(file, np.uint8, "r")
        n = digest.n
        ends = whole[8 * n : 8 * n + 8 * (n + 1)].view(np.int64)
        _open[digest.id] = (whole[: 8 * n].view(np.uint64), ends, whole[16 * n + 8 : 17 * n + 8], whole[17 * n + 8 :])
    return _open[digest.id]


def suffixes(host: str, labels: int) -> list[str]:
    """The host and every domain above it, those of so many labels at most."""
    out, at = [], len(host)
    while labels > 0 and at >= 0:
        at = host.rfind(".", 0, at)
        out.append(host[at + 1 :])
        labels -= 1
    return out


def probe(digest: Digest, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
    """The longest rule that fits each URL, and its verdict; of two of a length, the one with the longer host."""
    keys, ends, verdicts, strings = opened(digest)
    texts, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        heads = [path[:n] for n in digest.lengths if n <= len(path)]
        for domain in suffixes(host, digest.labels):
            for head in heads:
                texts.append((domain + head).encode())
                owner.append((i, len(domain)))
    found: list[tuple | None] = [None] * len(hosts)
    if digest.n and texts:
        wanted = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
        low = np.searchsorted(keys, wanted, "left")
        for k in np.flatnonzero((low < digest.n) & (keys[np.minimum(low, digest.n - 1)] == wanted)):
            at = int(low[k])
            while at < digest.n and keys[at] == wanted[k]:  # equal keys stand together; the string decides
                if strings[ends[at] : ends[at + 1]].tobytes() == texts[k]:
                    i, domain = owner[k]
                    best = (len(texts[k].decode()), domain, texts[k].decode(), "block" if verdicts[at] else "allow")
                    found[i] = max(found[i] or best, best)
                at += 1
    return [f and f[2] for f in found], [f and f[3] for f in found]


def judged(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", max_bytes: int = MAX_DIGEST_BYTES) -> DataFrame:
    """page_id, host, path, the rule that decides (null if none fits) and the verdict (default where none fits).

    rules: (verdict, host + path) pairs; a later pair of the same rule replaces an earlier one. A null URL or one
    without :// has an empty host and path, which no rule fits; one of any length is read whole. Repeated rows are judged
    alike; other columns are ignored. An empty table gives no rows. Lists beyond max_bytes are joined, with equal results.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if sum(len(r.encode()) + 17 for _, r in rules) > max_bytes:
        return judged_by_join(parts, pages.sparkSession.createDataFrame([(v, r, k) for k, (v, r) in enumerate(rules)], "verdict string, rule string, position long"), default)
    sent = pages.sparkSession.sparkContext.broadcast(Digest(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rule, verdict = probe(sent.value, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())], [*b.schema.names, "rule", "verdict"]
            )

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judged_by_join(parts: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule lists (verdict, rule, position) too large to send: the candidates of each distinct host and path join the rules."""
    lengths = sorted(r[0] for r in rules.select(F.when(F.instr("rule", "/") > 0, F.length("rule") - F.instr("rule", "/") + 1).otherwise(0).alias("n")).distinct().collect())
    places = parts.select("host", "path").distinct()
    pieces = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    tried = places.select("host", "path", F.explode(domains).alias("domain"), heads.alias("heads")).select("host", "path", "domain", F.explode("heads").alias("head"))
    last = rules.groupBy("rule").agg(F.max_by("verdict", "position").alias("verdict"))
    fits = tried.withColumn("rule", F.concat("domain", "head")).join(last, "rule")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("domain"))).alias("b"))
    out = spread_join(parts, best, ["host", "path"], ["page_id"], "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP7_SQL = """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                                          ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
SELECT page_id, host, path,
       (SELECT rule FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rule) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
