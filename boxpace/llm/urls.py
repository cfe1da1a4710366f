"""URL filters by allow and block lists (operator 2).

The rules form a trie: first the host's labels from the right (``com``,
``example``, ``www``), then, below each host node, the path's segments. One walk
from the root passes every rule that fits an url, and the deepest one wins, so
an allow entry inside a blocked site (or the reverse) takes precedence by
length alone. The trie is built on the driver, its size is checked, and it is
broadcast; urls are parsed by column expressions.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lower_ascii

MAX_TRIE_BYTES = 256 << 20
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 2)


class RuleTrie:
    """Longest-match lookup over (host, path prefix, verdict) rules.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. Of the rules that fit, the one with the most host labels wins, then
    the longest path. Two verdicts for one rule: block wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("h", {}).setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("p", {})
            for seg in whole:
                node = node.setdefault("s", {}).setdefault(seg, {})
            # What follows the last slash is a prefix of the url's segment there.
            old = node.setdefault("e", {}).get(last)
            if old is None or verdict == "block":
                node["e"][last] = (f"{host}{path}", verdict)

    def find(self, host: str, path: str):
        """(rule, verdict) of the winning rule, or None."""
        segs = path.split("/")
        node, best = self.root, self._path(self.root, segs)
        for label in reversed(host.split(".")):
            node = node.get("h", {}).get(label)
            if node is None:
                break
            best = self._path(node, segs) or best
        return best

    @staticmethod
    def _path(node: dict, segs: list[str]):
        best, node = None, node.get("p")
        for i, seg in enumerate(segs):
            if node is None:
                break
            ends = node.get("e")
            if ends:
                hit = max((e for e in ends if seg.startswith(e)), key=len, default=None)
                best = ends[hit] if hit is not None else best
            node = node.get("s", {}).get(seg) if i < len(segs) - 1 else None
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (host, path, allow | block). ``rule`` is the winner's host and
    path, NULL where none fits; then ``verdict`` is ``default``. A NULL url or one
    without ``://`` has an empty host and path. NULL ids stay NULL, repeated
    rows are judged each, an empty table gives no rows.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    blob = cloudpickle.dumps(RuleTrie(rules))
    if len(blob) > MAX_TRIE_BYTES:
        raise ValueError(f"the rules take {len(blob)} bytes, more than {MAX_TRIE_BYTES}")
    shared = spark.sparkContext.broadcast(blob)

    def run(batches):
        import pyarrow as pa
        trie = cloudpickle.loads(shared.value)
        for b in batches:
            hits = [trie.find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([h and h[0] for h in hits], pa.string()),
                 pa.array([h[1] if h else default for h in hits], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"))
    return parsed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
