"""URL filters as a sort-merge range join.

A host is turned into its labels from the right, each closed by the lowest character there is. A rule's host
then is a prefix, and a prefix is an interval of sorted keys that holds the host and all its
subdomains and nothing else; intervals of two rules are nested or apart. Rules and URLs are dealt into
ranges of keys, sorted together and swept once: a rule that opens is put on a stack, one whose interval
has ended is taken off, and a URL is judged by the rules on the stack, whose paths are tested there.

* Ranges are cut by key and URL hash, so a host with a third of all rows spreads over many ranges. The
  cuts are fitted on a sample of ``SAMPLE`` keys a range and only balance the load; every row is swept.
* A rule goes to every range its interval meets, so each range starts with the rules open there. The
  wide ones among them are the ancestors of one host.
* The sweep runs in Arrow batches and holds the stack only.

Defined results: null and URLs without ``://`` have an empty host and path and fit no rule with a host.
Of the rules that fit, the longest (host and path together, then host) wins; of two equal rules that
differ in their verdict, ``block`` counts. Rules without a host or with nulls are left out. No rule:
``default``. Repeated rows are judged each for itself. Other columns, whatever their names, are carried in ``page``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.common import fold, keep_whole

DEFAULT = "allow"
#: Keys sampled per range to place the cuts, and ranges per shuffle partition.
SAMPLE, RANGES = 20, 4
_END, _NEXT = "\x01", "\x02"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, ``A-Z`` folded."""
    return fold(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the right, each closed by the lowest character; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _END), F.lit(_END))
    )


def _cuts(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys that part the rows about evenly, from a bounded sample."""
    total, wanted = keys.count(), ranges * SAMPLE
    if total == 0 or ranges < 2:
        return []
    taken = keys if total <= wanted else keys.sample(min(1.0, wanted / total), seed=1)
    seen = sorted(r[0] for r in taken.limit(2 * wanted).collect())
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``(page, host, path, rule, verdict)`` of every page; ``rules`` has ``(host, path, verdict)``."""
    spark = pages.sparkSession
    parts = pages.select(keep_whole(pages, "page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    spread = F.hex(F.xxhash64("page"))
    urls = parts.select("page", "host", "path", F.concat(host_key(F.col("host")), F.lit("\0"), spread).alias("key"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(urls.select("key"), partitions * RANGES)

    @F.pandas_udf(T.IntegerType())
    def range_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(cuts, k)).astype("int32")

    opened = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.lit(None).cast(urls.schema["page"].dataType).alias("page"),
        F.col("host"),
        F.col("path"),
        F.col("verdict"),
        host_key(F.col("host")).alias("key"),
    )
    # A range needs a rule if a key of it can lie in the rule's interval.
    after = F.concat(F.expr("left(key, length(key) - 1)"), F.lit(_NEXT))
    reach = opened.select("*", range_of("key").alias("low"), range_of(after).alias("high"))
    dealt_rules = reach.select(
        "page", "host", "path", "verdict", "key", F.lit(0).alias("kind"), F.explode(F.sequence("low", "high")).alias("range")
    )
    dealt_urls = urls.select(
        "page", "host", "path", F.lit(None).cast("string").alias("verdict"), "key", F.lit(1).alias("kind"), range_of("key").alias("range")
    )
    rows = dealt_rules.unionByName(dealt_urls).repartition(partitions, "range").sortWithinPartitions("range", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Stack entries: key of the host, the host, its paths with verdicts, the lengths of the paths.
        stack: list[tuple[str, str, dict[str, str], set[int]]] = []
        at = None
        for batch in batches:
            taken, named, verdicts = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict"))
            for i, (span, key, kind, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if span != at:
                    at, stack = span, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, set()))
                    known = stack[-1][2].get(path)
                    stack[-1][2][path] = verdict if known in (None, verdict) else "block"
                    stack[-1][3].add(len(path))
                    continue
                best = (-1, -1, None, default)
                for _, owner, paths, lengths in stack:
                    if host != owner and not host.endswith("." + owner):
                        continue
                    for n in sorted(lengths, reverse=True):
                        if n <= len(path) and (said := paths.get(path[:n])) is not None:
                            best = max(best, (len(owner) + n, len(owner), owner + path[:n], said))
                            break
                taken.append(i)
                named.append(best[2])
                verdicts.append(best[3])
            if taken:
                kept = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("page"), kept.column("host"), kept.column("path"), pa.array(named, pa.string()), pa.array(verdicts, pa.string())],
                    names=["page", "host", "path", "rule", "verdict"],
                )

    schema = T.StructType(
        [T.StructField("page", urls.schema["page"].dataType)]
        + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    )
    return rows.select("range", "key", "kind", "host", "path", "verdict", "page").mapInArrow(sweep, schema)
