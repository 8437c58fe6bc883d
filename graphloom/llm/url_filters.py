"""URL filters by a sort-merge range join over reversed-host keys.

A url's key is its host's labels in reverse, a separator, and its path; one key for the host and for
each parent domain that a rule could name. A rule is then an interval of keys: all that start with
its own key. Keys are sorted and merged with the sorted rules; as prefixes nest, the rules that hold
at a key are a stack, and its top is the longest.

A rule list of at most `max_broadcast_rules` goes to every task, and each batch of urls is swept
where it is: no shuffle. A longer one is dealt by ranges: keys are range-partitioned (a salt spreads
equal keys), each rule goes to the partitions its interval meets, and every partition is swept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, materialise

END = "\x00"
TOP = chr(0x10FFFF)
Rule = tuple[str, str, str]  # verdict, host, path


def key(host: str, path: str) -> str:
    # \x00 ends the host part; inside a host it is escaped
    labels = host.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01").split(".")
    return ".".join(reversed(labels)) + END + path


def parents(host: str, depth: int) -> Iterator[str]:
    """The host and its parent domains, of at most `depth` labels."""
    at = len(host)
    for _ in range(depth):
        at = host.rfind(".", 0, at)
        yield host[at + 1 :]
        if at < 0:
            return


def sweep(keys: Iterable[tuple[str, int]], rules: list[tuple[str, int]]) -> Iterator[tuple[int, int]]:
    """keys: (key, row); rules: (prefix, rule), both sorted. Yields (row, rule) for the longest rule of each key that has one."""
    stack: list[tuple[str, int]] = []
    at = 0
    for k, row in keys:
        while at < len(rules) and rules[at][0] <= k:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not k.startswith(stack[-1][0]):
            stack.pop()
        if stack:
            yield row, stack[-1][1]


def _prepared(rules: list[Rule]) -> list[Rule]:
    """One rule for each host and path; where both verdicts are given, block."""
    best: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        host = host.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
        best[host, path] = "block" if verdict == "block" else best.get((host, path), verdict)
    return [(v, h, p) for (h, p), v in sorted(best.items())]


def _longest(rule: Rule) -> tuple[int, int]:
    return len(rule[1]) + len(rule[2]), len(rule[1])


def url_parts(url: str) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), ASCII_UPPER, ASCII_LOWER), F.regexp_extract(text, pattern, 2)


def judge_urls(
    pages: DataFrame,
    rules: list[Rule] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = 50_000,
) -> DataFrame:
    """One row per input row: the id, `host`, `path`, `rule` (host and path of the longest rule that
    fits, else null) and `verdict` (the rule's, else `default`).

    `rules`: (verdict, host, path), as a list or a DataFrame of these columns. A rule with more
    characters in host and path together is longer; then the longer host. A null url, or one without
    `://`, has an empty host and path; only a rule with an empty host can fit it. Rows of `rules`
    with a null host or path are empty there; with a null verdict they block.
    """
    host, path = url_parts(url_col)
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["_id"].dataType.simpleString()
    if isinstance(rules, DataFrame):
        rules = rules.select(F.coalesce("verdict", F.lit("block")).alias("verdict"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        few = rules.limit(max_broadcast_rules + 1).collect()
        if len(few) > max_broadcast_rules:
            return _by_ranges(parts, rules, id_col, default)
        rules = [tuple(r) for r in few]
    elif len(rules) > max_broadcast_rules:
        return _by_ranges(parts, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), id_col, default)
    table = _prepared(rules)
    prefixes = sorted((key(h, p), i) for i, (_, h, p) in enumerate(table))
    depth = max([h.count(".") + 1 for _, h, _ in table], default=0)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[int | None] = [None] * len(pdf)
            keys = sorted((key(d, p), i) for i, (h, p) in enumerate(zip(pdf["host"], pdf["path"])) for d in parents(h, depth))
            for row, rule in sweep(keys, prefixes):
                if found[row] is None or _longest(table[rule]) > _longest(table[found[row]]):
                    found[row] = rule
            yield pdf.assign(
                rule=[None if r is None else table[r][1] + table[r][2] for r in found],
                verdict=[default if r is None else table[r][0] for r in found],
            )

    return parts.mapInPandas(judged, f"_id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("_id", id_col)


def _by_ranges(parts: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    rules = rules.groupBy(F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(
        F.max("verdict").alias("r_verdict")  # 'block' > 'allow'
    )
    depth = (rules.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0]) or 0
    urls = materialise(parts.withColumn("_row", F.monotonically_increasing_id()))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(r, key(d, p)) for r, h, p in zip(pdf["_row"], pdf["host"], pdf["path"]) for d in parents(h, depth)]
            yield pd.DataFrame(made, columns=["_row", "_key"]).astype({"_row": "int64"})

    def ruled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_key=[key(h, p) for h, p in zip(pdf["r_host"], pdf["r_path"])])

    keys = urls.select("_row", "host", "path").mapInPandas(keyed, "_row long, _key string")
    keys = materialise(keys.repartitionByRange("_key", F.xxhash64("_row")).withColumn("_part", F.spark_partition_id()))
    spans = keys.groupBy("_part").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))  # a row per partition
    met = materialise(rules.mapInPandas(ruled, "r_host string, r_path string, r_verdict string, _key string").join(
        F.broadcast(spans), (F.col("_key") <= F.col("_hi")) & (F.concat("_key", F.lit(TOP)) >= F.col("_lo"))
    ).select("r_host", "r_path", "r_verdict", F.col("_key"), F.col("_part")))

    def swept(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(theirs["r_verdict"], theirs["r_host"], theirs["r_path"]))
        hits = sweep(sorted(zip(mine["_key"], mine["_row"])), sorted(zip(theirs["_key"], range(len(rows)))))
        made = [(row, *_longest(rows[i]), rows[i][1] + rows[i][2], rows[i][0]) for row, i in hits]
        return pd.DataFrame(made, columns=["_row", "_all", "_host", "rule", "verdict"]).astype({"_row": "int64", "_all": "int64", "_host": "int64"})

    best = (
        keys.groupBy("_part").cogroup(met.groupBy("_part")).applyInPandas(swept, "_row long, _all long, _host long, rule string, verdict string")
        .groupBy("_row").agg(F.max(F.struct("_all", "_host", "rule", "verdict")).alias("_best"))
    )
    return urls.join(best, "_row", "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
