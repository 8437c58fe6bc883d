"""Personal data: fixed patterns and bootstrapped contextual extraction; DataFrame operations only.

Base spans come from one pattern per kind. Positions are found without a UDF: matches are wrapped in
two control characters, the text is split there, and running sums of the part lengths over a window
per document and kind are the positions.

The base spans are the seeds of a bootstrap. The word in front of an instance, and the two words in front
of it, are lexical patterns; the instances of a pattern are the seeds and the other identifier-like tokens
(with a digit, outside base spans) that follow it anywhere. Patterns and instances form a graph that is
scored in rounds: a pattern's confidence is the share of its distinct instances that are known, if at
least `min_seeds` of them are. Seeds are known; so is, for a pattern, what another pattern of a
confidence of at least `accept` has found in the round before. So found identifiers support new patterns,
but never the one that found them, and confidences only grow: rounds end when no more patterns are
accepted. Tokens behind an accepted pattern are added as spans of the kind `found`.

Scale: only matches, part lengths and context words leave the scan, not texts. Edges of the graph are
distinct pairs, aggregated before they are shuffled; a popular pattern is a large key of equi-joins
that Spark can split.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KINDS = ["email", "ip", "card", "phone", "found"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: The kinds' patterns, each in a form whose matching takes linear time and no recursion: possessive where
#: nothing that follows could need a character back, and starting only where a leftmost match can start.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+",  # fewer than 16 digits never hold
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "found": r"(?<!\S)[^\s0-9]*+[0-9]\S*+",
}
_NEEDS = {"email": "@", "phone": "+"}
_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"


def _split(text: Column, kind: str) -> Column:
    """The text cut around the matches of a kind; an odd index is a match."""
    marked = F.regexp_replace(text, F.lit(f"({PATTERNS[kind]})"), F.lit(f"{_OPEN}$1{_CLOSE}"))
    if kind in _NEEDS:
        marked = F.when(F.contains(text, F.lit(_NEEDS[kind])), marked).otherwise("")
    return F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)


def _parts(kind: str) -> Column:
    """The parts in column `kind` as an array of (kind number, index, length, value), where the value of an
    even part is the one or two words that end it. Empty without a match."""

    def part(p: Column, i: Column) -> Column:
        words = F.regexp_extract(p, r"(?<!\S)((?:\S++\s++)?\S++)\s*+$", 1)
        word = F.lower(F.regexp_replace(words, r"\s++", " "))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), F.length(p).cast("long").alias("n"), F.when(i % 2 == 1, p).otherwise(word).alias("v")
        )

    return F.transform(F.when(F.size(kind) > 1, F.col(kind)).otherwise(F.array().cast("array<string>")), part)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match keeps its kind's conditions."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == KINDS.index("email"), True)
        .when(kind == KINDS.index("ip"), value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == KINDS.index("card"), F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == KINDS.index("phone"), F.length(digits).between(8, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (`_row`, `_id`), and their matches that hold: `_row`, `k`, `start`, `stop`, `value`, `left` (one or two words in front)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), F.translate(text, _OPEN + _CLOSE, _PLAIN * 2)).otherwise(text)
    slim = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), clean.alias("_text"))
    slim = slim.select("_row", "_id", *(_split(F.col("_text"), k).alias(k) for k in KINDS))
    parts = F.concat(*map(_parts, KINDS))
    # every row leaves a part of kind -1, so one scan gives both results
    blank = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"), F.lit("").alias("v")))
    flat = materialise(slim.select("_row", "_id", F.explode(F.concat(blank, parts)).alias("_p")).select("_row", "_id", "_p.*"))
    window = Window.partitionBy("_row", "k").orderBy("i")
    placed = (
        flat.where("k >= 0")
        .select("_row", "k", "i", "n", F.col("v").alias("value"), F.lag("v").over(window).alias("left"), F.sum("n").over(window).alias("stop"))
        .where("i % 2 = 1")
        .where(_holds(F.col("k"), F.col("value")))
        .select("_row", "k", (F.col("stop") - F.col("n")).alias("start"), "stop", "value", "left")
    )
    return flat.where("k = -1").select("_row", "_id"), placed


def _candidates(placed: DataFrame) -> DataFrame:
    """Base matches, and the tokens outside of them without surrounding punctuation; `seed` tells which."""
    found = KINDS.index("found")
    lead = F.length("value") - F.length(F.regexp_replace("value", r"^[(\"'\[<{]+", ""))
    trail = F.length("value") - F.length(F.regexp_replace("value", r"[.,;:!?)\"'\]>}]++$", ""))
    base_stop = F.when(F.col("k") < found, F.col("stop"))
    base_start = F.when(F.col("k") < found, F.col("start"))
    # both frames grow from their first row, which Spark computes in one pass
    forth = Window.partitionBy("_row").orderBy("start", F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_row").orderBy(F.desc("start"), "k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_before", F.max(base_stop).over(forth))
        .withColumn("_after", F.min(base_start).over(back))
        .withColumn("seed", F.col("k") < found)
        .where("seed or (coalesce(_before, -1) <= start and coalesce(_after, stop) >= stop)")
        .withColumn("_lead", F.when(F.col("seed"), 0).otherwise(lead))
        .withColumn("_trail", F.when(F.col("seed"), 0).otherwise(trail))
        .select(
            "_row",
            "k",
            (F.col("start") + F.col("_lead")).alias("start"),
            (F.col("stop") - F.col("_trail")).alias("stop"),
            F.expr("substring(value, _lead + 1, length(value) - _lead - _trail)").alias("value"),
            "left",
            "seed",
        )
        .where(F.col("seed") | (F.length("value") > 0))
    )


def _contexts(left: str) -> Column:
    """The patterns of the words in front: the last one, and both."""
    return F.array_distinct(F.array(F.element_at(F.split(left, " "), -1), F.col(left)))


def score_graph(edges: DataFrame, min_seeds: int, accept: float, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`edges`: distinct (`left`, `value`) with `seed` (of the value). Returns the patterns that enough known instances
    support (`left`, `confidence`) and the instances' scores (`value`, `score`): 1 for a seed, else the chance
    that not all of its patterns fail, 1 - prod(1 - confidence)."""
    known, before = edges.withColumn("_known", F.col("seed")), 0
    for _ in count() if rounds is None else range(rounds):
        patterns = materialise(
            known.groupBy("left")
            .agg(F.avg(F.col("_known").cast("double")).alias("confidence"), F.count_if("_known").alias("_n"))
            .where(F.col("_n") >= min_seeds)
            .select("left", "confidence")
        )
        accepted = patterns.where(F.col("confidence") >= accept).select("left")
        now = accepted.count()
        if now == before:
            break
        before = now
        found = edges.where("not seed").join(accepted, "left", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("_by"))
        known = edges.join(found, "value", "left").join(accepted.withColumn("_own", F.lit(1)), "left", "left")
        known = known.select("left", "value", (F.col("seed") | (F.coalesce("_by", F.lit(0)) - F.coalesce("_own", F.lit(0)) > 0)).alias("_known"))
    miss = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.coalesce("confidence", F.lit(0.0)))))
    scores = edges.join(patterns, "left", "left").groupBy("value").agg(F.max("seed").alias("_seed"), miss.alias("_miss"))
    return patterns, scores.select("value", F.when(F.col("_seed"), 1.0).otherwise(1 - F.exp("_miss")).alias("score"))


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int | None = None,
    min_seeds: int = 3,
    accept: float = 0.8,
) -> DataFrame:
    """One row per input row: the id and `spans`, an array of (`kind`, `start`, `stop`, `value`) ordered by
    kind as in `KINDS`, then start; positions are code points, half-open.

    Null texts are empty. The control characters U+0001 and U+0002 are read as U+0003, which changes
    no position. A seed or token at the start of a text has no pattern. `rounds`: how many at most; by
    default until nothing changes, at the latest when all patterns are accepted.
    """
    rows, placed = matches(docs, id_col, text_col)
    spans = materialise(_candidates(placed))
    behind = spans.where("left is not null and left <> ''").withColumn("left", F.explode(_contexts("left")))
    seeds = spans.groupBy("value").agg(F.max("seed").alias("seed"))
    edges = materialise(behind.select("left", "value").distinct().join(seeds, "value").select("left", "value", "seed"))
    patterns, _ = score_graph(edges, min_seeds, accept, rounds)
    accepted = patterns.where(F.col("confidence") >= accept).select("left")
    added = behind.where("not seed").join(accepted, "left", "left_semi").dropDuplicates(["_row", "start"]).select(*spans.columns)
    span = F.struct("k", "start", "stop", "value")
    per_row = (
        spans.where("seed").unionByName(added).groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))  # of one text
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    named = F.transform(
        F.coalesce("_spans", F.expr("cast(array() as array<struct<k:int,start:bigint,stop:bigint,value:string>>)")),
        lambda s: F.struct(F.element_at(names, s["k"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")),
    )
    return rows.join(per_row, "_row", "left").select(F.col("_id").alias(id_col), named.alias("spans"))


def personal_data_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, a checksum of the base spans, all spans as text, and the number of those found by their context."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "found")
    return found.select(
        id_col,
        *(count(k) for k in KINDS if k != "found"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("found"),
    )
