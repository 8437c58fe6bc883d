"""Compression of vectors to short codes: a codebook per part of the vector, refined by Hamerly's form of Lloyd's
algorithm, in integers throughout.

A vector's components become integers, floor(scale * x), and it is cut into `parts` equal parts. Each part position
has a codebook of `entries` entries; a part is coded by the nearest one (squared Euclidean distance, ties to the
lower index). With every part the table of assignments keeps one upper bound of the distance to its own entry
and one lower bound of the distance to the second nearest. When the entries move, the upper bound grows by the own
entry's way and the lower one shrinks by the longest way of any other. A part whose upper bound is strictly below the
lower one, or below half the way from its entry to the next entry, can't have another nearest one, nor a
tie, and isn't compared. Otherwise the upper bound is made exact first, and only if it still fails are all entries
compared. Bounds are integers in steps of 1/256, rounded away from safety's edge, so they never decide wrongly.

A round is one map over the stored table and one aggregation of sums by part, entry and component, which a task
hands over as one number each (`parts * entries * width` at most). Codebooks have a fixed size, whatever
the number of vectors; nothing else reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

STEP = 256
#: Components beyond it count as it: no distance of theirs would fit a long integer.
LARGEST = 1 << 40
LONGEST = (1 << 63) - 1
_FAR = np.int64(1 << 61)

STATE = "_id {id}, _label {label}, _x array<long>, _code array<int>, _upper array<long>, _lower array<long>"


def _exact(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """As floating-point numbers while all squares and their sums are exact in them, else as Python's integers."""
    small = all(not a.size or int(np.abs(a).max()) < 1 << 22 for a in (x, *others)) and x.shape[-1] <= 64
    return [a.astype(np.float64 if small else object) for a in (x, *others)]


def _above(squared: np.ndarray) -> np.ndarray:
    root = np.sqrt(squared.astype(np.float64)) * STEP
    return np.minimum(np.floor(root * (1 + 2.0**-40)) + 1, float(_FAR)).astype(np.int64)


def _below(squared: np.ndarray) -> np.ndarray:
    root = np.sqrt(squared.astype(np.float64)) * STEP
    return np.maximum(np.minimum(np.floor(root * (1 - 2.0**-40)) - 1, float(_FAR)), 0).astype(np.int64)


@dataclass
class Codebooks:
    """`books`: parts x entries x width, integers. `moved`: how far each entry went in the last update, from above.
    `scanned` and `seen` count the parts compared with all entries and all parts."""

    books: np.ndarray
    moved: np.ndarray = field(init=False)
    scanned: int = 0
    seen: int = 0

    def __post_init__(self) -> None:
        self.moved = np.zeros(self.books.shape[:2], np.int64)

    def update(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries become the floors of their parts' means; unused ones stay."""
        new = self.books.copy()
        for part, entry in zip(*np.nonzero(counts)):
            new[part, entry] = [int(s) // int(counts[part, entry]) for s in sums[part, entry]]
        out = Codebooks(new)
        a, b = _exact(new, self.books)
        way = ((a - b) ** 2).sum(axis=2)
        out.moved = np.where(way == 0, 0, _above(way))
        return out

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Codes and bounds of rows x parts x width, in place. Bounds are those of before the last update."""
        entries = self.books.shape[1]
        for part in range(self.books.shape[0]):
            own, book = _exact(x[:, part], self.books[part])
            moved = self.moved[part]
            first = np.argsort(moved)[-2:]
            rest = np.full(entries, moved[first[-1]])
            rest[first[-1]] = moved[first[0]] if entries > 1 else 0
            norms = (book**2).sum(axis=1)
            between = norms[:, None] - 2 * book.dot(book.T) + norms
            np.fill_diagonal(between, between.max() + 1 if entries > 1 else 1 << 60)
            half = _below(between.min(axis=1)) // 2
            c = code[:, part]
            u, low = upper[:, part] + moved[c], np.maximum(lower[:, part] - rest[c], 0)
            unsure = np.flatnonzero(u >= np.maximum(low, half[c]))
            d = ((own[unsure] - book[c[unsure]]) ** 2).sum(axis=1)
            u[unsure] = _above(d)
            unsure = unsure[u[unsure] >= np.maximum(low[unsure], half[c[unsure]])]
            if len(unsure):
                some = own[unsure]
                d = (some**2).sum(axis=1)[:, None] - 2 * some.dot(book.T) + norms
                best = d.argmin(axis=1)  # the first of equals
                at = np.arange(len(unsure))
                c[unsure], u[unsure] = best, _above(d[at, best])
                if entries > 1:
                    d[at, best] = d.max() + 1
                    low[unsure] = _below(d.min(axis=1))
                else:
                    low[unsure] = _FAR
            code[:, part], upper[:, part], lower[:, part] = c, u, low
            self.scanned += len(unsure)
        self.seen += x.shape[0] * x.shape[1]

    def errors(self, x: np.ndarray, code: np.ndarray) -> list[int]:
        """Squared distances to the own entries, summed over the parts."""
        a, b = _exact(x, self.books[np.arange(x.shape[1]), code])
        return [min(int(e), LONGEST) for e in ((a - b) ** 2).sum(axis=2).sum(axis=1)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width) if width else flat.reshape(len(column), 0)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _integers(values: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of each row, with zeros behind a vector that is shorter than `width`."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    sizes = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(values), width), np.int64)
    row = np.repeat(np.arange(len(values)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def usable(vector: Column) -> Column:
    """Whether it is a vector of numbers: neither null itself nor with null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


@dataclass
class Compressed:
    """`codes`: the id, the label, `codes` (array of entry numbers, a part each) and `error`. `codebooks` as numbers."""

    codes: DataFrame
    codebooks: Codebooks

    def codebook_rows(self) -> DataFrame:
        rows = [(p, e, book) for p, part in enumerate(self.codebooks.books.tolist()) for e, book in enumerate(part)]
        return self.codes.sparkSession.createDataFrame(rows, "part int, entry int, vector array<long>")


def compress_vectors(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Compressed:
    """Codes of all usable vectors. Others, null ones and those with a null or non-finite component, have no row.

    The first codebooks are the parts of the `entries` vectors with the smallest ids (null is the largest; of equal
    ids the smaller vector comes first). With fewer vectors the codebooks are shorter. All vectors are as long as the longest one, made a
    multiple of `parts`, with zeros behind. Repeated rows are coded each. A component's integer is within +-2^40, and
    an error that exceeds a long integer is the largest one. No vectors give no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    kept = vectors.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_v")
    ).where(usable(F.col("_v")))
    longest = kept.agg(F.max(F.size("_v"))).first()[0] or 1
    size = -(-longest // parts) * parts
    width = size // parts
    first = kept.orderBy(F.col("_id").asc_nulls_last(), F.col("_v")).limit(entries).collect()  # `entries` rows
    start = _integers(pa.array([r["_v"] for r in first], pa.list_(pa.float64())), scale, size)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)))
    kinds = {name: kept.schema[f"_{name}"].dataType.simpleString() for name in ("id", "label")}
    schema = STATE.format(**kinds)

    def begin(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = _integers(batch.column("_v"), scale, size)
                yield assigned(batch, x, np.zeros((n, parts), np.int64), np.full((n, parts), _FAR), np.zeros((n, parts), np.int64), books)

    def assigned(batch: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> pa.RecordBatch:
        books.assign(x.reshape(-1, parts, width), code, upper, lower)
        columns = [_lists(x, pa.int64()), _lists(code, pa.int32()), _lists(upper, pa.int64()), _lists(lower, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), *columns], ["_id", "_label", "_x", "_code", "_upper", "_lower"])

    def again(books: Codebooks):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    code, upper, lower = (_numbers(batch.column(c), parts).astype(np.int64) for c in ("_code", "_upper", "_lower"))
                    yield assigned(batch, _numbers(batch.column("_x"), size), code, upper, lower, books)

        return step

    state = materialise(kept.mapInArrow(begin, schema))
    for _ in range(rounds):
        books = books.update(*_sums(state, parts, len(first), width))
        state = materialise(state.mapInArrow(again(books), schema))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, code = _numbers(batch.column("_x"), size).reshape(-1, parts, width), _numbers(batch.column("_code"), parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_label"), batch.column("_code"), pa.array(books.errors(x, code), pa.int64())],
                    ["_id", "_label", "codes", "error"],
                )

    coded = state.select("_id", "_label", "_x", "_code").mapInArrow(final, "_id {id}, _label {label}, codes array<int>, error long".format(**kinds))
    return Compressed(coded.withColumnsRenamed({"_id": id_col, "_label": label_col}), books)


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the assigned parts by part, entry and component, and how many they are."""
    size = parts * width

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x, code = _numbers(batch.column("_x"), size).reshape(-1, width), _numbers(batch.column("_code"), parts)
            slot = (code + np.arange(parts) * entries).ravel()
            own = np.zeros((parts * entries, width), np.int64)  # 10,000 rows of 2^40 at most
            np.add.at(own, slot, x)
            total += own
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        slot, at = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slot, pa.int32()),
                pa.array(at, pa.int32()),
                pa.array(count[slot]),
                pa.array([str(v) for v in total[used].ravel()], pa.string()),
            ],
            ["slot", "at", "n", "total"],
        )

    each = state.select("_x", "_code").mapInArrow(added, "slot int, at int, n long, total string")
    rows = each.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect()
    sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
    for r in rows:
        sums[r.slot // entries, r.slot % entries, r.at] = int(r.total)
        counts[r.slot // entries, r.slot % entries] = r.n
    return sums, counts


def with_label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds `label_error`, the sum of `error` over the rows of equal labels, null ones together. A label's rows are
    summed before the shuffle and get the sum by a join, so a label of a third of all rows is no group of one task."""
    codes = materialise(codes)
    label, total = F.col(label_col), F.sum(F.col("error").cast("decimal(28,0)"))
    sums = materialise(codes.groupBy(label.alias("_of")).agg(F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")))
    return codes.join(sums, codes[label_col].eqNullSafe(sums["_of"])).drop("_of")


def code_digest(compressed: Compressed, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """The id, `code` (two hex digits a part), `error`, `label_error`, `codebooks_sha256`."""
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return with_label_errors(compressed.codes, label_col).select(
        id_col, F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(compressed.codebooks.sha256()).alias("codebooks_sha256")
    )
