"""Product codes of vectors by Lloyd's algorithm whose members stay with their entry.

1. Vectors become whole numbers and are cut into equal parts; each part position has a
   codebook of its own, at first the parts of the vectors with the smallest ids.
2. Every part is assigned to its nearest entry and sent, once, to the partition of
   (position, entry, salt); the salt deals an entry with many members to many partitions.
3. An entry's owners add up the members they hold, and the sums of all owners give the new
   entry: as many rows as there are entries, whatever the number of vectors.
4. Members are assigned again where they lie. Those that keep their entry stay; only those that
   change it go through the next shuffle, to their new owners.
5. At last the members' entries and distances come together by vector.

A state is two written tables, of those that stay and of those that move, so a lost executor costs a read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stream_arrow, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Members of one owner, if all vectors had the same entry; and salts at most.
OWNED, SALTS = 1024, 4096
#: Parts that a task assigns at once.
BATCH = 8192
#: Scaled components stay below this, so that all sums of squares are exact.
LIMIT = 1 << 26

MEMBER = "row bigint, position int, entry int, x array<bigint>, distance bigint"


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and those as whole numbers; all must have one length."""
    lists = vectors.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    flat, parent = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
    bad = ~np.isfinite(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)))
    good = lengths >= 0
    good[parent[bad]] = False
    if not good.any():
        return good, np.zeros((0, 0), np.int64)
    if len(set(lengths[good].tolist())) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths[good].tolist()))}")
    x = np.floor(np.asarray(flat.fill_null(np.nan))[good[parent]].reshape(int(good.sum()), -1) * SCALE)
    if np.abs(x).max(initial=0) >= LIMIT:
        raise ValueError(f"a component times {SCALE} is not below {LIMIT}")
    return good, x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance; ties go to the lower index."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    entry = d.argmin(axis=1)
    return entry, d[np.arange(len(x)), entry]


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """``(row, id, label, x)``: the vectors that are kept, as whole numbers, each with a number of its own."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    chosen = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterable[list]:
        for b in batches:
            good, x = whole(b.column("v"))
            mask = pa.array(good)
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield [b.column("id").filter(mask), b.column("label").filter(mask), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))]

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    rows = stream_arrow(chosen, scale, f"id {kinds['id']}, label {kinds['label']}, x array<bigint>")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "x"), "vectors")


def _members(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The parts of whole vectors, each with its nearest entry."""
    parts, _, width = books.shape

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[list]:
        for b in batches:
            n = b.num_rows
            x = np.asarray(b.column("x").flatten()).reshape(n, parts, width)
            found = [nearest(x[:, k], books[k]) for k in range(parts)]
            entry, distance = (np.stack([f[k] for f in found], axis=1) for k in (0, 1))
            offsets = pa.array(np.arange(n * parts + 1) * width, pa.int32())
            yield [np.repeat(np.asarray(b.column("row")), parts), np.tile(np.arange(parts), n), entry.ravel(), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), distance.ravel()]

    return stream_arrow(rows.select("row", "x"), cut, MEMBER, BATCH // parts)


def _reassigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members with the entry that is nearest now, in the partition where they lie, and whether it is another."""
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterable[list]:
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, width)
            position, before = np.asarray(b.column("position")), np.asarray(b.column("entry"))
            entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for k in np.unique(position):
                own = position == k
                entry[own], distance[own] = nearest(x[own], books[k])
            yield [b.column("row"), position, entry, b.column("x"), distance, entry != before]

    return stream_arrow(members, assign, f"{MEMBER}, moved boolean", BATCH)


def _owned(members: DataFrame, salts: int) -> DataFrame:
    """Members sent to the partitions of their owners."""
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt")
    return members.select("*", salt).repartition("position", "entry", "salt").drop("salt")


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """New entries: the floor of each component's mean over the members; an entry without members stays."""
    width = books.shape[2]
    sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *(F.sum(F.get("x", k)).alias(f"s{k}") for k in range(width)))
    new = books.copy()
    for r in sums.collect():  # a row for each entry
        new[r["position"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return new


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    on_round: Callable[[int, DataFrame, DataFrame], None] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error)`` for each kept vector, and the codebooks ``[part, entry, component]``.

    Vectors that are null or hold null or non-finite components are dropped. Components become
    ``floor(256 * x)``, and vectors are cut into ``parts`` equal parts, of which their length must be a
    multiple. The codebooks start as the parts of the ``entries`` vectors of the smallest ids (ties by
    components, null last; fewer vectors make fewer entries) and go through ``rounds`` of assignment and update.
    ``code`` is two hexadecimal digits a part, so at most 256 entries; ``error`` is the squared distance to the
    entries. Repeated rows and ids are vectors of their own and each get a row. Vectors of different lengths, or components
    that times 256 reach 2^26, are errors. Without a kept vector there are no rows, and no codebooks.
    ``on_round`` is told the number of a round and the members that stayed and moved in it.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    first = [r.x for r in rows.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]
    if not first:
        kinds = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kinds[0]}, label {kinds[1]}, code string, error bigint"), np.zeros((0, 0, 0), np.int64)
    if not len(first[0]) or len(first[0]) % parts or any(len(x) != len(first[0]) for x in first):
        raise ValueError(f"vectors of length {len(first[0])} cannot be cut into {parts} equal parts")
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    salts = min(SALTS, -(-rows.count() // OWNED))

    resident = written(_owned(_members(rows, books), salts), "members")
    for k in range(rounds):
        if k:
            assigned = written(_reassigned(resident, books), "assigned", by=["moved"])
            stay, move = assigned.where("not moved").drop("moved"), assigned.where("moved").drop("moved")
            if on_round:
                on_round(k, stay, move)
            resident = stay.unionByName(written(_owned(move, salts), "arrived"))
        books = _updated(resident, books)
    last = _reassigned(resident, books)

    # eight entries fill a 64-bit number: positions 0 to 7, 8 to 15 and so on
    words = range(-(-parts // 8))
    packed = [F.bit_or(F.when(F.expr(f"position div 8 = {w}"), F.expr("shiftleft(cast(entry as bigint), 8 * (7 - position % 8))")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in words]
    coded = last.groupBy("row").agg(*packed, F.sum("distance").alias("error"))
    code = F.substring(F.concat(*(F.lpad(F.lower(F.hex(f"w{w}")), 16, "0") for w in words)), 1, 2 * parts)
    return rows.select("row", "id", "label").join(coded, "row").select("id", "label", code.alias("code"), "error"), books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)``: codes with the error of all vectors of the label, nulls together.

    See ``codes`` for what is kept and how ties, repeats and odd input count; other columns are ignored, whatever their names.
    """
    coded, books = codes(vectors, parts, entries, rounds, id_col, vector_col, label_col)
    coded = written(coded, "coded")
    by_label = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with ``decoded``: the components that a code stands for."""
    book = F.array(*(F.array(*(F.array(*map(F.lit, map(int, e))) for e in part)) for part in books))
    place = lambda k: F.conv(F.substring("code", k * 2 + 1, 2), 16, 10).cast("int")
    found = F.flatten(F.array(*(F.get(F.get(book, k), place(k)) for k in range(len(books)))))
    return coded.withColumn("decoded", F.transform(found, lambda c: c / F.lit(float(SCALE))))
