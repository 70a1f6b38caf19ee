"""MinHash near-duplicate detection: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges.

1. Each text becomes a set of hashed word shingles. One permutation fills the bins
   of its signature (the smallest hash of each bin); an empty bin borrows from
   another, chosen by a hash of bin and attempt until one is filled.
2. Texts with equal sets form a class; one row of each class goes on.
3. Rows of the signature form bands, and classes with equal bands meet in a bucket.
   A bucket of m classes yields m - 1 edges, from its smallest class to the others,
   which are confirmed on full sets. A centre that fails with some members may hide
   links between others, so the classes of such buckets, while these hold several
   components, are searched again: linked sets share one of their rarest shingles,
   counting as many of each as the threshold asks for, so these are buckets again. Every
   two members of such a bucket that still holds several components are tested: classes
   are dealt to blocks, by the largest of their buckets, and two blocks that meet in a
   bucket are tested against each other once, as a product of matrices.
4. Confirmed edges are joined to components by label propagation with shortcuts.

Every aggregate has a partial step, and the sides of every join with a hot key are
tables, so that the join stands directly on its exchanges and Spark splits them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _M1, _S32, as_bytes, map_arrow, mix, scope, slices, text_or_empty, windows, word_hashes, written

ROWS = 5
#: A link at the threshold shares no band with this probability at most.
MISS = 1e-8
ATTEMPTS = 4096
#: Classes, and shingles, of one block on average, at most.
LARGE, BLOCK_SHINGLES = 128, 1 << 18
#: Columns of one matrix.
COLUMNS = 4096


def bands_for(at_least: int, of: int) -> int:
    """Bands of ``ROWS`` rows needed at a similarity of ``at_least / of``."""
    return math.ceil(math.log(MISS) / math.log1p(-((at_least / of) ** ROWS)))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``size``-word shingles; of all its words, if fewer."""
    out = []
    for a, b in slices(texts):
        h, counts = word_hashes(texts[a:b])
        all_windows, at = windows(h, size), 0
        for n in counts.tolist():
            out.append(np.unique(all_windows[at : at + n - size + 1]) if n >= size else windows(h[at : at + n], n) if n else h[:0])
            at += n
    return out


def class_digest(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; null for the empty set."""
    if not len(s):
        return None
    halves = mix(s ^ _M1).sum(dtype=np.uint64), mix(s * _M1 ^ _S32).sum(dtype=np.uint64)
    return np.array(halves, dtype="<u8").tobytes()


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures of non-empty sets, densified."""
    n = len(sets)
    sig, filled = np.zeros((n, bins), dtype=np.uint64), np.zeros((n, bins), dtype=bool)
    for k, s in enumerate(sets):
        own = (((s >> _S32) * np.uint64(bins)) >> _S32).astype(np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))  # sets are sorted, so are their bins
        sig[k, own[first]] = s[first]
        filled[k, own[first]] = True
    source = np.random.default_rng(8).integers(0, bins, size=(ATTEMPTS, bins))
    rows, cols = np.nonzero(~filled)
    for attempt in source:
        if not len(rows):
            break
        pick = attempt[cols]
        hit = filled[rows, pick]
        sig[rows[hit], cols[hit]] = sig[rows[hit], pick[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return sig


def band_hashes(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """The hashes of each set's bands."""
    sig = signatures(sets, bands * ROWS).reshape(len(sets), bands, ROWS)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
    for k in range(ROWS):
        h = mix(h * _M1 ^ sig[:, :, k])
    return h.view(np.int64)


def _sketches(docs: DataFrame, bands: int, size: int, least: int) -> DataFrame:
    kind = docs.schema["_id"].dataType.simpleString()

    def columns(b: pa.RecordBatch) -> list:
        sets = shingle_sets(as_bytes(b.column(1)), size)
        large = [k for k, s in enumerate(sets) if len(s) >= least]
        of: list = [None] * len(sets)
        for k, h in zip(large, band_hashes([sets[k] for k in large], bands)) if large else []:
            of[k] = h
        return [b.column(0), [len(s) for s in sets], [class_digest(s) for s in sets], of]

    return map_arrow(docs, columns, f"_id {kind}, n bigint, cls binary, bands array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def columns(b: pa.RecordBatch) -> list:
        sets = shingle_sets(as_bytes(b.column(1)), size)
        return [[class_digest(s) for s in sets], [s.view(np.int64) for s in sets]]

    return map_arrow(docs, columns, "cls binary, shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """``(center, cls, linked)`` for each pair, from full sets; sets of repeated rows repeat a pair."""
    both = pairs.join(sets, "cls").join(sets.select(F.col("cls").alias("center"), F.col("shingles").alias("other")), "center")
    common = F.size(F.array_intersect("shingles", "other"))
    linked = of * common >= at_least * (F.size("shingles") + F.size("other") - common)
    return both.select("center", "cls", linked.alias("linked"))


def _links(tested: DataFrame) -> DataFrame:
    return tested.where("linked").select(F.col("center").alias("a"), F.col("cls").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of each node of the edges ``(a, b)``: one label for each component, its smallest node."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("new"))
        moved = written(moved, "moved")
        jump = moved.select(F.col("u").alias("new"), F.col("new").alias("far"))
        after = written(moved.join(jump, "new").select("u", "label", F.least("new", "far").alias("after")), "labels")
        if not after.where("label <> after").limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("after").alias("label"))
        labels = after.select("u", F.col("after").alias("label"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with ``comp``, the component of ``cls`` as far as it is known."""
    return members.join(labels, members["cls"] == labels["node"], "left").select(*members.columns, F.coalesce("label", "cls").alias("comp"))


def _rarest(sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """``(key, cls, n)``: the shingles of each set of which two linked sets share at least one.

    In one order of all shingles, by how many sets have them, two linked sets agree in one of
    the first ``n - ceil(n * at_least / of) + 1`` of each. Shingles of one set come
    first and lead to none, so they are counted and not kept.
    """
    rows = sets.select(F.explode("shingles").alias("key"), "cls", F.size("shingles").alias("n"))
    shared = written(rows.groupBy("key").agg(F.count("*").alias("in_sets")).where("in_sets > 1"), "shared")
    by_set = Window.partitionBy("cls")
    place, n_shared = F.row_number().over(by_set.orderBy("in_sets", "key")), F.count("*").over(by_set)
    kept = rows.join(shared, "key").select("key", "cls", "n", place.alias("place"), n_shared.alias("n_shared"))
    return kept.where(of * (F.col("n_shared") + 1 - F.col("place")) >= at_least * F.col("n")).select("key", "cls", "n")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))

    def cells(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    if not len(both):
        return out
    (cols_a, rows_a), (cols_b, rows_b) = cells(a, rows_a), cells(b, rows_b)
    for start in range(0, len(both), COLUMNS):
        part = []
        for cols, rows, n in ((cols_a, rows_a, len(left)), (cols_b, rows_b, len(right))):
            lo, hi = np.searchsorted(cols, (start, start + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(both) - start)), dtype=np.float32)
            m[rows[lo:hi], cols[lo:hi] - start] = 1
            part.append(m)
        out += np.rint(part[0] @ part[1].T).astype(np.int64)
    return out


def block_links(left: list[np.ndarray], right: list[np.ndarray], at_least: int, of: int) -> list[tuple[int, int]]:
    """Links between two lists of sets: as many as join what all links between them join."""
    common = _common(left, right)
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    top = list(range(len(left) + len(right)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(of * common >= at_least * (sizes - common)))):
        x, y = find(a), find(len(left) + b)
        if x != y:
            top[x] = y
            out.append((a, b))
    return out


def _searched(members: DataFrame, sets: DataFrame, labels: DataFrame, at_least: int, of: int) -> DataFrame:
    """Links ``(a, b)`` that join all linked sets meeting in a bucket ``(key, cls, n)`` of several components."""
    members = _labelled(members, labels)
    found = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("lo < hi")
    parts = F.ceil(F.greatest(F.col("size") / LARGE, F.col("shingles") / BLOCK_SHINGLES)).alias("parts")
    members = written(members.join(written(found.select("key", "size", parts), "mixed"), "key"), "members")
    # a bucket's classes mostly have the same home, so that they make few blocks
    home = members.groupBy("cls", "comp").agg(F.max(F.struct("size", "key", "parts")).alias("home"))
    home = written(home.select("cls", "comp", F.xxhash64("home.key", F.pmod(F.xxhash64("cls"), "home.parts")).alias("block")), "homes")
    blocks = home.join(sets, "cls").groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.collect_list(F.struct("cls", "shingles")).alias("sets"))
    blocks = written(blocks, "blocks")
    met = written(members.select("key", "cls").join(home.select("cls", "block"), "cls").select("key", "block").distinct(), "met")
    pairs = met.join(met.select("key", F.col("block").alias("other")), "key").where("block <= other").select("block", "other").distinct()
    ends = blocks.select("block", "lo", "hi")
    ends = pairs.join(ends, "block").join(ends.select(F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "other")
    pairs = written(ends.where("least(lo, lo2) < greatest(hi, hi2)").select("block", "other"), "pairs")
    both = pairs.join(blocks.select("block", F.col("sets.cls").alias("a"), F.col("sets.shingles").alias("left")), "block")
    both = both.join(blocks.select(F.col("block").alias("other"), F.col("sets.cls").alias("b"), F.col("sets.shingles").alias("right")), "other")

    def columns(batch: pa.RecordBatch) -> list:
        out: list = [[], []]
        a, left, b, right = batch.columns
        for k in range(batch.num_rows):
            own, other = ([x.values.to_numpy() for x in c[k].values] for c in (left, right))
            for i, j in block_links(own, other, at_least, of):
                out[0].append(a[k].values[i])
                out[1].append(b[k].values[j])
        return [[x.as_py() for x in c] for c in out]

    links = map_arrow(both.select("a", "left", "b", "right"), columns, "a binary, b binary")
    return written(links.where("a <> b"), "links")


def near_duplicates(docs: DataFrame, at_least: int = 80, of: int = 100, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``at_least / of`` or more.

    A-Z count as a-z; words are runs of characters other than ASCII white space; a set
    holds the distinct ``size``-word shingles, or all words as one if there are fewer.
    One row ``(id, n_shingles, component_id, kept)`` for each row of ``docs``:
    ``component_id`` is the smallest id reachable over links, ``kept`` tells whether it
    is the row's own. Null and blank texts have empty sets and no links, hence their own
    id; repeated rows are equal texts and share a component; rows of one id with other
    texts are linked by their texts only; a null id is no component's smallest if
    others are there. Other columns are ignored, whatever their names.
    """
    with scope(docs.sparkSession) as kept:
        return kept(written(_near_duplicates(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), at_least, of, size), "near-dup")).withColumnRenamed("_id", id_col)


def _near_duplicates(docs: DataFrame, at_least: int, of: int, size: int) -> DataFrame:
    bands = bands_for(at_least, of)
    # smaller sets reach the threshold only with equal sets
    least = next(n for n in range(1, 10**6) if n * of >= at_least * (n + 1)) if at_least < of else 10**9
    sketches = written(_sketches(docs, bands, size, least), "sketches")
    classes = written(sketches.where("cls is not null").groupBy("cls").agg(F.min("_id").alias("doc"), F.first("bands").alias("bands")), "classes")

    rows = classes.where("bands is not null").select("cls", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.min("cls").alias("center"), F.max("cls").alias("last")).where("center < last").drop("last")
    star = written(rows.join(written(buckets, "buckets"), "key").where("cls <> center"), "star")
    pairs = written(star.select("center", "cls").distinct(), "pairs")
    wanted = pairs.select("cls").union(pairs.select("center")).distinct()
    ids = classes.join(wanted, "cls", "left_semi").select(F.col("doc").alias("_id")).distinct()
    wanted_docs = docs.join(ids.hint("shuffle_hash"), "_id", "left_semi")
    # null ids, of which there may be many, would be one key of a join
    if ids.where("_id is null").limit(1).count():
        wanted_docs = wanted_docs.unionByName(docs.where("_id is null"))
    sets = written(_sets(wanted_docs, size), "sets")
    tested = written(_confirmed(pairs, sets, at_least, of), "confirmed")
    links = _links(tested)
    labels = components(links)

    unsure = written(star.join(tested.where("not linked"), ["center", "cls"], "left_semi").select("key").distinct(), "unsure")
    members = _labelled(star.join(unsure, "key", "left_semi").select("key", "cls"), labels)
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    residue = members.join(written(mixed, "mixed"), "key", "left_semi").select("cls").distinct()
    residue = written(sets.join(residue, "cls", "left_semi").dropDuplicates(["cls"]), "residue")
    found = _searched(written(_rarest(residue, at_least, of), "members"), residue, labels, at_least, of)
    if found.limit(1).count():
        labels = components(links.unionByName(found))

    found = written(labels.join(classes.select(F.col("cls").alias("node"), "doc"), "node"), "nodes")
    smallest = written(found.groupBy("label").agg(F.min("doc").alias("smallest")), "smallest")
    found = found.join(smallest, "label").select(F.col("node").alias("cls"), "smallest")
    of_class = classes.join(found, "cls", "left").select("cls", F.coalesce("smallest", "doc").alias("_component"))
    component = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return sketches.join(written(of_class, "component"), "cls", "left").select(
        "_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept")
    )
