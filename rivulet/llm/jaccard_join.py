"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document's set holds its runs of five consecutive white-space words (a text of one to four words is one run), as
64-bit hashes. Documents with equal sets form a class; only one member of each goes on. Steps:

1. Signatures: ``HASHES`` MinHash values for each set, and ``BANDS`` band keys, each of ``ROWS`` values. A pair at the
   threshold 0.8 misses all bands with a chance of (1 - 0.8^4)^28 = 4 x 10^-7.
2. Candidates: members of one band bucket. Of buckets with the same members in several bands only the first band's is
   kept, so copies in pairs meet once. A bucket of more than ``BLOCK`` members is cut into blocks, and every pair of
   blocks becomes a group of its own: no group exceeds 2 x ``BLOCK`` members, and no pair is ever left out.
3. Pruning (BayesLSH): in each group the MinHash values of the pairs are compared ``STEP`` at a time. After n values
   with m equal, the similarity's posterior from a uniform prior is Beta(m + 1, n - m + 1); a pair is dropped once its
   mass at or above the threshold is below ``TOLERANCE``. A pair is looked at in the first band where it collides alone.
4. Exact check: the sets of the members that are left are made again from their texts, joined to their groups and
   intersected (as a product of
   0/1 matrices in larger groups); |A and B| >= threshold |A or B| makes a link. A group gives, for each member, its
   number of links and the least member it is connected to within the group, never the pairs themselves, so a group of
   k near copies makes rows in the order of k.
5. Classes: connected components of these stars by min-label steps with written tables between them.

Defined cases: null and blank texts have an empty set: they are each other's copies and link to nothing else; repeated
rows stay repeated; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import arrow_map, materialize, sorted_groups, words_of

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 28
HASHES = ROWS * BANDS
STEP, TOLERANCE = 16, 1e-7
BLOCK = 512
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word runs."""
    at, index, names = words_of(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    flat = hashes[index] if len(index) else np.zeros(0, np.uint64)
    n = max(0, len(flat) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs = _mix(runs + flat[k : k + n] + np.uint64(k + 1))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(b - a):
                x = _mix(x + flat[a + k : a + k + 1] + np.uint64(101 + k))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:HASHES] | np.uint64(1), seed[HASHES:]


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    a, b = _permutations()
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 256):
        x = values[k : k + 256, None] * a + b
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _M2 + rows[:, k])
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each n of values compared, the least number of equal ones that a pair may have and stay."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) -> (class, shingles), without texts of other classes, which a repeated id may bring."""
    for batch in batches:
        sets = shingle_sets(batch.column(1).fill_null(""))
        rows = [(c, s.tobytes()) for c, s in zip(batch.column(0).to_pylist(), sets) if class_key(s) == c]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ()))], names=["class", "shingles"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = batch.column(1).fill_null("").dictionary_encode()
        sets = shingle_sets(coded.dictionary)
        rows = []
        for s in sets:
            sig = signature(s)
            rows.append((class_key(s), sig.tobytes(), band_keys(sig) if len(s) else np.zeros(0, np.int64)))
        index = coded.indices.to_numpy(zero_copy_only=False)
        take = pa.array(index)
        keys, sigs, bands = zip(*rows) if rows else ((),) * 3
        columns = [pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(list(bands), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(c.take(take) for c in columns)], names=["doc_id", "class", "signature", "bands"])


_PAIR_SCHEMA = "grp binary, class binary, member int, members int, partners binary"


def _equal_matrix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows of keys, whether row i of one and row j of the other agree in each column, summed over columns."""
    out = np.zeros((len(left), len(right)), np.int32)
    for k in range(left.shape[1]):
        out += left[:, k][:, None] == right[:, k][None, :]
    return out


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (key, x, y, band) of members with signatures -> members that keep a partner, with partners as bits."""
    least = least_matches()
    held: list[tuple] = []
    for group in sorted_groups(batches, ["key", "x", "y"]):
        band, x, y = group["band"][0].as_py(), group["x"][0].as_py(), group["y"][0].as_py()
        block = group["block"].to_numpy()
        order = np.argsort(block != x, kind="stable")
        classes = group["class"].to_pylist()
        sigs = np.stack([np.frombuffer(s, np.uint32) for s in group["signature"].to_pylist()])[order]
        n = len(order)
        left = int((block == x).sum())
        a, b = (np.arange(n), np.arange(n)) if x == y else (np.arange(left), np.arange(left, n))
        keep = a[:, None] < b[None, :]
        rows = sigs.reshape(n, BANDS, ROWS)
        for k in range(band):  # pairs that met in an earlier band are that band's
            if not keep.any():
                break
            keep &= ~(rows[a, k][:, None, :] == rows[b, k][None, :, :]).all(axis=2)
        equal = np.zeros(keep.shape, np.int32)
        for k in range(0, HASHES, STEP):
            if not keep.any():
                break
            equal += _equal_matrix(sigs[a, k : k + STEP], sigs[b, k : k + STEP])
            keep &= equal >= least[k + STEP]
        if not keep.any():
            continue
        full = np.zeros((n, n), bool)
        full[np.ix_(a, b)] = keep
        some = np.flatnonzero(full.any(axis=0) | full.any(axis=1))
        full = full[np.ix_(some, some)]
        name = group["key"][0].as_py().to_bytes(8, "little", signed=True) + bytes(f"{x},{y}", "ascii")
        bits = np.packbits(full, axis=1)
        for i, m in enumerate(some.tolist()):
            held.append((name, classes[order[m]], i, len(some), bits[i].tobytes()))
        if len(held) > 2048:
            yield _pair_rows(held)
            held = []
    if held:
        yield _pair_rows(held)


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["grp", "class", "member", "members", "partners"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of members with sets and candidate partners -> (class, links, root) for members with links."""
    held: list[tuple] = []
    for group in sorted_groups(batches, ["grp"]):
        n = group["members"][0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        classes = group["class"].to_pylist()
        pairs = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in group["partners"].to_pylist()]).astype(bool)
        sizes = np.array([len(s) for s in sets])
        both = _intersections(sets, pairs)
        linked = pairs & (both >= THRESHOLD * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
        linked |= linked.T
        links = linked.sum(axis=1)
        root = np.arange(n)
        while True:  # least member of each connected part of the group
            low = np.where(linked, root[None, :], n).min(axis=1)
            new = np.minimum(root, low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        held += [(classes[i], int(links[i]), classes[root[i]]) for i in np.flatnonzero(links).tolist()]
        if len(held) > 4096:
            yield _link_rows(held)
            held = []
    if held:
        yield _link_rows(held)


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=["class", "links", "root"])


def _intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if n <= 6:
        for i, j in zip(*np.nonzero(pairs)):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # a run of one member alone is in no intersection
    column_of = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], column_of[column[keep]]
    width = max(64, (8 << 20) // (4 * n))
    total = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        total += m @ m.T
    return np.rint(total).astype(np.int64)


def _components(stars: DataFrame) -> DataFrame:
    """(node, label): least node of each component of the edges (class, root)."""
    edges = stars.where("class != root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct()
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), F.col("label")), "b").groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels.node == heard.a).select("node", "label", F.least("label", "heard").alias("next"))
        # A label's own label is as good: this halves the way to the least node.
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "label")
        step = materialize(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new != label").isEmpty():
            return labels


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, class_id (least id that it is linked to, by any number of steps, or itself),
    n_links (linked classes of equal sets beside its own), copy_id (least id with an equal set), n_copies."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = arrow_map(source, _sign, f"doc_id {kind}, class binary, signature binary, bands array<long>")
    signed = materialize(signed, "signatures")
    members = signed.select("doc_id", "class")
    classes = signed.groupBy("class").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    rows = classes.select("class", F.posexplode("bands").alias("band", "key"))
    mark = F.xxhash64("class")
    buckets = rows.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("m"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.bit_xor(mark).alias("all"), F.sum(F.shiftright(mark, 20)).alias("sum")
    )
    buckets = buckets.where("m > 1").groupBy("m", "lo", "hi", "all", "sum").agg(F.min(F.struct("band", "key")).alias("first"))
    buckets = materialize(buckets.select("first.band", "first.key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "buckets")
    placed = rows.join(buckets, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("class", F.lit(7)), "blocks").cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = placed.withColumn("other", F.explode(other))
    placed = placed.select("class", "key", "band", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    placed = placed.join(classes.select("class", "signature"), "class")
    grouped = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    grouped = grouped.select("key", "x", "y", "band", "block", "class", "signature")
    pairs = materialize(arrow_map(grouped, _prune, _PAIR_SCHEMA), "pairs")

    needed = pairs.select("class").distinct().join(classes.select("class", "copy_id"), "class")
    texts = source.join(needed, source.doc_id.eqNullSafe(needed.copy_id)).select("class", "text")
    sets = arrow_map(texts, _sets, "class binary, shingles binary").dropDuplicates(["class"])
    checked = pairs.join(sets, "class").repartition("grp").sortWithinPartitions("grp", "member")
    links = materialize(arrow_map(checked.select("grp", "class", "members", "partners", "shingles"), _verify, "class binary, links long, root binary"), "links")

    labels = _components(links)
    counts = links.groupBy("class").agg(F.sum("links").alias("n_links"))
    ids = classes.select("class", "copy_id", "n_copies").join(labels.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    ids = ids.withColumn("label", F.coalesce("label", "class"))
    ids = materialize(ids, "class-labels")
    named = ids.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    ids = ids.join(named, "label").select("class", "copy_id", "n_copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(ids, "class").select(F.col("doc_id").alias(id_col), "class_id", "n_links", "copy_id", "n_copies")
