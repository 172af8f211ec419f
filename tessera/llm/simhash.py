"""Operator 5: near-duplicates by SimHash and multi-index hashing.

A fingerprint has a bit where more than half of a text's shingle hashes have
it. It is cut into two halves, and each fingerprint enters, for each half, the
table entries within one bit of that half: two fingerprints meet where a half
differs in at most 2 bits, which every pair of distance 4 or less does, and
complete distances are then verified. So :func:`near_components` is exact.

Copies collapse first: only distinct fingerprints are looked up. A bucket does
not give all its near pairs: pairs that a third member joins are left out, and
large buckets give a spanning forest, by breadth-first search over what is
still unvisited. Components are those of all links.

A bucket of more than ``most_bucket`` members is never gathered. Such a bucket
can only lie within one bit of a half that has over ``most_bucket / 33``
fingerprints, which is counted first; there, members are dealt by the other
half too: a member that has the bucket's half enters all entries within 2 bits
of its other half, one that is a bit off enters those within 1 bit. Two members
meet exactly where their distance is 4 or less by that path, so each entry is a
class and its members hang on the smallest. No link is lost, at any size.

:func:`keep_one` is for texts of Jaccard similarity 0.8 and more, which is not
the same as distance 4: the links of fingerprints come first and join most
near copies, and an exact path finds the rest. In one order of all shingles,
rare ones first, two sets of similarity 0.8 share one of the first
``n - ceil(0.8 n) + 1``. Only shingles that sets of different components have
there are kept, and in their buckets parity bits, as many as a set has members
or more, and sizes rule out pairs that cannot be so similar. No pair is missed.
What is found so far are candidates: inside each component of them all pairs
are verified, and of each component of verified pairs the document with the
smallest id stays. So every document that goes is linked by pairs of 0.8 or
more to the one that stays, whatever the size of the parts that it is done in:
a large bucket or group is dealt in parts, and every two parts meet in a task.

Null and empty texts have fingerprint zero, linked like any other; to
:func:`keep_one` they are alike among themselves only. Very long texts are read
whole. Fewer words than a shingle: the whole sequence is one. Null ids pass
through and name a component only where no other id does; in :func:`keep_one`
they come after all others. Repeated rows give one result each, and one of them
stays in :func:`keep_one`. Empty tables give empty results. Extra columns are
not read, or returned as they are by :func:`keep_one`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, discard, in_arrow, mix64, utf8, written
from tessera.llm.components import components

DISTANCE = 4
SIMILARITY = 0.8
PART_ROWS = 500
#: Parity bits that a set has at least; documents sampled for the order of shingles, which are common from COMMON of them on.
LEAST_BITS = 256
SAMPLE_DOCS, COMMON, MOST_COMMON = 10_000, 4, 200_000
MOST_BUCKET = 20_000
#: Runs up to MATRIX are compared as a matrix, those up to SMALL many at a time.
SMALL, MATRIX = 16, 512
_FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)])
_FLIPS2 = np.concatenate([_FLIPS, np.array([(1 << i) | (1 << j) for i in range(32) for j in range(i)], np.uint64)])
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64, seed 42, of the shingles of a text, repeats included."""
    import xxhash

    parts = ascii_lower(text).split()
    if not parts:
        return np.zeros(0, np.uint64)
    plain = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(plain, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(plain.__getitem__, cuts), repeat(42)), np.uint64, len(parts) - words + 1)


def fingerprint(text: bytes, words: int = 4) -> int:
    return _bits(shingle_hashes(text, words))


def _bits(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp`` (as a signed 64-bit integer). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, words) for at in range(0, b.num_rows, 512) for t in utf8(b.column(1).slice(at, 512))]
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(np.array(found, np.uint64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, run, f"doc_id {kind}, fp long")


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp >> _HALF, fp & _LOW


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the entries within one bit of its halves; the low bit of a key numbers the half."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            fp = b.column(0).slice(at, 2048).to_numpy().view(np.uint64)
            for side, half in enumerate(_halves(fp)):
                key = ((half[:, None] ^ _FLIPS) << np.uint64(1)) | np.uint64(side)
                yield pa.RecordBatch.from_arrays([_signed(key.ravel()), _signed(np.repeat(fp, len(_FLIPS)))], ["key", "fp"])


def _subkeys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of hot buckets under entries of their other half as well."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            key, fp = (b.column(k).slice(at, 2048).to_numpy().view(np.uint64) for k in (0, 1))
            high, low = _halves(fp)
            side = key & np.uint64(1)
            own, other = np.where(side == 0, high, low), np.where(side == 0, low, high)
            exact = own == key >> np.uint64(1)
            for which, flips in ((exact, _FLIPS2), (~exact, _FLIPS)):
                if which.any():
                    n = len(flips)
                    yield pa.RecordBatch.from_arrays([_signed(np.repeat(key[which], n)), _signed((other[which][:, None] ^ flips).ravel()), _signed(np.repeat(fp[which], n))], ["key", "sub", "fp"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Prints:
    """Fingerprints, near within a distance."""

    def __init__(self, values: np.ndarray, distance: int = DISTANCE) -> None:
        self.values, self.distance = values, distance

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]) <= self.distance

    def names(self, at: np.ndarray) -> np.ndarray:
        return self.values[at]


class Parities:
    """Sets by their parity bits (all of one width) and sizes, near where they may have the similarity.

    Sets of sizes n and m and similarity s differ in at most (n + m)(1 - s) / (1 + s)
    members, parity bits in no more than that, and the smaller has s of the larger's
    size at least: so no pair that is as similar is ever ruled out.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, least: float = SIMILARITY) -> None:
        self.bits, self.sizes, self.labels, self.least = bits, sizes, labels, least

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m, s = self.sizes[a], self.sizes[b], self.least
        return (_apart(self.bits[a], self.bits[b]) * (1 + s) <= (n + m) * (1 - s) + 1e-6) & (np.minimum(n, m) >= s * np.maximum(n, m) - 1e-6)

    def names(self, at: np.ndarray) -> np.ndarray:
        return self.labels[at]


def forest(members: Prints | Parities, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the members at ``rest``, found without listing pairs."""
    a, b, queue = [], [], []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = members.near(rest, np.full(len(rest), x))
        if near.any():
            found = rest[near]
            a.append(found)
            b.append(np.full(len(found), x))
            queue.extend(found.tolist())
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _pairs(members: Prints | Parities, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of several runs of one size, ``runs[run, member]``.

    A pair is left out where a member before both is near both: it then hangs
    together by that one, so a dense run gives a star and not all its pairs.
    """
    near = np.triu(members.near(runs[:, :, None], runs[:, None]), 1)
    if not near.any():
        return runs[:0, 0], runs[:0, 0]
    up = near.astype(np.float32)
    near &= np.matmul(up.transpose(0, 2, 1), up) == 0
    run, a, b = np.nonzero(near)
    return runs[run, a], runs[run, b]


def _linked(members: Prints | Parities, first: np.ndarray, size: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """Links of the runs that begin at ``first``; a pair takes ``cells`` words."""
    found = []
    for n in range(2, SMALL + 1):
        at = first[size == n]
        step = max(1, 500_000 // (n * n * cells))
        found += [_pairs(members, at[i : i + step, None] + np.arange(n)) for i in range(0, len(at), step)]
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        run = np.arange(at, at + n)
        found.append(_pairs(members, run[None]) if n * n * cells <= MATRIX * MATRIX else forest(members, run))
    for x, y in found:
        a, b = members.names(x), members.names(y)
        apart = a != b
        if apart.any():
            yield pa.RecordBatch.from_arrays([_signed(a[apart]), _signed(b[apart])], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut at its changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy()
        upto = int(np.searchsorted(k, k[-1]))
        if upto or (held and held[-1].column(0)[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, b.slice(0, upto)]).combine_chunks().to_batches()[0] if held or upto else b
            held = []
        held.append(b.slice(upto))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _borders(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return first, np.diff(np.append(first, len(k)))


def _print_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` from ``key, fp`` sorted by key: runs of equal keys are buckets."""
    for b in _runs(batches):
        yield from _linked(Prints(b.column(1).to_numpy().view(np.uint64)), *_borders(b.column(0).to_numpy()), 1)


def _set_links(least: float):
    """``a, b`` (labels) from ``key, label, size, bits`` sorted by key; all sets of a key have equally many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            first, size = _borders(b.column(0).to_numpy())
            wide = pc.binary_length(b.column(3)).to_numpy()[first] // 8
            for words in np.unique(wide).tolist():
                some = wide == words
                rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(f, f + n) for f, n in zip(first[some].tolist(), size[some].tolist(), strict=True))])
                part = b.take(pa.array(rows))
                bits = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u8").reshape(-1, words)
                members = Parities(bits, part.column(2).to_numpy(), part.column(1).to_numpy().view(np.uint64), least)
                yield from _linked(members, np.cumsum(size[some]) - size[some], size[some], words)

    return run


def _bucketed(keys: DataFrame, run) -> DataFrame:
    return keys.repartition("key").sortWithinPartitions("key").transform(in_arrow, run, "a long, b long")


def fingerprint_links(fps: DataFrame, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of ``fps(fp)``, distinct, at distance 4 or less."""
    dense = most_bucket // 33
    halves = fps.select(F.inline(F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")), F.struct(F.lit(1).alias("side"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")))))
    heavy = written(halves.groupBy("side", "half").count().where(F.col("count") > dense).select("side", "half"), "dense-halves")
    keys = fps.select("fp").transform(in_arrow, _keys, "key long, fp long")
    if heavy.isEmpty():
        return _bucketed(keys, _print_links).distinct()
    flips = F.array(*(F.lit(int(x)).cast("long") for x in _FLIPS))
    hot = heavy.select(F.explode(F.transform(flips, lambda x: F.shiftleft(F.col("half").bitwiseXOR(x), 1).bitwiseOR(F.col("side").cast("long")))).alias("key")).distinct()
    cool = _bucketed(keys.join(hot, "key", "left_anti"), _print_links)
    dealt = keys.join(hot, "key", "left_semi").transform(in_arrow, _subkeys, "key long, sub long, fp long")
    least = dealt.groupBy("key", "sub").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = dealt.join(least, ["key", "sub"]).where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return cool.unionByName(classes).distinct()


def _named(marked: DataFrame, most_bucket: int) -> DataFrame:
    """``fp, component_id`` for every fingerprint of ``marked``."""
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(fingerprint_links(classes.select("fp"), most_bucket)).withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # A table of its own, so that the join of the documents to it stands alone and Spark may split a popular fingerprint.
    out = written(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    discard(classes)
    return out


def near_components(docs: DataFrame, words: int = 4, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``, by 64 bits at distance 4."""
    marked = written(fingerprints(docs, words), "fingerprints")
    named = _named(marked, most_bucket)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, words: int, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and in how many: an order for prefixes, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                found = [np.unique(shingle_hashes(t, words)) for t in utf8(b.column(0).slice(at, 512))]
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found))], ["h"])

    share = max(1, docs.count() // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    often = sample.transform(in_arrow, run, "h long").groupBy("h").count().where(f"count >= {COMMON}").orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = often.column("h").to_numpy().view(np.uint64), often.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefix(h: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``n - ceil(least n) + 1`` members of a set, those that are rare in the sample first."""
    often = np.zeros(len(h), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        often = np.where(common[0][at] == h, common[1][at], 0)
    return h[np.lexsort((h, often))][: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]


def _parity(h: np.ndarray, width: int) -> bytes:
    """A bit for each residue of the hashes, set where an odd number of them has it. ``width`` is a power of two."""
    odd = np.bincount((mix64(h) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _widths(n: int, least: float) -> list[int]:
    """Parity bits of a set of ``n``: a power of two from ``n`` on, and the next one too where a set of that width may be as similar."""
    own = max(LEAST_BITS, 1 << max(0, n - 1).bit_length())
    return [own, 2 * own] if n >= least * own else [own]


def marks(docs: DataFrame, words: int, least: float) -> DataFrame:
    """``a, b`` (the row's name: hashes of its id and text), ``doc_id, node`` (the set's name), ``fp, size, bits, prefix``. No shuffle after the sample."""
    import xxhash

    common = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows, bits, prefixes = batch.slice(at, 512), [], [], []
                for t in utf8(part.column(3)):
                    h = np.unique(shingle_hashes(t, words))
                    rows.append([xxhash.xxh64_intdigest(h.tobytes(), 11), _bits(h), len(h)])
                    bits.append([_parity(h, w) for w in _widths(len(h), least)])
                    prefixes.append(_prefix(h, least, common).view(np.int64))
                values = np.array(rows, np.uint64)
                arrays = [*(part.column(k) for k in range(3)), *(_signed(values[:, k]) for k in range(3)), pa.array(bits, pa.list_(pa.binary())), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "doc_id", "node", "fp", "size", "bits", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _named_rows(docs.select("doc_id", "text")).select("_a", "_b", "doc_id", "text").transform(in_arrow, run, f"a long, b long, doc_id {kind}, node long, fp long, size long, bits array<binary>, prefix array<long>")


def _named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_a, _b``, the name of a row: ids may repeat, and ids and texts may be null."""
    return docs.withColumns({"_a": F.xxhash64(docs["doc_id"]), "_b": F.xxhash64(docs["text"])})


def set_links(sets: DataFrame, least: float, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """``a, b``: links between the labels of ``sets(node, label, size, bits, prefix)``, over all pairs that may have the similarity.

    Shingles go first, in narrow rows; a bucket is one of those and one width of
    parity bits. Only members of buckets with more than one label are given
    their bits. A bucket of more than ``most_bucket`` members is dealt in parts
    of half as many, and every two parts meet in a task.
    """
    each = sets.select("node", "label", "size", F.posexplode("bits").alias("up", "bits"))
    entries = sets.select("node", "label", "prefix", F.posexplode(F.transform("bits", F.octet_length)).alias("up", "width"))
    entries = entries.select("node", "label", "up", "width", F.explode("prefix").alias("h")).select(F.xxhash64("h", "width").alias("key"), "node", "label", "up")
    by_key = W.partitionBy("key")
    shared = entries.withColumns({"low": F.min("label").over(by_key), "high": F.max("label").over(by_key), "n": F.count(F.lit(1)).over(by_key)}).where("low < high")
    parts = F.when(F.col("n") > most_bucket, F.ceil(2 * F.col("n") / most_bucket)).otherwise(1).cast("long")
    shared = shared.select("key", "node", "up", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    block = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return _bucketed(shared.select(block.alias("key"), "node", "up").join(each, ["node", "up"]).select("key", "label", "size", "bits"), _set_links(least))


def _candidates(docs: DataFrame, words: int, least: float, most_bucket: int) -> tuple[DataFrame, DataFrame]:
    """``a, b, node`` of all rows, and ``node, root, first, sets``: all pairs of similarity ``least`` and more have one root.

    ``first`` is the first row of a set, with the number of rows of its name; ``sets`` the number of sets of a root.
    """
    marked = written(marks(docs, words, least), "marks")
    names = marked.groupBy("node", "a", "b").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.min("fp").alias("fp"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b", "rows")
    classes = written(names.groupBy("node").agg(F.min(first).alias("first"), F.min("fp").alias("fp")), "set-classes")
    near = components(fingerprint_links(classes.select("fp").distinct(), most_bucket)).withColumnRenamed("node", "fp")
    labelled = written(classes.join(near, "fp", "left").select("node", "first", F.coalesce("root", "fp").alias("label")), "labelled")
    once = marked.join(labelled, "node").where("a = first.a AND b = first.b").dropDuplicates(["node"])  # the join has dealt them by node
    sets = written(once.select("node", "label", "size", "bits", "prefix"), "sets")
    rows = written(marked.select("a", "b", "node").distinct(), "row-names")
    discard(marked, classes)
    joined = components(set_links(sets, least, most_bucket)).withColumnRenamed("node", "label")
    rooted = written(labelled.select("node", "label", "first").join(joined, "label", "left").select("node", "first", F.coalesce("root", "label").alias("root")), "rooted")
    named = written(rooted.join(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("sets")), "root").select("node", "root", "first", "sets"), "named")
    discard(sets, labelled, rooted)
    return rows, named


def wide_components(docs: DataFrame, words: int = 5, least: float = SIMILARITY, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """``doc_id, component_id`` of the groups of candidates."""
    rows, named = _candidates(docs, words, least, most_bucket)
    ids = named.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    of_row = rows.join(named.select("node", "root"), "node").join(ids, "root").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "component_id")
    return _named_rows(docs.select("doc_id", "text")).join(of_row, ["_a", "_b"]).select("doc_id", "component_id")


class Kept:
    """Noted documents, by their shingles.

    Two sets of similarity ``least`` share one of the first ``n - ceil(least n) + 1``
    members of either, in any fixed order, so only those are indexed and looked up.
    """

    def __init__(self, least: float) -> None:
        self.least, self.sets, self.names, self.index = least, [], [], {}

    def _first(self, shingles: np.ndarray) -> list[int]:
        n = len(shingles)
        return shingles[: n - int(np.ceil(self.least * n - 1e-9)) + 1].tolist() if n else [-1]

    def meets(self, shingles: np.ndarray) -> list[int]:
        """Places of the noted sets that may be as similar."""
        return sorted({k for h in self._first(shingles) for k in self.index.get(h, ())})

    def similar(self, k: int, shingles: np.ndarray) -> bool:
        n, m = len(shingles), len(self.sets[k])
        if min(n, m) < self.least * max(n, m) - 1e-9:
            return False
        both = len(np.intersect1d(self.sets[k], shingles, assume_unique=True))
        return not n + m or both >= self.least * (n + m - both) - 1e-9

    def add(self, name: object, shingles: np.ndarray) -> None:
        for h in self._first(shingles):
            self.index.setdefault(h, []).append(len(self.sets))
        self.sets.append(shingles)
        self.names.append(name)


def _verified(least: float):
    """``a, b``: spanning links of the pairs of similarity ``least`` in blocks, from rows sorted by block, side and node.

    Sets of side 0 are noted, those of side 1 are held against them only; in a
    block of one part sets are held against those before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, parent = None, Kept(least), {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        last = None
        for b in batches:
            found = []
            for group, i, j, side, node, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if block != (group, i, j):
                    block, kept, parent, last = (group, i, j), Kept(least), {}, None
                if node == last:
                    continue  # repeated rows
                last, shingles = node, np.frombuffer(data, "<u8")
                if i == j or side:
                    for k in kept.meets(shingles):
                        x, y = root(node), root(kept.names[k])
                        if x != y and kept.similar(k, shingles):
                            parent[x] = y
                            found.append((node, kept.names[k]))
                if not side:
                    kept.add(node, shingles)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _sets(words: int):
    """The shingles of the last column in place of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, words)).astype("<u8").tobytes() for t in utf8(part.column(3))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(sets, pa.binary())], ["root", "parts", "node", "shingles"])

    return run


def similar_rows(docs: DataFrame, words: int = 5, least: float = SIMILARITY, part_rows: int = PART_ROWS, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """``_a, _b, repeated``: names of the rows that are not the first of their group, and of first ones of which there are several (``repeated``).

    Groups are the components of all pairs of similarity ``least`` and more.
    Within a group of candidates sets are compared in blocks: those of more than
    ``part_rows`` sets are dealt in parts, and every two parts meet in a task.
    """
    rows, named = _candidates(docs, words, least, most_bucket)
    members = named.where("sets > 1").select(F.col("first.a").alias("_a"), F.col("first.b").alias("_b"), "root", F.ceil(F.col("sets") / part_rows).cast("long").alias("parts"), "node")
    # Members and rows that go grow with the corpus: never broadcast, at any size.
    texts = _named_rows(docs.select("doc_id", "text")).join(members.hint("merge"), ["_a", "_b"])
    sets = written(texts.select("root", "parts", "node", "text").transform(in_arrow, _sets(words), "root long, parts long, node long, shingles binary"), "member-sets")
    part = sets.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = other.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("side"), "node", "shingles")
    order = ("root", "i", "j", "side", "node")
    links = blocks.repartition("root", "i", "j").sortWithinPartitions(*order).transform(in_arrow, _verified(least), "a long, b long")
    roots = components(links).withColumnRenamed("root", "group")
    grouped = written(named.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("group", "node").alias("group")), "grouped")
    stays = grouped.join(grouped.groupBy("group").agg(F.min("first").alias("stays")), "group").select("node", "stays")
    marked = rows.join(stays, "node").withColumn("stay", (F.col("a") == F.col("stays.a")) & (F.col("b") == F.col("stays.b"))).where("NOT stay OR stays.rows > 1")
    out = written(marked.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("stay").alias("repeated")), "similar")
    discard(rows, named, sets, grouped)
    return out


def keep_one(docs: DataFrame, words: int = 5, least: float = SIMILARITY, part_rows: int = PART_ROWS, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """``docs`` with one row of each group of :func:`similar_rows`: the one with the smallest id."""
    gone = similar_rows(docs, words, least, part_rows, most_bucket)
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), F.xxhash64(docs["doc_id"]).alias("_a"), F.xxhash64(docs["text"]).alias("_b"))
    flagged = whole.join(gone.hint("merge"), ["_a", "_b"], "left")
    out = flagged.where("repeated IS NULL").select("_doc")
    if not gone.where("repeated").isEmpty():
        hashed = [F.col("_doc")[f.name] for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
        place = F.row_number().over(W.partitionBy("_a", "_b").orderBy(F.xxhash64(*hashed)))
        out = out.unionByName(flagged.where("repeated").withColumn("_place", place).where("_place = 1").select("_doc"))
    return out.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
