"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets decide.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words split at white space); a text of fewer words
is one shingle; without words the set is empty and linked with nothing.  Two documents are linked if the Jaccard
similarity of their sets is at least ``similarity``.

1. Rows of equal sets form a class, named by its smallest doc_id and the set's signature; only one row of a class goes on.
2. Each class carries 1,024 MinHash values as an odd sketch: 2,048 parity bits, one flipped by each value; the first
   256 also as 32 band keys of 8 values.  The XOR of two sketches estimates their similarity precisely where that is high.
3. Band keys are sorted once, in ranges that cut a large bucket; what is alone in its bucket goes no further.  In each bucket
   every member is compared with the bucket's smallest member only (a star, never all pairs).  Survivors of the sketch
   are confirmed on their full sets; confirmed links give components.
4. Buckets whose members still lie in several components are compared once more, across components only, in cells of
   bounded size.  Members of the bucket's largest component meet only members of the others.  First the sketches meet: a member
   goes on if its sketch agrees with that of one of another component and this is the first band that the two share.  Then the
   sets of those that went on decide.  No pair becomes a row but a link that joins components.
5. The links of both rounds give the final components.  Pairs inside one component need no row: they change nothing.

A pair at the threshold shares a band with probability 1 - (1 - 0.85**8)**32 > 0.9999; a sketch estimate is taken as a
refusal only about 5 standard deviations below the threshold.

Nulls: a null text is a text without words; rows with a null doc_id are left out of links and returned alone with a null
component.  Rows that repeat a doc_id with another text count as further documents of that id: each has its own links, so
one may be kept while the other goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import bitmap, components, cut, discard, is_set, partners, parts, place, row_sig, table, unused
from .textops import Words, list_array, mix, not_blank, portions, window_hashes

SHINGLE = 5
#: MinHash values of a sketch and its bits; bands and the values of each.
HASHES, SKETCH_BITS, BANDS, ROWS = 1024, 2048, 32, 8
SIMILARITY = 0.85
#: Estimates this far below the threshold refuse a pair: 5 standard deviations of 1,024 samples at 0.85, and sketch noise.
SLACK = 0.07
#: Members of a bucket that meet in one cell, on either side.
CELL = 128
#: Band keys that are looked at in one go.
PIECE = 1 << 17

_rng = np.random.default_rng(20_25)
_A = (_rng.integers(1 << 32, size=HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)
_SALT = _rng.integers(1 << 63, size=HASHES, dtype=np.uint64)
_BLOCK = 1 << 15


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their number."""
    words = Words(texts, not_blank)
    short = (words.n > 0) & (words.n < SHINGLE)
    starts, count = words.windows(SHINGLE)
    long = window_hashes(words.hash, starts, SHINGLE)
    sets, at = [], np.concatenate(([0], np.cumsum(count)))
    for d in range(len(texts)):
        if short[d]:
            n, first = int(words.n[d]), int(words.first[d])
            sets.append(window_hashes(words.hash, np.array([first]), n))
        else:
            sets.append(np.unique(long[at[d] : at[d + 1]]))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))


def minhashes(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """HASHES smallest values of each set (rows); no set may be empty."""
    h = (mix(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(count), HASHES), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(count)))
    d = 0
    while d < len(count):
        to = max(d + 1, int(np.searchsorted(first, first[d] + _BLOCK, side="right")) - 1)
        part, offsets = h[first[d] : first[to]], first[d:to] - first[d]
        space = np.empty_like(part)
        for k in range(HASHES):
            np.multiply(part, _A[k], out=space)
            np.add(space, _B[k], out=space)
            out[d:to, k] = np.minimum.reduceat(space, offsets)
        d = to
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    power = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], dtype=np.uint64)
    keys = (mins[:, : BANDS * ROWS].reshape(len(mins), BANDS, ROWS).astype(np.uint64) * power).sum(axis=2, dtype=np.uint64)
    return mix(keys + mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words."""
    bit = (mix(mins.astype(np.uint64) ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = (bit + np.arange(len(mins))[:, None] * SKETCH_BITS).ravel()
    odd = (np.bincount(flat, minlength=len(mins) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(mins), SKETCH_BITS), axis=1, bitorder="little").view(np.int64)


def most_odd(similarity: float) -> int:
    """The largest XOR population count whose estimate is at least the similarity less SLACK."""
    lowest = similarity - SLACK
    share = (1 - (1 - 2 / SKETCH_BITS) ** (2 * HASHES * (1 - lowest))) / 2
    return int(np.ceil(SKETCH_BITS * share))


def signatures(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two independent sums over each set (rows): equal sets have equal signatures."""
    first = np.concatenate(([0], np.cumsum(count)))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x)))) for x in (sets, sets ^ np.uint64(0xA5A5A5A5A5A5A5A5))]
    return np.stack([x[first[1:]] - x[first[:-1]] for x in sums], axis=1).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in portions(batches, most=300_000, rows=400):
        sets, count = shingle_sets(texts)
        some = count > 0
        mins = minhashes(sets, count[some])
        sig = signatures(sets, count)
        width = np.where(some, 1, 0)
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.get_field_index("doc_id")), pa.array(count),
            pa.array(sig[:, 0]), pa.array(sig[:, 1]), batch.column(batch.schema.get_field_index("row")),
            list_array(band_keys(mins).ravel() if len(mins) else np.zeros(0, np.int64), width * BANDS, pa.int64()),
            list_array(odd_sketches(mins).ravel() if len(mins) else np.zeros(0, np.int64), width * (SKETCH_BITS // 64), pa.int64()),
        ], names=["doc_id", "n_shingles", "sig_a", "sig_b", "row", "bands", "sketch"])


def _full_sets(bits: Broadcast):
    """(id, sig, set) of the rows whose place in the bitmap is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            asked = every.filter(pa.array(is_set(bits.value, np.asarray(every.column(2)))))
            for batch, texts in portions([asked]):
                sets, count = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures(sets, count)[:, 0]), list_array(sets.view(np.int64), count, pa.int64())], names=["id", "sig", "set"])

    return run


def _together(piece: int):
    """Of rows sorted by bucket those that aren't alone in it, with the first of the bucket.

    The rows of the first and the last bucket, which may go on in another partition, are all kept and marked as an edge; so are
    those of a bucket of more than ``piece`` rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(t: pa.RecordBatch, start: np.ndarray, before: bool, after: bool) -> pa.RecordBatch:
            size = np.diff(np.append(start, t.num_rows))
            edge = np.zeros(len(start), bool)
            edge[0], edge[-1] = before or (after and len(start) == 1), after or (before and len(start) == 1)
            keep = np.flatnonzero(np.repeat((size > 1) | edge, size))
            first, at = pa.array(np.repeat(start, size)[keep]), pa.array(keep)
            return pa.RecordBatch.from_arrays([*[t.column(k).take(at) for k in range(3)], t.column(1).take(first), t.column(2).take(first), pa.array(np.repeat(edge, size)[keep])],
                                              names=["bucket", "id", "sig", "centre", "centre_sig", "edge"])

        held, rows, before = [], 0, True
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows < piece:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket = np.asarray(t.column(0))
            start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            if len(start) == 1:
                yield told(t, start, True, True)
                held, rows, before = [], 0, True
            else:  # the last bucket waits for the rest of it
                yield told(t.slice(0, int(start[-1])), start[:-1], before, False)
                held, rows, before = [t.slice(int(start[-1]))], t.num_rows - int(start[-1]), False
        if rows:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket = np.asarray(t.column(0))
            yield told(t, np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), before, True)

    return run


_MEMBER = "bucket long, i int, j int, block int, id long, sig long, comp long, n long, sketch array<long>"


def _by_cell(meet, key: tuple[str, ...] = ("bucket", "i", "j")):
    """meet of each cell's rows, which are sorted by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            if not whole.num_rows:
                return
            one = whole.combine_chunks().to_batches()[0]
            named = [np.asarray(one.column(k)) for k in key]
            edge = np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in named])) + 1, [one.num_rows]))
            got = [r for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a > 1 and (r := meet(one.slice(a, b - a))) is not None]
            if got:
                yield pa.Table.from_batches(got).combine_chunks().to_batches()[0]

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            if rest is not None:
                whole = pa.concat_tables([rest, whole])
            named = [np.asarray(whole.column(k)) for k in key]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in named]))
            keep = int(other[-1]) + 1 if len(other) else 0
            yield from cells(whole.slice(0, keep))
            rest = whole.slice(keep)
        if rest is not None:
            yield from cells(rest)

    return run


def _matrix(t: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(t.column(name).flatten()).reshape(t.num_rows, -1)


def _agreeing(t: pa.RecordBatch, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a cell, of different components, whose sketches agree: (left, right, how far apart)."""
    block, n, comp = (np.asarray(t.column(k)) for k in ("block", "n", "comp"))
    left, right = (np.flatnonzero(block == t.column(k)[0].as_py()) for k in ("i", "j"))
    words = _matrix(t, "sketch").view(np.uint64)
    apart = np.bitwise_count(words[left][:, None, :] ^ words[right][None, :, :]).sum(axis=2, dtype=np.int32)
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    p, q = np.nonzero((apart <= most) & (comp[left][:, None] != comp[right][None, :]) & (100 * small >= percent * large))
    return left[p], right[q], apart[p, q]


def _sketches_meet(similarity: float):
    """The rows of a cell that agree with another, where the two share no earlier band."""
    most, percent = most_odd(similarity), round(100 * similarity)

    def meet(t: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y, _ = _agreeing(t, most, percent)
        if not len(x):
            return None
        bands, bucket, goes = _matrix(t, "bands"), t.column("bucket")[0].as_py(), []
        for at in range(0, len(x), 4096):
            a, b = bands[x[at : at + 4096]], bands[y[at : at + 4096]]
            here = a[np.arange(len(a)), np.argmax(a == b, axis=1)] == bucket
            goes += [x[at : at + 4096][here], y[at : at + 4096][here]]
        goes = np.unique(np.concatenate(goes))
        return t.select([f.name for f in t.schema if f.name != "bands"]).take(pa.array(goes)) if len(goes) else None

    return _by_cell(meet)


def _sets_meet(similarity: float):
    """Links between members of different components.

    Pairs whose sketches agree are confirmed on their full sets, the likeliest first; a pair whose components a link of this
    cell has joined already is passed over, so a cell gives fewer links than it has rows.
    """
    most, percent = most_odd(similarity), round(100 * similarity)

    def meet(t: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y, apart = _agreeing(t, most, percent)
        order = np.argsort(apart, kind="stable")
        comp, flat = np.asarray(t.column("comp")).tolist(), np.asarray(t.column("set").flatten())
        at = np.concatenate(([0], np.cumsum(np.asarray(t.column("set").value_lengths()))))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        left, right = [], []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            u, v = find(comp[a]), find(comp[b])
            if u == v:
                continue
            one, two = flat[at[a] : at[a + 1]], flat[at[b] : at[b + 1]]
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * shared >= percent * (len(one) + len(two) - shared):
                root[max(u, v)] = min(u, v)
                left.append(a)
                right.append(b)
        if not left:
            return None
        return pa.RecordBatch.from_arrays([t.column(k).take(pa.array(r)) for r in (left, right) for k in ("id", "sig")], names=["a", "a_sig", "b", "b_sig"])

    return _by_cell(meet)


def _node(id_: str, sig: str) -> Column:
    """A class: ordered by its smallest doc_id."""
    return F.struct(F.col(id_).alias("id"), F.col(sig).alias("sig"))


def _sets_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, set) of the rows that nodes (node) names, and of a few others.

    The texts are read where they lie.  A bitmap of bounded size tells which may be asked for; what it lets
    through by mistake finds no partner in the joins that follow.
    """
    held = texts.sparkSession.sparkContext.broadcast(bitmap(nodes.select(place("node.id"))))
    sets = texts.select("doc_id", "text", place("doc_id").alias("at")).mapInArrow(_full_sets(held), "id long, sig long, set array<long>")
    return sets.select(_node("id", "sig").alias("node"), "set").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= round(100 * similarity) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _in_buckets(base: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, node, centre) of each class in each bucket that holds more than one; written out."""
    rows = (base.where("doc_id is not null and n_shingles > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig_a", "sig_b"], "left_semi")
            .select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("sig_a").alias("sig")))
    order = ["bucket", "id", "sig"]
    met = cut(rows.repartitionByRange(parts(base.sparkSession), *order).sortWithinPartitions(*order)
              .mapInArrow(_together(PIECE), "bucket long, id long, sig long, centre long, centre_sig long, edge boolean"), "buckets")
    met = met.select("bucket", _node("id", "sig").alias("node"), _node("centre", "centre_sig").alias("centre"), "edge")
    # of the buckets at the ends of partitions, two for each
    ends = met.where("edge").groupBy("bucket").agg(F.min("centre").alias("centre"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = cut(met.where("not edge").drop("edge").unionByName(met.where("edge").drop("centre", "edge").join(ends, "bucket")), "shared")
    discard(met)
    return shared


def _across(at: DataFrame, sketch: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components, of the members (bucket, node, comp) of buckets that hold several."""
    n = parts(at.sparkSession)
    counts = at.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("bucket", F.col("most.comp").alias("largest"), F.ceil(F.col("most.k") / CELL).cast("int").alias("inner"), F.ceil((F.col("size") - F.col("most.k")) / CELL).cast("int").alias("outer"))
    deal = F.xxhash64("node")
    own = F.col("comp") == F.col("largest")
    block = F.when(own, F.pmod(deal, "inner")).otherwise(F.col("inner") + F.pmod(deal, "outer")).cast("int")
    other = F.sequence(F.when(own, F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)
    dealt = (at.join(mixed, "bucket").select("bucket", "node", F.xxhash64("comp").alias("comp"), block.alias("block"), F.explode(other).alias("other"))
             .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp").join(sketch, "node")
             .select("bucket", "i", "j", "block", "node.*", "comp", "n", "sketch", "bands"))

    def cells(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    agree = cut(cells(dealt).mapInArrow(_sketches_meet(similarity), _MEMBER), "agree")
    sets = _sets_of(agree.select(_node("id", "sig").alias("node")), texts).select("node.*", "set")
    links = cells(agree.join(sets, ["id", "sig"]).select(*agree.columns, "set")).mapInArrow(_sets_meet(similarity), "a long, a_sig long, b long, b_sig long")
    links = cut(links.select(_node("a", "a_sig").alias("a"), _node("b", "b_sig").alias("b")), "second")
    discard(agree)
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of every document, row being ``row_sig`` of its text; docs needs doc_id and text."""
    n = parts(docs.sparkSession)
    docs = docs.select("doc_id", "text", row_sig("text").alias("row"))
    base = cut(docs.mapInArrow(_sketched, "doc_id long, n_shingles long, sig_a long, sig_b long, row long, bands array<long>, sketch array<long>"), "sketched")
    texts = docs.where("doc_id is not null and text is not null")
    named = base.where("doc_id is not null and n_shingles > 0").select("doc_id", "row", "n_shingles", "sig_a", "sig_b", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("salt"))
    # a class of very many copies is dealt by the salt, so that none of its steps meets in one task
    salted = named.groupBy("sig_a", "sig_b", "salt").agg(F.min("doc_id").alias("rep"))
    classes = cut(salted.groupBy("sig_a", "sig_b").agg(F.min("rep").alias("rep")), "classes")

    # 1: a star in each bucket
    shared = _in_buckets(base, classes)
    stars = shared.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    of_shared = shared.select("node").distinct()
    sketch = cut(base.select(_node("doc_id", "sig_a").alias("node"), F.col("n_shingles").alias("n"), "sketch", "bands").join(of_shared, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    one = sketch.drop("bands")
    likely = cut(stars.join(one.toDF("a", "n_a", "sketch_a"), "a").join(one.toDF("b", "n_b", "sketch_b"), "b")
                 .where((100 * F.least("n_a", "n_b") >= round(100 * similarity) * F.greatest("n_a", "n_b")) & (apart <= most_odd(similarity)))
                 .select("a", "b"), "likely")
    first = cut(_confirmed(likely, texts, similarity), "first")
    discard(likely)
    found = cut(components(first), "found")

    # 2: across the components that still share a bucket
    at = shared.drop("centre").distinct().join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    second = _across(at, sketch, texts, similarity)
    for done in (shared, sketch, found):
        discard(done)
    final = components(first.union(second)).select(F.col("node.id").alias("rep"), F.col("node.sig").alias("sig_a"), F.col("component.id").alias("component"))

    of_class = classes.join(final, ["rep", "sig_a"], "left").select("sig_a", "sig_b", F.coalesce("component", "rep").alias("component_id"))
    dealt = salted.drop("rep").join(of_class, ["sig_a", "sig_b"])
    linked = named.join(dealt, ["sig_a", "sig_b", "salt"]).select("doc_id", "row", "n_shingles", "component_id")
    alone = base.where("doc_id is null or n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without all but one of each group; rows with a null doc_id stay."""
    key, row = unused(docs, "id_"), unused(docs, "row_")
    lost = cut(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct(), "lost")
    return partners(docs, lost, (F.col("doc_id") == F.col(key)) & (row_sig("text") == F.col(row)), place("doc_id", row_sig("text")), place(key, row))[1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op10_minhash_near_dedup": (query, None)}
