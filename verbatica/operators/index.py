"""A stored index of words, in segments: what is added is split once, what is deleted drops out, and no text is read again.

A segment holds posting lists (term, numbers, counts) in ``BUCKETS`` folders by a hash of the term, sorted by term, so that a search reads the folders and row groups
of its own terms.  Inside a segment a text goes by a number of 64 bits, so no id is repeated for each word; a list has ``LIST`` numbers at most, so a word that very many
texts hold is many rows.  Which segment speaks for a text stands in a snapshot table of documents (id, segment, number, size, digest), one small row each: postings of
another segment do not count.  A change writes its segment first and then the next snapshot; a writer that is lost in between leaves a segment that nothing names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.lineage import cut
from .retrieval import Words, _asked, best, bm25, boolean_match, query_terms, tokens
from .store import Table

BUCKETS, LIST = 32, 4096
#: Folders of one bucket are written by so many tasks.
SALT = 4
DOCS = "id string, segment string, number long, size long, digest long"
LISTS = "term string, numbers array<long>, counts array<int>"


def digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _rows(lists: dict[str, tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    rows = [(t, n[at : at + LIST], c[at : at + LIST]) for t, (n, c) in lists.items() for at in range(0, len(n), LIST)]
    if rows:
        terms, numbers, counts = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["term", "numbers", "counts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of a batch of texts (number, words); the term "" counts all words of a text."""
    for batch in batches:
        lists: dict[str, tuple[list[int], list[int]]] = {}
        for number, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term, n in [("", len(words)), *Counter(words).items()]:
                held = lists.setdefault(term, ([], []))
                held[0].append(number)
                held[1].append(n)
        yield from _rows(lists)


def _relisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of single postings (term, number, n)."""
    for batch in batches:
        lists: dict[str, tuple[list[int], list[int]]] = {}
        for term, number, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held = lists.setdefault(term, ([], []))
            held[0].append(number)
            held[1].append(n)
        yield from _rows(lists)


def _once(drawers: DataFrame) -> DataFrame:
    """(id, text) with one row for an id: the largest text of those that differ. Only texts of ids that repeat move."""
    rows = drawers.where("id is not null").select("id", "text")
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    if twice.isEmpty():
        return rows
    return rows.join(twice, "id", "left_anti").unionByName(rows.join(twice, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.docs = Table(spark, f"{self.path}/docs")

    def documents(self) -> DataFrame:
        """(id, segment, size, digest) of every indexed text."""
        return self.docs.read() if self.docs.snapshots() else self.spark.createDataFrame([], DOCS)

    def _put(self, lists: DataFrame, name: str) -> None:
        dealt = lists.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(F.get("numbers", F.lit(0))), F.lit(SALT)))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/segments/{name}")

    def _numbers(self, ids: DataFrame) -> int:
        """A seed by which no two ids have the same number."""
        seed = 0
        while not ids.groupBy(F.xxhash64("id", F.lit(seed))).count().where("count > 1").isEmpty():
            seed += 1
        return seed

    def _segment(self, drawers: DataFrame) -> DataFrame:
        """Writes a segment of (id, text); the rows of its documents."""
        name, text = uuid.uuid4().hex, F.coalesce("text", F.lit(""))
        number = F.xxhash64("id", F.lit(self._numbers(drawers.select("id"))))
        self._put(drawers.select(number.alias("number"), tokens(text).alias("w")).mapInArrow(_counted, LISTS), name)
        sizes = self._single(self._lists([name]).where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == "")))
        return drawers.select("id", number.alias("number"), digest(text).alias("digest")).join(sizes, "number").select("id", "segment", "number", F.col("n").cast("long").alias("size"), "digest")

    def _lists(self, segments: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{LISTS}, bucket int, segment string")
        for name in segments:
            out = out.unionByName(self.spark.read.schema(f"{LISTS}, bucket int").parquet(f"{self.path}/segments/{name}").withColumn("segment", F.lit(name)))
        return out

    @staticmethod
    def _single(lists: DataFrame) -> DataFrame:
        """(segment, term, number, n) of posting lists."""
        return lists.select("segment", "term", F.explode(F.arrays_zip("numbers", "counts")).alias("p")).select("segment", "term", F.col("p.numbers").alias("number"), F.col("p.counts").alias("n"))

    def segments(self) -> list[str]:
        """Names of the segments that speak for any text; there is one for each change since the last merge."""
        return sorted(r["segment"] for r in self.documents().select("segment").distinct().collect())

    def add(self, drawers: DataFrame) -> None:
        """Texts (id, text) come in; those of ids that are there already take their places. Of rows with one id the largest text counts."""
        new = self._segment(_once(drawers))
        self.docs.write(self.documents().join(new.select("id"), "id", "left_anti").unionByName(new))

    def delete(self, ids: DataFrame) -> None:
        self.docs.write(self.documents().join(ids.select("id").distinct(), "id", "left_anti"))

    def refresh(self, drawers: DataFrame) -> dict[str, int]:
        """Makes the index that of drawers (id, text); texts are split only where they are new or changed. Gives how many were added, changed and deleted."""
        held, now = self.documents().select("id", F.col("digest").alias("old")), drawers.where("id is not null")
        told = now.select("id", digest(F.col("text")).alias("new")).join(held, "id", "full").select("id", F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("new") != F.col("old"), "changed").alias("fate"))
        counts = {r["fate"]: r["n"] for r in told.where("fate is not null").groupBy("fate").agg(F.count("*").alias("n")).collect()}
        if counts.get("deleted"):
            self.delete(told.where("fate = 'deleted'"))
        if counts.get("added") or counts.get("changed"):
            self.add(now.join(told.where("fate in ('added', 'changed')").select("id"), "id", "left_semi").select("id", "text"))
        return {fate: counts.get(fate, 0) for fate in ("added", "changed", "deleted")}

    def merge(self) -> None:
        """One segment of what counts now, from postings alone."""
        name, docs = uuid.uuid4().hex, self.documents()
        number = F.xxhash64("id", F.lit(self._numbers(docs.select("id"))))
        live = self._single(self._lists(self.segments())).join(docs.select("segment", "number", number.alias("now")), ["segment", "number"])
        held = live.select("term", F.col("now").alias("number"), "n").repartition(_bucket(F.col("term")), F.pmod("number", F.lit(SALT))).sortWithinPartitions("term")
        self._put(held.mapInArrow(_relisted, LISTS), name)
        self.docs.write(docs.withColumns({"segment": F.lit(name), "number": number}))

    def rebuild(self, drawers: DataFrame, truncation_ok: bool = False) -> int:
        """The whole index anew from drawers (id, text). Refused where they are fewer than the index knows, unless the caller says that this is right."""
        known, given = self.documents().count(), drawers.where("id is not null").select("id").distinct().count()
        if given < known and not truncation_ok:
            raise ValueError(f"{given} drawers were given, the index knows {known}: the source may be cut short")
        self.docs.write(self._segment(_once(drawers)))
        return given

    def clean(self) -> int:
        """Segments go that the newest snapshot does not name; how many went. Nothing may read or write the index meanwhile."""
        live = set(self.segments())
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        dead = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName() not in live]
        for path in dead:
            fs.delete(path, True)
        return len(dead)

    def asked(self, terms: DataFrame) -> Words:
        """The live texts by the asked terms (term), as ``retrieval.words_of`` gives them, without reading a text.

        Terms are numbers before postings move, and postings move once, by their text's number; ids do not.
        """
        docs, words = self.documents(), _asked(terms)
        numbered = self.spark.createDataFrame(pa.table({"term": words, "place": pa.array(range(len(words)), pa.int32())}))
        segments = self.segments()
        at = F.array_position(F.array(*map(F.lit, segments)).cast("array<string>"), F.col("segment")).cast("int").alias("at")
        lists = self._lists(segments).join(F.broadcast(numbered.withColumn("bucket", _bucket(F.col("term")))), ["bucket", "term"])
        single = lists.select(at, "place", F.explode(F.arrays_zip("numbers", "counts")).alias("p"))
        held = single.groupBy("at", F.col("p.numbers").alias("number")).agg(F.collect_list(F.struct("place", F.col("p.counts").alias("n"))).alias("w"))
        size = F.col("size")
        got = lambda f, kind: F.coalesce(F.transform("w", f), F.array()).cast(f"array<{kind}>")
        rows = docs.select("id", at, "number", "size").join(held, ["at", "number"], "left").select(
            "id", F.lit(1).cast("long").alias("texts"), "size", got(lambda p: p["place"], "int").alias("term"), got(lambda p: p["n"], "bigint").alias("tf"), got(lambda p: p["n"] * size, "bigint").alias("total"))
        return Words(cut(rows, "asked"), words)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """BM25 of queries (query_id, text), without reading a text."""
        return bm25(queries, queries, k, self.asked(query_terms(queries)))

    def match(self, queries: DataFrame, match: str = "all", k: int | None = None) -> DataFrame:
        """(query_id, id, n_terms) of texts with all, or any, of the terms; the k with most terms, if k is given."""
        return boolean_match(queries, queries, match, index=self.asked(query_terms(queries)), k=k)
