"""Enrichment in bounded runs: names of texts that were not looked at yet become register entries and facts, each text once, whatever is interrupted.

A run claims its ids first, then writes its facts and its register entries, and marks the ids last; each of these is a folder of the run, which a second try overwrites.
Facts and entries count from the mark on.  A run that was killed leaves a claim without a mark: the next call takes up the same ids under the same number,
so no id is done twice and none is lost.  One worker at a time; the work itself is spread by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import names as nm

#: Texts of a name that its signs are looked for in, and how sure a promotion must be.
SAMPLE, SURE = 20, 0.75
CLAIM, FACT, ENTRY = "id string", "subject string, predicate string, object string", "name string, kind string, confidence double"


class Enrichment:
    def __init__(self, spark: SparkSession, path: str, patterns: dict[str, list[str]], sample: int = SAMPLE, sure: float = SURE):
        self.spark, self.path, self.patterns, self.sample, self.sure = spark, path.rstrip("/"), patterns, sample, sure

    def _runs(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName().removeprefix("run=")) for s in fs.listStatus(folder) if done(s.getPath())) if fs.exists(folder) else []

    def _write(self, df: DataFrame, kind: str, run: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/run={run}")

    def _read(self, kind: str, schema: str, runs: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/run={n}" for n in runs]
        return self.spark.read.schema(schema + ", run int").option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema + ", run int")

    def facts(self) -> DataFrame:
        """(subject, predicate, object, run) of the runs that ended."""
        return self._read("facts", FACT, self._runs("scanned"))

    def learned(self) -> DataFrame:
        """(name, kind, confidence, run) of the runs that ended."""
        return self._read("entries", ENTRY, self._runs("scanned"))

    def scanned(self) -> DataFrame:
        return self._read("scanned", CLAIM, self._runs("scanned"))

    def work(self, drawers: DataFrame, most: int) -> int | None:
        """The number of the run that is next, its ids claimed: one that was left off, else the first `most` ids that were not scanned; none if nothing is left."""
        claimed, scanned = self._runs("claims"), self._runs("scanned")
        empty = lambda n: self._read("claims", CLAIM, [n]).isEmpty()
        open_ = [n for n in claimed if n not in scanned]
        if open_ and not empty(open_[0]):
            return open_[0]
        left = drawers.select("id").where("id is not null").distinct().join(self.scanned().select("id"), "id", "left_anti").orderBy("id").limit(most)
        number = open_[0] if open_ else max(claimed, default=0) + 1  # an empty claim, of a time when all was done, is claimed anew
        self._write(left, "claims", number)
        return None if empty(number) else number

    def run(self, drawers: DataFrame, known: DataFrame, most: int = 1000) -> dict[str, int] | None:
        """One run over drawers (id, text) with a register known (name, kind); how many ids, entries and facts it brought, or None if all is done."""
        number = self.work(drawers, most)
        if number is None:
            return None
        texts = drawers.select("id", F.coalesce("text", F.lit("")).alias("text")).join(self._read("claims", CLAIM, [number]).select("id"), "id", "left_semi")
        held = nm.mentions(texts, "id", self.patterns, least=3)
        register = known.select("name", "kind").unionByName(self.learned().select("name", "kind"))
        new = held.join(register.select("name"), "name", "left_anti")
        self._write(self._promoted(new, texts), "entries", number)
        entries = self._read("entries", ENTRY, [number])
        named = register.select("name").union(entries.select("name")).distinct()
        told = held.join(named, "name", "left_semi").select(F.col("name").alias("subject"), F.lit("mentioned_in").alias("predicate"), F.col("id").alias("object"))
        self._write(told, "facts", number)
        self._write(texts.select("id"), "scanned", number)  # last: what is not marked is done again
        return {"run": number, "ids": self._read("scanned", CLAIM, [number]).count(), "entries": entries.count(), "facts": self._read("facts", FACT, [number]).count()}

    def _promoted(self, held: DataFrame, texts: DataFrame) -> DataFrame:
        """Names that their signs tell surely, by the first texts that hold them; each name's sample is bounded."""
        order = Window.partitionBy("name").orderBy("id")
        sample = held.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= self.sample).select("name", "id").join(texts, "id").select("name", "text")
        patterns = self.patterns

        def look(batches):
            from collections import Counter

            import pyarrow as pa

            counts: Counter = Counter()
            held: dict[str, nm.Signs] = {}
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if name not in held:
                        if len(held) >= 256:
                            held.clear()
                        held[name] = nm.Signs([name], patterns)
                    held[name].count(text, counts)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["name", "sign", "n"])

        signs = sample.mapInArrow(look, "name string, sign string, n long").groupBy("name", "sign").agg(F.sum("n").alias("n"))
        found = nm.scored(held.groupBy("name").agg(F.sum("n").alias("n")), signs, patterns)
        return found.where(F.col("kind").isin("person", "project") & (F.col("confidence") >= self.sure)).select("name", "kind", "confidence")
