"""The archive: drawers, facts and tunnels in snapshot tables, and one method for each thing a user asks of them.

Every method gives a DataFrame or writes the next snapshot of a table; nothing is collected but single values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as t
from ..operators import graph, knowledge, retrieval, store, taxonomy
from ..operators.filters import where, where_text

DRAWER = "id string, wing string, room string, hall string, source_file string, chunk_index long, filed_at string, importance int, added_by string, text string"
FACT = "subject string, predicate string, object string, valid_from string, valid_to string, confidence double, drawer_id string, extracted_at string"
TUNNEL = "id string, wing_a string, room_a string, wing_b string, room_b string, label string, kind string"


class Archive:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tables = {name: (store.Table(spark, f"{path.rstrip('/')}/{name}"), schema) for name, schema in (("drawers", DRAWER), ("facts", FACT), ("tunnels", TUNNEL))}

    def _read(self, name: str) -> DataFrame:
        at, schema = self.tables[name]
        return at.read() if at.snapshots() else self.spark.createDataFrame([], schema)

    def _write(self, name: str, df: DataFrame) -> str:
        at, schema = self.tables[name]
        fields = self.spark.createDataFrame([], schema).schema
        return at.write(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]))

    @property
    def drawers(self) -> DataFrame:
        return self._read("drawers")

    @property
    def facts(self) -> DataFrame:
        return self._read("facts")

    @property
    def tunnels(self) -> DataFrame:
        return self._read("tunnels")

    # drawers

    def file(self, rows: DataFrame, added_by: str = "miner") -> str:
        """Files texts (wing, room, source_file, filed_at, text): cut into slices, each under an id made from its content's revision."""
        revision = t.source_revision(F.col("text"), F.lit(1), F.lit("project"))
        cut = t.sliced(rows.withColumn("__revision", revision))
        new = cut.select(t.revision_id(F.col("wing"), F.col("room"), F.col("source_file"), F.col("__revision"), F.col("chunk_index")).alias("id"), "wing", "room", F.lit("").alias("hall"), "source_file", "chunk_index",
                         "filed_at", F.lit(3).alias("importance"), F.lit(added_by).alias("added_by"), F.col("chunk").alias("text"))
        return self._write("drawers", store.upsert(self.drawers, new))

    def add_drawer(self, wing: str, room: str, content: str, source_file: str = "", added_by: str = "user", filed_at: str = "") -> str:
        """One drawer, under an id made from its place and content; the same again changes nothing. Gives the id."""
        named = self.spark.range(1).select(t.safe_name(F.lit(wing)).alias("wing"), t.safe_name(F.lit(room)).alias("room"), F.concat(F.lit(f"drawer_{wing}_{room}_"), F.substring(F.sha2(F.lit(wing + room + content), 256), 1, 24)).alias("id"))
        row = named.first()
        if row["wing"] is None or row["room"] is None:
            raise ValueError("a wing and a room need plain names")
        new = self.spark.createDataFrame([(row["id"], wing, room, "", source_file, 0, filed_at, 3, added_by, content)], DRAWER)
        if self.drawers.where(F.col("id") == row["id"]).isEmpty():
            self._write("drawers", self.drawers.unionByName(new))
        return row["id"]

    def get_drawer(self, ident: str) -> DataFrame:
        return self.drawers.where(F.col("id") == ident)

    def get_drawers(self, idents: DataFrame) -> DataFrame:
        return self.drawers.join(idents.select("id").distinct(), "id", "left_semi")

    def select_drawers(self, condition: dict | None = None, text: dict | None = None, columns: list[str] | None = None) -> DataFrame:
        return self.drawers.where(where(condition) & where_text(text)).select(*(columns or ["*"]))

    def update_drawer(self, ident: str, content: str | None = None, wing: str | None = None, room: str | None = None) -> str:
        change = self.spark.createDataFrame([(ident, wing, room, content)], "id string, wing string, room string, text string")
        return self._write("drawers", store.update(self.drawers, change))

    def delete_drawers(self, idents: DataFrame | None = None, condition: dict | None = None) -> str:
        return self._write("drawers", store.delete(self.drawers, idents, where(condition) if condition else None))

    def list_drawers(self, wing: str | None = None, room: str | None = None, after: str = "", size: int = 20) -> DataFrame:
        return taxonomy.listing(self.drawers, wing, room, after, size)

    def page(self, ident: str, offset: int = 0, limit: int = 2048, expected_hash: str | None = None) -> DataFrame:
        """(id, offset, text, next, sha256): a window of one text; no row if the text isn't the expected one."""
        row = self.get_drawer(ident).withColumn("sha256", F.sha2("text", 256))
        row = row.where(F.col("sha256") == expected_hash) if expected_hash else row
        more = F.when(F.char_length("text") > offset + limit, offset + limit)
        return row.select("id", F.lit(offset).alias("offset"), F.substring("text", offset + 1, limit).alias("text"), more.alias("next"), "sha256")

    # overviews

    def status(self) -> DataFrame:
        return taxonomy.counts(self.drawers)

    def wings(self) -> DataFrame:
        return taxonomy.wings(self.drawers)

    def rooms(self, wing: str | None = None) -> DataFrame:
        return taxonomy.rooms(self.drawers, wing)

    def taxonomy(self) -> DataFrame:
        return taxonomy.taxonomy(self.drawers)

    def wake_up(self, wing: str | None = None) -> DataFrame:
        return taxonomy.wake_up(self.drawers.where(where({"wing": wing} if wing else None)))

    # retrieval

    def search(self, query: str, k: int = 5, wing: str | None = None, room: str | None = None, mode: str = "lexical", vector: list[float] | None = None, vectors: DataFrame | None = None,
               project: str | None = None, scorer: Callable | None = None, around: int = 0) -> DataFrame:
        """Cleaned query inside the scope, best first: words alone (lexical), or words, vectors and facts in one of the modes fast, standard and boosted.

        vectors (id, vector) belong to drawers, vector to the query; without them there is no dense signal.  project is the wing of who asks.  around adds a context of so many
        slices before and after each hit.
        """
        asked = self.spark.range(1).select(F.lit(0).cast("long").alias("query_id"), t.sanitized_query(F.lit(query))["clean"].alias("text"))
        inside = self.select_drawers({k_: v for k_, v in (("wing", wing), ("room", room)) if v})
        if mode == "lexical":
            hits = retrieval.search(asked, inside, k=k)
        else:
            asked = asked.select("*", F.lit(vector).cast("array<double>").alias("vector") if vector is None else F.array(*map(F.lit, vector)).cast("array<double>").alias("vector"), F.lit(project).cast("string").alias("wing"))
            filed = F.coalesce(F.unix_timestamp(F.to_timestamp(F.nullif("filed_at", F.lit("")))).cast("double"), F.lit(0.0))
            numbered = inside.select("id", "wing", "room", "text", F.xxhash64("id").alias("doc_id"), filed.alias("filed"), F.lit(None).cast("double").alias("quality"), F.lit(None).cast("double").alias("novelty"))
            rows = self.spark.createDataFrame([], "id long, vector array<double>") if vectors is None else vectors.select(F.xxhash64("id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
            names = self.facts.select(F.col("subject").alias("entity")).union(self.facts.select("object")).distinct()
            hits = retrieval.search_all(asked, numbered, rows, self.facts, names, mode, k, scorer=scorer)
            hits = hits.join(inside.select("id", "wing", "room"), "id").select("query_id", "rank", "id", "wing", "room", "score")
        out = hits.join(inside.select("id", "text"), "id")
        if around:
            placed = hits.join(inside.select("id", "source_file", "chunk_index"), "id").select("id", "source_file", "chunk_index")
            out = out.join(taxonomy.neighbours(self.drawers, placed, around), "id", "left")
        return out.orderBy("rank")

    def recall(self, query: str, match: str = "all", k: int = 8, budget: int = 8192) -> DataFrame:
        """Exact recall: drawers with all (or any) words, by BM25, as far as the byte budget goes."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        held = retrieval.boolean_match(asked, self.drawers, match).select("id")
        inside = self.drawers.join(held, "id", "left_semi")
        return retrieval.within_bytes(retrieval.bm25(asked, inside, k).join(inside.select("id", "text"), "id"), budget).orderBy("rank")

    # facts

    def add_fact(self, subject: str, predicate: str, obj: str, valid_from: str | None = None, **rest: object) -> str:
        return self._write("facts", knowledge.with_triple(self.facts, subject, predicate, obj, valid_from, **rest))

    def invalidate(self, subject: str, predicate: str, obj: str, ended: str) -> str:
        return self._write("facts", knowledge.invalidated(self.facts, subject, predicate, obj, ended))

    def query_facts(self, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return knowledge.of_entity(self.facts, entity, as_of, direction)

    def timeline(self, entity: str | None = None) -> DataFrame:
        return knowledge.timeline(self.facts, entity)

    def fact_stats(self) -> DataFrame:
        return knowledge.statistics(self.facts)

    # graph

    def graph_stats(self) -> DataFrame:
        return graph.statistics(graph.nodes(self.drawers))

    def traverse(self, room: str, hops: int = 2) -> DataFrame:
        return graph.traverse(graph.nodes(self.drawers), room, hops)

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
        return graph.tunnels(graph.nodes(self.drawers), wing_a, wing_b)

    def create_tunnel(self, wing_a: str, room_a: str, wing_b: str, room_b: str, label: str = "") -> str:
        return self._write("tunnels", graph.with_tunnel(self.tunnels, wing_a, room_a, wing_b, room_b, label))

    def list_tunnels(self, wing: str | None = None) -> DataFrame:
        return graph.tunnels_of(self.tunnels, wing)

    def delete_tunnel(self, ident: str) -> str:
        return self._write("tunnels", graph.without_tunnel(self.tunnels, ident))

    def follow_tunnels(self, wing: str, room: str) -> DataFrame:
        return graph.followed(self.tunnels, self.drawers, wing, room)

    # diary

    def write_diary(self, agent: str, entry: str, topic: str = "general", filed_at: str = "") -> str:
        return self.add_drawer(f"wing_{agent}", "diary", entry, topic, agent, filed_at)

    def read_diary(self, agent: str, n: int = 10) -> DataFrame:
        held = self.drawers.where((F.col("wing") == f"wing_{agent}") & (F.col("room") == "diary"))
        return taxonomy.latest(held, "wing", n).join(held.select("id", "text"), "id").orderBy("place")

    # upkeep

    def optimize(self, files: int = 8, keep: int = 2) -> None:
        for name, (at, _) in self.tables.items():
            if at.snapshots():
                at.compact(files)
                at.forget(keep)

    def sizes(self) -> DataFrame:
        """(table, snapshots, n) of every table."""
        out = None
        for name, (at, _) in self.tables.items():
            row = self._read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(len(at.snapshots())).alias("snapshots"), "n")
            out = row if out is None else out.unionByName(row)
        return out
