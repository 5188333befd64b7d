"""The engine as one object: what an API would call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scores
from corpusmill.operators import identity, retrieval, tables


@dataclass
class Engine:
    """Tables: documents (id, text, year, source, ...), vectors (id, embedding), edges (edge_id, source, target), features (id, scores)."""

    spark: SparkSession
    documents: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    features: DataFrame | None = None
    artifacts: DataFrame | None = None  # artifact_id, provider, artifact_type, ...
    links: DataFrame | None = None  # paper, artifact, relation, confidence, field
    topics: DataFrame | None = None  # id, cluster, rank, label
    key: str = "id"

    def search(self, query: str, mode: str = "lexical", vector: list[float] | None = None, limit: int = 10, offset: int = 0, candidates: int = 200, **filters) -> DataFrame:
        """lexical, dense or hybrid; candidates are found first, then filtered, then paged."""
        asked = self.spark.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))
        lex = retrieval.bm25(self.documents, self.key, "text", asked, candidates) if mode != "dense" else None
        den = None
        if mode != "lexical":
            q = self.spark.range(1).select(F.lit("q").alias("query_id"), F.array(*[F.lit(float(x)) for x in vector or []]).alias("query"))
            den = retrieval.exact_knn(self.vectors, self.key, "embedding", q, candidates, include_self=True)
        found = lex if den is None else den if lex is None else retrieval.hybrid(lex, den, self.key)
        rows = found.select(self.key, "score").join(self.documents, self.key)
        return tables.page(tables.optional(rows, *self._tests(filters)), [F.desc("score"), F.asc(self.key)], limit, offset)

    @staticmethod
    def _tests(filters: dict) -> list:
        """name=value: equal in any case; name_from, name_to: range (null fails); name=True or False: tri-state."""
        out = []
        for name, v in filters.items():
            if v is None:
                continue
            if isinstance(v, bool):
                out.append(tables.tri_state(name, v))
            elif name.endswith("_from"):
                out.append(F.col(name[:-5]) >= v)
            elif name.endswith("_to"):
                out.append(F.col(name[:-3]) <= v)
            else:
                out.append(F.lower(F.col(name).cast("string")) == str(v).lower())
        return out

    def list(self, order: str, descending: bool = True, limit: int = 10, offset: int = 0, **filters) -> DataFrame:
        by = F.desc_nulls_last(order) if descending else F.asc_nulls_last(order)
        return tables.page(tables.optional(self.documents, *self._tests(filters)), [by, F.asc(self.key)], limit, offset)

    def rank(self, profile: dict) -> DataFrame:
        """profile: weights by feature, limit, filters."""
        s = scores.weighted({k: F.col(k) for k in profile["weights"]}, profile["weights"])
        rows = tables.optional(self.features.withColumn("score", s), *self._tests(profile.get("filters", {})))
        return tables.page(rows, [F.desc("score"), F.desc(self.key)], max(1, profile.get("limit", 10)))

    def similar(self, of, limit: int = 10, least: float = -1.0) -> DataFrame:
        one = self.vectors.where(F.col(self.key) == of).select(F.col(self.key).alias("query_id"), F.col("embedding").alias("query"))
        return retrieval.exact_knn(self.vectors, self.key, "embedding", one, limit).where(F.col("score") >= least)

    def references(self, of, limit: int = 10, offset: int = 0) -> DataFrame:
        return tables.page(self.edges.where(F.col("source") == of), [F.asc("edge_id")], limit, offset)

    def citations(self, of, limit: int = 10, offset: int = 0) -> DataFrame:
        return tables.page(self.edges.where(F.col("target") == of), [F.asc("edge_id")], limit, offset)

    def compare(self, ids: list) -> DataFrame:
        """Two to five papers, in the order given."""
        if not 2 <= len(set(ids)) == len(ids) <= 5:
            raise ValueError("compare takes 2 to 5 different ids")
        at = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(self.key))
        return self.documents.where(F.col(self.key).isin(ids)).withColumn("position", at).orderBy("position")

    def artifact_list(self, order: str = "artifact_id", descending: bool = False, limit: int = 10, offset: int = 0, has_papers: bool | None = None, **filters) -> DataFrame:
        rows = tables.optional(self.artifacts, *self._tests(filters))
        if has_papers is not None:
            rows = rows.join(self.links.select(F.col("artifact").alias("artifact_id")), "artifact_id", "left_semi" if has_papers else "left_anti")
        by = F.desc_nulls_last(order) if descending else F.asc_nulls_last(order)
        return tables.page(rows, [by, F.asc("artifact_id")], limit, offset)

    def artifact(self, of) -> DataFrame:
        """One artifact with the number of its papers and the relations they have to it."""
        own = self.links.where(F.col("artifact") == of).agg(F.countDistinct("paper").alias("papers"), F.array_sort(F.collect_set("relation")).alias("relations"), F.max("confidence").alias("confidence"))
        return self.artifacts.where(F.col("artifact_id") == of).join(own)

    def papers_of(self, artifact, limit: int = 10, offset: int = 0) -> DataFrame:
        best = identity.artifact_details(self.links.where(F.col("artifact") == artifact)).withColumnRenamed("paper", self.key)
        return tables.page(best.join(self.documents, self.key), [F.desc("confidence"), F.asc(self.key)], limit, offset)

    def artifacts_of(self, paper) -> DataFrame:
        best = identity.artifact_details(self.links.where(F.col("paper") == paper)).withColumnRenamed("artifact", "artifact_id")
        return best.join(self.artifacts, "artifact_id").orderBy(F.desc("confidence"), "artifact_id", "relation")

    def clusters(self, order: str = "size") -> DataFrame:
        """Topics with their size and label; by size, or by name of the column."""
        rows = self.topics.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("label"))
        return rows.orderBy(F.desc("size") if order == "size" else F.asc(order), "cluster")

    def cluster(self, of, limit: int = 10, offset: int = 0) -> DataFrame:
        own = self.topics.where(F.col("cluster") == of)
        return tables.page(own.join(self.documents, self.key), [F.asc("rank"), F.asc(self.key)], limit, offset)

    def detail(self, of) -> DataFrame:
        """A paper with its artifacts, topic, and numbers of references and citations, where these tables are there."""
        out = self.documents.where(F.col(self.key) == of)
        if self.links is not None:
            own = self.artifacts_of(of).select("artifact_id", "relation", "confidence", "evidence", "fields")
            out = out.join(own.agg(F.array_sort(F.collect_list(F.struct("artifact_id", "relation", "confidence", "evidence", "fields"))).alias("artifacts")))
        if self.topics is not None:
            out = out.join(self.topics.select(self.key, "cluster", "rank", F.col("label").alias("cluster_label")), self.key, "left")
        if self.edges is not None:
            n = lambda c, name: self.edges.where(F.col(c) == of).agg(F.count(F.lit(1)).alias(name))
            out = out.join(n("source", "references")).join(n("target", "citations"))
        return out

    def health(self) -> dict[str, int | None]:
        """Rows of each table that is there."""
        every = {"documents": self.documents, "vectors": self.vectors, "edges": self.edges, "features": self.features, "artifacts": self.artifacts, "links": self.links, "topics": self.topics}
        return {k: None if df is None else df.count() for k, df in every.items()}
