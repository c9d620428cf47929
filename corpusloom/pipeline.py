"""The whole analysis as stages of named tables, resumable, with review gates and published reports."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import boilerplate, content, dedup, domains, lexical, near, sampling
from corpusloom.session import clear, exists, files
from corpusloom.sources import sinks, tables


class LoomError(Exception):
    """A known failure of the analysis."""


class SourceChanged(LoomError):
    """The sources are not those that earlier stages were made from."""


class ReviewRequired(LoomError):
    """A gate waits for human judgement."""


class ReviewRejected(LoomError):
    """Judged candidates did not reach the required precision."""


@dataclasses.dataclass(frozen=True)
class Config:
    """Sources, output folder and parameters; paths may hold environment variables."""

    pages: str
    domains: str
    output: str
    review: bool = True
    review_rows: int = 100
    min_precision: float = 0.95
    min_lower: float = 0.90
    jaccard: float = near.JACCARD

    def __post_init__(self) -> None:
        for name in ("pages", "domains", "output"):
            path = os.path.expandvars(getattr(self, name))
            if "$" in path:
                raise LoomError(f"{name}: unresolved variable in {path}")
            object.__setattr__(self, name, path)
        if not 0 < self.jaccard <= 1 or self.review_rows < 1:
            raise LoomError("jaccard must lie in (0, 1] and review_rows be positive")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A source table: Parquet, or a tab-separated file by its suffix."""
    if path.endswith((".tsv", ".txt")):
        return tables.read_pages(spark, path) if kind == "pages" else tables.read_domains(spark, path)
    return spark.read.parquet(path)


class Pipeline:
    """Runs stages into ``output/stages`` once each, and reports into ``output/public``."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.stages, self.public = f"{config.output}/stages", f"{config.output}/public"

    def verify(self) -> dict:
        """Identity of sources and parameters; an error if earlier stages were made from others."""
        own = {"sources": {k: files(self.spark, getattr(self.config, k)) for k in ("pages", "domains")}, "config": self.config.fingerprint()}
        known = Path(self.config.output, "identity.json")
        if known.exists() and json.loads(known.read_text()) != own:
            raise SourceChanged("sources or parameters differ from those of earlier stages")
        if not known.exists():
            sinks.write_json(own, str(known))
        return own

    def stage(self, name: str, make) -> DataFrame:
        """The table of a stage; made unless an earlier run completed it."""
        path = f"{self.stages}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def gate(self, name: str, candidates: DataFrame, key: str) -> DataFrame | None:
        """Passes if there is nothing to judge or the judged sample is precise enough; unsure counts as wrong.

        Returns the labels by sample id, if there are any.
        """
        if not self.config.review or candidates.isEmpty():
            return None
        sheet, filled = f"{self.config.output}/review/{name}.csv", f"{self.config.output}/review/{name}-filled.csv"
        if not Path(filled).exists():
            sample = candidates.withColumn("one", F.lit(name))
            sinks.export_review(sampling.stratified_sample(sample, key, ["one"], self.config.review_rows), sheet, key)
            raise ReviewRequired(sheet)
        labels = sinks.import_review(self.spark, filled).withColumn("one", F.lit(name))
        row = sampling.review_gate(labels, "one", F.col("label") == "yes", self.config.min_precision, self.config.min_lower).first()
        if row is None or not row.approved:
            raise ReviewRejected(f"{name}: precision {row and row.precision}, lower bound {row and row.lower}")
        return labels

    def run(self) -> dict:
        """All stages and reports; what is complete is not made again."""
        self.verify()
        pages, domain = load(self.spark, self.config.pages, "pages"), load(self.spark, self.config.domains, "domains")
        canon = self.stage("domains", lambda: domains.canonical_domains(domain))
        features = self.stage("features", lambda: dedup.page_features(pages))
        docs = self.stage("documents", lambda: boilerplate.clean_pages(pages).join(dedup.mark_representatives(features, "normalized_sha256").filter("is_representative").select("page_id"), "page_id", "left_semi"))
        found = self.stage("candidates", lambda: boilerplate.candidates(boilerplate.text_units(docs), docs))
        self.gate("candidates", found, "unit")
        cleaned = self.stage("clean", lambda: boilerplate.clean(docs, found).filter("text <> ''"))
        wiki = canon.filter("is_wiki").select(F.col("id").alias("domain_id"))
        residual = self.stage("residual", lambda: boilerplate.residual_candidates(boilerplate.residual_units(cleaned, wiki), cleaned).withColumn("review_key", F.concat_ws(":", "domain_id", "kind", "unit")))
        labels = self.gate("residual", residual, "review_key")
        if labels is not None:
            judged = residual.withColumn("sample_id", F.substring(F.sha2("review_key", 256), 1, 20)).join(labels.filter("label = 'no'").select("sample_id"), "sample_id")
            residual = boilerplate.approved_residuals(residual, judged.select("domain_id", "kind", "unit"))
        final = self.stage("final", lambda: boilerplate.clean_residual(cleaned.select("page_id", "domain_id", "text"), residual).filter("text <> ''"))
        unique = self.stage("unique", lambda: final.join(dedup.mark_representatives(final.select("page_id", F.sha2("text", 256).alias("h")), "h").filter("is_representative").select("page_id"), "page_id", "left_semi"))
        named = unique.withColumnRenamed("page_id", "doc_id")
        vocab = self.stage("vocabulary", lambda: lexical.vocabulary(lexical.tokens(named)))
        bigrams = self.stage("bigrams", lambda: lexical.ngram_counts(lexical.sequences(named), 2))
        prof = self.stage("profiles", lambda: content.profile(named))
        groups = dedup.groups(features, "normalized_sha256")
        reports = {
            "status": pages.groupBy("status").agg(F.count("*").alias("pages")).orderBy("status"), "clusters": dedup.cluster_summary(groups, "normalized"), "group_sizes": dedup.group_sizes(groups, "normalized").orderBy("group_size"),
            "domain_levels": domains.levels(canon).orderBy("level"), "domain_children": domains.children(canon), "vocabulary": lexical.vocabulary_summary(vocab), "zipf": lexical.zipf_bins(vocab).orderBy("bin"), "coverage": lexical.coverage(vocab).orderBy("rank"),
            "collocations": lexical.npmi(bigrams), "signals": content.signal_prevalence(prof).orderBy("signal"), "diversity": content.ttr_by_size(prof).orderBy("size"), "sizes": content.quantiles(prof, "characters", "words"),
        }
        files = [p for name, df in reports.items() for p in sinks.write_table(df, self.public, name)]
        checks = {r.check: r.violations for r in sampling.broken({"df_at_most_tf": (vocab, F.col("df") <= F.col("tf")), "cleaning_shrinks": (cleaned, F.col("characters_after") <= F.col("characters_before"))}).collect()}
        sinks.write_json({"pages": features.count(), "documents": docs.count(), "clean": cleaned.count(), "final": final.count(), "unique": unique.count(), "violations": checks}, f"{self.public}/summary.json")
        sinks.write_checksums(self.public)
        if any(checks.values()):
            raise LoomError(f"invariants do not hold: {checks}")
        clear(self.spark)
        return {"files": len(files), "violations": checks}

    def near_duplicates(self) -> dict:
        """Groups of near-duplicates among the unique clean documents; needs a completed run."""
        if not exists(self.spark, f"{self.stages}/unique/_SUCCESS"):
            raise LoomError("near-duplicates need a completed run")
        docs = self.spark.read.parquet(f"{self.stages}/unique")
        groups = self.stage("near", lambda: near.near_groups(docs, self.config.jaccard, id_col="page_id"))
        row = groups.agg(F.count("*").alias("documents"), F.countDistinct("class_id").alias("classes"), F.count_if(F.col("links") > 0).alias("linked")).first()
        sinks.write_json(row.asDict(), f"{self.public}/near.json")
        return row.asDict()
