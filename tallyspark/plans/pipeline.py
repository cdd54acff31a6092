"""The façade: CSV files to bronze, silver and validated layers, duplicates, reconciliation and marts, one batch at a time."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import canonical, duplicates, reconcile, rules, standardize
from ..sources import csv
from . import reports

log = logging.getLogger("tallyspark")


class Pipeline:
    """Each step reads the batch's partition of the layer before and overwrites its own; running a batch again gives the same layers.

    at: the batch's time, in every layer's timestamp.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), at: str = "1970-01-01 00:00:00"):
        self.spark, self.root, self.config, self.at = spark, root.rstrip("/"), config, at

    def layer(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, batch: str) -> DataFrame:
        return csv.read_batch(self.spark, self.layer(name), batch)

    def write(self, df: DataFrame, name: str, batch: str) -> DataFrame:
        csv.write_layer(df, self.layer(name), batch)
        log.info("%s: batch %s written", name, batch)
        return self.read(name, batch)

    def ingest(self, folder: str, batch: str) -> DataFrame:
        files = csv.discover(self.spark, folder)
        raw = csv.read_raw(self.spark, folder, files)
        self.write(csv.bronze(raw, batch, self.at), "bronze", batch)
        return self.write(csv.manifest(raw, files, batch, self.at), "manifest", batch)

    def silver(self, batch: str) -> DataFrame:
        bronze = canonical.number_rows(csv.spread(self.read("bronze", batch)))
        silver = standardize.standardize(standardize.rename(bronze), self.config)
        lineage = {"ingestion_processing_batch_id": F.lit(batch), "standardization_timestamp": F.lit(self.at), "pipeline_stage": F.lit("SILVER"), "source_layer": F.lit("BRONZE")}
        silver = self.write(silver.withColumns(lineage), "silver", batch)
        self.write(standardize.audit(silver, "row_id"), "standardization_audit", batch)
        return self.write(standardize.summary(silver), "standardization_summary", batch)

    def validate(self, batch: str) -> DataFrame:
        silver = self.read("silver", batch)
        own = silver.drop("ingestion_processing_batch_id", "standardization_timestamp", "pipeline_stage", "source_layer", "processing_batch_id")
        checked = rules.validate(rules.count_ids(own), self.config).withColumns({"standardization_timestamp": F.lit(self.at), "validation_timestamp": F.lit(self.at)})
        checked = self.write(checked, "validated", batch)  # written once; the three routes are filters of it
        self.write(rules.audit(checked, "row_id"), "validation_audit", batch)
        return self.write(rules.summary(checked), "validation_summary", batch)

    def routed(self, batch: str, status: str) -> DataFrame:
        return rules.route(self.read("validated", batch), status)

    def match(self, batch: str) -> dict[str, DataFrame]:
        """Pairs, the reconciliation audit and the marts of the batch's valid rows, written and read again."""
        gold = self.routed(batch, "VALID")
        rows = self.write(canonical.canonical_view(gold), "canonical", batch)
        pairs = self.write(duplicates.all_pairs(rows, self.config), "duplicate_pairs", batch)
        audit = self.write(reconcile.reconcile(rows, self.config), "reconciliation_audit", batch)
        dup = duplicates.run_summary(rows, pairs)
        marts = {
            "duplicate_run_summary": dup,
            "reconciliation_summary": reconcile.summary(audit, dup),
            "gold_transaction_master": reports.full_master(rows, audit, duplicates.row_status(rows, pairs), self.at, batch),
            "gold_duplicate_summary": duplicates.mart(pairs),
            "gold_validation_summary": reports.validation_mart(self.read("validation_summary", batch), self.read("validation_audit", batch)),
            "gold_reconciliation_summary": reports.reconciliation_mart(reconcile.summary(audit)),
            "gold_fx_variance": reconcile.fx_mart(rows, self.config),
        }
        return {"duplicate_pairs": pairs, "reconciliation_audit": audit} | {k: self.write(v, k, batch) for k, v in marts.items()}

    def run(self, folder: str, batch: str) -> dict[str, DataFrame]:
        """All steps over a folder of CSV files: the manifest, the summaries and the marts."""
        out = {"manifest": self.ingest(folder, batch), "standardization_summary": self.silver(batch), "validation_summary": self.validate(batch)}
        out |= self.match(batch)
        kpis = reports.executive_kpis(out["validation_summary"], reconcile.summary(out["reconciliation_audit"]))
        out["executive_kpis"] = self.write(kpis, "executive_kpis", batch)
        out["alerts"] = self.write(reports.alerts(out["executive_kpis"]), "alerts", batch)
        stages = {n: self.read(n, batch) for n in ("bronze", "silver")} | {s.lower(): self.routed(batch, s) for s in ("VALID", "WARNING", "REJECTED")} | {n: out[n] for n in ("duplicate_pairs", "reconciliation_audit", "gold_transaction_master")}
        out["lineage"] = self.write(reports.stages(stages), "lineage", batch)
        return out
