"""Tolerant CSV scan of the export files: every column text, malformed lines skipped and countable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SCHEMA_VERSION = "star-1"

# File names and columns of the export.
ROLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "sales_headers": ("Facture_vente_ent_v.csv", (
        "ENT_ID", "PIECENOFULL", "TIERS", "DATEPIECE", "DATEECHEANCE", "MONTANTSIGNE_DEV", "HT_DEV", "TTC_DEV",
        "MODEREGLLIBELLE", "NBREARTICLE", "DEPOT")),
    "sales_lines": ("ZZ_Facture_vente_mouv.csv", (
        "MOUV_ID", "NUMEROFULL", "TIERS", "REFERENCE", "DESIGNATION", "ARTICLE_LIBELLE_FAM_STAT1", "DATEFACTURE",
        "MONTANTSIGNE_DEV", "QUANTITESIGNEE", "MTCRSIGNE", "SENS")),
    "purchase_headers": ("Facture_achat_ent_v.csv", (
        "ENT_ID", "PIECENOFULL", "FOURNISSEURNOM", "CLE_FOURNISSEUR", "DATEPIECE", "DATEECHEANCE", "MONTANTSIGNE_DEV",
        "HT_DEV", "TTC_DEV", "MONTANTTVAFOURNISSEUR_DEV", "MODEREGLLIBELLE", "PIECEEXTERNE")),
    "purchase_lines": ("Facture_achat_mouv_v.csv", (
        "MOUV_ID", "NUMEROFULL", "CLE_FOURNISSEUR", "REFERENCE", "DESIGNATION", "INDICMVTSTOCK", "DATEFACTURE",
        "QUANTITESIGNEE", "MONTANTSIGNE_DEV")),
    "quotes": ("Devis_vente_ent_vv.csv", (
        "ENT_ID", "PIECENOFULL", "TIERS", "DATEPIECE", "MONTANTSIGNE_DEV", "HT_DEV", "TTC_DEV", "STATUS", "ETATPIECE")),
    "deliveries": ("Gsl_vente_bl_entete.csv", ("ENT_CLIENT_CODE", "ENT_DATE", "ENT_NBR_ARTICLE")),
    "customer_reference": ("Gsl_vente_fa_entete.csv", (
        "ENT_CLIENT_CODE", "ENT_CLIENT_INTITULE", "ENT_CLIENT_VILLE", "ENT_DEPOT_CODE", "ENT_DEPOT_INTITULE")),
    "suppliers": ("Fournisseurs_v.csv", ("CLE_FOURNISSEUR", "TIERS", "NOMFOURNISSEUR", "VILLE", "PAYSLIBELLE")),
}
# end of fixed values


def role_path(folder: str, role: str) -> str:
    return f"{folder}/{ROLES[role][0]}"


def _text_schema(names) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of the file (one line read)."""
    first = spark.read.text(path).limit(1).collect()
    return [h.strip().strip('"').lstrip("﻿") for h in first[0][0].split(",")] if first else []


def read_role(spark: SparkSession, folder: str, role: str, keep_malformed: bool = False) -> DataFrame:
    """All-text scan in file column order; lines of the wrong width are dropped, or kept and flagged."""
    path = role_path(folder, role)
    names = header_of(spark, path)
    extra = ["_corrupt_record"] if keep_malformed else []
    df = (spark.read.schema(_text_schema(names + extra)).option("header", "true")
          .option("mode", "PERMISSIVE" if keep_malformed else "DROPMALFORMED")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", "false").option("columnPruning", "false").csv(path))
    missing = [c for c in ROLES[role][1] if c not in names]
    for c in missing:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df if keep_malformed else df.select(*ROLES[role][1])


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {role: read_role(spark, folder, role) for role in ROLES}


def file_signature(df: DataFrame, label: str) -> DataFrame:
    """Name, size and modification time of the files behind a scan, hashed with the schema version."""
    files = df.select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("s"),
                      F.col("_metadata.file_modification_time").alias("m")).groupBy("f").agg(
        F.max("s").alias("s"), F.max("m").alias("m"))
    part = F.concat_ws(":", "f", F.col("s").cast("string"), F.unix_timestamp("m").cast("string"))
    return files.agg(F.sha2(F.concat_ws("|", F.lit(SCHEMA_VERSION), F.array_sort(F.collect_list(part))), 256).alias("signature")) \
        .select(F.lit(label).alias("source"), "signature")


def is_stale(current: DataFrame, published: DataFrame) -> DataFrame:
    """Sources whose signature is new or differs from the last published build."""
    old = published.select("source", F.col("signature").alias("_old"))
    return current.join(old, "source", "left").select(
        "source", "signature", (~F.col("signature").eqNullSafe(F.col("_old"))).alias("stale"))


def data_fingerprint(sales: DataFrame, lines: DataFrame, purchases: DataFrame) -> DataFrame:
    """Counts, bounds and totals of the warehouse, hashed: changes exactly when the data does."""
    cents = lambda c: F.round(F.sum(c) * 100).cast("bigint").cast("string")
    s = sales.agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.min("date").cast("string"), F.max("date").cast("string"),
                              cents("ttc"), F.countDistinct("customer").cast("string")).alias("part"))
    a = lines.agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.round(F.sum("amount")).cast("bigint").cast("string")).alias("part"))
    p = purchases.agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.round(F.sum("ttc")).cast("bigint").cast("string")).alias("part"))
    parts = s.select(F.lit("1sales").alias("t"), "part").unionByName(a.select(F.lit("2lines").alias("t"), "part")) \
        .unionByName(p.select(F.lit("3purchases").alias("t"), "part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "part"))), lambda x: x["part"]), "|")
    return parts.agg(text.alias("state")).select("state", F.substring(F.sha2(F.col("state"), 256), 1, 16).alias("fingerprint"))


def consumer_status(consumers: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Each model's last learned fingerprint against the current one: fresh, stale or never."""
    now = fingerprint.select("fingerprint").scalar()
    seen = F.col("learned_fingerprint")
    return consumers.select("consumer", F.when(seen.isNull(), "never").when(seen == now, "fresh").otherwise("stale").alias("status"))
