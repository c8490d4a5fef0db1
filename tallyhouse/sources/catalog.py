"""Pricing catalog: one JSON document, read once and broadcast as a table."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_END = 2**63 - 1
MODES = ("flat", "volume", "graduated")

# Prices per million tokens when a model leaves one out.
FALLBACK = {"input_per_m": 1.0, "output_per_m": 3.0, "embedding_per_m": 0.10}


@dataclass(frozen=True)
class Tier:
    """Prices for tokens with cumulative month volume in ``[lo, hi)``."""

    lo: int
    hi: int
    input: float
    output: float
    embed: float


@dataclass(frozen=True)
class ModelPrice:
    model_id: str
    mode: str
    input_per_m: float
    output_per_m: float
    embedding_per_m: float
    tiers: tuple[Tier, ...]


@dataclass(frozen=True)
class Catalog:
    models: dict[str, ModelPrice]
    defaults: ModelPrice
    prefixes: tuple[str, ...]
    cache_read_multiplier: float = 0.5
    version: str = "1"
    effective_date: str | None = None

    @property
    def tier_count(self) -> int:
        return max(len(m.tiers) for m in [self.defaults, *self.models.values()])

    def uses(self, mode: str) -> bool:
        return any(m.mode == mode for m in self.models.values())

    @property
    def needs_volume(self) -> bool:
        return self.uses("volume") or self.uses("graduated")

    def with_model(self, model: ModelPrice) -> Catalog:
        return replace(self, models={**self.models, model.model_id: model})

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per model; Spark broadcasts it if it is small."""
        rows = [
            (m.model_id, m.mode, m.input_per_m, m.output_per_m, m.embedding_per_m,
             [(t.lo, t.hi, t.input, t.output, t.embed) for t in m.tiers])
            for m in self.models.values()
        ]
        return spark.createDataFrame(
            rows,
            "model_id string, pricing_mode string, input_per_m double, output_per_m double, "
            "embedding_per_m double, "
            "tiers array<struct<lo:bigint,hi:bigint,input:double,output:double,embed:double>>",
        )

    def document(self) -> dict:
        def entry(m: ModelPrice) -> dict:
            out = {} if m.mode == "flat" else {"pricing_mode": m.mode}
            out.update(input_per_m=m.input_per_m, output_per_m=m.output_per_m,
                       embedding_per_m=m.embedding_per_m)
            if m.mode != "flat":
                out["tiers"] = [
                    {"up_to_tokens_m": None if t.hi == OPEN_END else t.hi // 1_000_000,
                     "input_per_m": t.input, "output_per_m": t.output, "embedding_per_m": t.embed}
                    for t in m.tiers
                ]
            return out

        return {
            "version": self.version,
            "effective_date": self.effective_date,
            "cache_read_multiplier": self.cache_read_multiplier,
            "volume_scope": "customer_model",
            "billing_period": "calendar_month",
            "models": {k: entry(m) for k, m in self.models.items()},
            "defaults": entry(self.defaults),
            "prefix_models": list(self.prefixes),
        }


def model_price(model_id: str, body: dict) -> ModelPrice:
    base = {k: float(body.get(k, v)) for k, v in FALLBACK.items()}
    listed = body.get("tiers") or []
    mode = (body.get("pricing_mode") or ("volume" if listed else "flat")).lower()
    if mode not in MODES:
        raise ValueError(f"{model_id}: unknown pricing_mode {mode}")
    if (mode == "flat") == bool(listed):
        raise ValueError(f"{model_id}: pricing_mode {mode} does not fit {len(listed)} tiers")
    tiers, lo = [], 0
    for i, tier in enumerate(listed or [{}]):
        bound = tier.get("up_to_tokens_m")
        # Volume beyond the last bound stays in the last tier.
        hi = OPEN_END if bound is None or i == len(listed) - 1 else int(bound) * 1_000_000
        price = {k: float(tier.get(k, v)) for k, v in base.items()}
        tiers.append(Tier(lo, hi, price["input_per_m"], price["output_per_m"], price["embedding_per_m"]))
        lo = hi
    return ModelPrice(model_id, mode, *base.values(), tuple(tiers))


def catalog_from(document: dict) -> Catalog:
    if document.get("volume_scope", "customer_model") != "customer_model":
        raise ValueError(f"unsupported volume_scope {document['volume_scope']}")
    if document.get("billing_period", "calendar_month") != "calendar_month":
        raise ValueError(f"unsupported billing_period {document['billing_period']}")
    models = {k: model_price(k, v) for k, v in document.get("models", {}).items()}
    return Catalog(
        models=models,
        defaults=model_price("defaults", document.get("defaults") or {}),
        prefixes=tuple(document.get("prefix_models", [])),
        cache_read_multiplier=float(document.get("cache_read_multiplier", 0.5)),
        version=str(document.get("version", "1")),
        effective_date=document.get("effective_date"),
    )


def load_catalog(spark: SparkSession, path: str, snapshot: str | None = None) -> Catalog:
    """Read the catalog document; a stored snapshot wins over the file."""
    chosen = path
    if snapshot is not None:
        try:
            spark.read.text(snapshot, wholetext=True).first()
            chosen = snapshot
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    text = spark.read.text(chosen, wholetext=True).first()[0]
    return catalog_from(json.loads(text))


def write_catalog(spark: SparkSession, catalog: Catalog, path: str) -> None:
    """Replace the stored snapshot with one JSON document."""
    body = json.dumps(catalog.document())
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


_TIER = "struct<up_to_tokens_m:string,input_per_m:double,output_per_m:double,embedding_per_m:double>"
_DOCUMENT = (
    "volume_scope string, billing_period string, defaults string, "
    f"models map<string,struct<pricing_mode:string,tiers:array<{_TIER}>>>"
)


def validate_catalogs(df: DataFrame, doc_id: str, body: str) -> DataFrame:
    """Check catalog documents, one row per broken rule.

    ``df`` holds one JSON document per row. Output: ``doc_id``, ``model_id``
    (null for document rules) and ``rule``.
    """
    doc = df.select(F.col(doc_id).alias("doc_id"), F.from_json(body, _DOCUMENT).alias("d"))

    def rule(condition, name):
        return F.when(condition, F.lit(name))

    document_rules = F.array(
        rule(F.col("d.models").isNull(), "missing_models"),
        rule(F.col("d.defaults").isNull(), "missing_defaults"),
        rule(F.coalesce("d.volume_scope", F.lit("customer_model")) != "customer_model",
             "unsupported_volume_scope"),
        rule(F.coalesce("d.billing_period", F.lit("calendar_month")) != "calendar_month",
             "unsupported_billing_period"),
    )
    of_documents = doc.select(
        "doc_id", F.lit(None).cast("string").alias("model_id"),
        F.explode(F.array_compact(document_rules)).alias("rule"),
    )
    model = doc.select("doc_id", F.explode("d.models").alias("model_id", "m")).select(
        "doc_id", "model_id", F.col("m.pricing_mode").alias("mode"),
        F.coalesce(F.col("m.tiers"), F.array().cast(f"array<{_TIER}>")).alias("tiers"),
    ).withColumn("n", F.size("tiers"))
    bounds = F.transform("tiers", lambda t: t["up_to_tokens_m"])
    whole = F.transform(bounds, lambda b: b.try_cast("bigint"))
    given = F.filter(whole, lambda b: b.isNotNull())
    # Each given bound must be a whole number above the one before it; the
    # first is compared with -1.
    rising = F.forall(
        F.zip_with(
            given, F.concat(F.array(F.lit(-1).cast("bigint")), given),
            lambda this, before: F.coalesce(this > before, F.lit(True)),
        ),
        lambda ok: ok,
    )
    numeric = F.forall(bounds, lambda b: b.isNull() | b.rlike("^-?[0-9]+$"))
    model_rules = F.array(
        rule(~F.coalesce(F.col("mode").isin(*MODES), F.lit(True)), "invalid_pricing_mode"),
        rule((F.col("mode") == "flat") & (F.col("n") > 0), "flat_with_tiers"),
        rule(F.col("mode").isin("volume", "graduated") & (F.col("n") == 0), "tiers_required"),
        rule((F.col("n") > 0) & ~(numeric & rising), "bounds_not_increasing"),
        rule((F.col("n") > 0) & F.element_at(bounds, -1).isNotNull(), "last_tier_not_open"),
    )
    of_models = model.select(
        "doc_id", "model_id", F.explode(F.array_compact(model_rules)).alias("rule")
    )
    return of_documents.unionByName(of_models)
