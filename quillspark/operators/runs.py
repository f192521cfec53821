"""Run files with their manifest, and configurations from YAML."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.evaluation import run_rejects
from quillspark.operators.tables import LIMITS
from quillspark.registry import canonical_json, config_hash
from quillspark.schemas import RUN_SCHEMA


@dataclasses.dataclass(frozen=True)
class RunManifest:
    """What made a run; its id is a hash of all of it."""

    corpus_snapshot: str
    chunker_config_id: str
    dedup_config_id: str
    parser_id: str
    embedder_id: str
    qrels_version: int
    split: str
    embedder_snapshot_date: str = ""
    embedding_dim: int = 0
    quantization: str = "none"
    index_params: dict[str, Any] = dataclasses.field(default_factory=dict)
    prefilter: bool = True
    sparse_id: str | None = None
    fusion_id: str | None = None
    reranker_id: str | None = None
    rerank_top_k: int | None = None
    query_transform_id: str | None = None
    generator_id: str | None = None
    generator_snapshot_date: str | None = None
    prompt_sha: str | None = None
    judge_id: str | None = None
    seed: int = 0
    constraints: dict[str, float] = dataclasses.field(default_factory=lambda: {name: most for name, (_, most) in LIMITS.items()})
    code_git_sha: str = ""
    notes: str = ""

    def __post_init__(self) -> None:
        if self.split not in ("dev", "test"):
            raise ValueError("split is dev or test")

    def run_id(self) -> str:
        return config_hash(dataclasses.asdict(self))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_run(run: DataFrame, path: str, manifest: RunManifest) -> None:
    """A new run file; one that exists or rows with a bad span or rank are errors. The manifest is written last, so a run
    that has one is complete."""
    if not run_rejects(run).isEmpty():
        raise ValueError("a run has rows with a bad span or rank")
    run.withColumn("run_id", F.lit(manifest.run_id())).select(*[c.split()[0] for c in RUN_SCHEMA.split(", ")]).write.mode("errorifexists").parquet(path)
    p, fs = _fs(run.sparkSession, path + ".manifest.json")
    out = fs.create(p, False)
    out.write(bytearray(canonical_json(dataclasses.asdict(manifest)).encode()))
    out.close()


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, RunManifest]:
    p, fs = _fs(spark, path + ".manifest.json")
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} has no manifest, so it is not complete")
    text = "\n".join(r[0] for r in spark.read.text(path + ".manifest.json").collect())
    return spark.read.schema(RUN_SCHEMA).parquet(path), RunManifest(**json.loads(text))


def configured(kind: type, text: str) -> Any:
    """A configuration dataclass from YAML; an unknown name is an error that lists the known ones."""
    import yaml

    given = yaml.safe_load(text) or {}
    known = [f.name for f in dataclasses.fields(kind)]
    if not isinstance(given, dict) or (unknown := sorted(set(given) - set(known))):
        raise ValueError(f"unknown settings {unknown if isinstance(given, dict) else given!r}; there are {', '.join(known)}")
    return kind(**given)
