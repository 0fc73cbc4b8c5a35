"""Documents that travel with data: manifests, metrics, runs; JSON and YAML in and out; paths; run folders."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import random
import re
import shutil
import subprocess
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

TASKS, SPLITS = ("ctr", "cvr", "multitask"), ("train", "valid", "test")


class Document:
    """A dataclass that writes itself as JSON and reads itself back; unknown keys are kept out."""

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False, default=str)

    @classmethod
    def from_dict(cls, d: dict):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in known})

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))

    def save(self, path: str) -> None:
        p = Path(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def load(cls, path: str):
        return cls.from_json(Path(path).read_text(encoding="utf-8"))


@dataclass
class DatasetManifest(Document):
    name: str
    version: str
    task: str = "ctr"
    splits: dict[str, str] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    num_rows: dict[str, int] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


@dataclass
class Metrics(Document):
    auc: float | None = None
    logloss: float | None = None
    ece: float | None = None
    mce: float | None = None
    gini: float | None = None
    ks: float | None = None
    groups: dict[str, dict] = field(default_factory=dict)
    kpis: dict[str, float] = field(default_factory=dict)
    intervals: dict[str, dict] = field(default_factory=dict)


@dataclass
class RunMeta(Document):
    run_id: str
    name: str = ""
    started: str = ""
    config: dict = field(default_factory=dict)
    config_hash: str = ""
    environment: dict = field(default_factory=dict)
    status: str = "created"


def dict_hash(d: dict) -> str:
    return hashlib.sha256(json.dumps(d, sort_keys=True, default=str).encode()).hexdigest()


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 16):
            h.update(block)
    return h.hexdigest()


def seed_everything(seed: int) -> None:
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % 2**32)


def environment() -> dict:
    import pyspark

    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "git": git_state(), "packages": packages()}


def git_state(folder: str = ".") -> dict:
    """Commit and whether files differ from it; empty outside a repository."""
    def ask(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    commit = ask("rev-parse", "HEAD")
    return {"commit": commit, "dirty": bool(ask("status", "--porcelain"))} if commit else {}


def packages() -> dict[str, str]:
    """Installed packages and their versions."""
    return {d.metadata["Name"]: d.version for d in metadata.distributions() if d.metadata["Name"]}


def logger(name: str, level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(level)
    return log


def is_absolute(path: str) -> bool:
    """Unix, drive-letter, share and URI paths."""
    return bool(re.match(r"/|[A-Za-z]:[\\/]|\\\\|[a-z][a-z0-9+.-]*://", path))


def resolve_paths(config, root: str):
    """Make the values of keys that end in _path, _dir or _root absolute, with variables and ~ expanded."""
    if isinstance(config, dict):
        return {k: _resolved(v, root) if isinstance(v, str) and re.search(r"_(path|dir|root)$", k) and k not in ("class_path", "module_path") else resolve_paths(v, root) for k, v in config.items()}
    if isinstance(config, list):
        return [resolve_paths(x, root) for x in config]
    return config


def _resolved(path: str, root: str) -> str:
    p = os.path.expanduser(os.path.expandvars(path))
    return p if is_absolute(p) else os.path.normpath(os.path.join(root, p))


def load_config(path: str) -> dict:
    """A YAML or JSON file; those named in its ``defaults`` list come first and are overridden by it."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        own = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML configurations need PyYAML") from e
        own = yaml.safe_load(text) or {}
    out: dict = {}
    for name in own.pop("defaults", []):
        if isinstance(name, str) and name != "_self_":
            out = merged(out, load_config(str(Path(path).parent / name)))
    return merged(out, own)


def dump_config(config: dict, path: str) -> None:
    """Write a configuration as YAML or, by its ending, JSON; ``load_config`` reads it back."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if path.endswith(".json"):
        text = json.dumps(config, indent=2, default=str)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML configurations need PyYAML") from e
        text = yaml.safe_dump(config, sort_keys=False, allow_unicode=True)
    Path(path).write_text(text, encoding="utf-8")


def merged(a: dict, b: dict) -> dict:
    return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


class RunFolder:
    """A run's folder: configuration, artifacts, checkpoints, curves and tables."""

    PARTS = ("artifacts", "checkpoints", "curves", "tables")

    def __init__(self, root: str, name: str = "run"):
        self.id = f"{name}_{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
        self.path = Path(root) / self.id
        for p in self.PARTS:
            (self.path / p).mkdir(parents=True, exist_ok=True)

    def save_config(self, config: dict) -> RunMeta:
        meta = RunMeta(self.id, started=datetime.now(timezone.utc).isoformat(), config=config, config_hash=dict_hash(config), environment=environment())
        meta.save(str(self.path / "run_meta.json"))
        return meta

    def save_metrics(self, metrics: Metrics) -> None:
        metrics.save(str(self.path / "metrics.json"))

    def add_artifact(self, path: str) -> Path:
        return Path(shutil.copy2(path, self.path / "artifacts"))

    def artifacts(self) -> list[str]:
        return sorted(p.name for p in (self.path / "artifacts").iterdir())

    def save_checkpoint(self, path: str, step: int) -> Path:
        return Path(shutil.copy2(path, self.path / "checkpoints" / f"step_{step:09d}{Path(path).suffix}"))

    def checkpoints(self) -> list[str]:
        """By step."""
        return sorted(p.name for p in (self.path / "checkpoints").iterdir())


def get_run(root: str, run_id: str) -> dict:
    """One run: its description, metrics if there are any, and the files of its parts."""
    path = Path(root) / run_id
    if not (path / "run_meta.json").exists():
        raise KeyError(f"no run {run_id!r} in {root}")
    measured = path / "metrics.json"
    files = {part: sorted(str(p.relative_to(path / part)) for p in (path / part).rglob("*") if p.is_file()) for part in RunFolder.PARTS if (path / part).is_dir()}
    return RunMeta.load(str(path / "run_meta.json")).to_dict() | {"metrics": Metrics.load(str(measured)).to_dict() if measured.exists() else None, "files": files}


def runs(spark, root: str):
    """The catalog of runs: run_id, name, started, status, config_hash."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run_meta.json").schema("run_id string, name string, started string, status string, config_hash string").json(root)


def run_metrics(spark, root: str):
    """run_id, metric, value of every run, to get, list and compare."""
    from pyspark.sql import functions as F

    names = ["auc", "logloss", "ece", "mce", "gini", "ks"]
    m = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").schema(", ".join(f"{n} double" for n in names)).json(root)
    own = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return m.select(own.alias("run_id"), *names).unpivot("run_id", names, "metric", "value").where("value is not null")


def compare_runs(spark, root: str, first: str, second: str):
    """metric, first, second, difference of two runs; a metric that one run lacks is null there."""
    from pyspark.sql import functions as F

    m = run_metrics(spark, root)
    side = lambda run, name: m.where(F.col("run_id") == run).select("metric", F.col("value").alias(name))
    return side(first, "first").join(side(second, "second"), "metric", "full").withColumn("difference", F.col("second") - F.col("first"))
