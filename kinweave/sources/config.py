"""Configuration, paths, task registry, run folders and logs: plain Python on the driver."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields
from datetime import datetime
from pathlib import Path


@dataclass(frozen=True)
class Dataset:
    name: str
    data_dir: str = "data"
    split_names: tuple[str, ...] = ("train", "valid", "test")
    split_ext: str = "csv"
    prim_id_col: str = "id"
    context_field: str = "authors"
    context_separator: str = ","
    left_id_col: str = "ltable_id"
    right_id_col: str = "rtable_id"
    label_col: str = "label"
    context_name_field: str = "name"
    tables: tuple[tuple[str, str], ...] = ()
    id_namespace: str = "shared"


@dataclass(frozen=True)
class Run:
    """Folders of a run. The last four are for fitted scorers outside: where they lie and which tasks they know."""

    output_dir: str = "out"
    log_dir: str = "logs"
    run_name: str = "run"
    reduced_dir: str = "out/reduced"
    splits_dirname: str = "splits"
    models_dir: str = "models"
    model_filename: str = "model.pt"
    tasks_file: str = "models/configs.json"


@dataclass(frozen=True)
class Algo:
    alpha: float = 0.1
    threshold: float = 0.5
    k: int = 2
    strategy: str = "LATE_FUSION"
    similarity: str = "jaccard_coefficient"
    is_relations_triples: bool = True
    use_gpu: bool = False
    fp16: bool = False


@dataclass(frozen=True)
class Finetune:
    enabled: bool = False
    task: str = "matching"
    lm: str = ""
    encoder: str = ""
    fp16: bool = False
    lr: float = 3e-5
    epochs: int = 1
    batch_size: int = 32
    max_len: int = 128


@dataclass(frozen=True)
class Config:
    dataset: Dataset
    run: Run
    algo: Algo
    finetune: Finetune = field(default_factory=Finetune)

    def table_path(self, side: str) -> str:
        return f"{self.dataset.data_dir}/{self.dataset.name}/table{side.upper()}.csv"

    def pairs_path(self, split: str) -> str:
        return f"{self.dataset.data_dir}/{self.dataset.name}/{split}.{self.dataset.split_ext}"

    def sides(self) -> tuple[tuple[str, str], ...]:
        """(side, column of the pairs that names its records), the left one first."""
        return self.dataset.tables or (("a", self.dataset.left_id_col), ("b", self.dataset.right_id_col))

    def reduced_path(self, split: str, side: str) -> str:
        return f"{self.run.reduced_dir}/{split}_{side}.csv"

    def text_path(self, split: str) -> str:
        return f"{self.run.output_dir}/{self.run.splits_dirname}/{self.run.run_name}/{split}.txt"

    def model_path(self) -> str:
        return f"{self.run.models_dir}/{self.finetune.task}/{self.run.model_filename}"


#: Keys that experiment files may use in place of a section's own.
ALIASES = {
    "dataset": {"splits": "split_names", "context_sep": "context_separator", "table_configs": "tables"},
    "run": {"output_root": "output_dir", "logs_root": "log_dir", "reduced_root": "reduced_dir", "checkpoints_root": "models_dir", "ditto_configs_path": "tasks_file"},
    "algo": {"rel_similarity": "similarity"},
    "finetune": {"n_epochs": "epochs"},
}


def _own_keys(section: str, values: dict | None) -> dict:
    """A section under its own keys; ``dataset_dir`` is the data folder and the data set's name in one."""
    values = dict(values or {})
    if section == "dataset" and (folder := values.pop("dataset_dir", None)):
        path = Path(folder)
        values = {"name": path.name, "data_dir": str(path.parent)} | values
    named = ALIASES[section]
    if twice := [k for k in values if named.get(k) in values]:
        raise ValueError(f"keys given under two names in {section}: {', '.join(sorted(twice))}")
    return {named.get(k, k): v for k, v in values.items()}


def _section(kind, values: dict):
    known = {f.name: f.type for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown keys in {kind.__name__}: {', '.join(sorted(unknown))}")
    # Numbers such as 3e-5 come from YAML as text.
    read = {"float": float, "int": int}
    whole = lambda v: tuple(map(whole, v)) if isinstance(v, list) else v
    return kind(**{k: read[known[k]](v) if known[k] in read else whole(v) for k, v in values.items()})


def from_dict(data: dict) -> Config:
    """dataset, run and algo must be there, finetune may."""
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    if missing := [s for s in ("dataset", "run", "algo") if s not in data]:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    config = Config(*[_section(kind, _own_keys(name, data.get(name))) for name, kind in (("dataset", Dataset), ("run", Run), ("algo", Algo), ("finetune", Finetune))])
    if [c for _, c in config.sides()] != [config.dataset.left_id_col, config.dataset.right_id_col]:
        raise ValueError("tables names a side for left_id_col and one for right_id_col, in this order")
    if config.dataset.id_namespace not in ("shared", "sided"):
        raise ValueError("id_namespace is shared or sided")
    return config


def load(path: str) -> Config:
    """YAML where its parser is installed, else JSON."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return from_dict(json.loads(text))
    return from_dict(yaml.safe_load(text))


def register_task(path: str, task: dict) -> bool:
    """Appends a task to a JSON list unless its name is there; tells whether it did."""
    file = Path(path)
    tasks = json.loads(file.read_text()) if file.exists() else []
    if any(t.get("name") == task["name"] for t in tasks):
        return False
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps([*tasks, task], indent=2))
    return True


def next_run(folder: str) -> int:
    """One more than the greatest number among a folder's entries; 0 in an empty one."""
    root = Path(folder)
    return max((int(p.name) for p in root.iterdir() if p.name.isdigit()), default=-1) + 1 if root.exists() else 0


def run_log_name(alpha: float, threshold: float, now: datetime | None = None) -> str:
    plain = lambda x: str(x).replace(".", "_")
    return f"alpha_{plain(alpha)}_t_{plain(threshold)}_{(now or datetime.now()).strftime('%Y%m%d-%H%M%S')}.log"


def run_logger(name: str, folder: str | None = None, alpha: float = 0.1, threshold: float = 0.5) -> logging.Logger:
    """A logger to the console and, where a folder is given, to a file of the run."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    shape = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    if not logger.handlers:
        console = logging.StreamHandler()
        console.setFormatter(shape)
        logger.addHandler(console)
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        file = logging.FileHandler(Path(folder) / run_log_name(alpha, threshold))
        file.setFormatter(shape)
        logger.addHandler(file)
    return logger
