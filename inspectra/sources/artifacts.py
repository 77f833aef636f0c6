"""Model artifacts: a folder of files with a manifest of checksums, complete once its marker is there."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from datetime import date

MARKER, MANIFEST = "_SUCCESS", "manifest.json"
ALLOWED = ["metadata.json", "metrics.json", "model_card.md", "features.json", "calibration.json", "members.json"]


def _sum(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_artifact(folder: str, files: dict[str, object], model=None, *, more: dict[str, object] | None = None, force: bool = False) -> str:
    """Write all files, the model and ``more`` models by their subfolder beside the target and swap them in; an existing artifact stays unless ``force``, and returns on failure."""
    if os.path.exists(folder) and not force:
        raise FileExistsError(folder)
    parent = os.path.dirname(os.path.abspath(folder))
    os.makedirs(parent, exist_ok=True)
    stage = tempfile.mkdtemp(prefix=".staged-", dir=parent)
    try:
        for name, content in files.items():
            with open(os.path.join(stage, name), "w", encoding="utf-8") as f:
                f.write(content if isinstance(content, str) else json.dumps(content, sort_keys=True, default=str, indent=1))
        for name, m in ({"model": model} | (more or {})).items():
            if m is not None:
                m.write().overwrite().save(os.path.join(stage, name))
        inside = [os.path.relpath(os.path.join(d, n), stage) for d, _, ns in os.walk(stage) for n in ns]
        with open(os.path.join(stage, MANIFEST), "w", encoding="utf-8") as f:
            json.dump({n: _sum(os.path.join(stage, n)) for n in sorted(inside)}, f, indent=1)
        open(os.path.join(stage, MARKER), "w").close()
        old = None
        if os.path.exists(folder):
            old = f"{folder}.old"
            shutil.rmtree(old, ignore_errors=True)
            os.rename(folder, old)
        try:
            os.rename(stage, folder)
        except OSError:
            if old:
                os.rename(old, folder)
            raise
        if old:
            shutil.rmtree(old)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return folder


def broken_files(folder: str) -> list[str]:
    """Files whose checksum differs or that are missing; the marker and manifest must be there."""
    if not os.path.exists(os.path.join(folder, MARKER)) or not os.path.exists(os.path.join(folder, MANIFEST)):
        return [MANIFEST]
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        sums = json.load(f)
    return [n for n, s in sums.items() if not os.path.isfile(os.path.join(folder, n)) or _sum(os.path.join(folder, n)) != s]


def read_metadata(folder: str | None, *, jurisdiction: str, ready: bool = True, max_bytes: int = 1_000_000) -> tuple[dict | None, str | None]:
    """``(metadata, reason)``; never raises, so a bad artifact is only an absent one."""
    try:
        if not folder:
            return None, "not_configured"
        if not os.path.isdir(folder) or os.path.islink(folder):
            return None, "not_an_artifact"
        if [n for n in broken_files(folder)]:
            return None, "checksum"
        path = os.path.join(folder, "metadata.json")
        if os.path.getsize(path) > max_bytes:
            return None, "too_large"
        with open(path, encoding="utf-8") as f:
            meta = json.load(f)
        if meta.get("jurisdiction") != jurisdiction:
            return None, "other_jurisdiction"
        if ready and meta.get("readiness") != "ready":
            return None, "not_ready"
        return {k: v for k, v in meta.items() if k != "path"}, None
    except (OSError, ValueError):
        return None, "unreadable"


def load_model(folder: str, *, trusted: bool, jurisdiction: str):
    """The model of an artifact with its calibration and members (``models.Trained``); only if the caller says it is trusted and every check passes."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import IsotonicRegressionModel

    from inspectra.operators.models import Member, Trained

    if not trusted:
        raise PermissionError("an artifact is only loaded when trusted")
    meta, reason = read_metadata(folder, jurisdiction=jurisdiction)
    if meta is None:
        raise ValueError(f"artifact refused: {reason}")

    def read(name: str) -> object:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return json.load(f)

    def calibration(method: str, name: str) -> tuple[str, object]:
        kinds = {"isotonic": IsotonicRegressionModel, "sigmoid": LogisticRegressionModel}
        return method, kinds[method].load(os.path.join(folder, name)) if method in kinds else None

    kept = read("members.json")
    members = [Member(m["member"], reason=m["reason"]) if m["reason"] else Member(m["member"], PipelineModel.load(os.path.join(folder, f"members/{m['member']}/model")), calibration(m["calibration"], f"members/{m['member']}/calibration"))
               for m in kept["members"]]
    return Trained(PipelineModel.load(os.path.join(folder, "model")), calibration(read("calibration.json")["method"], "calibration"), members, kept["needed"])


def model_card(meta: dict, metrics: dict) -> str:
    lines = [f"# Model card: {meta.get('jurisdiction')} {meta.get('target')}", "", f"Version {meta.get('version')}, written {meta.get('written') or date.today().isoformat()}, readiness {meta.get('readiness')}.", "",
             "| part | " + " | ".join(sorted({k for m in metrics.values() for k in m})) + " |"]
    columns = sorted({k for m in metrics.values() for k in m})
    lines += ["|" + "---|" * (len(columns) + 1)] + ["| " + " | ".join([p, *[str(m.get(k, "")) for k in columns]]) + " |" for p, m in metrics.items()]
    return "\n".join(lines) + "\n"
