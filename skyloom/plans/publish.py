"""Targets, staging, atomic publication, manifests and recovery."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.layout import ChunkPlan, Codec, laid_out, parquet_options

MANIFEST = "manifest.json"
SCHEMA_VERSION = 6
PRODUCT_MARK = "_skyloom.json"
SAFETY = 1.25
LEAST_BYTES = 64 << 20


class PublishError(RuntimeError):
    """A target or job that must not be touched."""


def check_target(target: Path, overwrite: bool) -> None:
    """Refuse links, files, and folders with contents unless they hold a product of ours and may go."""
    if target.is_symlink():
        raise PublishError(f"{target} is a link")
    if not target.exists():
        return
    if not target.is_dir():
        raise PublishError(f"{target} is not a folder")
    ours = (target / PRODUCT_MARK).exists() or (target / "zarr.json").exists()
    if any(target.iterdir()) and not (overwrite and ours):
        raise PublishError(f"{target} has contents" if ours else f"{target} holds no product")


def check_writable(parent: Path) -> None:
    """Create, flush and remove a probe file."""
    parent.mkdir(parents=True, exist_ok=True)
    probe = parent / f".probe-{uuid.uuid4().hex}"
    with probe.open("wb") as out:
        out.write(b"x")
        out.flush()
        os.fsync(out.fileno())
    probe.unlink()


def check_capacity(parent: Path, bytes_: int, share: float = 0.9) -> int:
    """Bytes wanted with a margin; an error if they exceed a share of what is free."""
    wanted = max(LEAST_BYTES, int(bytes_ * SAFETY))
    free = shutil.disk_usage(next(p for p in (parent, *parent.parents) if p.exists())).free
    if wanted > share * free:
        raise PublishError(f"{wanted} bytes wanted, {free} free")
    return wanted


def staging_path(target: Path) -> Path:
    """A sibling of the target with a name of its own."""
    return target.with_name(f".{target.name}.{uuid.uuid4().hex}")


def publish(staged: Path, target: Path, overwrite: bool = False) -> None:
    """Move the staged product to the target; what was there comes back if that fails."""
    check_target(target, overwrite)
    backup = None
    if target.exists():
        backup = staging_path(target)
        os.replace(target, backup)
    try:
        os.replace(staged, target)
    except OSError:
        if backup is not None:
            os.replace(backup, target)
        raise
    if backup is not None:
        shutil.rmtree(backup)


def write_product(cells: DataFrame, target: str, plan: ChunkPlan, codec: Codec, meta: dict, overwrite: bool = False) -> int:
    """Write cells chunk by chunk to a staged folder, count them, publish; returns the rows."""
    goal = Path(target)
    check_target(goal, overwrite)
    check_writable(goal.parent)
    staged = staging_path(goal)
    try:
        dealt = laid_out(cells, plan)
        dealt.write.options(**parquet_options(codec)).partitionBy("ct").parquet(str(staged))
        rows = cells.sparkSession.read.parquet(str(staged)).count()
        (staged / PRODUCT_MARK).write_text(json.dumps(meta | {"chunks": plan.chunks, "rows": rows}, default=str))
        publish(staged, goal, overwrite)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return rows


def measured_capacity(parent: Path, sample_bytes: int, sample_cells: int, cells: int) -> int:
    """Bytes projected from a measured sample; an error beyond 95 % of what is free."""
    projected = int(sample_bytes / max(sample_cells, 1) * cells * SAFETY)
    free = shutil.disk_usage(parent).free
    if projected > 0.95 * free:
        raise PublishError(f"{projected} bytes projected, {free} free")
    return projected


def copy_product(source: str, target: str, overwrite: bool = False) -> None:
    """Copy a product whose layout and codec are already those wanted; links are refused."""
    origin, goal = Path(source), Path(target)
    check_target(goal, overwrite)
    if any(p.is_symlink() for p in [origin, *origin.rglob("*")]):
        raise PublishError(f"{origin} holds links")
    staged = staging_path(goal)
    try:
        shutil.copytree(origin, staged)
        publish(staged, goal, overwrite)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def next_output(source: str) -> Path:
    """A free name beside a product: ``<name>_rechunked_<n>``."""
    origin = Path(source.rstrip("/"))
    n = 1
    while (found := origin.with_name(f"{origin.stem}_rechunked_{n}{origin.suffix}")).exists():
        n += 1
    return found


@dataclass
class Job:
    """A run's folder with its manifest and events."""

    root: Path
    manifest: dict = field(default_factory=dict)

    @classmethod
    def create(cls, temporary: Path, config: dict) -> Job:
        """New folder under the temporary one."""
        root = temporary / "skyloom-pipeline" / uuid.uuid4().hex
        root.mkdir(parents=True)
        job = cls(root, {"schema": SCHEMA_VERSION, "status": "running", "config": config, "stages": {}, "error_history": []})
        job.save()
        return job

    def save(self) -> None:
        """Write the manifest so that readers see the old or the new one."""
        fresh = self.root / f".{MANIFEST}.{uuid.uuid4().hex}"
        fresh.write_text(json.dumps(self.manifest, indent=1, default=str))
        os.replace(fresh, self.root / MANIFEST)

    def event(self, kind: str, **details) -> None:
        """Append one line to the events."""
        with (self.root / "events.jsonl").open("a") as out:
            out.write(json.dumps({"time": time.time(), "event": kind, **details}, default=str) + "\n")

    def finish_stage(self, name: str, path: str | None, rows: int) -> None:
        """Record a stage whose output is complete."""
        self.manifest["stages"][name] = {"path": path, "rows": rows, "validated": True}
        self.save()
        self.event("stage", name=name, rows=rows)

    def end(self, status: str, error: str | None = None) -> None:
        """Record how the run ended."""
        self.manifest["status"] = status
        if error:
            self.manifest["error_history"].append(error)
        self.save()
        self.event(status, error=error)


@dataclass(frozen=True)
class Recovery:
    """Where a failed or cancelled run can go on."""

    job: Job
    stage: str
    path: str


def newest_manifest(temporary: Path) -> Path | None:
    """The manifest that was written last."""
    found = list((temporary / "skyloom-pipeline").glob(f"*/{MANIFEST}"))
    return max(found, key=lambda p: p.stat().st_mtime, default=None)


def inspect_recovery(manifest: Path) -> Recovery:
    """The latest stage of a failed run whose output can be reused, the resampled one first."""
    data = json.loads(manifest.read_text())
    if data.get("schema") != SCHEMA_VERSION:
        raise PublishError("the manifest has another schema")
    if data.get("status") not in ("failed", "cancelled"):
        raise PublishError(f"a run that is {data.get('status')} is not resumed")
    root = manifest.parent.resolve()
    for stage in ("resample", "convert"):
        entry = data["stages"].get(stage)
        if not entry or not entry.get("validated") or not entry.get("path"):
            continue
        path = Path(entry["path"]).resolve()
        if root not in path.parents:
            raise PublishError("the stage lies outside the job")
        if path.exists():
            return Recovery(Job(root, data), stage, str(path))
    raise PublishError("no finished stage is left")


def mark_recovered(recovery: Recovery, cleanup: bool = False) -> None:
    """Record the success; the history of errors stays."""
    recovery.job.end("succeeded")
    if cleanup:
        shutil.rmtree(recovery.path, ignore_errors=True)


def as_config(config: object) -> dict:
    """A configuration record as plain values."""
    return asdict(config)
