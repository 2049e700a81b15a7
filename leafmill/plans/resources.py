"""Devices and threads of model stages, as Spark resource profiles."""

from __future__ import annotations

import os

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests

DEVICES = ("auto", "cpu", "cuda", "mps", "xpu")


def threads(asked: int | None = None) -> int:
    """Threads of one model: as asked, else OMP_NUM_THREADS, else four."""
    if asked is not None:
        if asked < 1:
            raise ValueError("at least one thread is needed")
        return asked
    return int(os.environ.get("OMP_NUM_THREADS", "4"))


def device(name: str, available: tuple[str, ...] = ("cpu",)) -> str:
    """The device to use: ``auto`` takes the first accelerator there is, a missing one falls back to the CPU; ``cuda:1`` names one."""
    kind = name.split(":")[0]
    if kind not in DEVICES or (":" in name and (kind != "cuda" or not name.split(":")[1].isdigit())):
        raise ValueError(f"unknown device {name}")
    if kind == "auto":
        return next((d for d in ("cuda", "mps", "xpu") if d in available), "cpu")
    return name if kind in available else "cpu"


def profile(name: str = "cpu", asked_threads: int | None = None, memory: str | None = None) -> ResourceProfile:
    """What a stage's ``mapInPandas(..., profile=)`` needs: a core for each thread, and a GPU for each task on CUDA."""
    n = threads(asked_threads)
    tasks, executors = TaskResourceRequests().cpus(n), ExecutorResourceRequests().cores(n)
    if memory:
        executors = executors.memory(memory)
    if name.startswith("cuda"):
        tasks, executors = tasks.resource("gpu", 1), executors.resource("gpu", 1)
    return ResourceProfileBuilder().require(tasks).require(executors).build
