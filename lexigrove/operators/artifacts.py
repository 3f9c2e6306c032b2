"""Model snapshots that travel to the workers, and the resources of the stages that use them."""

from __future__ import annotations

import hashlib
import os
import shutil
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pandas as pd
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from pyspark.resource import ResourceProfile


# What runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A file beside a snapshot's own in its archive, so that one without files is unpacked too.
MARK = ".snapshot"


def folder_digest(folder: str) -> str:
    """sha256 of a folder's files, names and contents in the order of names."""
    whole = hashlib.sha256()
    for base, inner, names in os.walk(folder):
        inner.sort()
        for name in sorted(n for n in names if n != MARK):
            path = os.path.join(base, name)
            with open(path, "rb") as f:
                own = hashlib.file_digest(f, "sha256").hexdigest()
            whole.update(f"{os.path.relpath(path, folder)}\0{own}\n".encode())
    return whole.hexdigest()


@dataclass(frozen=True)
class Shipped:
    """A folder that Spark unpacks on every worker, named by its content."""

    name: str
    digest: str

    def path(self) -> str:
        """Where it is on this worker; that it is missing or not what was sent are errors of their own."""
        here = os.path.join(SparkFiles.getRootDirectory(), self.name)
        if not os.path.isdir(here):
            raise FileNotFoundError(f"archive {self.name} has not reached this worker")
        if (found := folder_digest(here)) != self.digest:
            raise ValueError(f"archive {self.name} is not what was sent: {found} instead of {self.digest}")
        return here


def ship(spark: SparkSession, folder: str) -> Shipped:
    """Send a folder of the driver's machine to all workers, once for each content."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"no folder {folder}")
    digest = folder_digest(folder)
    sent = Shipped(f"model-{digest[:20]}", digest)
    packed = os.path.join(_kept(spark), sent.name)
    if not os.path.exists(f"{packed}.zip"):
        made = shutil.make_archive(packed, "zip", folder)
        with zipfile.ZipFile(made, "a") as z:
            z.writestr(MARK, digest)
        spark.sparkContext.addArchive(f"{made}#{sent.name}")
    return sent


_KEPT: dict[str, str] = {}


def _kept(spark: SparkSession) -> str:
    """A folder on the driver from which Spark hands out archives as long as the application runs."""
    return _KEPT.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexigrove-archives-"))


def local(folder: str | Shipped) -> str:
    """The path of a model's folder in a task: that of a shipped one, or a path that all workers share."""
    return folder.path() if isinstance(folder, Shipped) else folder


def executors_have_gpu(spark: SparkSession) -> bool:
    """Whether a task finds a CUDA device. What the driver has does not matter."""
    from .scorers import gpu_visible

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"gpu": [gpu_visible()]})

    return bool(spark.range(1).mapInPandas(look, "gpu boolean").first().gpu)


def gpu_profile(cores: int = 4) -> ResourceProfile:
    """An executor with one GPU, and a task that has it to itself."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    executor = ExecutorResourceRequests().cores(cores).resource("gpu", 1)
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(1).resource("gpu", 1)).build


def profile_for(frame: DataFrame, gpu: bool) -> ResourceProfile | None:
    """The profile of a stage that wants a GPU; a local session has its own machine and no profiles."""
    master = frame.sparkSession.sparkContext.master
    return gpu_profile() if gpu and not master.startswith("local") else None
