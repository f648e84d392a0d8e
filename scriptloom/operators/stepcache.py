"""Results of steps, kept under a hash of what they depend on: the step's code, its settings, and its inputs.

An input read from files is known by their names, lengths and times; the result of a step by that step's key. A hit reads
the kept result and starts no job, not even for its schema; a miss computes, writes it beside, and makes it known by one
small file that appears whole or not at all, so a crash leaves no half result, and of two runs at once one is used.
"""

from __future__ import annotations

import dataclasses
import hashlib
import inspect
import json
import sys
import types
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .keyed import Conflict, Files

PACKAGE = __name__.split(".")[0]


@dataclass(frozen=True)
class Kept:
    """Rows with the key of what they come from."""

    rows: DataFrame
    key: str


def modules_of(f: Callable) -> list[types.ModuleType]:
    """The package's modules that a function's code can reach: its own, and those it or they name."""
    seen, todo = {}, [sys.modules[f.__module__]]
    while todo:
        m = todo.pop()
        if m.__name__ in seen or not getattr(m, "__file__", None):
            continue
        seen[m.__name__] = m
        for x in vars(m).values():
            name = x.__name__ if isinstance(x, types.ModuleType) else getattr(x, "__module__", None) if callable(x) else None
            if name and name.split(".")[0] == PACKAGE and name in sys.modules:
                todo.append(sys.modules[name])
    return [seen[k] for k in sorted(seen)]


def code_key(f: Callable) -> str:
    """A hash of a function's source and of the modules of this package that it can reach."""
    h = hashlib.sha256(inspect.getsource(f).encode())
    for m in modules_of(f):
        if m.__name__.split(".")[0] == PACKAGE:
            h.update(m.__name__.encode() + b"\0" + Path(m.__file__).read_bytes())
    return h.hexdigest()


def plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    return value


class StepCache:
    """Kept results in a folder. on(step) says whether a step is cached; steps that aren't always run, and what follows
    them runs too. hits and misses name the steps of this run."""

    def __init__(self, spark: SparkSession, folder: str, on: Callable[[str], bool] = lambda step: True):
        self.spark, self.folder, self.on, self.files = spark, folder, on, Files(spark, folder)
        self.hits: list[str] = []
        self.misses: list[str] = []

    def source(self, rows: DataFrame) -> Kept:
        """Rows read from files. Their key lists the files, so a file that is added, gone or written anew is another input."""
        listed, jvm = [], self.spark._jvm
        for name in sorted(rows.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            status = path.getFileSystem(self.files.conf).getFileStatus(path)
            listed.append([name, status.getLen(), status.getModificationTime()])
        plan = [rows.schema.json(), listed, rows._jdf.queryExecution().optimizedPlan().canonicalized().toString()]
        return Kept(rows, hashlib.sha256(json.dumps(plan).encode()).hexdigest())

    def step(self, name: str, f: Callable[..., DataFrame], *inputs: Kept, **settings: Any) -> Kept:
        """f(*rows of the inputs, **settings), or what it gave before."""
        told = json.dumps([name, code_key(f), {k: plain(v) for k, v in sorted(settings.items())}, [x.key for x in inputs]], sort_keys=True, default=repr)
        key = hashlib.sha256(told.encode()).hexdigest()
        if not self.on(name):
            self.misses.append(name)
            return Kept(f(*(x.rows for x in inputs), **settings), uuid.uuid4().hex)
        if found := self._found(key):
            self.hits.append(name)
            return Kept(found, key)
        self.misses.append(name)
        rows, made = f(*(x.rows for x in inputs), **settings), f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{made}")
        try:
            self.files.write_new(f"steps/{key}.json", json.dumps({"step": name, "folder": made, "schema": rows.schema.json()}))
        except Conflict:
            self.files.delete(made)  # another run was first with the same result
        return Kept(self._found(key), key)

    def _found(self, key: str) -> DataFrame | None:
        if not self.files.fs.exists(self.files.path(f"steps/{key}.json")):
            return None
        told = json.loads(self.files.read(f"steps/{key}.json"))
        return self.spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).parquet(f"{self.folder}/{told['folder']}")
