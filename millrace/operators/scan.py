"""Reading what a pickle would do, without loading it."""

from __future__ import annotations

import pickletools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Operations that call or build, modules known to be safe, names that run code.
CALLS = ["GLOBAL", "STACK_GLOBAL", "INST", "OBJ", "NEWOBJ", "NEWOBJ_EX", "REDUCE", "BUILD"]
SAFE_MODULES = ("torch", "numpy", "collections", "builtins", "_codecs", "datetime", "copyreg")
RUNNERS = ["eval", "exec", "compile", "__import__", "getattr"]
SYSTEM = ("os", "posix", "nt", "subprocess", "sys", "shutil", "socket", "pty")


def operations(data: bytes) -> tuple[list[str], list[str], str | None]:
    """The distinct operations, the imports as module.name in order, and what stopped the reading."""
    ops, imports, strings = [], [], []
    try:
        for op, arg, _ in pickletools.genops(data):
            if op.name not in ops:
                ops.append(op.name)
            if isinstance(arg, str) and op.name not in ("GLOBAL", "INST"):
                strings.append(arg)
            if op.name in ("GLOBAL", "INST"):
                imports.append(arg.replace(" ", "."))
            elif op.name == "STACK_GLOBAL" and len(strings) >= 2:
                imports.append(".".join(strings[-2:]))
    except Exception as e:  # noqa: BLE001 - any damaged input
        return ops, imports, str(e)[:200]
    return ops, imports, None


def pickle_scan(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, opcodes, imports, error and risk (dangerous, suspicious, safe, damaged) of each file.

    Imports of system modules, of code runners and of open are dangerous; other imports outside the safe
    modules are suspicious. Null contents are damaged. Nothing is ever loaded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [operations(x) if x is not None else ([], [], "no content") for x in b.column(1).to_pylist()]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], type=lists), pa.array([r[1] for r in rows], type=lists), pa.array([r[2] for r in rows], type=pa.string())], names=[key, "opcodes", "imports", "error"])

    kind = files.schema[key].dataType.simpleString()
    out = files.select(key, content).mapInArrow(run, f"{key} {kind}, opcodes array<string>, imports array<string>, error string")
    module = lambda i: F.element_at(F.split(i, r"\."), 1)
    name = lambda i: F.element_at(F.split(i, r"\."), -1)
    runs = F.exists("imports", lambda i: module(i).isin(*SYSTEM) | name(i).isin(*RUNNERS, "open", "system", "popen"))
    other = F.exists("imports", lambda i: ~module(i).isin(*SAFE_MODULES))
    return out.withColumn("risk", F.when(runs, "dangerous").when(F.col("error").isNotNull(), "damaged").when(other, "suspicious").otherwise("safe"))
