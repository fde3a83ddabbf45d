"""Sinks: result sections as JSON, the filtered client list as CSV.

Each section is written by the executors (``df.write``), one folder per
section; nothing is assembled into one document on the driver. A set of
sections is published by a manifest: readers see the old set or the new one.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = (
    ("id", "ID"),
    ("nome", "Nome"),
    ("canal", "Canal"),
    ("porte", "Porte"),
    ("cidade", "Cidade"),
    ("uf", "UF"),
    ("regiao", "Regiao"),
    ("vendedor_id", "Vendedor"),
    ("cluster_nome", "Cluster"),
    ("rec_liq", "Receita_Liquida"),
    ("margem_pct", "Margem_Pct"),
    ("pedidos", "Pedidos"),
    ("recencia_dias", "Recencia_Dias"),
    ("skus", "SKUs_Mix"),
)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON-lines folder for a section (UTF-8, non-ASCII kept as is)."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)
    return path


def write_sections(sections: dict[str, DataFrame], base: str, mode: str = "overwrite") -> dict[str, str]:
    return {name: write_json(df, os.path.join(base, name), mode) for name, df in sections.items()}


def write_clients_csv(record: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The filtered client list, 14 columns with a header, every value quoted (RFC 4180: quotes doubled)."""
    cols = [F.col(src).cast("string").alias(dst) for src, dst in CSV_COLUMNS if src in record.columns]
    (
        record.select(*cols)
        .write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .csv(path)
    )
    return path


BUILDS, MANIFESTS = "_builds", "_manifests"
_NUMBERED = re.compile(r"[0-9]{8}\.json")


def publish_sections(sections: dict[str, DataFrame], base: str) -> dict:
    """Write all sections to a new build folder, then publish them together; gives the manifest.

    Layout: ``<base>/_builds/<id>/<section>`` and ``<base>/_manifests/<number>.json``
    with path and row count (counted from the written files) of every section.
    The manifest is the last thing to appear, by a rename: until then readers
    keep the build before. If a section fails, the new folder is removed, nothing
    is published and the error goes on. Two publishers at once get two numbers;
    the higher one is the current set.
    """
    if not sections:
        raise ValueError("no sections to publish")
    bad = [name for name in sections if not name or "/" in name or name.startswith(("_", "."))]
    if bad:
        raise ValueError(f"not a section name: {bad}")
    spark = next(iter(sections.values())).sparkSession
    build = uuid.uuid4().hex
    staged = os.path.join(base, BUILDS, build)
    try:
        made = {}
        for name, df in sections.items():
            path = write_json(df, os.path.join(staged, name), "errorifexists")
            made[name] = {"path": os.path.join(BUILDS, build, name), "rows": spark.read.text(path).count()}
    except BaseException:
        _delete(spark, staged)
        raise
    manifest = {"build": build, "sections": made}
    manifest["number"] = _commit(spark, base, manifest)
    return manifest


def published(spark: SparkSession, base: str) -> dict | None:
    """The current manifest; None if nothing has been published."""
    numbers = _manifest_numbers(spark, base)
    return _manifest(spark, base, numbers[-1]) if numbers else None


def read_section(spark: SparkSession, base: str, name: str, manifest: dict | None = None) -> DataFrame:
    """A section of the current build, or of the build of ``manifest`` (pass one to read several sections of one build)."""
    manifest = manifest or published(spark, base)
    if manifest is None or name not in manifest["sections"]:
        raise KeyError(f"section {name!r} is not published under {base}")
    return spark.read.json(os.path.join(base, manifest["sections"][name]["path"]))


def remove_old_builds(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete the builds of all but the ``keep`` newest manifests, manifest first; gives their ids. Unfinished builds stay."""
    if keep < 1:
        raise ValueError("the current build has to stay")
    gone = []
    for number in _manifest_numbers(spark, base)[:-keep]:
        manifest = _manifest(spark, base, number)
        _delete(spark, os.path.join(base, MANIFESTS, f"{number:08d}.json"))
        _delete(spark, os.path.join(base, BUILDS, manifest["build"]))
        gone.append(manifest["build"])
    return gone


def _fs(spark: SparkSession, path: str):
    """File system of a path and the path, as Hadoop has them (local, HDFS or an object store)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _delete(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _fs(spark, path)
    fs.delete(jvm_path, True)


def _manifest_numbers(spark: SparkSession, base: str, pattern: re.Pattern = _NUMBERED) -> list[int]:
    fs, folder = _fs(spark, os.path.join(base, MANIFESTS))
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:8]) for n in names if pattern.fullmatch(n))


def _manifest(spark: SparkSession, base: str, number: int) -> dict:
    path = os.path.join(base, MANIFESTS, f"{number:08d}.json")
    return {**json.loads(spark.read.text(path, wholetext=True).first()[0]), "number": number}


def _commit(spark: SparkSession, base: str, manifest: dict) -> int:
    """Write the manifest under the next free number, which a claim file secures against other publishers."""
    number = max(_manifest_numbers(spark, base, re.compile(r"[0-9]{8}\.(json|claim)")), default=0) + 1
    while True:
        fs, claim = _fs(spark, os.path.join(base, MANIFESTS, f"{number:08d}.claim"))
        if fs.createNewFile(claim):
            break
        number += 1
    _, hidden = _fs(spark, os.path.join(base, MANIFESTS, f"_{manifest['build']}.tmp"))
    _, final = _fs(spark, os.path.join(base, MANIFESTS, f"{number:08d}.json"))
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False, indent=1).encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(hidden, final):
        raise OSError(f"manifest {number} could not be published under {base}")
    return number
