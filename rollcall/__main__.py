"""Batch command line: ``python -m rollcall COMMAND``.

    entity-hash IN OUT --name COL --country COL [--address COL] [--date COL]
    canonicalize IN OUT --name COL [--jurisdiction COL]
    audit IN OUT --name COL [--limit N]
    validate IN OUT --schema FILE
    generate-example IN OUT --name COL --country COL [--address COL] [--date COL] [--jurisdiction COL] [--force]
    --version

``validate`` exits with 1 if a row breaks the schema. ``generate-example`` writes
each step of the way from raw rows to entity records (02_normalized,
03_canonical, 04_entity_record); steps that are there are skipped unless --force.
IN is a CSV with a header, JSON Lines or Parquet, by its suffix; OUT a folder.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import __doc__ as about
from rollcall import __version__
from rollcall.functions.identity import canonical_input, entity_hash
from rollcall.functions.localize import localize
from rollcall.functions.normalize import normalize_legal_name
from rollcall.operators import audit, records, validate
from rollcall.session import build_session
from rollcall.sources.readers import distinct_names
from rollcall.sources.writers import write_collisions_csv, write_jsonl, write_summary


def load(spark: SparkSession, path: str) -> DataFrame:
    kind = Path(path).suffix
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    if kind in (".jsonl", ".ndjson", ".gz"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def example(df: DataFrame, a: argparse.Namespace) -> dict[str, DataFrame]:
    """The steps from raw rows to entity records."""
    c = canonical_input(a.name, a.country, a.address, a.date)
    j = F.col(a.jurisdiction) if a.jurisdiction else F.upper(a.country)
    n = df.select(F.col(a.name).alias("legalName"), j.alias("jurisdictionIso"), c["name"].alias("legalNameNormalized"), entity_hash(a.name, a.country, a.address, a.date).alias("entityHash"), F.lit("entity").alias("entityType"), c.alias("canonical"))
    n = records.attach_attestation(n, records.attestation("urn:attestor:rollcall"))
    return {"02_normalized": n.drop("canonical"), "03_canonical": n.select("canonical.*"), "04_entity_record": records.entity_records(n)}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rollcall", description=about, epilog=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["entity-hash", "canonicalize", "audit", "validate", "generate-example"])
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("input")
    p.add_argument("output")
    for name in ("name", "country", "address", "date", "jurisdiction", "schema"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    spark = build_session()
    df = load(spark, a.input)
    if a.command == "entity-hash":
        write_jsonl(df.withColumn("entity_hash", entity_hash(a.name, a.country, a.address, a.date)), a.output, a.force)
    elif a.command == "canonicalize":
        out = localize(df, a.name, a.jurisdiction) if a.jurisdiction else df.withColumn("localized", F.col(a.name))
        write_jsonl(out.withColumn("normalized", normalize_legal_name("localized")), a.output, a.force)
    elif a.command == "audit":
        names = distinct_names(df.select(F.col(f"`{a.name}`").alias("raw_name")).withColumn("pos", F.monotonically_increasing_id()), limit=a.limit)
        m = audit.mapping(names)
        write_collisions_csv(audit.collisions(m), f"{a.output}/collisions")
        write_summary(audit.summary(m), f"{a.output}/summary")
    elif a.command == "generate-example":
        for name, step in example(df, a).items():
            if a.force or not Path(a.output, name).exists():
                write_jsonl(step, f"{a.output}/{name}", a.force)
    else:
        found = validate.with_violations(df, json.loads(Path(a.schema).read_text("utf-8")))
        write_jsonl(found.where(F.size("errors") > 0), a.output, a.force)
        return 0 if validate.summary(found).first()["ok"] else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
