"""Schema drift: what separates a specification from a stored table, and the statements that close the gap."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessera.table import TableSpec


@dataclass(frozen=True)
class Drift:
    table: str
    kind: str  # create, alter, none or skipped
    added: tuple[str, ...] = ()
    modified: tuple[tuple[str, str, str], ...] = ()
    dropped: tuple[str, ...] = ()
    options: tuple[tuple[str, str, str], ...] = ()
    destructive: tuple[str, ...] = ()
    plan: tuple[str, ...] = ()
    shadow: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def changed(self) -> bool:
        return self.kind in ("create", "alter")


@dataclass(frozen=True)
class Stored:
    """A table as the catalog has it."""

    columns: dict[str, str]
    options: dict[str, str] = field(default_factory=dict)
    rows: int | None = None


#: Type changes that keep every value.
_WIDER = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("int", "double")}


def diff_table(spec: TableSpec, stored: Stored | None) -> Drift:
    """A new table is created; columns are added in place; changed or dropped columns go through a shadow table, which is
    filled with the common columns and swapped in by two renames."""
    if spec.externally_managed:
        return Drift(spec.name, "skipped", warnings=(f"{spec.name} is managed elsewhere",))
    if stored is None:
        return Drift(spec.name, "create", plan=(spec.to_ddl(),))
    want = {f.name: f.dataType.simpleString() for f in spec.schema.fields}
    added = tuple(c for c in want if c not in stored.columns)
    modified = tuple((c, stored.columns[c], k) for c, k in want.items() if c in stored.columns and stored.columns[c] != k)
    dropped = tuple(c for c in stored.columns if c not in want)
    own = {"engine": spec.engine.name, "order_by": ", ".join(spec.order_by)}
    options = tuple((k, stored.options[k], v) for k, v in own.items() if k in stored.options and stored.options[k] != v)
    if not (added or modified or dropped or options):
        return Drift(spec.name, "none")
    why = [f"drops column {c}" for c in dropped] + [f"changes {c} from {a} to {b}" for c, a, b in modified if (a, b) not in _WIDER] + [f"changes {k} from {a!r} to {b!r}" for k, a, b in options]
    plan = [f"ALTER TABLE {spec.name} ADD COLUMNS ({', '.join(f'`{c}` {want[c]}' for c in added)})"] if added else []
    shadow: list[str] = []
    if modified or dropped or options:
        common = [c for c in want if c in stored.columns]
        cast = {c: k for c, _, k in modified}
        made = replace(spec, name=f"{spec.name}__shadow")
        shadow = [f"DROP TABLE IF EXISTS {made.name}", made.to_ddl(), f"INSERT INTO {made.name} ({', '.join(f'`{c}`' for c in common)}) SELECT {', '.join(f'CAST(`{c}` AS {cast[c]})' if c in cast else f'`{c}`' for c in common)} FROM {spec.name}", f"ALTER TABLE {spec.name} RENAME TO {spec.name}__old", f"ALTER TABLE {made.name} RENAME TO {spec.name}"]
        why += [] if stored.rows is None or not dropped else [f"{stored.rows} rows lose {len(dropped)} columns"]
    return Drift(spec.name, "alter", added, modified, dropped, options, tuple(why), tuple(plan) if not shadow else (), tuple(shadow))


def describe_table(spark: SparkSession, name: str, count: bool = False) -> Stored | None:
    if not spark.catalog.tableExists(name):
        return None
    columns = {f.name: f.dataType.simpleString() for f in spark.table(name).schema.fields}
    options = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r["key"] in ("engine", "order_by", "append_only")}
    return Stored(columns, options, spark.table(name).count() if count else None)


def detect_schema_drift(spark: SparkSession, tables: dict[str, TableSpec], count: bool = False) -> list[Drift]:
    names = [s.name for s in tables.values()]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"tables defined twice: {', '.join(twice)}")
    return [diff_table(s, describe_table(spark, s.name, count)) for s in tables.values()]


def push(spark: SparkSession, tables: dict[str, TableSpec], dry_run: bool = False, allow_destructive: bool = False) -> list[str]:
    """Statements that were run, or would be."""
    drifts = detect_schema_drift(spark, tables)
    risky = [f"{d.table}: {w}" for d in drifts for w in d.destructive]
    if risky and not (dry_run or allow_destructive):
        raise ValueError("destructive: " + "; ".join(risky))
    statements = [x for d in drifts if d.changed for x in (d.shadow or d.plan)]
    for x in () if dry_run else statements:
        spark.sql(x)
    return statements


def validate_tables(spark: SparkSession, tables: dict[str, TableSpec]) -> list[str]:
    """One line for each difference between the specifications and the catalog; none if they agree."""
    out = []
    for d in detect_schema_drift(spark, tables):
        out += [f"{d.table}: missing"] if d.kind == "create" else []
        out += [f"{d.table}: lacks column {c}" for c in d.added] + [f"{d.table}: {c} is {a}, not {b}" for c, a, b in d.modified]
        out += [f"{d.table}: has column {c} beyond the specification" for c in d.dropped] + [f"{d.table}: {k} is {a!r}, not {b!r}" for k, a, b in d.options]
    return out


def snapshot(tables: dict[str, TableSpec]) -> dict[str, Any]:
    return {s.name: {"columns": {f.name: {"type": f.dataType.simpleString(), "nullable": f.nullable} for f in s.schema.fields}, "engine": s.engine.name, "order_by": list(s.order_by)} for s in tables.values()}


def generate(tables: dict[str, TableSpec], before: dict[str, Any]) -> tuple[list[str], dict[str, Any]]:
    """Statements from the last snapshot to the specifications, and the new snapshot."""
    out: list[str] = []
    for s in tables.values():
        old = before.get(s.name)
        drift = diff_table(s, None if old is None else Stored({c: v["type"] for c, v in old["columns"].items()}, {k: ", ".join(old[k]) if isinstance(old.get(k), list) else old[k] for k in ("engine", "order_by") if k in old}))
        out += drift.shadow or drift.plan
    return out, snapshot(tables)


#: Quoted text and names, comments, and the semicolons between them.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;""", re.S)


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes and comments; comments and blanks go."""
    out, current, at = [], "", 0
    for m in _TOKEN.finditer(text):
        current += text[at : m.start()]
        at = m.end()
        if m[0] == ";":
            out.append(current.strip())
            current = ""
        elif m[0].startswith(("--", "/*")):
            current += " " if m[0].startswith("/*") else ""
        else:
            current += m[0]
    return [s for s in [*out, (current + text[at:]).strip()] if s]


#: The step that notes a whole file.
_WHOLE = -1


def migrate(spark: SparkSession, files: dict[str, str], history: str) -> list[str]:
    """Run the files (name -> text) that the history table lacks, in order of their names. Every statement is noted once it
    has run, so a file that failed midway goes on where it stopped; a statement whose text has changed since runs again."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {history} (name STRING, step INT, digest STRING, at TIMESTAMP) USING PARQUET")
    noted = {(r["name"], r["step"], r["digest"]) for r in spark.table(history).select("name", "step", "digest").collect()}
    whole = {name for name, step, _ in noted if step == _WHOLE}

    def note(name: str, step: int, digest: str) -> None:
        spark.sql(f"INSERT INTO {history} SELECT :name, :step, :digest, current_timestamp()", args={"name": name, "step": step, "digest": digest})

    ran = []
    for name in sorted(files):
        if name in whole:
            continue
        for step, x in enumerate(statements(files[name])):
            digest = hashlib.sha256(x.encode()).hexdigest()
            if (name, step, digest) not in noted:
                spark.sql(x)
                note(name, step, digest)
        note(name, _WHOLE, "")
        ran.append(name)
    return ran


def status(spark: SparkSession, files: dict[str, str], history: str) -> dict[str, str]:
    rows = spark.table(history).select("name", "step").collect() if spark.catalog.tableExists(history) else []
    whole, begun = {r["name"] for r in rows if r["step"] == _WHOLE}, {r["name"] for r in rows}
    return {n: "applied" if n in whole else "begun" if n in begun else "pending" for n in sorted(files)}


def pull(spark: SparkSession, names: list[str]) -> str:
    """Python source of the specifications of stored tables."""
    back = {"string": "String", "int": "Int32", "bigint": "Int64", "smallint": "Int16", "tinyint": "Int8", "double": "Float64", "float": "Float32", "boolean": "Bool", "date": "Date", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "variant": "JSON"}
    out = ["from tessera.table import table", "from tessera.types import ColumnSpec", ""]
    for n in names:
        fields = spark.table(n).schema.fields
        known = describe_table(spark, n).options
        rows = "".join(f'    "{f.name}": ColumnSpec("{back.get(f.dataType.simpleString(), f.dataType.simpleString())}"{", is_nullable=True" if f.nullable else ""}),\n' for f in fields)
        order = [c.strip() for c in known.get("order_by", "").split(",") if c.strip()] or [fields[0].name]
        out.append(f'{n.split(".")[-1]} = table("{n}", {{\n{rows}}}, order_by={order!r})\n')
    return "\n".join(out)


def list_tables(spark: SparkSession, database: str = "default") -> list[dict[str, Any]]:
    return [{"name": t.name, "columns": len(spark.table(t.name if t.isTemporary else f"{database}.{t.name}").columns), "temporary": t.isTemporary} for t in spark.catalog.listTables(database)]


def truncate(spark: SparkSession, name: str, confirmed: bool = False) -> None:
    _sure(confirmed, f"truncating {name}")
    spark.sql(f"TRUNCATE TABLE {name}")


def drop(spark: SparkSession, name: str, confirmed: bool = False) -> None:
    _sure(confirmed, f"dropping {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def reset(spark: SparkSession, tables: dict[str, TableSpec], confirmed: bool = False) -> None:
    _sure(confirmed, "dropping and recreating all tables")
    for s in tables.values():
        spark.sql(f"DROP TABLE IF EXISTS {s.name}")
        spark.sql(s.to_ddl())


def _sure(confirmed: bool, what: str) -> None:
    if not confirmed:
        raise PermissionError(f"{what} needs confirmed=True")


def check(text: str) -> list[str]:
    """Remarks on a migration file."""
    out = []
    for s in statements(text):
        if re.match(r"DROP\s+(TABLE|DATABASE|COLUMN)|TRUNCATE", s, re.I) or re.search(r"\bDROP\s+COLUMN", s, re.I):
            out.append(f"destructive: {s[:60]}")
        if s.count("(") != s.count(")"):
            out.append(f"unbalanced brackets: {s[:60]}")
    return out


def validate_config(config: dict[str, Any]) -> list[str]:
    """What is wrong with a configuration: schema and out are paths, databases name their catalogs and schemas."""
    out = []
    for k in ("schema", "out"):
        v = config.get(k)
        if k == "schema" and isinstance(v, dict):
            out += [f"schema.{n} must be a path" for n, p in v.items() if not isinstance(p, str) or not p]
        elif not isinstance(v, str) or not v:
            out.append(f"{k} must be a path")
    databases = config.get("databases")
    if not isinstance(databases, dict) or not databases:
        out.append("databases must name at least one database")
        return out
    for n, d in databases.items():
        if not isinstance(d, dict):
            out.append(f"databases.{n} must be a mapping")
        elif not isinstance(d.get("database"), str) or not re.fullmatch(r"[A-Za-z_]\w*", d["database"]):
            out.append(f"databases.{n}.database must be a name")
    if (c := config.get("default")) is not None and c not in databases:
        out.append(f"default names {c!r}, which is no database")
    return out


def save_snapshot(tables: dict[str, TableSpec]) -> str:
    return json.dumps(snapshot(tables), indent=2, sort_keys=True)


def schema_text(spark: SparkSession, name: str) -> str:
    kind: T.StructType = spark.table(name).schema
    return "\n".join(f"{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in kind.fields)
