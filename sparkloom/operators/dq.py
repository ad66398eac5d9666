"""Data-quality rules. A rule is (name, severity, column that is true where the row is good)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import hot_join
from sparkloom.sources.shared import written

REPORT = ("table_name", "rule", "severity", "row_key", "detail")


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    ok: Column
    detail: Column | None = None


def run_rules(df: DataFrame, table_name: str, key: str, rules: Sequence[Rule]) -> DataFrame:
    """One report row per broken rule and row, in a single pass over ``df``. A null outcome is a break."""
    marks = [F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), (F.lit("") if r.detail is None else F.coalesce(r.detail.cast("string"), F.lit("null"))).alias("detail"))) for r in rules]
    broken = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("b")).select("table_name", "b.rule", "b.severity", "row_key", "b.detail")


def with_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``violations``: sorted names of the broken rules."""
    marks = [F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]
    return df.withColumn("violations", F.array_sort(F.filter(F.array(*marks), lambda x: x.isNotNull())))


def report_row(df: DataFrame, table_name: str, rule: str, severity: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(table_name).alias("table_name"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def missing_columns(df: DataFrame, table_name: str, required: Sequence[str]) -> DataFrame:
    gone = sorted(set(required) - set(df.columns))
    rows = df.sparkSession.createDataFrame([(c,) for c in gone], "c string")
    return report_row(rows, table_name, "required_columns", "error", F.col("c"), F.col("c"))


def duplicate_keys(df: DataFrame, table_name: str, key: str) -> DataFrame:
    return report_row(df.groupBy(key).count().filter("count > 1"), table_name, "duplicate_keys", "error", F.col(key), F.col("count"))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str, table_name: str, key: str) -> DataFrame:
    """Rows whose reference is not there. The optimizer broadcasts the parent only if it measures small."""
    lost = child.join(parent.select(F.col(parent_column).alias("_p")).distinct(), F.col(column) == F.col("_p"), "left_anti")
    return report_row(lost, table_name, f"foreign_key:{column}", "error", F.col(key), F.col(column))


def enum(column: str, values: Sequence[str], severity: str = "error") -> Rule:
    return Rule(f"enum:{column}", severity, F.col(column).isin(*values), F.col(column))


def pattern(column: str, regex: str, severity: str = "error") -> Rule:
    return Rule(f"pattern:{column}", severity, F.col(column).rlike(regex), F.col(column))


def int_range(column: str, low: int, high: int, severity: str = "error") -> Rule:
    number = F.col(column).cast("string").try_cast("int")
    return Rule(f"int_range:{column}", severity, number.between(low, high), F.col(column))


def conditional(name: str, when: Column, then: Column, severity: str = "warning") -> Rule:
    return Rule(name, severity, ~when | F.coalesce(then, F.lit(False)))


def staleness(column: str, as_of: Column, days: int) -> list[Rule]:
    """Older than ``days`` is a warning, an unreadable date an error."""
    date = F.col(column).cast("string").try_cast("date")
    return [Rule(f"date:{column}", "error", date.isNotNull(), F.col(column)), Rule(f"stale:{column}", "warning", date.isNull() | (F.datediff(as_of, date) <= days), F.col(column))]


def row_floor(df: DataFrame, table_name: str, least: int) -> DataFrame:
    n = df.agg(F.count("*").alias("n")).filter(F.col("n") < least)
    return report_row(n, table_name, "row_floor", "error", F.lit(table_name), F.col("n"))


def totals(reports: Sequence[DataFrame]) -> DataFrame:
    """Errors, warnings and whether all is well over several reports."""
    every = reports[0]
    for r in reports[1:]:
        every = every.unionByName(r)
    return every.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings")).withColumn("ok", F.col("errors") == 0)


@dataclass(frozen=True)
class TableRules:
    """What is asked of one table: columns, a unique key, rules, references (column, table, its column) and a least number of rows."""

    key: str
    required: Sequence[str] = ()
    rules: Sequence[Rule] = ()
    references: Sequence[tuple[str, str, str]] = ()
    least_rows: int = 0


def validate(tables: Mapping[str, DataFrame], specs: Mapping[str, TableRules]) -> DataFrame:
    """Every finding over several tables, in the columns of ``REPORT``.

    Each table is scanned once, into rows of one shape: a broken rule, the key, a reference
    or a value that others refer to. One aggregation over those finds repeated keys and small
    tables, one join lost references of all tables, whatever the number of rules.
    A null reference is lost; null keys count as equal.
    """
    wanted = {name: [] for name in tables}
    for spec in specs.values():
        for _, other, theirs in spec.references:
            wanted[other] += [theirs] if theirs not in wanted[other] else []
    scans = [_scan(name, df, specs.get(name), wanted[name], tables) for name, df in tables.items() if name in specs or wanted[name]]
    every = written(reduce(DataFrame.unionByName, scans))
    spark = every.sparkSession
    keys = every.filter("kind = 'key'").groupBy("table_name", "row_key").agg(F.count("*").alias("n"))
    twice = keys.filter("n > 1").select("table_name", F.lit("duplicate_keys").alias("rule"), F.lit("error").alias("severity"), "row_key", F.col("n").cast("string").alias("detail"))
    refs = every.filter("kind = 'reference'")
    held = every.filter("kind = 'value'").select("domain", "matched").distinct()
    lost = refs.filter("matched IS NULL").unionByName(hot_join(refs.filter("matched IS NOT NULL"), held, ["domain", "matched"], "left_anti").select(*refs.columns))
    found = every.filter("kind = 'rule'").select(*REPORT).unionByName(twice).unionByName(lost.select(*REPORT))
    floors = [(name, spec.least_rows) for name, spec in specs.items() if spec.least_rows]
    if floors:
        counts = every.filter("kind = 'key'").groupBy("table_name").agg(F.count("*").alias("n"))
        few = spark.createDataFrame(floors, "table_name string, least long").join(counts, "table_name", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < least")
        found = found.unionByName(few.select("table_name", F.lit("row_floor").alias("rule"), F.lit("error").alias("severity"), F.col("table_name").alias("row_key"), F.col("n").cast("string").alias("detail")))
    gone = [missing_columns(tables[name], name, spec.required) for name, spec in specs.items() if set(spec.required) - set(tables[name].columns)]
    return reduce(DataFrame.unionByName, gone, found)


def _scan(name: str, df: DataFrame, spec: TableRules | None, wanted: Sequence[str], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (kind, table_name, rule, severity, row_key, detail, domain, matched) of one scan. References take the type of what they refer to."""
    key = F.lit(None).cast("string") if spec is None else F.col(spec.key).cast("string")

    def row(kind: str, rule: str, severity: str, detail: Column, domain: str, matched: Column) -> Column:
        fields = {"kind": F.lit(kind), "table_name": F.lit(name), "rule": F.lit(rule), "severity": F.lit(severity), "row_key": key, "detail": detail.cast("string"), "domain": F.lit(domain), "matched": matched.cast("string")}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    none = F.lit(None).cast("string")
    rows = [row("value", "", "", none, f"{name}.{c}", F.col(c)) for c in wanted]
    if spec is not None:
        rows.append(row("key", "", "", none, "", none))
        rows += [row("reference", f"foreign_key:{c}", "error", F.col(c), f"{other}.{theirs}", F.col(c).try_cast(tables[other].schema[theirs].dataType)) for c, other, theirs in spec.references]
        rows += [F.when(~F.coalesce(r.ok, F.lit(False)), row("rule", r.name, r.severity, F.lit("") if r.detail is None else F.coalesce(r.detail.cast("string"), F.lit("null")), "", none)) for r in spec.rules]
    return df.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select("e.*")


def provenance_rules(struct: str, keys: Sequence[str]) -> list[Rule]:
    return [Rule(f"provenance:{k}", "error", F.length(F.col(f"{struct}.{k}").cast("string")) > 0) for k in keys]


def forbidden_fields(column: str, names: Sequence[str]) -> Column:
    """Which of ``names`` are top-level keys of a JSON text, sorted."""
    keys = F.coalesce(F.expr(f"json_object_keys({column})"), F.array().cast("array<string>"))
    return F.array_sort(F.array_intersect(keys, F.array(*[F.lit(n) for n in names])))


def with_lineage(df: DataFrame, id_column: str, parents: str, edges: DataFrame) -> DataFrame:
    """Rows that lack parents or an edge of their own."""
    bare = df.filter(F.coalesce(F.size(parents), F.lit(0)) == 0)
    lost = df.filter(F.size(parents) > 0).join(edges.select(F.col("child_id").alias("_c")).distinct(), F.col(id_column) == F.col("_c"), "left_anti")
    return bare.unionByName(lost)


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], numbers: Mapping[str, float]) -> DataFrame:
    """Keys whose numbers differ by more than the tolerance given, or that one side lacks."""
    a, b = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in numbers], F.lit(True).alias("_in_l")), right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in numbers], F.lit(True).alias("_in_r"))
    j = a.join(b, list(keys), "full_outer")
    same = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    for c, eps in numbers.items():
        x, y = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= eps, F.lit(False)))
    return j.filter(~same).select(*keys)
