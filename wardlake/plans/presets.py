"""SQL presets, view registration and ad hoc SQL over the registered views.

Presets are Spark SQL text over the view names registered by ``register_views``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import gold, registers
from ..operators.quality import silver_patients, silver_transactions

# Presets read views of the operators, so they run the operators' own plans
# (aggregates before joins).
PRESETS = {
    "top_earners": "SELECT name, department, experience, total_earned FROM consultation_earners",
    "insurer_billing_stats": "SELECT insurance_provider, trans_count, avg_claim_cost, total_insured_payout "
                             "FROM insurer_billing",
    "geriatric_inpatients": "SELECT id, name, age, gender, blood_group, city FROM elderly_inpatients",
    "patient_demographics": "SELECT state, category, count FROM patient_groups",
    "department_revenue_summary": "SELECT department, total_revenue, transaction_count FROM gold_dept_profitability",
    "coverage_analysis": "SELECT insurance_provider, count, total_billed, total_covered FROM insurer_coverage",
}


def register_views(spark: SparkSession, frames: dict[str, DataFrame], gold_reads_bronze: bool = True) -> list[str]:
    """Create-or-replace the table, Bronze, Silver and Gold view names over the
    given frames (lazy: nothing runs until a view is queried)."""
    names = []

    def put(name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        names.append(name)

    for t in S.TABLES:
        if t in frames:
            put(t, frames[t])
            put(f"bronze_{t}", frames[t])
    sp = silver_patients(frames["patients"])
    st = silver_transactions(frames["transactions"])
    put("silver_patients", sp)
    put("silver_transactions", st)
    tx = frames["transactions"] if gold_reads_bronze else st
    pt = frames["patients"] if gold_reads_bronze else sp
    put("gold_dept_profitability", gold.gold_dept_profitability(tx))
    put("gold_monthly_revenue", gold.gold_monthly_revenue(tx))
    put("gold_insurance_utilization", gold.gold_insurance_utilization(tx, pt))
    put("elderly_inpatients", registers.geriatric_inpatients(frames["patients"]))
    put("patient_groups", gold.patient_demographics(frames["patients"]))
    put("insurer_billing", gold.insurer_billing_stats(frames["transactions"], frames["patients"]))
    put("insurer_coverage", gold.coverage_analysis(frames["transactions"], frames["patients"]))
    if {"doctors", "appointments"} <= set(frames):
        put("consultation_earners", gold.top_earners(frames["doctors"], frames["appointments"]))
    return names


class NotASelect(ValueError):
    pass


#: Functions that run code of the driver's or executors' class path.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
#: What a statement that only reads is made of, as the parser names it.
READING = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "Distinct", "Union", "Except", "Intersect", "UnresolvedHaving", "UnresolvedInlineTable",
    "OneRowRelation", "WithWindowDefinition", "Generate", "UnresolvedSubqueryColumnAliases", "Pivot", "Unpivot",
    "UnresolvedTableValuedFunction", "Sample", "UnresolvedHint", "UnresolvedOrdinal", "LocalRelation", "UnresolvedSubquery",
}
#: Expressions that hold a plan.
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _parsed(spark: SparkSession, sql: str):
    """The parser's tree (nothing is resolved or run)."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001 - the JVM's parser error
        raise NotASelect(f"not a statement: {str(e).splitlines()[0][:200]}") from None


def check_select(spark: SparkSession, sql: str) -> None:
    """Refuse everything but reading statements over registered views.  The parsed
    plan decides, not the text: every node must be one that reads, relations must be
    temporary views or the statement's own WITH names (so neither files nor tables of
    a catalog), and no function may call Java methods."""
    views = {r.viewName.lower() for r in spark.sql("SHOW VIEWS").collect() if r.isTemporary}

    def expression(e, known: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = e.nameParts().mkString(".").lower()
            if name.rsplit(".", 1)[-1] in FORBIDDEN_FUNCTIONS:
                raise NotASelect(f"function {name} is not allowed")
        if kind in SUBQUERIES:
            plan(e.plan(), known)
        for child in _seq(e.children()):
            expression(child, known)

    def plan(p, known: set[str]) -> None:
        kind = p.getClass().getSimpleName()
        if kind not in READING:
            raise NotASelect(f"only SELECT statements are allowed ({kind})")
        if kind == "UnresolvedWith":
            inner = set(known)
            for pair in _seq(p.cteRelations()):
                plan(pair._2(), inner)  # a WITH query sees those before it
                inner.add(str(pair._1()).lower())
            known = inner
        if kind == "UnresolvedRelation":
            name = p.multipartIdentifier().mkString(".").lower()
            if name not in known:
                raise NotASelect(f"{name} is no registered view")
        if kind == "UnresolvedTableValuedFunction":
            name = p.name().mkString(".").lower()
            if name.rsplit(".", 1)[-1] in FORBIDDEN_FUNCTIONS:
                raise NotASelect(f"function {name} is not allowed")
        for e in _seq(p.expressions()):
            expression(e, known)
        for child in _seq(p.children()):
            plan(child, known)

    plan(_parsed(spark, sql), views)


class AdhocResult:
    """The result of an ad hoc query: rows up to the cap, the row count before the
    cap, status (SUCCEEDED, FAILED) with the error, and the time it took.  The query
    is run once, when any of these is first asked for."""

    def __init__(self, full: DataFrame, max_rows: int):
        self.full, self.max_rows = full, max_rows
        self._done: tuple | None = None

    @property
    def columns(self) -> list[str]:
        return self.full.columns

    def run(self) -> "AdhocResult":
        if self._done is None:
            self._done = self._run()
        return self

    def _run(self) -> tuple:
        from pyspark.sql import Observation
        began, seen = time.perf_counter(), Observation()
        # rows are numbered in the order of the parts; each part is read to its end, so the
        # count is complete, but hands on no more rows than the cap.  (A sort of the whole
        # would look at the rows twice where its size is known beforehand.)
        counted = self.full.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("_nr", F.monotonically_increasing_id())
        first = counted.where(F.col("_nr").bitwiseAND((1 << 33) - 1) < self.max_rows).repartition(1)
        try:
            rows = first.sortWithinPartitions("_nr").limit(self.max_rows).drop("_nr").collect()
        except Exception as e:  # noqa: BLE001 - the result carries the error
            return [], 0, "FAILED", str(e), time.perf_counter() - began
        return rows, seen.get["rows"], "SUCCEEDED", None, time.perf_counter() - began

    @property
    def rows(self) -> DataFrame:
        """The rows up to the cap, in the query's order; raises if it failed."""
        rows, _, status, error, _ = self.run()._done
        if status == "FAILED":
            raise RuntimeError(error)
        return self.full.sparkSession.createDataFrame(rows, self.full.schema)

    def row_count(self) -> int:
        return self.run()._done[1]

    @property
    def status(self) -> str:
        return self.run()._done[2]

    @property
    def error(self) -> str | None:
        return self.run()._done[3]

    @property
    def duration_ms(self) -> int:
        return int(self.run()._done[4] * 1000)


def adhoc_sql(spark: SparkSession, sql: str, max_rows: int = S.ADHOC_MAX_ROWS) -> AdhocResult:
    """User SQL over the registered views: reading statements only, at most
    ``max_rows`` rows returned, one execution (see ``AdhocResult``)."""
    sql = sql.strip().rstrip(";")
    check_select(spark, sql)
    return AdhocResult(spark.sql(sql), max_rows)


def run_preset(spark: SparkSession, name: str) -> DataFrame:
    return adhoc_sql(spark, PRESETS[name]).rows
