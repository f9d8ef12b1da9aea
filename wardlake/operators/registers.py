"""Filtered registers, search, paging and top-k.

Optional filters: a missing/empty argument adds no predicate; several are
AND-ed.  Predicates are plain column comparisons, so they reach the Parquet scan
as pushed filters.  Ordered limits become ``TakeOrderedAndProject`` (each task
keeps only its best ``offset + limit`` rows); every ordering ends in the key so
pages are deterministic.  For deep pages use ``page_after`` (keyset paging over
all columns of the order), which needs no offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import to_api_names, to_api_types


def _where_eq(df: DataFrame, **eq) -> DataFrame:
    for col, val in eq.items():
        if val not in (None, ""):
            df = df.where(F.col(col) == F.lit(val))
    return df


def filter_patients(df: DataFrame, state: str | None = None, category: str | None = None) -> DataFrame:
    return _where_eq(df, state=state, category=category)


def search_patients(df: DataFrame, term: str | None) -> DataFrame:
    """lower(name) LIKE %term% OR lower(id) LIKE %term%; ``%`` and ``_`` inside
    the term stay wildcards (as in the reference's LIKE)."""
    if not term:
        return df
    pattern = f"%{term.lower()}%"
    return df.where(F.lower("name").like(pattern) | F.lower("id").like(pattern))


def filter_appointments(df: DataFrame, status: str | None = None, department: str | None = None) -> DataFrame:
    return _where_eq(df, status=status, department=department)


def filter_transactions(df: DataFrame, type: str | None = None, payment_type: str | None = None) -> DataFrame:
    return _where_eq(df, type=type, payment_type=payment_type)


def experienced_doctors(doc: DataFrame, min_experience: int = 15) -> DataFrame:
    """Doctors with experience > 15: name, department, fee; fee descending."""
    return (doc.where(F.col("experience") > min_experience)
            .orderBy(F.col("consultation_fee").desc(), "id")
            .select("name", "department", "consultation_fee"))


def geriatric_inpatients(pt: DataFrame, n: int = 10, min_age: int = 75) -> DataFrame:
    """Inpatients older than 75, oldest first (ties by id), top ``n``."""
    return (pt.where((F.col("age") > min_age) & (F.col("category") == "Inpatient"))
            .orderBy(F.col("age").desc(), "id").limit(n)
            .select("id", "name", "age", "gender", "blood_group", "city"))


def inpatient_count(pt: DataFrame) -> DataFrame:
    return pt.agg(F.count_if(F.col("category") == "Inpatient").alias("inpatients"))


def doctor_sample(doc: DataFrame, n: int = 10) -> DataFrame:
    """Fallback sample: first ``n`` doctors by id, five columns."""
    return doc.orderBy("id").limit(n).select("id", "name", "department", "consultation_fee", "experience")


def _order(cols) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in cols]


def page(df: DataFrame, order, page_no: int = 1, limit: int = S.DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page: order -> offset -> limit (page numbers start at 1)."""
    page_no = max(int(page_no), 1)
    out = df.orderBy(*_order(order))
    off = (page_no - 1) * limit
    if off:
        out = out.offset(off)
    return out.limit(limit)


def _pairs(order) -> list[tuple[str, bool]]:
    return [(c, True) if isinstance(c, str) else tuple(c) for c in order]


def _behind(df: DataFrame, order, last) -> Column:
    """Whether a row comes after the one with the values ``last``."""
    behind, same = F.lit(False), F.lit(True)
    for (c, desc), v in zip(order, last):
        col, val = F.col(c), F.lit(v).cast(df.schema[c].dataType)
        behind = behind | (same & (col < val if desc else col > val))
        same = same & (col == val)
    return behind


def _bound(df: DataFrame, order, last) -> Column:
    """The first column alone bounds the scan (a pushed filter)."""
    c, desc = order[0]
    first = F.lit(last[0]).cast(df.schema[c].dataType)
    return F.col(c) <= first if desc else F.col(c) >= first


def page_after(df: DataFrame, order, last=None, limit: int = S.DEFAULT_PAGE_SIZE) -> DataFrame:
    """Keyset page: the next ``limit`` rows after the row with the values ``last``
    (no offset, so deep pages cost the same as the first).

    ``order`` lists (column, descending) pairs that end in a unique key; ``last``
    holds the previous page's last values of these columns.  Rows follow when the
    first column that differs lies behind, so ties are never skipped.  The columns
    must not be null."""
    order = _pairs(order)
    if last is not None:
        df = df.where(_bound(df, order, last)).where(_behind(df, order, last))
    return df.orderBy(*[F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]).limit(limit)


def page_info(df: DataFrame, page_no: int = 1, limit: int = S.DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: total, page, limit, total_pages = max(1, ceil(total/limit)), and
    the first / last row position shown."""
    page_no = max(int(page_no), 1)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        "total", F.lit(page_no).alias("page"), F.lit(limit).alias("limit"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(limit))).cast("bigint").alias("total_pages"),
        F.lit((page_no - 1) * limit + 1).cast("bigint").alias("first_row"),
        F.least(F.lit(page_no * limit).cast("bigint"), F.col("total")).alias("last_row"))


#: Orders of the registers, all descending and ending in the key.
REGISTER_ORDER = {"patients": ["id"], "appointments": ["appointment_date", "id"], "transactions": ["date", "id"]}


def _register_page(df: DataFrame, table: str, page_no: int, limit: int, index: DataFrame | None) -> DataFrame:
    if index is not None:
        return page_by_number(df, REGISTER_ORDER[table], index, page_no, limit)
    return page(df, [F.col(c).desc() for c in REGISTER_ORDER[table]], page_no, limit)


def page_patients(pt: DataFrame, page_no: int = 1, limit: int = S.DEFAULT_PAGE_SIZE,
                  state: str | None = None, category: str | None = None, search: str | None = None,
                  index: DataFrame | None = None) -> DataFrame:
    """Patient register page: filters + search, id descending, API shape.  With the
    rank ``index`` of the filtered rows (``page_index`` by REGISTER_ORDER), also of the
    other registers, deep pages need no offset."""
    df = search_patients(filter_patients(pt, state, category), search)
    out = _register_page(df, "patients", page_no, limit, index)
    return to_api_types(to_api_names(out.select(*S.storage_columns("patients")), "patients"), "patients")


def patient_register(pt: DataFrame, page_no: int = 1, limit: int = S.DEFAULT_PAGE_SIZE,
                     state: str | None = None, category: str | None = None,
                     search: str | None = None) -> dict[str, DataFrame]:
    """Everything the patient register shows: the page, the page info (total
    after filters), the distinct states (of all patients) and the categories."""
    filtered = search_patients(filter_patients(pt, state, category), search)
    spark = pt.sparkSession
    return {
        "page": page_patients(pt, page_no, limit, state, category, search),
        "info": page_info(filtered, page_no, limit),
        "states": pt.select("state").distinct().orderBy("state"),
        "categories": spark.createDataFrame([(c,) for c in S.CATEGORIES], "category string"),
    }


def page_appointments(ap: DataFrame, page_no: int = 1, limit: int = S.DEFAULT_PAGE_SIZE,
                      status: str | None = None, department: str | None = None,
                      index: DataFrame | None = None) -> DataFrame:
    df = filter_appointments(ap, status, department)
    out = _register_page(df, "appointments", page_no, limit, index)
    return to_api_types(to_api_names(out.select(*S.storage_columns("appointments")), "appointments"),
                        "appointments")


def page_transactions(tx: DataFrame, page_no: int = 1, limit: int = S.DEFAULT_PAGE_SIZE,
                      type: str | None = None, payment_type: str | None = None,
                      index: DataFrame | None = None) -> DataFrame:
    df = filter_transactions(tx, type, payment_type)
    out = _register_page(df, "transactions", page_no, limit, index)
    return to_api_types(to_api_names(out.select(*S.storage_columns("transactions")), "transactions"),
                        "transactions")


def recent_rows(df: DataFrame, ts_col: str, n: int = S.SANDBOX_SAMPLE_ROWS, key: str = "id") -> DataFrame:
    """Newest ``n`` rows (ties by key)."""
    return df.orderBy(F.col(ts_col).desc(), F.col(key).desc()).limit(n)


def top_k(df: DataFrame, by, k: int, tie_break=()) -> DataFrame:
    """Largest ``k`` rows by ``by`` (descending), ties broken by ``tie_break``."""
    by = [by] if isinstance(by, str) else list(by)
    tie_break = [tie_break] if isinstance(tie_break, str) else list(tie_break)
    return df.orderBy(*[F.col(c).desc() for c in by], *tie_break).limit(k)


def latest_periods_ascending(df: DataFrame, period: str, n: int) -> DataFrame:
    """Keep the ``n`` latest periods (one row per period), oldest first."""
    return df.orderBy(F.col(period).desc()).limit(n).orderBy(period)


# -- pages by number without an offset ------------------------------------------

#: Rows that one task sorts for a rank index.
INDEX_ROWS = 500_000

def page_index(df: DataFrame, order, path: str, limit: int = S.DEFAULT_PAGE_SIZE) -> None:
    """Write a rank index of ``df`` to ``path``: for every page the values of the order
    columns in its first row.  ``order`` lists (column, descending) pairs that end in
    a unique key, as in ``page_after``.

    The order columns are stored, range-partitioned into tasks of about ``INDEX_ROWS``
    and numbered inside each partition; the partitions' row counts give each its
    offset, and rows at a page's start are kept.
    The index belongs to the rows as they are now; build it anew when they change."""
    from ..session import remove_path, scratch_path
    spark, order = df.sparkSession, _pairs(order)
    by = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    values, stage = scratch_path(spark, "page-values"), scratch_path(spark, "page-index")
    # stored first: their number is known then, and finding the ranges does not build them again
    df.select(*[c for c, _ in order]).write.parquet(values)
    stored = spark.read.schema(df.select(*[c for c, _ in order]).schema).parquet(values)
    tasks = max(-(-stored.count() // INDEX_ROWS), 1)
    # stored once, so that both passes see the same numbers
    (stored.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
     .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(stage))
    rows = spark.read.parquet(stage)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("_at")
    (rows.join(F.broadcast(offsets), "_part").where(rank % limit == 0).select((rank / limit + 1).cast("bigint").alias("page"), *[c for c, _ in order])
     .repartitionByRange("page").sortWithinPartitions("page").write.mode("overwrite").parquet(path))
    remove_path(spark, values)
    remove_path(spark, stage)


def page_by_number(df: DataFrame, order, index: DataFrame, page_no: int, limit: int = S.DEFAULT_PAGE_SIZE) -> DataFrame:
    """Page ``page_no`` of ``df`` through its rank index (of the same order and page
    size): the rows from the page's first row on, so no task keeps more than a page,
    however deep it lies.  Empty beyond the last page."""
    order = _pairs(order)
    first = index.where(F.col("page") == max(int(page_no), 1)).first()
    if first is None:
        return df.limit(0)
    last = [first[c] for c, _ in order]
    same = F.lit(True)
    for (c, _), v in zip(order, last):
        same = same & (F.col(c) == F.lit(v).cast(df.schema[c].dataType))
    by = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    return df.where(same | _behind(df, order, last)).where(_bound(df, order, last)).orderBy(*by).limit(limit)
