"""A subject table and sensor series derived from the given tables.

Subjects are customers with figures computed from their account and orders; series are
the events of a user, who is the customer of that number. Every subject column is one
SQL expression that means the same to Spark and to the SQL of the check, so both sides
start from the same rows. Some values are left out on purpose (the tables have no nulls).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinecohort.functions.columns import col
from kinecohort.operators.series import SeriesLayout
from kinecohort.plans.presets import NOT_RELEVANT
from kinecohort.sources.shared import materialize

# Events are sparse (50 to 100 per user), so the rolling window is short here; so are the blocks, of which
# scale 0.01 has about twenty, with windows that reach from one into the next.
LAYOUT = SeriesLayout(window=10, block_rows=512)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- subjects --------------------------------------------------------------------

# One row per customer: key k, nation nk, segment; a, h, l: whole account balance, highest
# and lowest order; n, done: orders, and finished ones.
_BASE = """
SELECT c_custkey AS k, c_nationkey AS nk, c_mktsegment AS segment,
       CAST(floor(c_acctbal) AS BIGINT) + 1000 AS a,
       CAST(floor(coalesce(hi, 0)) AS BIGINT) AS h,
       CAST(floor(coalesce(lo, 0)) AS BIGINT) AS l,
       coalesce(n, 0) AS n, coalesce(done, 0) AS done
FROM customer LEFT JOIN (
  SELECT o_custkey, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(*) AS n,
         count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done
  FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
"""


def subject_id(key: str) -> str:
    """Ids keep leading zeros; three subjects carry ids the cleaning rules name."""
    return (
        f"CASE {key} WHEN 5 THEN '83525bbe' WHEN 17 THEN 'cedf96c5' WHEN 23 THEN 'e252dcb6' "
        f"ELSE lpad(CAST({key} AS STRING), 8, '0') END"
    )


def _unless(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN NULL ELSE {value} END"


def _season(i: int) -> str:
    return (
        f"CASE (h + {i * 7} * n) % 5 WHEN 0 THEN 'Spring' WHEN 1 THEN 'Summer' "
        f"WHEN 2 THEN 'Fall' WHEN 3 THEN 'Winter' END"
    )


def _measure(i: int, spread: int, low: int, tenths: int = 10) -> str:
    mixed = f"(a * {3 + i} + h * {5 + i} + l * {2 * i + 1}) % {spread}"
    return f"{low} + CAST({mixed} AS DOUBLE) / {tenths}"


def _whole(i: int, spread: int, low: int) -> str:
    return f"CAST({low} + (a * {3 + i} + h * {5 + i} + l) % {spread} AS INT)"


HOURS = "CAST(a % 4 AS INT)"
FGC_FIELDS = ["CU", "GSND", "GSD", "PU", "SRL", "SRR", "TL"]
BIA_FIELDS = ["BMC", "BMI", "BMR", "DEE", "ECW", "FFM", "FFMI", "FMI", "Fat", "ICW", "LDM", "LST", "SMM", "TBW"]
ITEMS = [f"PCIAT-PCIAT_{i:02d}" for i in range(1, 21)]
_NO_BIA, _NO_FGC, _NO_PCIAT = "h % 4 = 1", "h % 7 = 2", "l % 3 = 1"


def _item(i: int) -> str:
    # Grows with hours and age, plus a little variation per item; 0..5.
    value = f"least(5, greatest(0, a % 4 + CAST(floor((nk % 18) / 6) AS BIGINT) - 1 + (h + {i * 13}) % 3))"
    return _unless(f"{_NO_PCIAT} OR (h + {i * 5}) % 29 = 0", f"CAST({value} AS INT)")


@cache
def subject_columns() -> dict[str, str]:
    """Expression per column, over the base relation."""
    cols = {
        "id": subject_id("k"),
        "Basic_Demos-Enroll_Season": _season(1),
        "Basic_Demos-Age": "CAST(5 + nk % 18 AS INT)",
        "Basic_Demos-Sex": "CAST(n % 2 AS INT)",
        "CGAS-Season": _season(2),
        "CGAS-CGAS_Score": _unless("h % 5 = 3", _whole(1, 70, 30)),
        "Physical-Season": _season(3),
        "Physical-BMI": _unless("h % 11 = 4", f"CASE WHEN h % 13 = 5 THEN 0 ELSE {_measure(2, 250, 12)} END"),
        "Physical-Height": _unless("h % 11 = 4", _measure(3, 300, 40)),
        "Physical-Weight": _unless("h % 11 = 4", f"CASE WHEN h % 17 = 6 THEN 0 ELSE {_measure(4, 900, 40)} END"),
        "Physical-Waist_Circumference": _unless("h % 3 = 0", _measure(5, 250, 18)),
        "Physical-Diastolic_BP": _unless("h % 10 = 1", _whole(6, 60, 0)),
        "Physical-HeartRate": _unless("h % 10 = 1", _whole(7, 60, 50)),
        "Physical-Systolic_BP": _unless("h % 10 = 1", f"CASE WHEN l % 19 = 0 THEN 0 ELSE {_whole(8, 80, 80)} END"),
        "Fitness_Endurance-Season": _season(4),
        "Fitness_Endurance-Max_Stage": _unless("h % 3 = 1", _whole(9, 8, 0)),
        "Fitness_Endurance-Time_Sec": _unless("h % 3 = 1", _whole(10, 60, 0)),
        "FGC-Season": _season(5),
    }
    for i, f in enumerate(FGC_FIELDS):
        cols[f"FGC-FGC_{f}"] = _unless(_NO_FGC, _measure(11 + i, 300, 0))
        cols[f"FGC-FGC_{f}_Zone"] = _unless(_NO_FGC, _whole(11 + i, 3, 0))
    cols["BIA-Season"] = _season(6)
    cols["BIA-BIA_Activity_Level_num"] = _unless(_NO_BIA, _whole(20, 5, 1))
    for i, f in enumerate(BIA_FIELDS):
        # Fat and the two indices reach 0, so that ratios meet zero denominators.
        low = 0 if f in ("Fat", "FMI", "BMI") else 5
        cols[f"BIA-BIA_{f}"] = _unless(_NO_BIA, _measure(21 + i, 40 if low == 0 else 500, low))
    cols["BIA-BIA_Frame_num"] = _unless(_NO_BIA, _whole(36, 3, 1))
    cols["PAQ_A-Season"] = _unless("n % 3 <> 0", _season(7))
    cols["PAQ_A-PAQ_A_Total"] = _unless("n % 3 <> 0", _measure(37, 40, 1))
    cols["PAQ_C-Season"] = _unless("n % 3 = 0 AND h % 2 = 0", _season(8))
    cols["PAQ_C-PAQ_C_Total"] = _unless("n % 3 = 0 AND h % 2 = 0", _measure(38, 40, 1))
    cols["PCIAT-Season"] = _unless(_NO_PCIAT, _season(9))
    for i, name in enumerate(ITEMS):
        cols[name] = _item(i)
    cols["PCIAT-PCIAT_Total"] = _unless(
        _NO_PCIAT, "CAST(" + " + ".join(f"coalesce({_item(i)}, 0)" for i in range(20)) + " AS INT)"
    )
    cols["SDS-Season"] = _season(10)
    cols["SDS-SDS_Total_Raw"] = _unless("h % 6 = 0", _whole(39, 60, 20))
    cols["SDS-SDS_Total_T"] = _unless("h % 6 = 0", _whole(40, 60, 35))
    cols["PreInt_EduHx-Season"] = _season(11)
    cols["PreInt_EduHx-computerinternet_hoursday"] = _unless("l % 23 = 0", HOURS)
    cols["sii"] = _unless(_NO_PCIAT, "CAST(0 AS INT)")
    # Subjects of whom hardly anything is known: nothing but one score, or not even that.
    bare = "l % 11 = 2"
    for c, e in cols.items():
        if c == "SDS-SDS_Total_T":
            cols[c] = _unless(f"{bare} AND l % 2 = 0", e)
        elif not (c.endswith("Season") or c.startswith("PCIAT") or c in ("sii", *NOT_RELEVANT)):
            cols[c] = _unless(bare, e)
    return cols


def _derived_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _BASE.replace("FROM customer", f"FROM parquet.`{sf_dir}/customer.parquet`").replace(
        "FROM orders", f"FROM parquet.`{sf_dir}/orders.parquet`"
    )
    df = spark.sql(base)
    return df.select(*[F.expr(e).alias(c) for c, e in subject_columns().items()])


_written: dict[tuple[str, str], DataFrame] = {}


def subjects(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """The subject table, written once per application, as a study would have it stored."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = materialize(_derived_subjects(spark, sf_dir), "subjects")
    df = _written[key]
    return df.select(*[col(c) for c in df.columns if keep is None or c in keep])


def subjects_sql(keep: list[str] | None = None) -> str:
    exprs = ",\n".join(f'{e} AS "{c}"' for c, e in subject_columns().items() if keep is None or c in keep)
    return f"SELECT {exprs} FROM ({_BASE})"


# --- series ------------------------------------------------------------------------


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Clock parts are taken from the zone-less timestamp, so the session zone is no matter.
    clock = (
        "(hour(ts) * 3600 + minute(ts) * 60) * 1000000000L"
        " + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT) * 1000"
    )
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
    exprs = {
        "id": subject_id("user_id"),
        "step": "event_id",
        "X": "value / 100",
        "Y": f"{k} / 100",
        "Z": "CAST(event_id % 1000 AS DOUBLE) / 1000",
        "enmo": "value",
        "light": f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE {k} END",
        "anglez": "value - 50",
        "non-wear_flag": "CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "time_of_day": clock,
        "weekday": "weekday(ts) + 1",
        "quarter": "quarter(ts)",
        "relative_date_PCIAT": "CAST(datediff(CAST(ts AS DATE), DATE '2024-01-01') - 10 AS DOUBLE)",
    }
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in exprs.items()])


def series_sql() -> str:
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
    return f"""
SELECT {subject_id("user_id")} AS id, event_id AS step,
  value / 100 AS "X", {k} / 100 AS "Y", CAST(event_id % 1000 AS DOUBLE) / 1000 AS "Z",
  value AS enmo, CASE WHEN event_id % 11 = 0 THEN NULL ELSE {k} END AS light, value - 50 AS anglez,
  CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS "non-wear_flag",
  CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS BIGINT) * 1000 AS time_of_day,
  CAST(isodow(ts) AS INT) AS weekday, CAST(quarter(ts) AS INT) AS quarter,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) - 10 AS DOUBLE) AS "relative_date_PCIAT"
FROM events"""
