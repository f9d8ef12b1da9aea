"""Property tests: operators against a plain-Python model on random inputs."""

from decimal import ROUND_FLOOR, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.helpers import frame, tx_row
from wardlake.functions import scalars as X
from wardlake.operators import upsert
from wardlake.sources.tables import number_text

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
cents = st.integers(min_value=-10_000_000, max_value=10_000_000)


@SETTINGS
@given(st.lists(cents, min_size=1, max_size=30))
def test_round_half_up_and_number_text(spark, values):
    df = spark.createDataFrame([(Decimal(v) / 100,) for v in values], "x decimal(12,2)")
    got = df.select(X.round_half_up("x").alias("r"), number_text("x").alias("t")).collect()
    for v, row in zip(values, got):
        d = Decimal(v) / 100
        assert row.r == int((d + Decimal("0.5")).to_integral_value(rounding=ROUND_FLOOR))
        want = format(d.normalize(), "f") if d != d.to_integral_value() else str(int(d))
        assert row.t == want


change = st.tuples(st.integers(0, 6), st.integers(1, 9), st.integers(1, 500))


@SETTINGS
@given(st.lists(change, max_size=8), st.lists(change, max_size=8))
def test_merge_matches_model(spark, tgt, src):
    def rows(spec):
        seen, out = set(), []
        for k, day, amt in spec:
            if k in seen:
                continue
            seen.add(k)
            out.append(tx_row(f"T{k}", date=f"2024-01-{day:02d} 00:00:00", amount=amt, dept=f"D{k}"))
        return out
    t_rows, s_rows = rows(tgt), rows(src)
    got = {r.id: (r.date.day, float(r.amount), r.department)
           for r in upsert.merge_upsert(frame(spark, "transactions", t_rows),
                                        frame(spark, "transactions", s_rows)).collect()}
    model = {r[0]: (r[3].day, float(r[4]), r[8]) for r in t_rows}
    for r in s_rows:
        if r[0] not in model:
            model[r[0]] = (r[3].day, float(r[4]), r[8])
        elif model[r[0]][0] < r[3].day:
            model[r[0]] = (r[3].day, float(r[4]), model[r[0]][2])
    assert got == model
