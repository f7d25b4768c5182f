
from tieout.operators import policy as P
from tieout.operators import registry as R

AS_OF = "2024-01-01 00:00:00"


def reg(spark):
    m = spark.createDataFrame(
        [("revenue_total", "Total revenue", "SUM(amount)", "finance", "confidential", ["gl"]),
         ("cost_total", "Total cost", "", "", "internal", [])],
        "name string, description string, formula string, owner string, sensitivity string, lineage array<string>")
    return R.register(spark.createDataFrame([], R.register(m.limit(0), m, as_of=AS_OF).registry.schema), m,
                      as_of=AS_OF).registry


def test_register_update_latest(spark):
    r = reg(spark)
    again = R.register(r, r.select("name", "description", "formula", "owner", "sensitivity"), as_of=AS_OF)
    assert again.registry.count() == 0 and {(x.reason, x.rows) for x in again.rejected.collect()} == {("already registered", 1)}
    patches = spark.createDataFrame([("revenue_total", "Net revenue", None), ("missing", "x", None),
                                     ("cost_total", None, "secret")],
                                    "name string, description string, sensitivity string")
    up = R.update(r, patches, as_of="2024-02-01 00:00:00")
    assert [(x.name, x.version, x.description) for x in up.registry.collect()] == [("revenue_total", 2, "Net revenue")]
    assert {x.name: x.reason for x in up.rejected.collect()} == {"missing": "metric not found",
                                                                "cost_total": "invalid sensitivity"}
    allv = r.unionByName(up.registry)
    assert {(x.name, x.version) for x in R.latest(allv).collect()} == {("revenue_total", 2), ("cost_total", 1)}
    assert [x.name for x in R.glossary(allv).collect()] == ["cost_total", "revenue_total"]
    assert [x.name for x in R.search(allv, "NET").collect()] == ["revenue_total"]
    assert R.search(allv, "").count() == 2


def test_update_rejects_immutable_fields(spark):
    import pytest
    with pytest.raises(ValueError):
        R.update(reg(spark), spark.createDataFrame([("x", 2)], "name string, version int"), as_of=AS_OF)


def test_conformance(spark):
    obs = spark.createDataFrame([("revenue_total", 1.5), ("cost_total", 2.0), ("nope", 1.0), ("revenue_total", None)],
                                "metric_name string, value double")
    c = {(x.metric_name, x.value): x for x in R.conformance(obs, reg(spark)).collect()}
    assert c[("revenue_total", 1.5)].is_valid is True and c[("revenue_total", 1.5)].metric_version == 1
    assert c[("cost_total", 2.0)].is_valid is False and c[("cost_total", 2.0)].checks.has_owner is False
    assert c[("nope", 1.0)].error == "Metric 'nope' not found in registry"
    assert c[("revenue_total", None)].is_valid is False


def test_row_policies(spark):
    rows = spark.createDataFrame([(lvl,) for lvl in ["PUBLIC", "internal", "CONFIDENTIAL", "RESTRICTED", None]],
                                 "sensitivity_level string")
    n = {role: P.visible_rows(rows, role).count() for role in
         ("analyst", "finance_lead", "data_engineer", "auditor", "pipeline", "nobody")}
    assert n == {"analyst": 2, "finance_lead": 3, "data_engineer": 3, "auditor": 5, "pipeline": 5, "nobody": 0}
    users = spark.createDataFrame([("a@x", "INTERNAL"), ("r@x", "RESTRICTED")],
                                  "user_email string, sensitivity_clearance string")
    assert P.visible_rows_for_user(rows, users, "a@x").count() == 2
    assert P.visible_rows_for_user(rows, users, "r@x").count() == 5
    assert P.visible_rows_for_user(rows, users, "ghost@x").count() == 0


def test_register_outcomes_in_one_frame(spark):
    r = reg(spark)
    batch = spark.createDataFrame([("revenue_total", "x", "f", "o", "public"), ("new_one", "b", "f", "o", "public"),
                                   ("new_one", "a", "f", "o", "public"), ("bad", "d", "f", "o", "secret")],
                                  "name string, description string, formula string, owner string, sensitivity string")
    out = R.register(r, batch, as_of=AS_OF)
    got = sorted((x.name, x.outcome, x.rows, x.definition.description if x.definition else None)
                 for x in out.outcomes.collect())
    assert got == [("bad", "invalid sensitivity", 1, None), ("new_one", "duplicate in batch", 1, "a"),
                   ("new_one", "registered", 1, "a"), ("revenue_total", "already registered", 1, None)]
    assert {x.name for x in out.registry.collect()} == {"new_one"}
