"""Concrete stages, their configuration, and characterisation models that are written and read again."""

import json

import pytest

from orrerium.operators import characterise, models
from orrerium.plans import stages
from orrerium.plans.registry import Context, Pipeline
from orrerium.plans.resume import content, run_resumable


@pytest.fixture
def small_forests(monkeypatch):
    monkeypatch.setattr(models, "TREES", 8)
    monkeypatch.setattr(models, "CLASS_TREES", 8)


def catalog(spark, n=240):
    rows = [(k, f"h{k // 3}", f"p{k}", 1.0 + (k * 7 % 50) * (1 + k % 3), 0.2 + 0.01 * (k % 120), 500.0 + 10 * (k % 90), None if k % 11 == 0 else 0.5 + (k % 60) / 10, 1.0 + (k % 60) * 2.0, "Transit" if k % 4 else "Radial Velocity", 2000 + k % 20) for k in range(n)]
    names = "row_index long, hostname string, pl_name string, pl_orbper double, st_mass double, pl_eqt double, pl_rade double, pl_bmasse double, discoverymethod string, disc_year int"
    return spark.createDataFrame(rows, names).selectExpr("*", "st_mass AS st_rad", "CAST(NULL AS DOUBLE) AS pl_orbsmax")


def test_all_stages(spark, small_forests):
    ctx = stages.run(spark, catalog(spark), {"characterisation": {"mode": "multiplanet"}, "mapper": {"n_cubes": 4}})
    assert [s["status"] for s in ctx.manifest["stages"]] == ["done"] * 8
    t = ctx.tables
    assert t["imputed"].where("pl_rade is null").count() == 0 and t["membership"].count() > 0
    assert t["node_table"].count() == t["membership"].select("node_id").distinct().count() == t["node_bias"].count()
    assert {r.metric for r in t["global_bias"].collect()} == {"weighted_purity", "weighted_entropy", "node_method_nmi", "dominant_method_assortativity"}
    assert {r.target for r in t["validation_metrics"].collect()} == {"pl_rade", "pl_bmasse", "radius_class"}
    assert t["tables"].count() == len(t) - 1 and t["gap_validation"].count() == 1


def test_stages_that_are_off_or_dry(spark):
    off = {"stages": {n: {"enabled": False} for n in stages.standard().stages if n != "data_audit"}}
    ctx = stages.run(spark, catalog(spark, 5), off)
    assert set(ctx.tables) == {"catalog", "column_profile"}
    dry = stages.standard().run(Context(spark, stages.DEFAULTS, {}), dry_run=True)
    assert {s["status"] for s in dry.manifest["stages"]} == {"planned"}


def test_configuration(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"mapper": {"n_cubes": 6}, "label": "facility"}))
    got = stages.load_config(spark, [f"file://{tmp_path}/run.json"], ["mapper.overlap=0.2"])
    assert (got["mapper"]["n_cubes"], got["mapper"]["overlap"], got["mapper"]["lens"], got["label"]) == (6, 0.2, "pca2", "facility")
    with pytest.raises(FileNotFoundError):
        stages.load_config(spark, [f"file://{tmp_path}/none.json"])
    kinds = {r.path.rpartition("/")[2]: r.kind for r in stages.artifacts(spark, f"file://{tmp_path}/*", "x").collect()}
    assert kinds == {"run.json": "manifest"} and stages.artifact_kind("a/config_x.yaml") == "config" and stages.artifact_kind("a.PNG") == "figure"


def test_models_that_are_read_again_predict_the_same(spark, small_forests, tmp_path):
    rows = catalog(spark)
    fitted = characterise.train(rows, ["log_pl_orbper", "st_mass", "pl_eqt", "st_lum"])
    assert fitted.features == ["log_pl_orbper", "st_mass", "pl_eqt"]
    asked = rows.limit(9).drop("pl_rade", "pl_bmasse").withColumnRenamed("row_index", "candidate_id")
    fitted.save(f"file://{tmp_path}/models")
    again = characterise.Trained.load(spark, f"file://{tmp_path}/models")
    cols = ["candidate_id", "pl_rade_q05", "pl_rade_q50", "pl_rade_q95", "pl_bmasse_q50", "prob_jovian_size", "predicted_radius_class", "analog_n_analogs", "orbit_class"]
    one, two = (sorted(map(tuple, characterise.predict(asked, f, rows, 5).select(*cols).collect())) for f in (fitted, again))
    assert one == two and len(one) == 9 and all(r[1] <= r[2] <= r[3] and r[7] == 5 for r in one)
    with pytest.raises(FileNotFoundError):
        characterise.Trained.load(spark, f"file://{tmp_path}/nothing")


def test_ablation_goes_on_where_a_set_cannot_be_fitted(spark, small_forests):
    got = characterise.ablation(catalog(spark, 120), {"orbit": ["log_pl_orbper", "st_mass"], "none": ["st_lum"]}, "random").collect()
    assert {(r.experiment, r.warning != "") for r in got} == {("orbit", False), ("none", True)}


def test_a_run_that_is_cut_is_resumed(spark, tmp_path):
    ran, broken = [], [True]
    p = Pipeline()

    @p.stage("double")
    def double(ctx):
        ran.append("double")
        return {"doubled": ctx.tables["numbers"].selectExpr("k", "v * 2 AS v")}

    @p.stage("total")
    def total(ctx):
        ran.append("total")
        out = ctx.tables["doubled"].selectExpr("sum(v) AS total")
        if broken[0]:  # fails within a task, after the first table has been written
            return {"a": out, "b": out.selectExpr("assert_true(false, 'cut') AS x", "total")}
        return {"a": out}

    @p.stage("scaled")
    def scaled(ctx):
        ran.append("scaled")
        return {"scaled": ctx.tables["a"].selectExpr(f"total * {ctx.config['by']} AS t")}

    folder = f"file://{tmp_path}/stages"

    def run(by=3, values=(1, 2, 3), unused=0, version=""):
        ran.clear()
        numbers = spark.createDataFrame(list(enumerate(values)), "k int, v int")
        return run_resumable(p, Context(spark, {"by": by, "unused": unused}, {"numbers": numbers}), folder, version=version)

    with pytest.raises(Exception, match="cut"):
        run()
    assert ran == ["double", "total"] and not (tmp_path / "stages/total/manifest.json").exists()
    assert any(x.name.startswith("_attempt") for x in (tmp_path / "stages/total").iterdir())
    broken[0] = False
    got = run()
    assert ran == ["total", "scaled"] and got.tables["scaled"].first().t == 36
    assert [s["status"] for s in got.manifest["stages"]] == ["kept", "done", "done"]
    assert not any(x.name.startswith("_") for x in (tmp_path / "stages/total").iterdir())  # the cut attempt is gone
    got = run(unused=5)
    assert ran == [] and got.tables["scaled"].first().t == 36
    assert run(by=4).tables["scaled"].first().t == 48 and ran == ["scaled"]
    assert run(by=4, values=(3, 2, 2)).tables["scaled"].first().t == 56 and ran == ["double", "total", "scaled"]
    run(by=4, values=(3, 2, 2), version="2")
    assert len(ran) == 3


def test_content_goes_by_rows_and_not_by_their_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert content(df) == content(df.repartition(3).orderBy("v")) == content(df.select("k", "v"))
    assert len({content(x) for x in (df, df.distinct(), df.withColumnRenamed("v", "w"), df.limit(0), df.withColumn("v", df["k"].cast("string")))}) == 5


def test_the_engines_stages_are_kept(spark, tmp_path):
    rows = catalog(spark, 60)
    for want in ("done", "kept"):
        ctx = Context(spark, stages.DEFAULTS, {"catalog": rows})
        got = run_resumable(stages.standard(), ctx, f"file://{tmp_path}/s", ["feature_audit", "imputation", "system_missing_planets"])
        assert [s["status"] for s in got.manifest["stages"]] == [want] * 3 and got.tables["imputed"].count() == 60
