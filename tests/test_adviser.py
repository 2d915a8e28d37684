"""Lineage of controls, and advice over several of them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.plans.adviser import REASONS, Adviser, Policy, Rules, advise
from pulsegrid.plans.advisor import Knob, Ledger
from pulsegrid.plans.lineage import Check, Lineage


def protocol():
    g = Lineage().control("t_pct", "percent").control("xover").control("emg_pct", "percent").control("tau", "duration", live=False)
    g.kernel(K.Smooth("x", "env", 0.5, 16, "tau")).stream("ratio", "env", "other")
    g.threshold("thr", "percentile", "t_pct", "env").threshold("emg", "percentile", "emg_pct", "noise")
    return g.check("loud", "above", "env", "thr").check("cross", "below", "ratio", "xover").inhibit("emg", "noise", "emg")


def test_report():
    r = protocol().report()
    assert r["bundles"][""]["combine"] == "all"
    loud, cross = r["bundles"][""]["checks"]
    assert (loud["knob"], loud["higher_is"], loud["controls"]) == ("t_pct", "harder", ["t_pct", "tau"])
    assert (cross["knob"], cross["higher_is"], cross["controls"]) == ("xover", "easier", ["tau", "xover"])
    assert r["check_controls"] == ["t_pct", "tau", "xover"] and r["inhibit_controls"] == ["emg_pct"]


def test_what_is_ambiguous_has_no_knob():
    g = protocol().control("k", "boolean").control("dead", live=False).stream("s", "xover")
    assert g.trace(Check("above", "env", None, ("t_pct", "xover"))) is None
    assert g.trace(Check("above", "env", "k")) is None and g.trace(Check("above", "env", "dead")) is None
    assert g.trace(Check("inside", "env", "thr")) is None and g.trace(Check("above", "env", "nothing")) is None
    g.threshold("two", "percentile", "t_pct", "s").threshold("auto", "range", "t_pct")
    assert g.trace(Check("above", "env", "two")) is None and g.trace(Check("above", "env", "auto")) is None
    assert g.trace(Check("at_or_above", "env", "xover")) == ("xover", "harder")
    g.stream("a", "b").stream("b", "a", "xover")
    assert g.feeds("a") == {"xover"}


def rows(n, rates, guards=None, **more):
    """Chunks of 10 clean training samples in which checks pass so often."""
    base = {"n": np.full(n, 10.0), "act": np.full(n, math.nan), "n_train": np.full(n, 10.0), "n_clean": np.full(n, 10.0), "emg_n": np.full(n, guards or 0.0)}
    for name, r in rates.items():
        base[f"{name}_n"] = np.asarray(r, float) * 10
    base["n_cond"] = np.min([base[f"{name}_n"] for name in rates], 0)
    return base | {k: np.asarray(v) for k, v in more.items()}


def run(policies, checks, rules, c):
    k = Adviser(policies, checks, ["emg"], rules)
    c = {f"manual_{p}": np.full(len(c["n"]), math.nan) for p in policies} | c
    return k.step({i: c[i] for i in k.inputs})


RULES = Rules(watch=20, between=30, settle=20)
TWO = {"floor": Policy("loud", 20.0, 10.0, 40.0, step=2.5), "ceiling": Policy("calm", 100.0, 50.0, 200.0, "proportional", 0.1, 5.0, harder_is_up=False)}


def test_the_limiting_check_moves_its_control():
    out = run(TWO, ["loud", "calm"], RULES, rows(6, {"loud": [0.9] * 6, "calm": [0.2] * 6}))
    assert [REASONS[int(r)] for r in out["reason"]] == ["collecting"] + ["too_strict"] * 5
    assert out["limiter"][1] == 1 and out["control"][1] == 1 and out["proposed"][1] == 110.0 and out["suggested"].tolist() == [False, True] + [False] * 4
    out = run(TWO, ["loud", "calm"], RULES, rows(3, {"loud": [0.9] * 3, "calm": [1.0] * 3}))
    assert out["control"][2] == 1 and out["proposed"][2] == 90.0  # the highest rate is tightened
    out = run(TWO, ["loud", "calm"], Rules(20, 30, 20, tighten_first=("loud",)), rows(3, {"loud": [0.9] * 3, "calm": [1.0] * 3}))
    assert out["control"][2] == 0 and out["proposed"][2] == 22.5


def test_no_knob_and_limits():
    out = run({"floor": TWO["floor"]}, ["loud", "calm"], RULES, rows(3, {"loud": [0.9] * 3, "calm": [0.2] * 3}))
    assert REASONS[int(out["reason"][2])] == "no_knob" and out["limiter"][2] == 1 and math.isnan(out["proposed"][2])
    out = run({"floor": Policy("loud", 10.0, 10.0, 40.0, step=2.5)}, ["loud"], RULES, rows(3, {"loud": [0.1] * 3}))
    assert REASONS[int(out["reason"][2])] == "at_limit"


def test_rebaseline_is_a_percentile_of_recent_values():
    p = {"thr": Policy("loud", 9.0, 0.0, 50.0, "rebaseline", window=20, pct=50.0, harder_is_up=True)}
    low = np.empty(4, object)
    low[:] = [np.arange(10.0)] * 4
    out = run(p, ["loud"], RULES, rows(4, {"loud": [0.1] * 4}, values_thr=low))
    assert REASONS[int(out["reason"][2])] == "too_strict" and out["proposed"][2] == 4.5
    high = np.empty(4, object)
    high[:] = [np.arange(10.0) + 40] * 4  # would make it harder, so nothing is suggested
    out = run(p, ["loud"], RULES, rows(4, {"loud": [0.1] * 4}, values_thr=high))
    assert REASONS[int(out["reason"][2])] == "at_limit"


def test_applied_change_that_overshoots_is_advised_back():
    c = rows(8, {"loud": [0.1, 0.1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]}, act=[math.nan, math.nan, 1.0] + [math.nan] * 5)
    out = run({"floor": TWO["floor"]}, ["loud"], RULES, c)
    assert out["applied"].tolist() == [False, False, True] + [False] * 5 and out["value_floor"].tolist() == [20.0, 20.0] + [17.5] * 6
    assert REASONS[int(out["reason"][3])] == "reversal" and out["proposed"][3] == 20.0


@pytest.mark.parametrize("seed", range(4))
def test_one_fixed_knob_is_the_ledger(seed):
    """With one control and one check both give the same reasons, values and events."""
    rng = np.random.default_rng(seed)
    n = 300
    c = rows(n, {"loud": rng.integers(0, 11, n) / 10}, act=rng.choice([math.nan] * 6 + [1.0, 2.0, 3.0], n))
    c["emg_n"] = rng.choice([0.0, 0.0, 0.0, 9.0], n)
    c["n_train"] = np.where(rng.random(n) < 0.1, 0.0, 10.0)
    manual = np.where(rng.random(n) < 0.03, 25.0, math.nan)
    old = Ledger(Knob(20.0, 2.5, 10.0, 40.0, 20, 30, 20), ["emg"]).step({**{k: c[k] for k in ("n", "n_train", "n_clean", "n_cond", "act", "emg_n")}, "manual": manual})
    new = run({"floor": TWO["floor"]}, ["loud"], RULES, c | {"manual_floor": manual})
    assert old["reason"].tolist() == new["reason"].tolist() and old["value"].tolist() == new["value_floor"].tolist()
    for e in ("applied", "dismissed", "suggested", "superseded", "blocked", "changed_manually", "equipment_change"):
        assert old[e].tolist() == new[e].tolist(), e


def test_advise_on_samples(spark):
    s = spark.range(400).select(F.lit(1).alias("session_id"), F.col("id").alias("sample_idx"), F.floor(F.col("id") / 10).alias("chunk_id"), (F.col("id") % 10).cast("double").alias("x"))
    got = advise(s, F.lit(True), F.lit(False), {"loud": F.col("x") > 8}, {"emg": F.lit(False)}, {"thr": Policy("loud", 8.0, 0.0, 9.0, "rebaseline", window=20, pct=50.0)}, RULES, {"thr": F.col("x")}).orderBy("chunk_id").collect()
    assert [r.reason for r in got[:2]] == ["collecting", "too_strict"] and got[1].control == "thr" and got[1].limiter == "loud" and got[1].proposed == 4.5 and got[1].told == ["suggested"]
