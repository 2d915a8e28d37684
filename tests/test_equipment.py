"""The record beside a protocol, refusals, custom steps by name."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters
from pulsegrid.plans.equipment import AMP_REFERENCE, Amplifier, Declaration, Feedback, declared, read_declaration, reference
from pulsegrid.plans.protocol import Protocol
from pulsegrid.plans.requirements import RequirementError

AMP = Amplifier("amp", ("Cz", "Fz"), (250.0,), "linked_ears", impedance=True, markers=("start",))
LAYER = Feedback("approach", "layer", "audio_gain", "approach", "Approach", times=(("attack", 4000), ("release", 8000)))
EVENT = Feedback("crossing", "event", "audio_chime", "crossing", "Crossing", 20, times=(("rearm", 3000), ("min_interval", 20000)))
OUTPUTS = {"audio_gain": "analog", "audio_chime": "event"}


def test_amplifier_reference():
    assert reference(AMP_REFERENCE, AMP) == "linked_ears" and reference("Fz", None) == "Fz"
    assert reference(AMP_REFERENCE, Amplifier("x", ("Cz",), reference="Cz")) == "Cz"
    for bad in (None, Amplifier("x"), Amplifier("x", reference="moon")):
        with pytest.raises(RequirementError):
            reference(AMP_REFERENCE, bad)


def test_declaration_is_checked():
    d = Declaration(AMP, (LAYER, EVENT), 5.0, ("start",), {"title": "t"})
    assert d.check(OUTPUTS) is d
    wrong = [
        Declaration(feedback=(LAYER, LAYER)), Declaration(feedback=(Feedback("a", "layer", "audio_chime", "r", "l"),)), Declaration(feedback=(Feedback("a", "movie", "audio_gain", "r", "l"),)),
        Declaration(feedback=(Feedback("a", "layer", "audio_gain", "r", "l", times=(("rearm", 1),)),)), Declaration(AMP, markers=("stop",)), Declaration(Amplifier("x"), impedance=5.0), Declaration(impedance=0.0), Declaration(feedback=(Feedback("a", "event", "nothing", "r", "l"),)),
    ]
    for w in wrong:
        with pytest.raises(RequirementError):
            w.check(OUTPUTS)


def test_amending_keeps_other_entries():
    quick = Feedback("approach", "layer", "audio_gain", "approach", "Approach", times=(("attack", 2000),))
    d = Declaration(feedback=(LAYER, EVENT)).amended(quick, Feedback("new", "event", "audio_chime", "r", "l"))
    assert [f.name for f in d.feedback] == ["approach", "crossing", "new"] and d.feedback[0].times == (("attack", 2000),) and d.feedback[1] == EVENT


def test_declaration_travels_with_the_rows(spark, tmp_path):
    rows = spark.range(3).select(F.lit("audio_gain").alias("channel"), F.col("id").alias("value"))
    out = declared(rows, Declaration(AMP, (LAYER, EVENT), 5.0, meta={"title": "t"}), OUTPUTS)
    out.write.parquet(str(tmp_path / "o"))
    got = read_declaration(spark.read.parquet(str(tmp_path / "o")))
    assert got["amp"]["reference"] == "linked_ears" and [f["name"] for f in got["feedback"]] == ["approach", "crossing"] and got["impedance"] == 5.0 and got["meta"] == {"title": "t"}
    assert read_declaration(rows) is None


def test_refused_hilbert():
    with pytest.raises(NotImplementedError, match="all-pass"):
        filters.hilbert_taps(65, "iir_allpass")
    with pytest.raises(ValueError):
        filters.hilbert_taps(65, "magic")


def test_unknown_custom_step():
    with pytest.raises(KeyError, match="nothing_like_it"):
        Protocol(16.0, 8).custom("nothing_like_it", "y", "x")
