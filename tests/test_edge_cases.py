"""The remaining hand-made cases of FIXTURES.md: null label, all
predictions one class, unseen category, phrase longer than the essay."""

from pyspark.sql import functions as F

from gradeflow.operators import categorical as CT
from gradeflow.operators import lexicon as L
from gradeflow.operators import metrics as M
from gradeflow.operators import stats as G


def test_null_label_and_one_predicted_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, 1)], "label int, pred int")
    assert G.count_classes(df, "label").first()["n_classes"] == 3  # null is not a class
    one = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "label int, pred int")
    cs = M.classification_scores(one).first()
    assert cs["mcc"] == 0.0  # zero denominator
    assar = M.qwk(one).first()["qwk"]
    assert assar == 0.0  # all predictions one class: kappa 0


def test_unseen_category(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    val = spark.createDataFrame([(3, "c")], "id int, v string")
    oh = CT.one_hot(val, ["v"], fit_on=train).first()
    assert oh["v_a"] == 0 and oh["v_b"] == 0
    le = CT.label_encode(val, ["v"], fit_on=train).first()
    assert le["v_label"] is None


def test_phrase_longer_than_essay(spark):
    essays = spark.createDataFrame([(1, "short text", "x"), (2, "short text", "y")], "essay_id long, essay string, essay_set string")
    phrases = spark.createDataFrame([(7, "short text that is much longer", "x"), (8, "short text", "x")], "key_id long, phrase string, essay_set string")
    got = L.phrase_presence(essays, phrases).collect()
    assert {tuple(r) for r in got} == {(1, 7, 0), (1, 8, 1)}
