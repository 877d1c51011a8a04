"""Golden values: the published per-group AUCs and confusion matrices fed
to the power-mean, final-metric and rate operators reproduce the published
final metrics and overall rates to the printed precision."""

import pytest

from equitext.operators import metrics as M

# Published per-group (subgroup AUC, BNSP AUC, BPSN AUC), nine groups in
# order, and the overall AUC and final metric, for six configurations.
GOLDEN = {
    "bag of words": (0.887, 0.834, [
        (0.771, 0.907, 0.697), (0.858, 0.793, 0.906), (0.847, 0.842, 0.864),
        (0.765, 0.865, 0.757), (0.819, 0.815, 0.857), (0.843, 0.872, 0.830),
        (0.794, 0.863, 0.796), (0.853, 0.865, 0.849), (0.782, 0.921, 0.688)]),
    "mean vectors": (0.837, 0.802, [
        (0.756, 0.846, 0.721), (0.827, 0.751, 0.875), (0.801, 0.820, 0.802),
        (0.754, 0.794, 0.788), (0.800, 0.812, 0.806), (0.790, 0.863, 0.742),
        (0.778, 0.816, 0.784), (0.835, 0.832, 0.819), (0.751, 0.866, 0.690)]),
    "v90 group rows": (0.812, 0.784, [
        (0.756, 0.843, 0.702), (0.825, 0.689, 0.899), (0.792, 0.765, 0.828),
        (0.738, 0.751, 0.799), (0.791, 0.778, 0.815), (0.785, 0.806, 0.785),
        (0.760, 0.791, 0.777), (0.788, 0.800, 0.788), (0.744, 0.846, 0.690)]),
    "v91 group rows": (0.783, 0.757, [
        (0.734, 0.819, 0.682), (0.803, 0.633, 0.897), (0.767, 0.736, 0.805),
        (0.713, 0.711, 0.787), (0.773, 0.746, 0.801), (0.761, 0.771, 0.770),
        (0.734, 0.765, 0.752), (0.754, 0.772, 0.756), (0.721, 0.809, 0.687)]),
    "v90 full train": (0.829, 0.784, [
        (0.751, 0.831, 0.724), (0.812, 0.647, 0.915), (0.786, 0.777, 0.820),
        (0.724, 0.704, 0.836), (0.793, 0.764, 0.833), (0.779, 0.835, 0.755),
        (0.756, 0.770, 0.803), (0.806, 0.829, 0.776), (0.742, 0.852, 0.688)]),
    "v91 full train": (0.825, 0.777, [
        (0.744, 0.810, 0.738), (0.801, 0.617, 0.917), (0.779, 0.760, 0.822),
        (0.711, 0.673, 0.844), (0.785, 0.740, 0.840), (0.772, 0.819, 0.759),
        (0.745, 0.742, 0.813), (0.801, 0.827, 0.765), (0.736, 0.832, 0.704)]),
}

# Published overall [[TP, FP], [FN, TN]] with accuracy, acceptance, TPR, TNR.
MATRICES = [
    ((7219, 1749, 26099, 328937), 0.923495, 2.464, 21.667, 99.471),
    ((4264, 3239, 29054, 327447), 0.911284, 2.061, 12.798, 99.021),
    ((5770, 7367, 27548, 323319), 0.904081, 3.609, 17.318, 97.772),
    ((3249, 4337, 30069, 326349), 0.905479, 2.084, 9.751, 98.688),
    ((3531, 2587, 29787, 328099), 0.911061, 1.681, 10.598, 99.218),
    ((3278, 2359, 30040, 328327), 0.910993, 1.549, 9.839, 99.287),
]


@pytest.mark.parametrize("config", sorted(GOLDEN))
def test_final_metric(spark, config):
    overall, final, rows = GOLDEN[config]
    bias = spark.createDataFrame(
        [(f"g{i}", s, bnsp, bpsn) for i, (s, bnsp, bpsn) in enumerate(rows)],
        "subgroup string, subgroup_auc double, bnsp_auc double, bpsn_auc double",
    )
    o = spark.createDataFrame([(overall,)], "auc double")
    got = M.final_metric(o, bias).first()["final_metric"]
    assert abs(got - final) <= 0.001, (config, got)


@pytest.mark.parametrize("m", MATRICES)
def test_overall_rates(spark, m):
    (tp, fp, fn, tn), acc, accept, tpr, tnr = m
    c = spark.createDataFrame([(tp + fp + fn + tn, tp, fp, fn, tn)], "n long, tp long, fp long, fn long, tn long")
    r = M.with_rates(c).first()
    assert abs(r["accuracy"] - acc) < 1e-6
    assert abs(r["acceptance_rate"] - accept) < 1e-3
    assert abs(r["tpr"] - tpr) < 1e-3
    assert abs(r["tnr"] - tnr) < 1e-3


# Published per-group [[TP, FP], [FN, TN]] with acceptance, TPR and TNR (%),
# bag-of-words configuration, nine groups in order.
GROUP_MATRICES = [
    ((328, 218, 1050, 4650), 8.742, 23.803, 95.522),
    ((137, 101, 799, 12483), 1.760, 14.637, 99.197),
    ((406, 224, 1583, 18563), 3.032, 20.412, 98.808),
    ((146, 105, 731, 3468), 5.640, 16.648, 97.061),
    ((72, 47, 300, 2789), 3.709, 19.355, 98.343),
    ((392, 233, 1553, 15730), 3.490, 20.154, 98.540),
    ((235, 154, 988, 6450), 4.970, 19.215, 97.668),
    ((34, 11, 172, 1146), 3.302, 16.505, 99.049),
    ((475, 296, 1555, 7918), 7.526, 23.399, 96.396),
]


def test_group_rates(spark):
    rows = [(f"g{i}", sum(m), *m) for i, (m, *_r) in enumerate(GROUP_MATRICES)]
    c = spark.createDataFrame(rows, "subgroup string, n long, tp long, fp long, fn long, tn long")
    got = {r["subgroup"]: r for r in M.with_rates(c).collect()}
    for i, (_m, accept, tpr, tnr) in enumerate(GROUP_MATRICES):
        r = got[f"g{i}"]
        assert abs(r["acceptance_rate"] - accept) < 1e-3
        assert abs(r["tpr"] - tpr) < 1e-3
        assert abs(r["tnr"] - tnr) < 1e-3
