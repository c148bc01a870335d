import numpy as np
import pytest

from purlin.operators import anomaly, federation

EYE = [[1.0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]


def meta(**more):
    return {"unit_scale_to_metre": 1.0, "project_guids": ["p"], "contexts": [{"wcs": EYE}], **more}


def moved(x):
    return [r[:3] + [r[3] + (x if i == 0 else 0)] for i, r in enumerate(EYE)]


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ([], (False, "empty", None)),
        ([meta()], (True, "single_model", None)),
        ([meta(), None], (False, "missing_coordinate_metadata", None)),
        ([meta(), {"project_guids": ["p"]}], (False, "invalid_coordinate_metadata", None)),
        ([meta(), meta(unit_scale_to_metre=0.001)], (False, "unit_mismatch", None)),
        ([meta(contexts=[{"wcs": EYE}, {"wcs": moved(5)}]), meta()], (False, "ambiguous_coordinate_frame", None)),
        ([meta(), meta(contexts=[{"wcs": moved(5)}])], (False, "coordinate_frame_mismatch", None)),
        ([meta(contexts=[{"wcs": EYE, "true_north": [0, 1]}]), meta(contexts=[{"wcs": EYE, "true_north": [1, 0]}])], (False, "true_north_mismatch", None)),
        ([meta(map_conversions=[{"e": 1}]), meta(map_conversions=[{"e": 2}])], (False, "map_conversion_mismatch", None)),
        ([meta(sites=[{"placement": EYE}]), meta(sites=[{"placement": moved(1)}])], (False, "spatial_placement_mismatch", None)),
        ([meta(sites=[{"placement": EYE}]), meta(sites=[{"placement": moved(0.005)}])], (True, "verified", "shared_project_guid")),
        ([meta(), meta(project_guids=["q"])], (False, "unverified_alignment", None)),
        ([meta(buildings=[{"guid": "b"}]), meta(project_guids=["q"], buildings=[{"guid": "b"}])], (True, "verified", "shared_building_guid")),
        ([meta(projects=[{"name": "King-St"}], buildings=[{"name": "A"}]), meta(project_guids=[], projects=[{"long_name": "king st"}], buildings=[{"name": "a"}])], (True, "verified", "shared_project_and_building_identity")),
    ],
)
def test_federation(files, want):
    assert federation.verdict(files) == want


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(1)
    n, f, h, k = 7, 3, 4, 2
    x = rng.normal(size=(n, f))
    edges = [(0, 1), (1, 2), (1, 2), (3, 4), (5, 5)]
    negative = [(0, 4), (2, 6)]
    layer = lambda o, i: (rng.normal(size=(o, i)), rng.normal(size=o))
    w = anomaly.Weights(layer(h, f), layer(k, h), layer(h, k), layer(f, h))
    a = np.eye(n)
    for i, j in edges:
        a[i, j] += 1
        a[j, i] += 1
    d = a.sum(1)
    a /= np.sqrt(np.outer(d, d))
    z = a @ (np.maximum(a @ (x @ w.conv1[0].T + w.conv1[1]), 0) @ w.conv2[0].T + w.conv2[1])
    back = np.maximum(z @ w.dec1[0].T + w.dec1[1], 0) @ w.dec2[0].T + w.dec2[1]
    feature = ((back - x) ** 2).mean(1)
    total, count = np.zeros(n), np.zeros(n)
    for pairs, y in ((edges, 1), (negative, 0)):
        for i, j in pairs:
            s = z[i] @ z[j] / np.sqrt(k)
            loss = np.log1p(np.exp(-s)) if y else np.log1p(np.exp(s))
            for e in (i, j):
                total[e] += loss
                count[e] += 1
    want = 0.7 * feature + 0.3 * total / np.maximum(count, 1)
    nodes = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, f0 double, f1 double, f2 double")
    as_frame = lambda rows: spark.createDataFrame(rows, "source_id long, target_id long")
    got = {r.id: r.score for r in anomaly.scores(nodes, as_frame(edges), ["f0", "f1", "f2"], w, as_frame(negative)).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist())
    drawn = anomaly.non_edges(nodes, as_frame(edges), 30).collect()
    assert drawn and not {(r.source_id, r.target_id) for r in drawn} & {p for i, j in edges for p in ((i, j), (j, i))}
