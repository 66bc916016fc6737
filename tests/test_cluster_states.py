import numpy as np

from taulab.operators.cluster import fitted_states, fleet_states, group_points, label_states, scale, silhouette


def fleet(spark):
    rng = np.random.default_rng(4)
    clean = rng.normal(size=(7, 4))
    rows, states = [], {}
    for cell in range(6):
        poisoned = clean.copy()
        if cell >= 2:  # cells 0 and 1 are clean, 4 and 5 are equal
            poisoned[cell % 4] += 3 if cell < 4 else 5
        if cell == 5:
            poisoned = states[4]
        states[cell] = poisoned
        rows += [(cell, f"c{i}", clean[i].tolist(), poisoned[i].tolist()) for i in range(7)]
    rows += [(9, f"c{i}", clean[i].tolist(), clean[i].tolist()) for i in range(3)]  # too few clients for three groups
    return spark.createDataFrame(rows, "cell long, client_id string, clean array<double>, poisoned array<double>"), clean, states


def test_equal_fleets_are_fitted_once_and_labels_are_those_of_each_cell(spark):
    rows, clean, states = fleet(spark)
    params = [(2, 3, 1), (3, 10, 42)]
    fleets = fleet_states(rows, ["cell"])
    distinct = {tuple(map(tuple, x)) for x in states.values()}
    fits = fitted_states(fleets, params).collect()
    # each distinct fleet by itself, each perturbed one by the clean scale; the three clients only with k = 2
    assert len(fits) == 2 * (2 * len(distinct) - 1) + 1
    got = {}
    for r in label_states(rows, ["cell"], params).collect():
        got.setdefault((r.cell, r.k), {})[r.client_id] = (r.label_clean, r.label_poisoned, r.label_frozen, r.silhouette_clean, r.silhouette_poisoned)
    assert set(got) == {(c, k) for c in range(6) for k in (2, 3)} | {(9, 2)}
    for (cell, k), labels in got.items():
        if cell == 9:
            continue
        n_init, seed = {2: (3, 1), 3: (10, 42)}[k]
        a, b, c = scale(clean, clean), scale(states[cell], states[cell]), scale(states[cell], clean)
        la, lb, lc = (group_points(x, k, n_init, 300, seed) for x in (a, b, c))
        assert labels == {f"c{i}": (la[i], lb[i], lc[i], silhouette(a, la), silhouette(b, lb)) for i in range(7)}
