from sylvaq.operators.stands import cluster_labels, cluster_regimes, mono_rate, site_regimes


def test_mono_rate(spark):
    data = [(1, 0.0, 0.0, "Acer"), (2, 25.0, 0.0, "Acer"), (3, 10.0, 0.0, None), (4, 12.0, 0.0, None), (5, 500.0, 0.0, "General_Conifer"), (6, 900.0, 0.0, "Tilia")]
    got = {r.id: (r.density, r.mono_rate) for r in mono_rate(spark.createDataFrame(data, "id bigint, x double, y double, name string"), 25.0).collect()}
    assert got[1] == (3, 1 / 3) and got[2] == (3, 1 / 3) and got[3] == (3, 0.0) and got[4] == (3, 0.0)
    assert got[5][0] == 0 and abs(got[5][1] - (2 / 3) / 4) < 1e-12  # the mean of the four others with neighbours
    assert got[6] == (0, 0.0)


def test_regimes(spark):
    rows = []
    for label, names in enumerate((["Acer"] * 7 + ["Tilia"] * 3, ["Acer"] * 8 + ["Tilia"] * 2, ["General_Conifer"] * 9, [None] * 4, ["Acer", "Tilia", "Ulmus", "Alnus"], ["Acer"] * 3 + ["Tilia"] * 3 + ["Ulmus"] * 2 + ["Alnus", "Pinus"])):
        rows += [(label, n) for n in names]
    rows += [(-1, "Acer")] * 3
    got = {r.label: r.regime for r in cluster_regimes(spark.createDataFrame(rows, "label bigint, name string")).collect()}
    assert got == {0: "Intermediate", 1: "Monoculture", 2: "Unknown", 3: "Unknown", 4: "Mixed", 5: "Intermediate"}


def test_labels(spark):
    pts = [(100 - i, 10.0 * (i % 3), 0.0) for i in range(12)] + [(i, 5000.0, 10.0 * (i % 3)) for i in range(12)] + [(500, 9000.0, 0.0)]
    sites = spark.createDataFrame([(*p, "Acer") for p in pts], "id bigint, x double, y double, name string")
    labels = cluster_labels(sites, 25.0, 10)
    got = {r.id: r.label for r in labels.collect()}
    assert {got[i] for i in range(12)} == {0} and {got[100 - i] for i in range(12)} == {1} and got[500] == -1
    regimes = cluster_regimes(labels.join(sites.select("id", "name"), "id"))
    assert {r.regime for r in site_regimes(sites, labels, regimes).collect()} == {"Monoculture", "Sparse"}
