"""Problem 9 counts its words and fits its trees over all documents, in any number of parts."""

from __future__ import annotations

import random

import numpy as np

from lexiloom.llm import personal
from lexiloom.llm.boosting import Boosted


def texts(n):
    rnd = random.Random(9)
    for i in range(n):
        name = f"{rnd.choice(['Linnea', 'Rowan', 'Tessa'])} {rnd.choice(['Talwick', 'Norrick'])}"
        yield rnd.choice([f"My name is {name} and I lost my account.", f"SĐT: 0125-881-{i:04d}", f"Mã đơn {rnd.randrange(10**9, 10**10)} đã khóa.", f"write to {name.split()[0].lower()}@thuxa.test", f"Address: {i} Larkspur Bend Lane, Port Ellery", "Ta là Hồng Lôi, người giữ cửa."])


def test_names_and_models_of_all_documents(spark, tmp_path):
    every = [*texts(9000)]
    folders = [f"{tmp_path}/{k}" for k in (1, 3)]
    for folder, parts in zip(folders, (1, 3), strict=True):
        spark.createDataFrame([*enumerate(every), (-1, None), (None, "call 555-0142")], "doc_id long, text string").repartition(parts).write.parquet(f"{folder}/documents.parquet")
    a, b = (personal.finder(spark, folder) for folder in folders)
    assert sum(a.names.first.values()) == sum(t.startswith("My name") for t in every)
    local = personal.Finder([*every, "call 555-0142"])
    for kind in personal.KINDS:
        assert a.models[kind].trees == b.models[kind].trees == local.models[kind].trees
        assert a.models[kind].threshold == b.models[kind].threshold == local.models[kind].threshold
    assert any(m.trees for m in a.models.values())
    found = personal.p9_found(spark, folders[1]).collect()
    assert {(r.doc_id, r.kind, r.occ_no) for r in found} == {(i, kind, 1) for i, places in enumerate(local(every)) for kind, _, _ in places}


def test_rows_with_weights_are_equal_rows():
    rnd = np.random.default_rng(3)
    x, n = rnd.integers(0, 400, (300, 3)).astype(float), rnd.integers(1, 5, 300)
    y, held = (x[:, 1] > 170).astype(float), np.arange(300) % 5 == 0
    from lexiloom.llm.boosting import together

    a, b = Boosted(), Boosted().fit(np.repeat(x, n, axis=0), np.repeat(y, n), np.repeat(held, n))
    together([a.steps(x, y, n.astype(float), held)])
    assert a.trees == b.trees and a.threshold == b.threshold
