"""Training and rules cover whole texts, all tokens and all labels."""

import numpy as np

from callatlas.llm import quality, toxicity, url_filter


def test_chain_learns_from_long_documents(spark):
    filler = " ".join(f"plain{k % 40}" for k in range(3000))
    docs = [(i, f"{filler} vile{i % 2} {filler}" if i % 2 == 0 else filler) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert model.chain.weights[b"w:vile0"] > 0


def test_training_in_lanes_agrees_with_whole_sequences(monkeypatch):
    rng = np.random.default_rng(2)
    docs = []
    for k, n in enumerate((5000, 2600, 900, 40)):
        places = sorted(rng.choice(n, n // 10, replace=False).tolist())
        docs.append((k % 2, n, places, [[p % 3] for p in places]))
    names = [b"x", b"y", b"z"]
    monkeypatch.setattr(toxicity, "LANE", 500)
    lanes = toxicity.train_chain(docs, names)
    monkeypatch.setattr(toxicity, "LANE", 10_000)
    whole = toxicity.train_chain(docs, names)
    assert np.allclose([*lanes.weights.values(), lanes.bias, lanes.start, *lanes.steps], [*whole.weights.values(), whole.bias, whole.start, *whole.steps], atol=1e-6)


def test_rules_of_more_than_400_tokens(spark):
    rows = [([f"path=t{k % 450}"], True) for k in range(5400)] + [(["path=other"], False)] * 5400 + [(["path=mid"], k < 27) for k in range(30)]
    rules = {tuple(r.antecedent) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.0005).collect()}
    assert ("path=mid",) in rules and len(rules) == 451


def test_host_labels_over_many_sites(spark):
    pages = spark.createDataFrame([(k, f"http://{'casino' if k % 2 else 'fine'}.s{k}.net/{k}") for k in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(150)], "page_id long, bad boolean")
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in url_filter.judge(pages, labels).collect())


def test_sites_count_every_label(spark):
    docs = spark.createDataFrame([(k, "t", "en", "a") for k in range(100)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    assert [r.n for r in quality.site_posteriors(docs, labels).collect()] == [100]
