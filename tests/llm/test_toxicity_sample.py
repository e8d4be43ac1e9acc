from veilspan.llm import toxicity


def test_long_texts_are_passed_over_and_no_class_is_left_empty(spark, monkeypatch):
    texts = {k: ("mild " if k % 2 else "rude ") * (400 if k < 60 else 5) + str(k) for k in range(70)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda t, y: seen.append(sorted(zip(t, y))))
    toxicity.fit(docs, labels, sample_chars=2000)
    assert seen.pop() == sorted((texts[k].encode(), k % 2) for k in range(60, 70))
    toxicity.fit(docs, labels, sample_chars=20)
    assert sorted(y for _, y in seen.pop()) == [0, 1]
