import numpy as np

from kinfold.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_triples():
    tri, at = langid.triples(["ab", "", "a1b", "x"])
    edge = lambda *c: c[0] << 12 | c[1] << 6 | c[2]
    assert tri.tolist() == [edge(0, 1, 2), edge(1, 2, 0), edge(0, 1, 0), edge(1, 0, 2), edge(0, 2, 0), edge(0, 24, 0)]
    assert at.tolist() == [0, 2, 2, 5, 6]


def test_score_is_the_cosine_of_the_bundles(spark):
    docs = spark.createDataFrame([(1, "aa", "the cat sat"), (2, "bb", "der hund und")], "doc_id long, lang string, text string")
    model = langid.fit(docs)
    letters = np.random.default_rng(langid.SEED).integers(0, 2, (64, langid.DIM), dtype=np.int8) * 2 - 1
    vector = lambda t: sum((np.roll(letters[x >> 12], 2) * np.roll(letters[x >> 6 & 63], 1) * letters[x & 63]).astype(float) for x in langid.triples([t])[0].tolist())
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    texts = ["the hund", "", "the the the cat", "12", "und der und", "x " * 3000]
    names, scores, size = model.predict(texts)
    for text, name, score, n in zip(texts, names, scores, size):
        want = [cosine(vector(text), vector(x)) for x in ("the cat sat", "der hund und")] if n else [0, 0]
        assert abs(score - max(0, *want)) < 1e-6 and name == (["aa", "bb"][int(np.argmax(want))] if n else "und")


def test_many_languages(spark):
    rows = [(i, f"l{i:03d}", " ".join(chr(97 + (i * k) % 26) * 2 + chr(97 + i // 26) + chr(97 + k) for k in range(1, 9))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert len(model.languages) == 200
    names, scores, _ = model.predict([t for _, _, t in rows])
    assert sum(n == lang for n, (_, lang, _) in zip(names, rows)) >= 198 and scores.min() > 0.99


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "the and of that with", "en"), (5, "der die und nicht ein", "de"), (4, "the and of that with", "en"), (6, "the " * 50_000, None), (None, "und der", "de"), (7, "日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as held_out", "lang as score", "lang as tri")
    got = langid.identify(df).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert langid.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
