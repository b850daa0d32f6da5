"""Each stage on its own input against a plain version, and the whole run."""

import random
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from kinfold.llm import langid
from kinfold.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    kept = {}
    for name, stage in P.STAGES[:-1]:
        now = materialize(stage(spark, now, SF), name)
        assert now.columns == columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert len(kept["language_id"]) >= 0.97 * docs.count()
    assert set(kept["minhash_near_dedup"]) < set(kept["language_id"])
    assert set(kept["suffix_array_dedup"]) == set(kept["minhash_near_dedup"]) == set(kept["mixing"])
    seen = {}
    for i in sorted(kept["minhash_near_dedup"]):
        raw = kept["minhash_near_dedup"][i].text.encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen.setdefault(raw[k : k + 50], i) < i:
                mark[k : k + 50] = b"\1" * 50
        want = bytes(x for x, m in zip(raw, mark) if not m).decode("utf-8", "ignore")
        assert kept["suffix_array_dedup"][i].text == want and kept["suffix_array_dedup"][i].n_chars == len(want)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = P.run(spark, SF).collect()
    assert {r.doc_id for r in last} == set(kept["mixing"])
    assert all(r.ids == lib.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in last)
    assert len({(r.mix_file, r.mix_row) for r in last}) == len(last)


def test_language_stage_rejects_texts_without_language(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "a", 19), (2, "12345 ###", "en", "a", 9), (3, None, None, "a", 0), (4, "der hund und die katze", "de", "b", 22), (5, "and the dog", "en", None, 11)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(langid.held_out(docs).where("not held_out"))
    assert model.languages
    assert {r.doc_id for r in P.language(spark, docs, SF).collect()} == {1, 4, 5}


def test_empty_table(spark):
    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        now = materialize(stage(spark, now, SF), name)
    assert now.count() == 0


def test_near_dedup_keeps_what_brute_force_keeps_at_080(spark):
    r = random.Random(8)
    texts = []
    for _ in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 140))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3):
            near = list(words)
            for at in r.sample(range(len(near)), edits):
                near[at] = f"n{r.randrange(5000)}"
            texts.append(" ".join(near))
    r.shuffle(texts)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(t.split() for t in texts)}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), s in share.items():
        if s >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert sum(0.8 <= s < 0.85 for s in share.values()) > 5
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in P.near_dedup(spark, docs, SF).collect()} == {i for i in sets if find(i) == i}


def test_short_texts_stay_and_long_gibberish_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(6)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n)) for n in (300, 1000, 4000) for _ in range(20)]
    short = docs.where("lang = 'en'").limit(50).collect()
    words = [w for d in short for w in d.text.split()[:3] if w.isalpha() and w.isascii() and len(w) > 2]
    more = [(10**6 + i, t, None, "a", len(t)) for i, t in enumerate(noise)] + [(2 * 10**6 + i, t, None, "a", len(t)) for i, t in enumerate(words)]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {x.doc_id for x in P.language(spark, both, SF).collect()}
    clean = {x.doc_id for x in docs.collect()}
    assert len(clean - kept) <= 0.005 * len(clean)
    assert sum(2 * 10**6 + i in kept for i in range(len(words))) > 0.95 * len(words)
    assert sum(10**6 + i in kept for i in range(len(noise))) <= 0.05 * len(noise)


def test_stages_on_nulls_repeats_long_texts_and_clashing_columns(spark):
    base = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = [tuple(x.values()) for x in base] + [tuple(base[0].values())] * 2
    rows += [(None, base[1]["text"], "en", "a", 1), (9001, None, None, None, None), (9002, "", "en", "b", 0), (9003, "the of and " + base[2]["text"] * 200, "en", None, 5), (9004, "the and of", None, "b", 3)]
    clash = ["ids", "n_tokens", "mix_file", "mix_row", "score", "lang_pred", "slot", "row", "spans", "doc", "mark", "unit", "told", "h", "key", "bucket", "text_"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) AS `{c}`" for c in clash])
    docs = docs.withColumnRenamed("text_", "a.b")
    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, materialize(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        assert all(r["a.b"] == f"text_{r.doc_id or 0}" and r.score == f"score{r.doc_id or 0}" for r in now.collect())
        assert now.count() <= before.count() if name in ("language_id", "minhash_near_dedup") else now.count() == before.count()
    last = P.encode(spark, now, SF).collect()
    assert {"ids", "n_tokens", "mix_file", "mix_row", "ids_", "n_tokens_", "mix_file_", "mix_row_"} <= set(last[0].asDict())
    assert all(r.ids_ == f"ids{r.doc_id or 0}" and r.n_tokens == len(r.ids) for r in last)
    assert sum(r.doc_id == base[0]["doc_id"] for r in last) == 3 and not {9001, 9002} & {r.doc_id for r in last}
