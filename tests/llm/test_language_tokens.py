"""Language ID, SentencePiece and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfolk.llm import language_viterbi as lid
from kinfolk.llm import sentencepiece_nbest as sp

EN = "the weather this morning is rather cold and they should bring other things with them".split()
DE = "das Wetter heute ist schön und wir gehen zusammen nach Hause über die große Straße".split()
RU = "погода сегодня хорошая и мы пойдём гулять по большой улице вместе".split()


def documents(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        lang, words = (("en", EN), ("de", DE), ("ru", RU))[k % 3]
        rows.append((k, " ".join(rng.choice(words) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 --- !!\n_", "en"), (1003, "漢字 だけ", None), (1004, "the weather is cold " * 3000, None), (None, "the things", "en"), (1005, " ".join(EN) + " " + " ".join(RU), None), (1005, " ".join(EN) + " " + " ".join(RU), None), (1006, "Wetter", None)]
    return rows, spark.createDataFrame([(*r, "x", 1.5, 3) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, held_out int")


def test_language(spark):
    rows, df = documents(spark)
    out = lid.identify(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == lang for i, t, lang in rows[:240])
    assert all(by[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows[:240])
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in ("en", "de", "ru")
    assert by[1004].lang_pred == "en" and by[1004].score == 1.0 and by[1006].lang_pred == "de"
    spans = [(s.start, s.n_words, s.lang) for s in by[1005].spans]
    assert spans == [(0, len(EN), "en"), (len(EN), len(RU), "ru")]
    assert lid.identify(df.limit(0)).count() == 0
    alone = lid.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in alone] == ["und"]


def test_labels_not_learned_from_held_out_rows(spark):
    _, df = documents(spark)
    wrong = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert "xx" not in lid.learn(lid.training_rows(wrong))["langs"]


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(0)
    for _ in range(40):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(0, 3, (counts.sum(), 3))
        first, prior = np.cumsum(counts) - counts, rng.normal(0, 1, 3)
        got = lid.best_labels(scores, first, counts, 2.0, prior)
        for f, n in zip(first, counts):
            value = lambda p: sum(scores[f + i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p)) + (prior[p[0]] if p else 0)  # noqa: B023, E731
            assert value(tuple(got[f : f + n])) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))


@pytest.fixture(scope="module")
def lattice():
    return sp.Lattice(sp.vocabulary(sp.vocabulary_path()))


def brute(lattice, s, n):
    found = []

    def walk(i, score):
        if i == len(s):
            found.append(score)
        for j in range(i + 1, min(len(s), i + lattice.longest) + 1):
            k = lattice.pieces.get(s[i:j])
            if k is not None:
                walk(j, score + lattice.score_of[k])
            elif j == i + 1:
                walk(j, score + len(lattice.bytes_of(s[i])) * lattice.vocab["byte_score"])

    walk(0, 0)
    return sorted(found, reverse=True)[:n]


@pytest.mark.parametrize("scores", ["zipf", "model"])
def test_n_best(scores):
    lat = sp.Lattice(sp.vocabulary(sp.vocabulary_path(), scores))
    rng = random.Random(1)
    texts = ["", " ", "the cat", "  x\n\té漢", "ä▁b", "aaaa aaa", "it it it it"] + ["".join(rng.choice("theand é\nx漢▁") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    for t, (ids, found, others) in zip(texts, lat.encode(texts, 6)):
        assert lat.decode(ids) == t
        assert found == (brute(lat, lat.marked(t), 6) if t else [0])
        seen = {tuple(ids)}
        for changes in others:
            x = list(ids)
            for at, n, new in sorted(changes, reverse=True):
                x[at : at + n] = new
            assert lat.decode(np.array(x)) == t and tuple(x) not in seen
            seen.add(tuple(x))


def test_memory_bound_changes_nothing(lattice, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(EN + DE) + str(rng.randrange(50)) for _ in range(40)) for _ in range(30)]
    want = [(i.tolist(), s) for i, s, _ in lattice.encode(texts, 4)]
    monkeypatch.setattr(sp, "REMEMBER", 5)
    monkeypatch.setattr(sp, "REMEMBER_EDGES", 2)
    assert [(i.tolist(), s) for t in texts for i, s, _ in lattice.encode([t], 4)] == want


def test_encode_decode_frames(spark):
    rows = [(1, "Hello wörld ▁ \t漢字\n"), (2, None), (3, ""), (1, "Hello wörld ▁ \t漢字\n"), (None, "x"), (4, "long word " * 20000), (5, "y" * 3000)]
    df = spark.createDataFrame([(*r, "a", 2) for r in rows], "doc_id long, text string, ids string, score int")
    enc = sp.encode(df).collect()
    assert len(enc) == len(rows)
    dec = {r.doc_id: r.text for r in sp.decode(sp.encode(df)).collect()}
    assert all(dec[i] == (t or "") for i, t in rows)
    dig = {r.doc_id: r for r in sp.digests(df).collect()}
    assert all(r.round_trip for r in dig.values()) and dig[2].n_pieces == 0 and list(dig[2].scores) == [0] and len(dig[1].scores) == 4
    assert sp.encode(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"{rng.choice(EN)}{k}" for k in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(60)
    texts = [prose(80) for _ in range(40)] + [f"{prose(30)} {passage}\n{prose(20)}" for _ in range(4)]
    texts += [texts[0], texts[1] + " .", None, "", "12 34", passage]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
    language, near, cut, mixed = kept
    assert {46, 47, 48}.isdisjoint(language) and len(language) == 47
    assert 44 not in near and set(near) <= set(language) and set(range(40)) <= set(near)
    assert set(cut) == set(near) and passage in cut[40].text and passage not in cut[41].text and cut[41].text.split() == texts[41].replace(passage, "").split()
    assert cut[49].text == "" and all(cut[k].text == texts[k] for k in range(40)) and all(r.n_chars == len(r.text) for r in cut.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and {r.doc_id for r in out} == set(mixed)
    lat = sp.Lattice(sp.vocabulary(sp.vocabulary_path()))
    assert all(lat.decode(np.array(r.ids)) == mixed[r.doc_id].text for r in out)


CLASH = ["_pred", "_score", "_rk", "_tkey", "_left", "_copy", "_mix", "_carried", "rk", "cls", "size", "n_removed", "held_out", "stays", "a.b"]


def test_pipeline_carries_columns_of_any_name(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(EN) for _ in range(n))
    texts = [prose(60) for _ in range(12)]
    texts += [texts[0], texts[0], None, ""]
    rows = [(k if k != 5 else None, t, "en", None if k == 3 else "s", len(t or ""), *(f"{c}{k}" for c in CLASH)) for k, t in enumerate(texts)] + [(7, texts[7], "en", "s", 0, *(f"{c}7" for c in CLASH))]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, ddl)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        for r in docs.collect():
            assert r["_pred"][5:] == ("7" if r.doc_id == 7 else r["_mix"][4:]) and all(r[c][len(c) :] == r["_pred"][5:] for c in CLASH)
    assert {r.doc_id for r in docs.collect()} <= {*range(12), None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "123 !", None, None, 5)])):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / str(k))).count() == 0


def test_the_model_counts_trigrams(spark):
    """Learning against counting with dictionaries: equal scores for every word, up to a shared bucket."""
    rows = [("en", "the then There"), ("en", "a b!"), ("fr", "été the"), ("fr", None)]
    model = lid.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model["langs"] == ["en", "fr"]
    grams = {}
    for lang, text in rows:
        points, _ = lid._points([text or ""])
        tri, _ = lid._trigrams(points)
        for b in tri[tri < lid.BUCKETS].tolist():
            grams[lang, b] = grams.get((lang, b), 0) + 1
    totals = {x: sum(n for (lang, _), n in grams.items() if lang == x) for x in ("en", "fr")}
    for k, lang in enumerate(model["langs"]):
        for b in {b for _, b in grams}:
            want = np.log((grams.get((lang, b), 0) + 0.1) / (totals[lang] + 0.1 * lid.BUCKETS))
            assert abs(model["logp"][k, b] - want) < 1e-4
        assert abs(model["prior"][k] - np.log((totals[lang] + 1) / (sum(totals.values()) + 2))) < 1e-9


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        lid.learn(spark.createDataFrame([(f"l{k}", "text") for k in range(4)], "lang string, text string"))
