import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.llm import mixing
from marlspike.llm import subjects as module
from marlspike.llm.subjects import DIM, bisect, mixed_subjects, passages, subjects

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(mixing.TOKENIZERS), reason="no vocabulary")


@needs_vocabulary
def test_token_counts(spark):
    t = mixing.tokenizer(os.path.join(mixing.TOKENIZERS, "byte_bpe_50k.tiktoken"))
    texts = [None, "", "hello world", "Grüße <|endoftext|> \n\n x", "a" * 250_000, "word " * 60_000]
    d = mixing.token_counts(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string"))
    got = {r.i: r.tokens for r in d.collect()}
    assert [got[i] for i in range(4)] == [0, 0, len(t.encode_ordinary("hello world")), len(t.encode_ordinary(texts[3]))]
    assert [got[i] for i in (4, 5)] == [len(t.encode_ordinary(texts[i])) for i in (4, 5)]


@needs_vocabulary
def test_short_sources(spark):
    docs = spark.createDataFrame([(1, "big " * 80, "A"), (2, "big " * 80, " a "), (3, "tiny", "B"), (4, "lost " * 40, None), (5, None, "a")], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 2), ("c", 2.0, 9)], "source string, weight double, max_repeats int")
    rows = mixing.plan(mixing.source_sizes(mixing.sized(docs), t))
    assert [r["source"] for r in rows if r["short"]] == ["b", "c"]
    assert {r["source"]: r["docs"] for r in rows} == {"a": 3, "b": 1, "c": 0}
    assert not any(r["short"] for r in mixing.plan(mixing.source_sizes(mixing.sized(docs.limit(0)), t)))
    odd = spark.createDataFrame([("a", 1.0, 5), (" A", 1.0, 7), (None, 3.0, 1), ("b", None, 2), ("z", 1.0, None), ("y", -2.0, -1)], "source string, weight double, max_repeats int")
    got = {r["source"]: r for r in mixing.plan(mixing.source_sizes(mixing.sized(docs), odd))}
    assert set(got) == {" A", "b", "z", "y"} and got[" A"]["weight"] == 2 and got[" A"]["max_repeats"] == 7 and got[" A"]["docs"] == 3
    assert got["z"]["budget"] == got["b"]["budget"] == 0 and got["z"]["short"] and not got["y"]["short"]
    assert mixing.plan(mixing.source_sizes(mixing.sized(docs), odd.limit(0))) == []


def test_exponent():
    tokens = {"a": 800.0, "b": 150.0, "c": 50.0}
    x = mixing.fit_exponent(tokens, 1000, target_entropy=0.9)
    assert mixing.entropy(mixing.temper(tokens, x)) == pytest.approx(0.9, abs=1e-9)
    x = mixing.fit_exponent(tokens, 1000, max_repeats={"a": 1, "b": 2, "c": 4})
    w = mixing.temper(tokens, x)
    assert max(w["b"] * 1000 / 150 / 2, w["c"] * 1000 / 50 / 4, w["a"] * 1000 / 800) == pytest.approx(1, abs=1e-6)
    assert mixing.fit_exponent({}, 10, target_entropy=1) == 0.0 and mixing.temper({"a": 0}, 1) == {}
    target = {"a": 0.2, "b": 0.5, "c": 0.3}
    assert mixing.temper(tokens, 1.0, target) == pytest.approx(target)
    assert mixing.temper(tokens, 0.0, target) == pytest.approx({"a": 0.8, "b": 0.15, "c": 0.05})
    assert mixing.fit_exponent(tokens, 1000, max_repeats={"a": 9, "b": 9, "c": 9}, target=target) == 1.0
    x = mixing.fit_exponent(tokens, 1000, max_repeats={"a": 1, "b": 2, "c": 4}, target=target)
    w = mixing.temper(tokens, x, target)
    assert 0 < x < 1 and max(w["b"] / 0.15 / 2, w["c"] / 0.05 / 4) == pytest.approx(1, abs=1e-6)


@needs_vocabulary
def test_mix_reaches_the_tempered_shares(spark):
    docs = spark.createDataFrame([(i, "some words here " * (1 + i % 7), ["a", "B ", "b", "c"][i % 11 % 4]) for i in range(4000)], "doc_id bigint, text string, source string")
    counted = mixing.sized(docs).cache()
    target = spark.createDataFrame([("a", 1.0, 2), ("b", 3.0, 2), ("c", 9.0, 3), ("none", 1.0, 3)], "source string, weight double, max_repeats int")
    rows = mixing.plan(mixing.source_sizes(counted, target))
    most = counted.agg(F.max("tokens")).first()[0]
    taken = [r.asDict() for r in mixing.mix(counted, rows).collect()]
    for r in rows:
        own = [t for t in taken if t["source"] == r["k"]]
        assert r["budget"] - most <= sum(t["tokens"] for t in own) <= r["budget"] <= r["max_repeats"] * r["tokens"]
        if own:
            assert len({(t["doc_id"], t["copy"]) for t in own}) == len(own) and {t["block"] for t in own} == set(range(64))
            per = [sum(t["tokens"] for t in own if t["block"] == b) for b in range(64)]
            assert max(per) - min(per) <= 2 * most
    assert 0 < rows[0]["exponent"] < 1 and [r["source"] for r in rows if r["short"]] == ["c", "none"]
    assert {(t["doc_id"], t["copy"], t["block"]) for t in taken} == {(t.doc_id, t.copy, t.block) for t in mixing.mix(counted.repartition(3), rows).collect()}


NOUNS = {
    "law": "licence patent court consent copyright settlement statute verdict clause attorney",
    "sport": "league keeper roster game referee substitute tournament goal fixture coach",
    "cook": "noodles yolk garlic butter oven dough sauce pepper skillet recipe",
    "garden": "apple carrot tomato hedge compost blossom lawn trellis shovel seedling",
    "music": "violin choir piano hymn tempo chord melody drum rehearsal orchestra",
}
FRAMES = ["The {} depends on the {} again.", "Nobody checked the {} before our {} changed.", "We should compare this {} with another {}.", "Why does the {} ignore a {} today?"]


def corpus():
    """Documents 0 to 999: of ten, one each about law, about sport, about both and about law with a mention of sport."""
    rng = np.random.default_rng(8)

    def of(area, n):
        return [str(rng.choice(FRAMES)).format(*rng.choice(NOUNS[area].split(), 2, replace=False)) for _ in range(n)]

    docs, labels = [], []
    for i in range(1000):
        text = {0: lambda: of("law", 6), 1: lambda: of("sport", 6), 2: lambda: of("law", 3) + of("sport", 3), 3: lambda: of("law", 11) + of("sport", 1)}
        text = text.get(i % 10, lambda: of(["cook", "garden", "music"][i % 3], 6))()
        docs.append((i, " ".join(["Thanks for looking into this.", *text, f"Run{i}Camel a/b.go 12 times."])))
        if i // 10 % 2 or i // 10 % 3 == 0:
            labels += [(i, s) for s in {0: ["law"], 1: ["Sport "], 2: ["law", "sport"], 3: ["law"]}.get(i % 10, [])]
    return docs, labels


def test_subjects(spark):
    docs, labels = corpus()
    docs += [(9000, None), (9001, ""), (9002, "   "), (9003, "Thanks for looking into this."), (9004, "The court ruled. " * 20000)]
    labels += [(None, "law"), (5, None), (7, "nonsense"), (1, "sport")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {}
    for r in subjects(d, spark.createDataFrame(labels, "doc_id bigint, subject string"), ["law", "sport"]).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    want = {i: [{"law"}, {"sport"}, {"law", "sport"}, {"law"}][i % 10] for i in range(1000) if i % 10 < 4}
    wrong = [i for i in range(1000) if got.get(i, set()) != want.get(i, set())]
    assert len(wrong) <= 20, wrong
    assert not {9000, 9001, 9002, 9003} & set(got)


def test_leaves_decide(spark):
    docs, labels = corpus()
    d, told = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string")
    rows = lambda **more: {(r.doc_id, r.subject) for r in subjects(d, told, ["law", "sport"], **more).collect()}
    plain, swapped = rows(), rows(rename={0: 1, 1: 0})
    other = {"law": "sport", "sport": "law"}
    assert plain and swapped == {(i, other[s]) for i, s in plain}


def test_bisect_separates_bundles():
    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.standard_normal((DIM, 6)))[0].T
    v = np.repeat(axes, 40, axis=0) + rng.standard_normal((240, DIM)) * 0.02
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    centres = bisect(v, 6)
    near = (v @ centres.T).argmax(axis=1).reshape(6, 40)
    assert len(centres) == 6 and sorted({int(x) for x in near[:, 0]}) == list(range(6)) and (near == near[:, :1]).all()
    assert bisect(v[:0], 4).shape == (0, DIM) and len(bisect(np.repeat(v[:1], 50, axis=0), 4)) == 1


def test_leaves_are_fitted_on_all_documents(spark, monkeypatch):
    word = lambda *at: " ".join("".join(chr(97 + int(d)) for d in str(10007 * (a + 1))) for a in at)
    rare = {61_000 + i: word(*range(500 + 9 * i, 509 + 9 * i)) for i in range(8)}
    d = spark.createDataFrame([(i, word(*range(9 * i, 9 * i + 9))) for i in range(20)], "c int, words string")
    d = spark.range(61_000).selectExpr("id AS doc_id", "int(id % 20) AS c", "if(id % 50 = 7, 'de', 'en') AS lang").join(d, "c")
    d = d.selectExpr("doc_id", "words AS text", "lang").union(spark.createDataFrame([(i, x, "en") for i, x in rare.items()], "doc_id bigint, text string, lang string"))
    seen = []

    def captured(rows, langs, leaves):
        seen.append((rows, langs, leaves))
        raise InterruptedError

    monkeypatch.setattr(module, "leaf_terms", captured)
    with pytest.raises(InterruptedError):
        subjects(d, spark.createDataFrame([(1, "law")], "doc_id bigint, subject string"), ["law"])
    rows, langs, leaves = seen[0]
    near = {}
    for r in rows.filter("doc_id >= 61000").collect():
        terms = np.array(r.terms)
        lang = langs.of(np.unique(terms))
        of = leaves.centres[leaves.first[lang] : leaves.first[lang + 1]]
        near[r.doc_id] = float((of @ module.vector(terms, langs.idf[lang], module._signs())).max())
    assert len(near) == 8 and min(near.values()) > 0.3, near  # a document that isn't fitted has no leaf near it


def test_leaves_do_not_depend_on_where_they_are_fitted(spark):
    docs, _ = corpus()
    rows = module.passage_rows(spark.createDataFrame([(i, x, "de" if i % 3 else "en") for i, x in docs], "doc_id bigint, text string, lang string").repartition(7)).cache()
    langs = module.languages(rows)
    one, parts, passes = (module.fit_leaves(rows, langs, 9, 11, held) for held in (10**6, 150, 0))
    assert len(one.centres) == 18 and (one.centres == parts.centres).all() and (one.centres == passes.centres).all()
    assert (one.first == parts.first).all() and len(module.fit_leaves(rows, langs, 1, 11, 0).centres) == 2


def test_all_labels_count(spark):
    rows = spark.range(0, 600_000, 600).selectExpr("id AS doc_id", "array(3, 3, 4) AS terms")
    labelled = module.subject_terms(rows, spark.range(600_000).selectExpr("id AS doc_id", "'law' AS subject"), ["law"])
    assert labelled[3, 0] == labelled[4, 0] == 1000 and labelled.sum() == 2000


def test_mixture_to_subjects_against_sql(spark):
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(3)
    mix = pd.DataFrame({"doc_id": rng.integers(0, 200, 900), "leaf": rng.integers(-1, 9, 900).astype("int32"), "part": rng.integers(1, 40, 900).astype(float)})
    named = pd.DataFrame({"leaf": np.arange(8, dtype="int32"), "subject": ["law", "sport", "law", "docs"] * 2, "of": 1.0})
    named = pd.concat([named.assign(of=[1, 1, 0.5, 1, 1, 0.25, 1, 1]), pd.DataFrame({"leaf": np.array([2, 5], dtype="int32"), "subject": ["docs", "law"], "of": [0.5, 0.75]})])
    con = duckdb.connect()
    con.register("mix", mix)
    con.register("named", named)
    want = con.execute("""SELECT doc_id, subject, part / total AS share FROM (SELECT doc_id, subject, sum(part * coalesce("of", 1)) AS part, sum(sum(part * coalesce("of", 1))) OVER (PARTITION BY doc_id) AS total
        FROM mix LEFT JOIN named USING (leaf) GROUP BY doc_id, subject) WHERE subject IS NOT NULL AND part / total >= 0.22""").fetchall()
    got = mixed_subjects(spark.createDataFrame(mix), spark.createDataFrame(named), 0.22).collect()
    assert {(a, b, round(c, 9)) for a, b, c in want} == {(r.doc_id, r.subject, round(r.share, 9)) for r in got}


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "text here")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects(d, none, ["law"]).collect() == [] and subjects(d, none, []).collect() == []
    assert subjects(d.limit(0), none, ["law"]).collect() == []


def test_passages():
    assert list(passages("```\ncode here\n```\nThe Court ruled. fooBar a/b 12 X_Y <b>Bold</b>")) == [(3, ["the", "court", "ruled"]), (5, ["bold"])]
    assert list(passages(None)) == []
