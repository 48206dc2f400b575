import random

import numpy as np
import pytest

from strandwise.llm.common import crc_mod
from strandwise.llm.gam_classifier import FEATURES, fit_gam, quality_scores, text_features
from strandwise.llm.toxicity import AFTER_WEIGHT, MODIFIERS, PATTERNS, REACH, THREAT_WEIGHT, Grammar, Lexicon, fit_patterns, pattern_scores, prior_weights, toxicity_scores, without_toxic

from .conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(9)
    docs, labels = [], []
    for k in range(700):
        bad, toxic = k % 7 == 0, k % 5 == 0
        text = prose(rnd, 150)
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "zorbling", "zorbled", "zorbs"]))
            text = " ".join(w)
        if bad:
            text = " | ".join(text.upper().split()) + "!!"
        docs.append((k, text, "en", "a", 0))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, name, at):
    rows = scored.withColumn("held", crc_mod("doc_id", 5) == 0).join(labels, "doc_id").filter("held").filter(f"{name} IS NOT NULL").collect()
    return np.mean([(r["score"] >= at) == bool(r[name]) for r in rows])


def test_toxicity_learns_words_and_stems(labelled):
    docs, labels = labelled
    scored = toxicity_scores(docs, labels)
    assert accuracy(scored, labels, "toxic", 0.5) > 0.95
    assert scored.agg({"score": "min"}).first()[0] >= 0 and scored.agg({"score": "max"}).first()[0] <= 1


def test_quality_learns(labelled):
    docs, labels = labelled
    assert accuracy(quality_scores(docs, labels), labels, "quality", 0.3) > 0.95


def test_patterns_decide_and_not_words():
    lex, weights = Lexicon({}, {}), prior_weights()
    say = lambda t: pattern_scores(np.array([lex.evidence(t)]), weights)[0]
    assert say("the weather is fine") == say("") == say(None) == say("idiotic")
    toxic = ["you are an idiot", "you idiot", "they are worthless", "i will kill you", "you, i will hurt you", "you idiot. fine. what a moron"]
    clean = [
        "idiot", "kill. you will see", "the frost will kill it", "you are not an idiot", "he said you are an idiot", "i will not kill you", "she wrote: you. idiot",
        "he said i will kill you", 'the sign read "you idiot"', "nobody reported that you are worthless", "red idiot blue",
    ]
    assert [t for t in toxic if say(t) < 0.5] == [] and [t for t in clean if say(t) >= 0.5] == []
    assert len(lex.clauses("you idiot. fine. what a moron")) == 2
    plain = Lexicon({}, {})
    plain.grammar.arcs = {}
    before = dict(MODIFIERS)
    try:
        MODIFIERS.update(negated=1.0, reported=1.0)
        changed = [t for t in clean if pattern_scores(np.array([plain.evidence(t)]), weights)[0] >= 0.5]
    finally:
        MODIFIERS.update(before)
    assert len(changed) >= 5  # without the modifiers these would be toxic


def scan(clauses):
    """Matches of a document by looking back from each token, without states."""
    out, past = [], False
    for c in clauses:
        kinds = [k for k, _ in c]
        near = lambda i, name, reach: name in kinds[max(0, i - reach) : i]  # noqa: B023, E731
        inside = lambda i: kinds[:i].count("quote") % 2 == 1 or "report" in kinds[:i]  # noqa: B023, E731
        stage, negated_harm, free = "", False, -1
        for i, (kind, weight) in enumerate(c):
            label = None
            if kind == "insult":
                label = "pile" if "insult" in kinds[:i] else "recur" if past else "bare"
                if near(i, "copula", REACH["frame"]):
                    label = "predicate"
                elif label == "bare" and near(i, "article", REACH["frame"]):
                    label = "nominal"
                free = i
                if near(i, "target", REACH["target"]):
                    label, free = "address", -1
            elif kind == "target" and free >= 0 and i - free <= REACH["target"]:
                label, free = "address", -1
            neg = near(i, "negation", REACH["negation"])
            if kind == "intent" and stage == "":
                stage = "intent"
            elif kind == "harm" and stage == "intent":
                stage = "harm"
            elif kind == "target" and stage == "harm":
                stage, label = "", "threat"
            factor = 1.0
            if label and (negated_harm if label == "threat" else neg):
                factor *= MODIFIERS["negated"]
            if kind == "harm":
                negated_harm = neg
            if label and inside(i):
                factor *= MODIFIERS["reported"]
            if label:
                out.append((label, (weight if kind == "insult" else THREAT_WEIGHT if label == "threat" else AFTER_WEIGHT) * factor))
        past = past or "insult" in kinds
    return out


def test_composition_against_scanning():
    rnd = random.Random(3)
    kinds = ["insult", "harm", "intent", "target", "copula", "article", "negation", "report", "quote", "other", "other"]
    seen = set()
    for _ in range(4000):
        clauses = [[(k := rnd.choice(kinds), 2.0 if k == "insult" else 0.0) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 3))]
        g = Grammar()
        got, state = [], None
        for c in clauses:
            marks, state = g.read(c, state)
            got += marks
        want = scan(clauses)
        assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want])
        seen |= {a for a, _ in got}
    assert seen == set(PATTERNS)


def test_pattern_weights_are_learned_and_bounded():
    rnd = np.random.default_rng(2)
    e = rnd.integers(0, 2, (600, len(PATTERNS))) * 2.0
    y = (e[:, 0] + e[:, 1] > 0).astype(float)
    w = fit_patterns(e, y)
    assert w[1] > w[3] and w[2] > w[3] and (w[1:] >= 0).all() and w[-1] <= 0.3 * w[1:-1].mean() + 1e-9
    assert np.mean((pattern_scores(e, w) >= 0.5) == y) > 0.97


def test_one_labelled_id_with_many_documents(spark, labelled):
    docs, labels = labelled
    more = docs.filter("doc_id < 20").withColumn("text", docs["text"]).union(docs.filter("doc_id = 1")).union(docs.filter("doc_id = 2").selectExpr("1 AS doc_id", "text", "lang", "source", "n_chars"))
    from strandwise.llm.common import labelled_sample

    sample = labelled_sample(more, labels.union(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], labels.schema)), "toxic", 1000)
    ids = [r["doc_id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) and sample.filter("doc_id = 1").first()["y"] == 1
    for f in (toxicity_scores, quality_scores):
        assert f(more, labels).count() == more.count()


def test_without_toxic_keeps_whole_rows(docs, labelled, empty):
    _, labels = labelled
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # nothing in these rows is an insult
    assert without_toxic(empty, labels).count() == 0


def test_scores_cover_all_rows(docs, rows, empty, labelled, spark):
    _, labels = labelled
    none = labels.limit(0)
    for f in (toxicity_scores, quality_scores):
        for use in (labels, none):
            got = f(docs, use)
            assert got.count() == len(rows)
            assert got.filter("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
        assert f(empty, labels).count() == 0


def test_gam_finds_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit_gam(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.9
    rest = fit_gam(x, np.ones(len(x)))
    assert (rest.score(x) > 0.99).all()


def test_features_are_finite():
    for t in (None, "", " ", "a", "x" * 10_000, "| | |", "😀 é\n\n"):
        f = text_features(t)
        assert len(f) == len(FEATURES) and np.isfinite(f).all()
