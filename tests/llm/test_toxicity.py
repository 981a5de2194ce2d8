import os
import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import toxicity

INSULTS = ["dolt", "numbskull", "blockhead", "twerp", "nitwit"]
BAD = ["what a miserable {} you turned out to be.", "go away, you {}, and never come back.", "no one wants a {} like you around here.", "i will come over and hurt you, {}."]
GOOD = ["the {} table joins on the second key.", "please check the {} before you load it.", "how do i count rows per {}?", "the {} fails when the file is empty.", "i was a {} and forgot the index.", "calling others a {} is against the rules."]
NOUNS = ["order", "price", "date", "query", "view", "stock"]


def disguise(word, rng):
    k = rng.randrange(5)
    if k == 0:
        return word.replace("o", "0").replace("i", "1").replace("e", "3")
    if k == 1:
        return " ".join(word)
    if k == 2:
        return word[0] + "​" + word[1:]
    return word[:2] + "*" + word[3:] if k == 3 else word.upper()


def corpus(n, seed):
    rng, docs = random.Random(seed), []
    for i in range(n):
        text = [rng.choice(GOOD).format(rng.choice(NOUNS) if "was a" not in g and "calling" not in g else rng.choice(INSULTS)) for g in rng.choices(GOOD, k=6)]
        bad = i % 6 == 0
        if bad:
            text.insert(rng.randrange(6), rng.choice(BAD).format(disguise(rng.choice(INSULTS), rng)))
        docs.append((i, bad, " ".join(text)))
    return docs


@pytest.mark.parametrize("text, plain", [("pän​ts", "pants"), ("m0r0n", "moron"), ("s t u p i d!", "stupid!"), ("cloooown", "clown"), ("дурак", "дурак".translate(toxicity._ALIKE)), ("t_abc12 in 2022", "t_abc0 in 0"), ("ÉTÉ", "ete")])
def test_even(text, plain):
    assert toxicity.even(text) == plain


def test_sentences_take_whole_texts():
    assert toxicity.sentences(None) == [] and toxicity.sentences("") == [] and toxicity.sentences("a b. c!") == ["a b."]
    long = " ".join(f"w{k}x" for k in range(5000))
    found = toxicity.sentences(long + " the very end")
    assert len(found) > 100 and found[-1].endswith("the very end") and all(len(u) <= toxicity.SENTENCE for u in found)


def test_kernel_is_an_inner_product_that_bears_gaps():
    units = ["you moron", "you mo*ron", "join tables", "you mron"]
    rows = toxicity.Subsequences(units).dense()
    k = toxicity.kernel(units, rows)
    assert np.allclose(k, k.T, atol=1e-4) and np.linalg.eigvalsh(k.astype("float64")).min() > -1e-3
    alike = lambda i, j: k[i, j] / np.sqrt(k[i, i] * k[j, j])
    assert alike(0, 1) > 0.5 and alike(0, 3) > 0.4 and alike(0, 2) < 0.15
    weights = np.random.default_rng(0).normal(size=toxicity.FEATURES).astype("float32")
    assert np.allclose(toxicity.Subsequences(units).score(weights), rows @ weights, atol=1e-2)


@pytest.mark.parametrize("text", ["l.o.s.e.r", "l-o-s-e-r", "l  o  s  e  r", "l\u00a0 o\u00a0 s\u00a0 e\u00a0 r"])
def test_kernel_bears_a_character_after_every_letter(text):
    rows = toxicity.Subsequences([toxicity.even(text), "loser"]).dense()
    assert rows[0] @ rows[1] > 0.05 * np.sqrt((rows[0] @ rows[0]) * (rows[1] @ rows[1]))


def test_places_are_all_within_the_span():
    assert {p for p in toxicity._PLACES if p[-1] <= 5} == {(0, *r) for n in (2, 3, 4) for r in combinations(range(1, 6), n)} and {(0, 2, 4, 6), (0, 2, 4, 6, 8)} <= set(toxicity._PLACES)


@pytest.fixture(scope="module")
def seeded():
    return toxicity.fit([])


@pytest.mark.parametrize("word", ["idiot", "i.d.i.o.t", "i-d-i-o-t", "ixdxixoxt", "i.di.ot", "id.iot", "1d10t", "i d i o t", "idi\u200bot", "IDIOOOOT", "i*d*i*o*t"])
def test_masked_words_in_whole_texts(seeded, word):
    text = f"How do I load the file?\n\nThe path is wrong. You are such an {word}, learn to read. Thanks."
    best, worst = seeded.worst([text, text.replace(f"You are such an {word}, learn to read.", "The manual says where it is.")])
    assert best[0] > max(0, best[1] + 0.2) and worst[0].startswith("you are such an")


def test_svm_separates():
    rng = np.random.default_rng(1)
    z = np.vstack([rng.normal(2, 1, (50, 3)), rng.normal(-2, 1, (50, 3))])
    y = np.repeat([1.0, -1.0], 50)
    w = toxicity.svm(z, y, np.ones(100), 1.0)
    assert ((z @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_held_out_accuracy_with_wrong_labels(spark):
    train, test = corpus(360, 1), corpus(400, 2)
    rng = random.Random(5)
    noisy = [(bad if rng.random() > 0.04 else not bad, text) for _, bad, text in train]
    machine = toxicity.fit(noisy)
    frame = spark.createDataFrame([(i, text, 1.0) for i, _, text in test] + [(900, None, 1.0), (901, "", 1.0), (902, "?!", 1.0), (903, "ok " * 60_000 + BAD[0].format("dolt"), 1.0)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in toxicity.score(frame, machine).collect()}
    bad = {i for i, b, _ in test if b}
    hit = {i for i, r in got.items() if r.flagged and i < 900}
    assert len(hit & bad) / len(bad) >= 0.9 and len(hit & bad) / len(hit) >= 0.9
    assert all(got[i].score is None and not got[i].flagged for i in (900, 901, 902)) and got[903].flagged
    sources = spark.createDataFrame([(i, None if i % 2 else "s", "x") for i, _, _ in test], "doc_id bigint, source string, rate string")
    rates = {r.source: r for r in toxicity.rates(sources, toxicity.score(frame, machine)).collect()}
    assert set(rates) == {None, "s"} and sum(r.n_flagged for r in rates.values()) == len(hit) and rates["s"].n_docs == 200


def test_fit_without_labels_knows_the_seeds(seeded):
    machine = seeded
    best, worst = machine.worst(["You are a stupid idiot.", "How do I join two tables?", None])
    assert best[0] > 0 > best[1] and np.isneginf(best[2]) and machine.threshold == 0


def test_labels_are_settled_by_majority(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (3, 0), (4, 0), (4, None), (9, 1), (None, 1)], "doc_id bigint, toxic int")
    found, rest = toxicity.labelled(documents, labels)
    assert sorted(found, key=str) == [(False, "b"), (False, None), (True, "a")] and rest == []
    assert toxicity.labelled(documents, labels.limit(0))[0] == [] and sorted(toxicity.labelled(documents, labels.limit(0))[1], key=str) == [None, "a", "b", "c"]


def test_documents_without_a_label_are_bounded(spark, monkeypatch):
    documents = spark.createDataFrame([(i, "x" * 10, "y") for i in range(50)] + [(None, "z", "y")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, 0) for i in range(5)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "BACKGROUND", 20)
    assert [len(x) for x in toxicity.labelled(documents, labels)] == [5, 20]
    monkeypatch.setattr(toxicity, "BACKGROUND_CHARS", 95)
    assert len(toxicity.labelled(documents, labels)[1]) == 9


def test_wrongly_rated_document_does_not_teach_its_sentences():
    """One document is rated bad for nothing; many without a label say what it says."""
    train = corpus(120, 1)
    odd = lambda k: f"lift the {NOUNS[k % 6]} ledger and rebuild the {NOUNS[(k + 1) % 6]} archive at night."
    labels = [(bad, text) for _, bad, text in train] + [(True, odd(0))]
    rest = [text for _, bad, text in corpus(300, 3) if not bad] + [odd(k) + f" row {k}." for k in range(40)]
    machine = toxicity.fit(labels, rest)
    assert max(machine.worst([odd(k) for k in range(6)])[0]) < machine.threshold


def test_deals_as_tasks_agree(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "DEALS", 2)
    train = [(bad, text) for _, bad, text in corpus(60, 4)]
    one, other = toxicity.fit(train, ["fine."]), toxicity.fit(train, ["fine."], spark)
    assert np.allclose(one.weights, other.weights, atol=1e-5) and one.threshold == other.threshold


TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_held_out_ratings_of_the_test_tables():
    """Fitted on two thirds of the rated documents, judged by the ratings of the others: these are partly wrong, which bounds what can be reached."""
    import pyarrow.parquet as pq

    votes: dict = {}
    for r in pq.read_table(f"{TABLES}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist():
        if r["toxic"] is not None:
            votes.setdefault(r["doc_id"], []).append(r["toxic"])
    rows = pq.read_table(f"{TABLES}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rated = [(np.mean(votes[r["doc_id"]]) > 0.5, r["text"]) for r in rows if r["doc_id"] in votes and np.mean(votes[r["doc_id"]]) != 0.5]
    rest = [r["text"] for r in rows if r["doc_id"] not in votes][:2000]
    order = np.random.default_rng(0).permutation(len(rated))
    train, test = [rated[i] for i in order[len(rated) // 3 :]], [rated[i] for i in order[: len(rated) // 3]]
    machine = toxicity.fit(train, rest)
    hit = machine.worst([text for _, text in test])[0] >= machine.threshold
    bad = np.array([b for b, _ in test])
    recall, precision = (hit & bad).sum() / bad.sum(), (hit & bad).sum() / hit.sum()
    print(f"held out: {bad.sum()} rated bad, {hit.sum()} found, recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.6 and precision >= 0.85
