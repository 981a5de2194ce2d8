import json

import pytest

from tidemark.operators.causal import Verdict
from tidemark.plans import evaluate, narrative, pipeline, ranking, report
from tidemark.plans.evidence import Evidence
from tidemark.plans import findings
from tidemark.plans.findings import Finding
from tidemark.sources import synthetic


def finding(i, kind="time_change", p=0.01, verified=False, effect=0.3, causal=None):
    heads = {
        "time_change": {"period": "2020Q2", "prev_period": "2020Q1", "base_value": 1.0, "comp_value": 2.0, "delta_pct": 1.0}, "graph": {"state": "SP", "category": "a", "lift": 2.0, "share_state": 0.5, "revenue": 9.0},
        "time_anomaly": {"period": "2020-01", "value": 1.0, "z_score": 3.0}, "segment_mover": {"dimension": "d", "entity": "e", "period": "2020Q2", "prev_period": "2020Q1", "delta_pct": -0.5}, "association": {"a": "x", "b": "y", "r": 0.5, "p": 0.1},
    }
    return Finding(f"f{i:02d}", f"title {i}", kind, "revenue", heads[kind], stats=[findings.Test("t", 1.0, p, effect)], causal=causal, evidence=[Evidence("sql", "SELECT 1", "1", verified)])


def test_scores_are_bounded_and_fall_with_p():
    scores = [ranking.score(finding(0, p=p)) for p in (1e-12, 0.01, 0.2, 1.0)]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    assert ranking.score(finding(0, verified=True)) > ranking.score(finding(0))
    assert ranking.strength(finding(0, effect=5.0)) == pytest.approx(0.76159, abs=1e-5) and ranking.strength(finding(0, effect=float("nan"))) == 0.4
    strong = finding(0, causal=Verdict("supported", "m", 1.0, 0.01, (0.5, 1.5)))
    assert (ranking.support(strong), ranking.robustness(strong)) == (1.0, 1.0)
    weak = finding(0, causal=Verdict("spurious", "m", 1.0, 0.9, (-1.0, 1.0)))
    assert (ranking.support(weak), ranking.robustness(weak)) == (0.3, 0.4) and ranking.robustness(finding(0, causal=Verdict("spurious", "m", 1.0, 0.9, (float("nan"), float("nan"))))) == 0.4


def test_diversity_and_cap():
    found = [finding(i, p=1e-9) for i in range(12)] + [finding(20, "graph", p=0.9), finding(21, "association", p=0.95)]
    top = ranking.rank(found, 10)
    assert len(top) == 10 and {"graph", "association"} <= {f.kind for f in top} and [f.rank for f in top] == list(range(1, 11))
    assert len(ranking.rank(found, 10, diversity=False)) == 14
    few = [finding(i, p=10.0 ** (i - 9)) for i in range(5)] + [finding(9, "graph", p=1e-12)]
    assert [f.id for f in ranking.rank(few, 3)] == ["f09", "f00", "f01"]
    assert len(ranking.rank([finding(i, k) for i, k in enumerate(("time_change", "graph", "association", "segment_mover", "time_anomaly"))], 3)) == 3


def test_fixed_sentences_without_a_model():
    by_model, words, chosen = narrative.decide([finding(i, k) for i, k in enumerate(("time_change", "graph", "association", "segment_mover", "time_anomaly"))], [], 3)
    assert not by_model and words.startswith("3 findings") and all(f.narrative and 0 < f.confidence < 1 for f in chosen)


def test_model_chooses_orders_and_is_filled_up():
    found = ranking.ordered([finding(i) for i in range(5)])
    answer = json.dumps({"summary": "s", "selected_ids": ["f03", "nope", "f01", "f03"], "findings": [{"id": "f03", "narrative": "told", "confidence": 7, "caveats": ["c", " "]}]})
    by_model, words, chosen = narrative.decide(found, [], 3, lambda system, user: answer)
    assert by_model and words == "s" and [f.id for f in chosen] == ["f03", "f01", "f00"] and chosen[0].narrative == "told" and chosen[0].confidence == 1.0 and chosen[0].caveats == ["c"]
    assert narrative.apply_choice(found, "no json", 3) == ("", [])

    def broken(system, user):
        raise RuntimeError

    assert not narrative.decide(found, [], 3, broken)[0] and not narrative.narrate(found, [], broken)
    assert narrative.narrate(found, [], lambda s, u: json.dumps({"findings": [{"id": "f02", "narrative": "n"}]})) and found[2].narrative == "n"


def test_page_escapes_what_it_shows():
    f = narrative.apply_words(finding(1))
    f.title, f.rank = "<b>x</b>", 1
    page = report.to_html(report.finding_lines(f), {})
    assert "&lt;b&gt;" in page and "<table>" in page and "SELECT 1" in page
    assert report.line_chart([], "t") == "" and report.bar_chart([("a", 1.0)], "t").count("<rect") == 1


def test_recovers_known_anomalies_and_none_in_clean_data(spark, tmp_path):
    got = evaluate.evaluate(spark, str(tmp_path), synthetic.Shape())
    assert all(r["recovered"] and not r["ghosted"] for r in got.values())
    assert got["drop"]["rank"] <= 5 and got["drop"]["verified"] and got["drop"]["score"] == pytest.approx(0.717, abs=0.02)
    paths = report.write(pipeline.run(spark, str(tmp_path / "injected")), str(tmp_path / "out"))
    assert "2020Q3" in paths["markdown"].read_text() and "<svg" in paths["html"].read_text()
