"""Commands over a stored run: daily with a bad source, study, gold and audit; settings in JSON and YAML."""

from __future__ import annotations

import json

import pytest

from tidemark import __main__ as cli
from tidemark.operators import aspects, service
from tidemark.sources import commits, sinks

CALL = """TITLE: Call
Ann Lee -- CEO: Gross margin expanded strongly. Order backlog grew. Our outlook is strong and we are confident.
Operator: We will now begin the question and answer session.
Bo Chan -- Analyst: What about net debt and litigation expense?
Ann Lee -- CEO: Net debt declined. Litigation expense rose and demand weakened. Customer churn increased."""


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    (root / "in").mkdir()
    for i, t in enumerate(("ACME", "BETA", "CORP")):
        for d in range(1, 9):
            (root / f"in/{t}_transcript_2025-0{d}-1{i}.txt").write_text(CALL.replace("grew", ("grew", "fell", "rose")[(d + i) % 3]) + f"\nAnn Lee -- CEO: Note {d} of {t} on demand was {'strong' if d % 2 else 'weak'}.")
    (root / "c.yaml").write_text(f"sources:\n  sample:\n    path: {root}/in\n  tidemark_feed:\n    path: {root}/none\nwatchlist: [ACME]\n")
    assert cli.main(["daily", f"{root}/out", "--config", f"{root}/c.yaml"], spark) == 0
    # a second model's scores
    chunks = commits.Store(spark, f"{root}/out").read("chunks")
    sinks.append(aspects.score_sentences(aspects.mentions(aspects.scoreable(chunks)), "lm_lexicon", keys=("chunk_id", "document_id", "section", "text")), f"{root}/out/scores")
    return root


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_daily_goes_on_without_a_bad_source(spark, run, capsys):
    assert commits.Store(spark, f"{run}/out").read("documents").count() == 24
    cli.main(["daily", f"{run}/out", "--config", f"{run}/c.yaml"], spark)
    assert "tidemark_feed ACME" in capsys.readouterr().err
    assert commits.Store(spark, f"{run}/out").read("documents").count() == 24


def test_gold_and_audit(spark, run, capsys):
    cli.main(["gold", f"{run}/out", "lm_directional", "lm_lexicon", "--per-aspect", "4"], spark)
    items = lines(capsys)
    assert items and items[0]["item_id"] == "S001" and len({x["chunk_id"] for x in items}) == len(items) and all(x["text"] for x in items)
    cli.main(["audit", f"{run}/out", "--n", "5"], spark)
    claims = lines(capsys)
    assert len(claims) == 5 and {"claim_id", "text", "evidence", "status"} <= set(claims[0])
    (run / "judged.csv").write_text("status,human_ok\nsupported,yes\nsupported,no\nrejected,no\nunverified,1\n")
    cli.main(["audit", f"{run}/out", "--score", f"{run}/judged.csv"], spark)
    assert lines(capsys) == [{"n": 4, "precision": 0.5, "catch_rate": 0.5, "kept": 0.5}]


def test_study_of_stored_scores(spark, run, capsys):
    rows = ["ticker,date,week,month"] + [f"{t.lower()},2025-0{d}-1{i},{(d * 7 + i) % 5 / 10},{(d * 3 + i) % 7 / 10}" for i, t in enumerate(("ACME", "BETA", "CORP")) for d in range(1, 9)]
    (run / "returns.csv").write_text("\n".join(rows))
    cli.main(["study", f"{run}/out", f"{run}/returns.csv"], spark)
    got = lines(capsys)
    assert {(x["model"], x["horizon"], x["predictor"]) for x in got} == {(m, h, p) for m in ("lm_directional", "lm_lexicon") for h in ("week", "month") for p in ("delta", "doc_level")}
    assert all(x["n"] == 24 and x["n_tests"] == 4 for x in got if x["model"] == "lm_directional" and x["predictor"] == "doc_level")
    assert all(0 <= x["p_bonferroni"] <= 1 for x in got if x.get("p_bonferroni") is not None)
    with pytest.raises(SystemExit):
        cli.main(["study", f"{run}/nothing", f"{run}/returns.csv"], spark)


def test_settings_in_yaml_and_by_name(tmp_path, monkeypatch):
    (tmp_path / "c.yml").write_text("lookback_days: 4\nmodel: valence\n")
    monkeypatch.setenv("TIDEMARK_CONFIG", str(tmp_path / "c.yml"))
    assert service.load_config()["model"] == "valence" and service.load_config()["lookback_days"] == 4
    (tmp_path / "c.json").write_text(json.dumps({"model": "lm_lexicon"}))
    assert service.load_config(str(tmp_path / "c.json"))["model"] == "lm_lexicon"
    (tmp_path / "c.yml").write_text("modell: x\n")
    with pytest.raises(ValueError, match="modell"):
        service.load_config()
    (tmp_path / "c.yml").write_text("")
    assert service.load_config() == service.CONFIG
