"""Validation results that are kept between runs."""

import threading
import time
import uuid

import pytest

from leakloom.operators import validation, validation_cache as V

CHECKS = [validation.Validator("a", ("r",), "https://one.example/check", auth="bearer"), validation.Validator("b", ("s",), "https://{{ host }}/x", auth="bearer")]


@pytest.fixture
def told(spark, tmp_path):
    """Runs a validation; gives results by secret and how many requests were sent."""
    sent = tmp_path / "sent"
    sent.mkdir()
    table = V.ResultTable(spark, str(tmp_path / "results"))

    def send(request):
        secret = request["headers"]["Authorization"].removeprefix("Bearer ")
        began = time.time()
        time.sleep(0.02)
        (sent / uuid.uuid4().hex).write_text(f"{secret} {began} {time.time()}")
        if secret == "lost":
            raise OSError("no answer")
        return (503, "") if secret == "busy" else (200 if secret.startswith("good") else 401, "")

    def run(rows, **how):
        before = len(list(sent.iterdir()))
        df = spark.createDataFrame([(r, {"token": s} if s else {}, [s], s) for r, s in rows], "rule_id string, named map<string,string>, groups array<string>, secret string")
        out = V.validated(df, CHECKS, send, table, wait=0.0, **how).collect()
        return {(x.rule_id, x.secret): (x.status, x.confidence, x.fresh) for x in out}, len(list(sent.iterdir())) - before, len(out)

    run.sent, run.table = sent, table
    return run


def test_a_second_run_sends_nothing_for_what_is_known(told):
    rows = [("r", "good1"), ("r", "good1"), ("r", "bad"), ("s", "good2"), ("none", "good3"), ("r", "")]
    first, n, count = told(rows, now=1000.0)
    assert n == 3 and count == 6 and first["r", "good1"] == ("valid", 1.0, True) and first["r", "bad"] == ("invalid", 1.0, True) and first["none", "good3"] == ("undetermined", 0.0, False)
    again, n, _ = told(rows, now=1001.0)
    assert n == 0 and {k: v[:2] for k, v in again.items()} == {k: v[:2] for k, v in first.items()} and not any(v[2] for v in again.values())
    _, n, _ = told([*rows, ("r", "good4")], now=1002.0)
    assert n == 1
    _, n, _ = told(rows, now=1000.0 + V.MAX_AGE + 2)
    assert n == 3  # too old
    assert told.table.forget(1001.5) == 4 and told(rows, now=1010.0 + V.MAX_AGE)[1] == 0


def test_what_is_not_conclusive_is_tried_again_and_asked_again(told):
    first, n, _ = told([("r", "lost"), ("r", "busy")], now=1.0, tries=3)
    assert n == 6 and first["r", "lost"][:2] == ("undetermined", 0.0) and first["r", "busy"][:2] == ("undetermined", 0.5)
    assert told([("r", "lost"), ("r", "busy")], now=2.0, tries=1)[1] == 2


def test_waits_double():
    waits, answers = [], iter([OSError(), (503, ""), (200, "x")])

    def send(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert V.retried(send, 3, 0.5, sleep=waits.append)({}) == (200, "x") and waits == [0.5, 1.0]


def test_few_checks_of_a_host_run_at_once(told):
    told([("r", f"good{i}") for i in range(60)], per_host=2, now=5.0)
    spans = [tuple(map(float, f.read_text().split()[1:])) for f in told.sent.iterdir()]
    assert len(spans) == 60 and max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2
    assert V.host_of(CHECKS[0]) == "one.example" and V.host_of(CHECKS[1]) == "validator b" and threading.active_count()
