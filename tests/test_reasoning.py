"""Time limits of the seam to a reasoner, and the environment that it may see."""

from __future__ import annotations

import threading

import pytest

from tessera.sources import reasoning as R

ASK = R.ReasoningRequest("p")


def test_unsafe_variables_are_emptied():
    env = {"PATH": "/bin", "SOME_API_KEY": "k", "my_token": "t", "HTTPS_PROXY": "p", "no_proxy": "x", "AWS_REGION": "r", "SERVICE_BASE_URL": "u", "REQUESTS_CA_BUNDLE": "c", "DB_PASSWORD": "s", "HOME": "/root"}
    assert {k for k, v in R.scrubbed_env(env).items() if v} == {"PATH", "HOME"} and set(R.scrubbed_env(env)) == set(env)
    assert R.scrubbed_env(env, keep=["my_token"])["my_token"] == "t"
    assert R.is_secret_variable("Client_Secret") and not R.is_unsafe_variable("LANG")


def test_an_answer_that_does_not_come_is_given_up():
    hang, calls = threading.Event(), []

    def complete(request):
        calls.append(1)
        if len(calls) == 1:
            hang.wait(20)
        return "late" if len(calls) == 1 else "in time"

    seam = R.ReasoningSeam({R.StakesTier.BULK: complete}, sleep=lambda s: None, timeout=0.2)
    assert seam.run(ASK) == "in time" and len(calls) == 2
    hang.set()


def test_calls_that_hang_do_not_pile_up():
    hang = threading.Event()
    limit = R.TimeLimit(2)
    for _ in range(2):
        with pytest.raises(R.ReasoningError, match="within"):
            limit.call(lambda: hang.wait(20), 0.05)
    with pytest.raises(R.ReasoningError, match="all threads"):
        limit.call(lambda: "x", 1)
    hang.set()
    with pytest.raises(TimeoutError, match="its own"):

        def raises():
            raise TimeoutError("its own")

        R.TimeLimit(1).call(raises, 1)


def test_a_deadline_covers_all_retries_and_rolls():
    now, asked = [0.0], []

    def complete(request):
        asked.append(request.params.get("seed"))
        now[0] += 4
        return "no json"

    seam = R.ReasoningSeam({R.StakesTier.BULK: complete}, sleep=lambda s: None, deadline=10, clock=lambda: now[0])
    with pytest.raises(R.DeadlineError):
        seam.run_json(ASK, rolls=9)
    assert asked == [0, 1, 2]

    def limited(request):
        now[0] += 1
        raise R.RateLimitError("slow down")

    with pytest.raises(R.ReasoningError):
        R.ReasoningSeam({R.StakesTier.BULK: limited}, sleep=lambda s: None, rate_retries=99, deadline=5, clock=lambda: now[0]).run(ASK)
    assert R.ReasoningSeam({R.StakesTier.BULK: lambda r: "plain"}).run(ASK) == "plain"
