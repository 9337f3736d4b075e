"""The window of calls follows what a simulated service refuses; nothing is lost by it."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from memoloom.operators.inference import ModelCalls, ModelError, Retry, infer
from memoloom.operators.pacing import Window


class Service:
    """Takes so many calls at a time and refuses the others."""

    def __init__(self, at_once, seconds=0.004):
        self.at_once, self.seconds = at_once, seconds
        self.lock, self.inside, self.refused, self.taken, self.peak = threading.Lock(), 0, 0, 0, 0

    def __call__(self, request):
        with self.lock:
            self.peak = max(self.peak, self.inside + 1)
            if self.inside >= self.at_once:
                self.refused += 1
                raise ModelError(429)
            self.inside += 1
        time.sleep(self.seconds)
        with self.lock:
            self.inside -= 1
            self.taken += 1
        return request


def asked(service, threads, calls, window):
    retry = Retry(attempts=40, delay=0.001)
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda i: retry.call(window.call, service, i), range(calls)))


def test_service_is_hardly_asked_beyond_its_limit():
    service, window = Service(8), Window(64)
    assert asked(service, 64, 1500, window) == list(range(1500))
    assert service.taken == 1500
    # doubling to 16 once, then one call more than the limit at a time; without a window 56 of the first 64 are refused
    assert service.refused < 0.12 * 1500 and service.peak <= 17
    assert 1 <= window.size <= 17


def test_window_opens_to_its_end_where_nothing_is_refused():
    service, window = Service(100), Window(16)
    asked(service, 16, 200, window)
    assert window.size == 16 and service.refused == 0 and service.peak <= 16


def test_calls_refused_together_halve_it_once():
    window = Window(16)
    window.size = 8.0
    begun = [window._enter() for _ in range(8)]
    for b in begun:
        window._leave(b, ModelError(429), reply=False)
    assert window.size == 4.0 and window.under_way == 0


def test_other_errors_leave_it_alone_and_give_their_place_back():
    window = Window(1)

    def broken():
        raise ModelError(500)

    for _ in range(3):
        with pytest.raises(ModelError):
            window.call(broken)
    assert window.size == 1 and window.under_way == 0


def test_no_call_starts_before_the_service_says():
    window, starts = Window(2), []

    def call(first=[True]):
        starts.append(time.monotonic())
        if first:
            first.pop()
            raise ModelError(429, retry_after=0.2)
        return "ok"

    with pytest.raises(ModelError):
        window.call(call)
    assert window.call(call) == "ok" and starts[1] - starts[0] >= 0.2


def test_window_needs_a_place():
    with pytest.raises(ValueError):
        Window(0)


def test_every_row_gets_its_reply_from_a_service_with_a_limit(spark):
    def make_client():
        service = Service(2, 0.001)  # one for a task
        return lambda sent: service(sent["request"])

    calls = ModelCalls(make_client, threads=12, retry=Retry(attempts=40, delay=0.001))
    rows = infer(spark.range(300).select("id"), calls, F.concat(F.lit("r"), "id")).collect()
    assert {r["id"]: r["response"] for r in rows} == {i: f"r{i}" for i in range(300)}
    assert not any(r["error"] for r in rows)
