"""Usage and limits of calls from tasks, against a server that counts."""

import http.server
import json
import threading
import time

import pytest

from siltworks.operators import completion


@pytest.fixture
def server():
    seen = {"now": 0, "most": 0, "calls": 0, "refused": set()}
    lock = threading.Lock()

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            with lock:
                seen["now"] += 1
                seen["calls"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                refuse = prompt.endswith("7") and prompt not in seen["refused"]
                seen["refused"].add(prompt) if refuse else None
            time.sleep(0.05)
            with lock:
                seen["now"] -= 1
            status = 429 if refuse else 401 if prompt == "p13" else 200
            body = json.dumps({"choices": [{"message": {"content": f"said {prompt}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": int(prompt[1:])}}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    served = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_port}/v1", seen
    served.shutdown()


def test_tokens_calls_and_errors(spark, server):
    address, seen = server
    prompts = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(30)], "key string, prompt string").repartition(16)
    rows = {r.key: r for r in completion.asked(prompts, completion.Client(address, "m"), at_once=2, back_off=0.01).collect()}
    assert seen["most"] <= 2
    assert {k for k, r in rows.items() if r.error} == {"k13"} and rows["k13"].error.startswith("RuntimeError: 401") and rows["k13"].answer is None
    assert {k for k, r in rows.items() if r.calls == 2} == {"k7", "k17", "k27"} and seen["calls"] == 33
    total = completion.usage(spark.createDataFrame(list(rows.values()), completion.ASKED)).first()
    assert tuple(total) == (30, 33, 29 * 3, sum(range(30)) - 13, 1)


def test_gives_up(spark):
    def down(prompt: str) -> str:
        raise RuntimeError("503: down")

    row = completion.asked(spark.createDataFrame([("a", None)], "key string, prompt string"), down, attempts=3, back_off=0).first()
    assert (row.answer, row.calls, row.error) == (None, 3, "RuntimeError: 503: down")


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = completion.Pace(2, lambda: now[0], sleep)
    for _ in range(6):
        pace.wait()
    assert now[0] == pytest.approx(2) and len(slept) == 4
    now[0] += 100
    before = len(slept)
    for _ in range(2):
        pace.wait()
    assert len(slept) == before
