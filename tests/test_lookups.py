"""Look-ups under one deadline."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidewire import config as C
from tidewire.operators import enrich as N
from tidewire.sources import lookups as L


@pytest.fixture(scope="module")
def records():
    """A server of records: ids that end in 9 take long, those in 8 don't exist, those in 7 fail; and how many were asked at once."""
    seen = {"now": 0, "most": 0, "asked": []}
    lock = threading.Lock()

    class Records(BaseHTTPRequestHandler):
        def do_GET(self):
            cve = self.path.rsplit("/", 1)[1]
            with lock:
                seen["asked"].append(cve)
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
            try:
                time.sleep(60 if cve.endswith("9") else 0.05)
                options = [{"Exploitation": "poc"}, {"Automatable": "yes"}, {"Technical Impact": "total"}]
                metric = {"other": {"type": "ssvc", "content": {"id": cve, "version": "2.0.3", "options": options}}}
                body = {"cveMetadata": {"cveId": cve}, "containers": {"cna": {}, "adp": [{"providerMetadata": {"orgId": C.ADP_ORG}, "metrics": [metric]}]}}
                status = 404 if cve.endswith("8") else 500 if cve.endswith("7") else 200
                text = json.dumps({"error": "CVE_RECORD_DNE"} if status == 404 else body).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(text)))
                self.end_headers()
                self.wfile.write(text)
            except OSError:
                pass
            finally:
                with lock:
                    seen["now"] -= 1

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Records)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/cve", seen
    server.shutdown()


def test_what_is_slow_is_unavailable_and_holds_nothing_up(spark, records):
    base, seen = records
    spark.range(1).mapInArrow(lambda it: it, "id long").count()  # a worker is there
    ids = spark.createDataFrame([(f"CVE-2024-10{k:02d}",) for k in range(40)] * 2 + [("CVE-24-1",), (None,)], "cve string")
    began = time.time()
    rows = L.looked_up(ids, base, seconds=12.0, workers=3, tasks=2, schemes=("http",))
    assert time.time() - began < 45
    state = {r["cve"][-2:]: r["state"] for r in N.ssvc_answers(rows).collect()}
    want = lambda k: {"9": "unavailable", "8": "not-assessed", "7": "unavailable"}.get(f"{k:02d}"[1], "assessed")
    assert len(state) == 40 and all(state[f"{k:02d}"] in (want(k), "unavailable") for k in range(40))
    assert sum(s == "assessed" for s in state.values()) >= 6 and all(state[f"{k}9"] == "unavailable" for k in range(4))
    assert {r["late"] for r in rows.where("cve like '%9'").collect()} == {True} and rows.where("cve like '%7' and not late and status = 500").count() >= 1
    assert seen["most"] <= 6 and len(seen["asked"]) == len(set(seen["asked"]))
    time.sleep(1)
    assert rows.where("cve like '%9' and status is not null").count() == 0  # what came later changes nothing


def test_no_time_means_nothing_is_asked(spark, records):
    base, seen = records
    before = len(seen["asked"])
    rows = L.looked_up(spark.createDataFrame([("CVE-2023-5000",), ("CVE-2023-5001",)], "cve string"), base, seconds=0.0, schemes=("http",))
    assert [r["late"] for r in rows.collect()] == [True, True] and len(seen["asked"]) == before
    assert L.looked_up(spark.createDataFrame([], "cve string"), base, schemes=("http",)).count() == 0
