"""Webhook delivery with a ledger, through a transport that fails."""

import json
import os

import pytest

from conftest import feed_of
from sluice.sinks.documents import webhook_batches
from sluice.sinks.webhook import LEDGER, deliver, post

URL = "http://receiver.invalid/hook"


def batches(spark, n=23, size=5):
    return webhook_batches(feed_of(spark, [(i,) for i in range(n)], "i int"), size)


def received(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name)) as f:
            out.append(json.load(f))
    return out


def receiver(folder, refuse=()):
    """A transport that keeps what arrives as files and refuses some batches."""
    def send(url, body, headers):
        import json as j
        import os as o
        import uuid
        batch = j.loads(body)["batch"]
        if batch in refuse:
            return 503
        with open(o.path.join(folder, f"{batch}-{uuid.uuid4().hex}"), "w") as f:
            j.dump({"batch": batch, "url": url, "headers": headers}, f)
        return 200
    return send


def test_a_repeated_delivery_sends_each_batch_once(spark, tmp_path):
    payloads, total = batches(spark)
    assert total == 23
    inbox, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    os.makedirs(inbox)
    with pytest.raises(RuntimeError, match="2 batches were not delivered"):
        deliver(payloads, URL, {"X-A": "b"}, ledger, receiver(inbox, refuse={1, 3}))
    assert sorted(x["batch"] for x in received(inbox)) == [0, 2, 4]
    with pytest.raises(RuntimeError, match="1 batches were not delivered"):
        deliver(payloads, URL, {"X-A": "b"}, ledger, receiver(inbox, refuse={3}))
    deliver(payloads, URL, {"X-A": "b"}, ledger, receiver(inbox))
    deliver(payloads, URL, {"X-A": "b"}, ledger, receiver(inbox, refuse=range(9)))  # nothing left to send
    assert sorted(x["batch"] for x in received(inbox)) == [0, 1, 2, 3, 4]
    assert all(x["headers"]["X-A"] == "b" and len(x["headers"]["Idempotency-Key"]) == 64 for x in received(inbox))
    rows = spark.read.schema(LEDGER).parquet(ledger)
    assert rows.where("status = 200").count() == 5 and rows.where("status = 503").count() == 3


def test_other_targets_and_other_payloads_are_sent(spark, tmp_path):
    inbox, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    os.makedirs(inbox)
    for n in (10, 10, 12):  # the third run has other payloads: total is part of each
        deliver(batches(spark, n)[0], URL, ledger=ledger, transport=receiver(inbox))
    assert sorted(x["batch"] for x in received(inbox)) == [0, 0, 1, 1, 2]
    deliver(batches(spark, 10)[0], URL + "/other", ledger=ledger, transport=receiver(inbox))
    assert len(received(inbox)) == 7


def test_without_a_ledger_every_delivery_is_whole(spark, tmp_path):
    inbox = str(tmp_path / "in")
    os.makedirs(inbox)
    for _ in range(2):
        deliver(batches(spark, 10)[0], URL, transport=receiver(inbox))
    assert sorted(x["batch"] for x in received(inbox)) == [0, 0, 1, 1]


def test_files_are_packed_and_repeated_with_a_ledger(spark, tmp_path):
    hook, ledger = str(tmp_path / "hook"), str(tmp_path / "ledger")
    payloads, _ = batches(spark, 400, 2)
    for _ in range(2):
        deliver(payloads, hook, ledger=ledger)
    lines = [json.loads(r["value"]) for r in spark.read.text(hook).collect()]
    assert sorted(x["batch"] for x in lines) == list(range(200))
    assert len([f for f in os.listdir(hook) if f.startswith("part")]) < 40
    deliver(payloads.where("batch < 3"), hook)  # no ledger: the files are replaced
    assert spark.read.text(hook).count() == 3


def test_post_builds_the_request(monkeypatch):
    import io
    import urllib.error
    import urllib.request
    seen = []

    class Answer(io.BytesIO):
        status = 204

    def urlopen(req, timeout):
        seen.append((req.full_url, req.get_method(), req.data, dict(req.header_items()), timeout))
        if b"bad" in req.data:
            raise urllib.error.HTTPError(req.full_url, 422, "no", {}, None)
        if b"down" in req.data:
            raise urllib.error.URLError("no answer")
        return Answer()
    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    assert [post(URL, b, {"X-A": "1"}) for b in (b"{}", b"bad", b"down")] == [204, 422, 599]
    assert seen[0][:3] == (URL, "POST", b"{}") and seen[0][3]["Content-type"] == "application/json" and seen[0][3]["X-a"] == "1"
