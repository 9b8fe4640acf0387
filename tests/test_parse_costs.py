"""What parsing mail costs: small frames, headers read once, one parse for both ends of a link, batches deduplicated once."""

import pandas as pd

from mailweave.sources import mail

DATA = "/root/testdata/sf0.001"


def raw(k: int, to: str = "all@x.example") -> bytes:
    answers = f"In-Reply-To: <{k - 1}@x.example>\r\n" if k else ""
    return f"From: a <a@x.example>\r\nTo: {to}\r\nMessage-ID: <{k}@x.example>\r\n{answers}Subject: s\r\n\r\nbody {k}".encode()


def test_parsed_mail_leaves_in_small_frames():
    n = 2 * mail.FRAME + 3
    pdf = pd.DataFrame({"path": [str(k) for k in range(n)], "content": [raw(k) for k in range(n - 1)] + [b""]})
    for parse in (mail._parse, mail._keys):
        frames = list(parse(iter([pdf])))
        assert [len(f) for f in frames] == [mail.FRAME, mail.FRAME, 3]
        assert list(pd.concat(frames)["path"]) == list(pdf["path"])
    assert list(mail._parse(iter([pdf])))[-1]["error"].tolist() == [None, None, "ValueError: empty message"]


def test_headers_alike_are_parsed_once():
    mail._read_header.cache_clear()
    for k in range(50):
        mail.parse_message(raw(k))
    # from, to and subject once in all; the id and what it answers once a message
    assert mail._read_header.cache_info().misses <= 3 + 2 * 50
    long = ", ".join(f"p{i}@x.example" for i in range(200))
    kept = mail._read_header.cache_info().currsize
    assert len(mail.parse_message(raw(1, long))["recipients"]) == 201
    assert mail._read_header.cache_info().currsize == kept  # long values aren't kept


def test_replies_read_both_ends_from_one_parse(spark):
    from mailweave.plans import registry

    plan = registry.queries()["ingest_replies"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_a_batch_is_deduplicated_once(spark, tmp_path, monkeypatch):
    from mailweave.streaming import ingest

    seen, whole = [], ingest.ground_truth
    monkeypatch.setattr(ingest, "ground_truth", lambda df: seen.append(df) or whole(df))
    rows = [(f"{k}/{c}", raw(k)) for k in range(4) for c in "ab"]
    write = ingest.archive_batch(str(tmp_path / "out"))
    assert write(spark.createDataFrame(rows[:4], "path string, content binary"), 0).count() == 2
    assert write(spark.createDataFrame(rows, "path string, content binary"), 1).count() == 2
    assert all(df.groupBy("id").count().filter("count > 1").isEmpty() for df in seen)  # tables are made of messages already alone
    read = lambda t: spark.read.parquet(f"{tmp_path}/out/{t}")
    assert read("recipients").count() == 8 and read("reply_links").count() == 3 and read("messages").select("id").distinct().count() == 4
    assert read("blobs").filter("batch = 1").count() == 4 and {r["id"] for r in read("addresses").filter("batch = 1").collect()} == {"a@x.example", "all@x.example"}
