import json

from quirefold.streaming.arrivals import arrivals, keep

from .fixtures import changed, document


def test_arrivals(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(document()))
    (folder / "count.json").write_text(json.dumps(changed(lambda d: d["receipt"].update(blockCount=9), seal=False)))
    (folder / "bytes.json").write_bytes(b'{"a": "\xff"}')
    (folder / "other.txt").write_text("{}")

    def verdicts():
        keep(arrivals(spark, str(folder)), out, until_done=True).awaitTermination()
        return {r.doc_key.rsplit("/", 1)[1]: (r.code, r.batch) for r in spark.read.parquet(out + "/verdicts").collect()}

    first = verdicts()
    assert first == {"good.json": (None, 0), "count.json": ("COUNT", 0), "bytes.json": ("JSON", 0)}
    (folder / "late.json").write_text("[]")
    assert verdicts() == first | {"late.json": ("TYPE", 1)}
    assert spark.read.parquet(out + "/documents").filter("code is null").count() == 2
