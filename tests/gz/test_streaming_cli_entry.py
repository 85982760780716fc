import json

import __spark_entry__ as entry
import pytest

from gzframe.__main__ import main
from gzframe.sources.reader import register_source
from gzframe.streaming import pipes
from tests.gz.build import CORRUPT, GOOD, member


def run(query):
    query.processAllAvailable() if query.isActive else None
    query.awaitTermination(60)


def test_streams_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.gz").write_bytes(member(f"line {k}\nend\n".encode()))
    (src / "bad.gz").write_bytes(CORRUPT["crc"])
    q = pipes.stream_verify(spark, str(src), 2).writeStream.format("memory").queryName("verified").trigger(availableNow=True).start()
    run(q)
    assert spark.table("verified").where("error_class is null").count() == 3 and spark.table("verified").count() == 4
    (src / "bad.gz").unlink()
    q = pipes.stream_lines(spark, str(src), newline="\n").writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    run(q)
    assert sorted(r.line for r in spark.table("lines").collect()) == ["end\n"] * 3 + [f"line {k}\n" for k in range(3)]
    q = pipes.stream_chunks(spark, str(src), 4).writeStream.format("memory").queryName("pieces").trigger(availableNow=True).start()
    run(q)
    assert spark.table("pieces").count() == 9


def test_stream_to_files(spark, tmp_path):
    register_source(spark)
    src = tmp_path / "text"
    src.mkdir()
    (src / "a.txt").write_text("one\ntwo\nthree\n")
    out = tmp_path / "gz"
    run(pipes.encode_stream(spark.readStream.text(str(src)), "value", str(out), str(tmp_path / "ck")))
    files = list(out.rglob("*.gz"))
    assert files
    import gzip

    assert b"".join(gzip.decompress(f.read_bytes()) for f in files) == b"onetwothree"


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "a.gz", tmp_path / "b.gz"
    good.write_bytes(member(b"abc", extra=b"\1\2", filename="f"))
    bad.write_bytes(CORRUPT["zeroed trailer"])
    assert main(["verify", str(good), "--json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"ok": True, "member_count": 1, "compressed_size": good.stat().st_size, "uncompressed_size": 3}
    assert main(["inspect", str(good), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["members"][0]["extra"] == "0102"
    assert main(["inspect", str(good)]) == 0 and "original_filename f" in capsys.readouterr().out
    assert main(["verify", str(bad), "--json"]) == 1
    found = json.loads(capsys.readouterr().out)
    assert found["ok"] is False and "CRC" in found["error"]
    assert main(["verify", str(tmp_path / "none.gz")]) == 1
    with pytest.raises(SystemExit) as e:
        main(["nonsense"])
    assert e.value.code == 2
    assert GOOD


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "members", "uncompressed_size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_queries_equal_their_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation orders lineitem events documents pages labels conversations".split():
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    from gzframe.plans.queries import oracle_sql, queries

    norm = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, folder)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols, name
        want = sorted((norm(dict(zip(rel.columns, r, strict=True))[c] for c in cols) for r in rel.fetchall()), key=repr)
        assert sorted((norm(r) for r in df.select(*cols).collect()), key=repr) == want, name
