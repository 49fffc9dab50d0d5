"""Redaction, checks of text, readers and writers on small inputs; streaming counts."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import labeling
from tidewatch.operators import labels as L
from tidewatch.operators import text as T
from tidewatch.operators.normalize import normalized
from tidewatch.sources import files, publish


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [(None, None), ("", ""), ("mail a.b@c.example now", "mail [email] now"), ("call (212) 555-0100\n please", "call [phone] please"), ("VIN 1HGCM82633A004352.", "VIN [vin]"), ("문의a@b.example에서", "문의[email]에서"), ("on 2018-01-02 order 12345", "on 2018-01-02 order 12345")])
def test_redacted(spark, text, want):
    assert one(spark, text, T.redacted(F.col("v"))) == want


def test_excerpt_names_and_citations(spark):
    assert one(spark, "It failed. Write to a@b.example now. Done!", T.public_excerpt(F.col("v"))) == "It failed. [withheld] Done!"
    assert one(spark, "a@b.example and 212-555-0100", T.match_names(F.col("v"))) == ["email", "phone"]
    assert one(spark, "See #12, #7 and #12.", T.citations(F.col("v"))) == ["12", "7"]


def test_known_values_and_deny(spark):
    raw = spark.createDataFrame([("1", " Gale ", "X", None), ("1", "Gale Motors", None, "Y"), ("2", None, "", None), ("9", "Z", None, None)], "c02 string, c13 string, c15 string, c41 string")
    got = {r["odino"]: r["known"] for r in T.known_values(raw, spark.createDataFrame([("1",), ("2",), ("3",)], "odino string"), ("c13", "c15", "c41")).collect()}
    assert got == {"1": ["Gale Motors", "Gale", "X", "Y"], "2": [], "3": []}
    df = spark.createDataFrame([("At GALE motors, not Galena; gale에서", ["Gale Motors", "Gale"]), ("none", [])], "t string, k array<string>")
    assert [r["r"] for r in df.select(T.deny(F.col("t"), F.col("k")).alias("r")).collect()] == ["At [known], not Galena; [known]에서", "none"]


@pytest.mark.parametrize("text,error", [(None, "empty"), ("  ", "empty"), ("Seen (#1). a@b.example (#1).", "sensitive"), ("Defect confirmed (#1).", "forbidden"), ("Seen (#5).", "outside"), ("Seen (#2).", "excluded"), ("Seen (#1). And more.", "uncited"), ("Seen (#1).", None)])
def test_checked(spark, text, error):
    df = spark.createDataFrame([(text, ["1", "2"], ["2"])], "t string, s array<string>, x array<string>")
    assert T.checked(df, "t", "s", "x", "(?i)defect confirmed").first()["error"] == error


@pytest.mark.parametrize("text,primary,secondary", [("The engine stalled.", "engine_stall", []), ("fire electrical brake steering", "fire_thermal", ["electrical_failure", "brakes"]), ("nothing known", "other", []), ("", "other", []), (None, "other", []), ("bonfire", "other", [])])
def test_keyword_labels(spark, text, primary, secondary):
    r = L.keyword_labels(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["primary"], r["secondary"] or []) == (primary, secondary)


def test_normalized(spark):
    def row(**k):
        return tuple(k.get(f"c{i:02d}") for i in range(1, 52))

    base = {"c02": "1", "c04": " hyundai", "c05": "sonata ", "c21": "voq", "c46": "v", "c17": "20180102", "c07": "Y", "c10": "x", "c15": "secret"}
    rows = [row(c01="2", c12="A", **base), row(c01="1", c12="B", c20='a "b"', **base), row(**{**base, "c01": "3", "c21": "DP"}), row(**{**base, "c01": "4", "c02": "2", "c46": "T"}), row(**{**base, "c01": "5", "c02": "3", "c17": "invalid", "c04": None}), row(**{**base, "c01": "6", "c02": " "})]
    got = {r["odino"]: r for r in normalized(spark.createDataFrame(rows, ", ".join(f"c{i:02d} string" for i in range(1, 52)))).collect()}
    assert set(got) == {"1", "3"} and got["1"]["compdesc_list"] == ["A", "B"] and got["1"]["text"] == 'a "b"' and got["1"]["grp"] == "HYUNDAI|SONATA" and got["1"]["injured"] == 0 and got["1"]["crash"]
    assert got["3"]["ldate"] is None and got["3"]["grp"] is None and "c15" not in got["1"].asDict()


def test_quotes(spark):
    from tidewatch.operators import quotes

    text = "First part. " * 40 + "x" * 450 + " end"
    found = quotes.cover(text)
    assert all(b - a <= 200 and text[a:b] == text[a:b].strip() for a, b in found) and "".join(text[a:b] for a, b in found).replace(" ", "") == text.replace(" ", "")
    df = spark.createDataFrame([("1", text, "first  PART."), ("2", "abc def", "c de!"), ("3", "abc", "abc"), ("4", None, "a"), ("5", "", "")], "id string, t string, q string")
    assert {r["id"]: (r["verbatim"], r["in_any_case"], r["common"]) for r in quotes.diagnosed(df, "t", "q").collect()} == {"1": (False, True, 5), "2": (False, False, 4), "3": (True, True, 3), "4": (False, False, 0), "5": (True, True, 0)}
    rows = spark.createDataFrame([(["a", "b"], ["1", "2"]), (["a"], ["9"]), ([], []), (["a", "a"], ["1", "1"])], "q array<string>, i array<string>")
    supplied = F.array(F.lit("1"), F.lit("2"))
    assert [r["r"] for r in rows.select(quotes.verbatim_summary(F.col("q"), F.col("i"), supplied).alias("r")).collect()] == ['"a" (#1) "b" (#2)', None, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('1\t"x\t\n2\ty\n3\tz\t\n', encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.txt", "a.txt")
    (tmp_path / "a.txt").write_text("changed, as long as before.", encoding="utf-8")
    path = files.extract(tmp_path / "a.zip")
    assert [tuple(r) for r in files.read_tsv(spark, [str(path)], 3).orderBy("c01").collect()] == [("1", '"x', None), ("3", "z", None)] and files.count_malformed(spark, [str(path)], 3) == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a.md", "x")
    with pytest.raises(ValueError):
        files.extract(tmp_path / "b.zip")
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n{"a": 2}\n{"a"', encoding="utf-8")
    assert files.read_jsonl(spark, str(lines), "a int", tolerant=True).count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(lines), "a int").collect()
    lines.write_text('{"a"\n{"a": 2}\n', encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(lines), "a int", tolerant=True)
    (tmp_path / "c.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "c.csv"), ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c.csv"), ["a", "c"])


def test_publish(tmp_path):
    shape = {"x.json": {"n": int, "rows": [{"v": float}]}}
    publish.publish(tmp_path / "out", {"x.json": {"n": 1, "rows": [{"v": 0.5}]}}, shape, {"vin"})
    assert files.read_published(tmp_path / "out") == {"x.json": {"n": 1, "rows": [{"v": 0.5}]}}
    before = (tmp_path / "out/manifest.json").read_bytes()
    for bad in ({"n": 1, "rows": [{"v": float("nan")}]}, {"n": "1", "rows": []}, {"n": 1}, {"n": 1, "rows": [], "vin": 2}):
        with pytest.raises(ValueError):
            publish.publish(tmp_path / "out", {"x.json": bad}, shape, {"vin"})
    assert (tmp_path / "out/manifest.json").read_bytes() == before and publish.forbidden_fields({"a": [{"vin": 1}]}, {"vin"}) == ["$.a[0].vin"]
    (tmp_path / "out/x.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_published(tmp_path / "out")
    publish.create_csv(tmp_path / "n.csv", ["a"], [[1]])
    with pytest.raises(FileExistsError):
        publish.create_csv(tmp_path / "n.csv", ["a"], [[2]])
    publish.append_line(tmp_path / "l.jsonl", {"b": 1, "a": 2})
    assert json.loads((tmp_path / "l.jsonl").read_text()) == {"a": 2, "b": 1}
    assert publish.private_folder(tmp_path / "p").stat().st_mode & 0o777 == 0o700


def test_labeling(spark):
    todo = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None)], "odino string, text string")

    def labeler(text):
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    got = {r["odino"]: (r["status"], r["attempts"], r["label"]) for r in labeling.labelled(todo, labeler, 2, 2, 0).collect()}
    assert got == {"1": ("ok", 1, "GOOD"), "2": ("failed", 2, None), "3": ("failed", 0, None)}
    cohort = spark.createDataFrame([("1", "m", "p", "i")], "odino string, model string, prompt_hash string, input_hash string").withColumn("cache_key", labeling.cache_key())
    cache = cohort.withColumns({"status": F.lit("ok"), "primary": F.lit("other"), "secondary": F.array().cast("array<string>"), "labeled_at": F.lit(1)})
    assert labeling.complete(cohort, cache).count() == 1 and labeling.undone(cohort, cache).count() == 0
    for column, value in (("status", "failed"), ("model", "n"), ("prompt_hash", "q"), ("input_hash", "j"), ("odino", "2"), ("cache_key", "k")):
        with pytest.raises(ValueError):
            labeling.complete(cohort, cache.withColumn(column, F.lit(value)))


def test_stream(spark, tmp_path):
    from tidewatch.streaming.counts import monthly_counts

    rows = "select * from values ('1', 'A', date '2018-01-03'), ('1', 'A', date '2018-01-03'), ('2', 'A', date '2018-02-01'), ('3', 'A', null) t(odino, grp, ldate)"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("odino string, grp string, ldate date").parquet(str(tmp_path / "in"))
    q = monthly_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r["month"]), r["n"]) for r in spark.table("counted").collect()} == {("2018-01-01", 1), ("2018-02-01", 1)}


def test_registered_queries_run_and_equal_their_sql(spark, sf):
    """Each query with SQL against DuckDB over whole tables of the smallest size."""
    import oracle

    from tidewatch.plans import registry

    con = oracle.connect(sf)
    said = {k: oracle.compare(spark, con, k, registry.QUERIES[k], registry.SQL[k], sf) for k in registry.SQL}
    assert {k: s for k, s in said.items() if not s.startswith("ok")} == {}


def test_command_line(capsys, tmp_path, spark, sf):
    from tidewatch import cli

    assert cli.main(["list"]) == 0 and "causal_poisson_alerts" in capsys.readouterr().out
    assert cli.main(["first_ids", sf, str(tmp_path / "out")]) == 0 and json.loads(capsys.readouterr().out) == {"query": "first_ids", "rows": 5}
    with pytest.raises(SystemExit):
        cli.main(["no_such_query", sf, str(tmp_path / "x")])
