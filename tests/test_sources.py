import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import quality as Q
from lectern.operators.collect import cursor_chain, first_seen, status_cascade
from lectern.operators.experiment import MockClient, blinded_order, extract_claims, final_text, final_text_or_original, generate, judge, verify
from lectern.sources import readers, sinks
from lectern.sources.replay import StoredPages
from lectern.streaming.bronze import collect_pages, deduplicated, windowed_events


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,note\n1,,"a ""q"", b"\n2,05,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "", 'a "q", b'), ("2", "05", "")]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2, "b": "x"}\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()] == [(1, None), (2, "x")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    rows, errors = readers.read_table(spark, str(tmp_path / "bad.jsonl"), "a int")
    assert rows.count() == 1 and [r.problem for r in errors.collect()] == ["not an object"]
    (tmp_path / "empty.jsonl").write_text("\n")
    assert [r.problem for r in readers.read_table(spark, str(tmp_path / "empty.jsonl"), "a int")[1].collect()] == ["empty"]
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}, 3]')
    rows, errors = readers.read_table(spark, str(tmp_path / "l.json"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and errors.count() == 1
    assert [r.problem for r in readers.read_table(spark, str(tmp_path / "x.yaml"))[1].collect()] == ["unknown kind"]


def test_documents_texts_sections_and_sheets(spark, tmp_path):
    for name in ("CS-01", "CS-02"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"professor_id": name, "papers": [1, 2]}))
    got = readers.read_json_documents(spark, str(tmp_path / "*.json"), "professor_id string, papers array<int>")
    assert all(r.professor_id == r.file_stem and r.papers == [1, 2] for r in got.collect()) and got.count() == 2
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("[E-1_c01] claim\nLABEL: supported\n[E-1_c02] other\nLABEL:\n")
    assert readers.read_texts(spark, str(tmp_path), [".md"]).count() == 1 and readers.file_checksums(spark, str(tmp_path)).count() == 3
    sheet = readers.read_texts(spark, str(tmp_path), [".md"])
    assert [tuple(r) for r in readers.checkbox_labels(sheet, "text").collect()] == [("E-1_c01", "supported")]
    assert readers.prompt_sections("# t\n## System\nbe kind\n## User\nhi {{x}}\n---\nend", ["System", "User"]) == {"System": "be kind", "User": "hi {{x}}"}
    with pytest.raises(ValueError):
        readers.prompt_sections("", ["System"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.00005, None), ("b", 0.12345, 2)], "k string, x double, n int")
    sinks.publish(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        sinks.publish(df, str(tmp_path / "t"))
    sinks.publish(df.limit(1), str(tmp_path / "t"), force=True)
    assert spark.read.json(str(tmp_path / "t")).count() == 1
    sinks.results_csv(df, str(tmp_path / "r"), ["n", "k", "x"])
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "r")).collect() if not x.value.startswith("n,")) == [",a,0.0", "2,b,0.1234"]
    assert sinks.union_of_columns([df, df.withColumn("y", F.lit(1))]).columns == ["k", "x", "n", "y"]
    public, private = sinks.split_public_private(df, "k", ["x"])
    assert public.columns == ["k", "n"] and private.columns == ["k", "x"]


def test_pages_are_stored_once_and_never_change(spark, tmp_path):
    pages = spark.createDataFrame([("r1", "c1"), ("r2", "c2"), ("r1", "c1")], "request_hash string, checksum string")
    path = str(tmp_path / "bronze")
    assert sinks.append_pages(pages, path) == 2 and sinks.append_pages(pages, path) == 0
    with pytest.raises(ValueError, match="change"):
        sinks.append_pages(spark.createDataFrame([("r1", "other")], pages.schema), path)
    with pytest.raises(ValueError, match="differ"):
        sinks.append_pages(spark.createDataFrame([("r9", "x"), ("r9", "y")], pages.schema), path)


def test_stream_resumes_behind_the_last_page(spark, tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    put = lambda i: (src / f"p{i:03d}.json").write_text(json.dumps({"meta": {"next_cursor": f"c{i}"}, "results": []}))
    for i in range(5):
        put(i)
    spark.dataSource.register(StoredPages)
    assert spark.read.format("stored_pages").option("path", str(src)).load().count() == 5
    table, check = str(tmp_path / "bronze"), str(tmp_path / "check")
    collect_pages(spark, str(src), table, check, 2).awaitTermination(120)
    assert spark.read.parquet(table).count() == 5
    for i in range(5, 8):
        put(i)
    collect_pages(spark, str(src), table, check, 2).awaitTermination(120)
    got = spark.read.parquet(table)
    assert got.count() == 8 and got.select("request_hash").distinct().count() == 8


def test_event_windows_batch_and_stream(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    batch = windowed_events(e)
    assert batch.agg(F.sum("n")).first()[0] == e.count()
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windowed_events(s).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = spark.table("w")
    assert 0 < closed.count() <= batch.count() and closed.select("window_start", "event_type", "n").exceptAll(batch.select("window_start", "event_type", "n")).count() == 0
    assert deduplicated(e.union(e), "event_id").count() == e.count()


def test_first_seen_cascade_and_chain(spark):
    df = spark.createDataFrame([("a", 2, "x", "u"), ("a", 1, "y", "v"), (None, 0, "z", "u"), ("b", 3, None, None)], "k string, n int, v string, d string").repartition(3)
    assert {r.k: (r.v, r.discovered_by) for r in first_seen(df, "k", ["n"], ["v"], "d").collect()} == {"a": ("y", ["u", "v"]), "b": (None, [])}
    s = df.select("n", status_cascade([(F.col("n") > 0, "zero"), (F.col("v").isNotNull(), "no_v")], "ok").alias("s"))
    assert {r.n: r.s for r in s.collect()} == {0: "zero", 1: "ok", 2: "ok", 3: "no_v"}
    chain = spark.createDataFrame([("*", "c1")] + [(f"c{i}", f"c{i + 1}") for i in range(1, 20)] + [("c20", None)], "cur string, nxt string")
    assert {r.cursor: r.steps for r in cursor_chain(chain, "cur", "nxt").collect()} == {"*": 0, **{f"c{i}": i for i in range(1, 21)}}
    with pytest.raises(ValueError, match="cycle"):
        cursor_chain(spark.createDataFrame([("*", "c1"), ("c1", "c2"), ("c2", "c1")], "cur string, nxt string"), "cur", "nxt")


def test_quality_rules(spark):
    a = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "1"), ("i", None)], "g string, m string")
    b = spark.createDataFrame([("g", "2"), ("g", "1"), ("h", "2"), ("i", None)], "g string, m string")
    assert [r.entity for r in Q.differing_sets(a, b, "g", "m", "x").collect()] == ["h"]
    assert {r.entity for r in Q.orphans(a, "m", b.filter("m = '1'"), "m", "x").collect()} == {"2"}
    assert {r.side: r.n for r in Q.unreferenced(a, b.filter("g <> 'h'"), ["g"]).collect()} == {"both": 2, "only_left": 1}
    t = spark.createDataFrame([(1, "Met Ann-Marie O'Neil today"), (2, "annmarie"), (3, None), (4, "")], "k int, t string")
    n = spark.createDataFrame([("Ann Marie O'Neil",), ("Met",), (None,), ("annmarie",)], "n string")
    assert {(r.k, r.name) for r in Q.containing_names(t, "k", "t", n, "n").collect()} == {(1, "Ann Marie O'Neil"), (2, "annmarie")}
    assert Q.report([Q.not_unique(a, "g", "u"), Q.malformed(a, "m", r"^\d$", "f"), Q.wrong_count(a, "g", 2, 2, "c")]).count() == 1 + 1 + 2


class Failing(MockClient):
    def complete(self, system, user, seed):
        if "boom" in user:
            raise RuntimeError("boom")
        return super().complete(system, user, seed)


def test_model_steps_isolate_failures(spark):
    df = spark.createDataFrame([(1, "First claim has four words. Second claim has words too."), (2, "boom"), (3, None)], "k int, t string")
    g = {r.k: r for r in generate(df, Failing(), "k", "t").collect()}
    assert g[1].error is None and g[1].out.startswith("Dear") and "boom" in g[2].error and g[3].error is None
    v = {r.k: r for r in verify(df, Failing(), "k", "t").collect()}
    assert len(v[1].out.edits) == 2 and v[2].out is None
    c = extract_claims(df, Failing(), "k", "t")
    assert {r.claim_id for r in c.collect()} == {"1_c01", "1_c02"}
    assert {r.claim_id for r in judge(c, Failing(), "k").collect()} == {"1_c01", "1_c02"}
    t = spark.createDataFrame([("o", "", True), ("o", "v", True), ("o", "v", False)], "o string, v string, a boolean")
    assert [r.x for r in t.select(final_text("o", "v", F.col("a")).alias("x")).collect()] == ["", "v", "o"]
    assert [r.x for r in t.select(final_text_or_original("o", "v").alias("x")).collect()] == ["o", "v", "v"]


def test_blinding_is_a_seeded_shuffle():
    runs = [f"CS-{i:02d}_A_1" for i in range(9)]
    order = sorted(runs)
    random.Random(42).shuffle(order)
    assert [r for r, _ in blinded_order(runs[::-1], 42)] == order and blinded_order(runs, 42)[0][1] == "E-0001"


def test_mappings_and_settings(tmp_path):
    @dataclasses.dataclass
    class Settings:
        seed: int
        share: float = 0.5
        name: str = "x"

    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"seed": 3, "share": 1}')
    bad.write_text("[1]")
    found, problems = readers.read_mapping(str(good))
    assert not problems and readers.typed_settings(found, Settings) == (Settings(3, 1), [])
    assert readers.read_mapping(str(bad))[0] == {} and len(readers.read_mapping(str(bad))[1]) == len(readers.read_mapping(str(tmp_path / "none"))[1]) == 1
    assert readers.typed_settings({"seed": True, "share": "a", "odd": 1}, Settings)[1] == ["unknown setting odd", "setting seed is no int", "setting share is no float"]
    assert readers.typed_settings({}, Settings)[1] == ["missing setting seed"]


def test_markers_sorted_keys_and_report_tables(spark, tmp_path):
    at = str(tmp_path / "marker")
    assert sinks.write_marker(spark, at, {"n": "3", "hash": "a"}) and not sinks.write_marker(spark, at, {"hash": "a", "n": "3"})
    with pytest.raises(ValueError):
        sinks.write_marker(spark, at, {"n": "4", "hash": "a"})
    df = spark.createDataFrame([(1, ((2, "x"), [(3, 4)]), None), (2, None, "a|b")], "z int, m struct<b: struct<d: int, c: string>, a: array<struct<y: int, x: int>>>, k string")
    assert sinks.sorted_keys(df).toJSON().collect()[0] == '{"m":{"a":[{"x":4,"y":3}],"b":{"c":"x","d":2}},"z":1}'
    assert sinks.sorted_keys(df).filter("z = 2").first().m is None
    assert sinks.markdown_table(df.select("z", "k").orderBy("z")) == "| z | k |\n| --- | --- |\n| 1 |  |\n| 2 | a\\|b |\n"
    with pytest.raises(ValueError):
        sinks.markdown_table(df.select("z"), 1)
