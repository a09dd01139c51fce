import hashlib

import pytest
from pyspark.sql import functions as F

from sievework.operators import chat, filters, generation, labels, selection
from sievework.operators.rows import KEY, OCC, SPLIT, Context, Refused, StepResult, assemble, conservation, rekey, row_key, row_key_of
from sievework.plans import recipe
from sievework.sources import readers, writers

CTX = Context(("text",), seed=5)


def made(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    kinds = {"label": "string", "score": "double", "grp": "string"}
    df = spark.createDataFrame(rows, "id long, text string" + "".join(f", {k} {kinds[k]}" for k in more))
    return assemble([("s", "train", df)], ["text"], "id")


def test_keys_normalise_and_agree(spark):
    def digest(body):
        return hashlib.sha256(("dw.rowkey/v1\n" + body).encode()).hexdigest()

    assert row_key_of({"text": " a\r\nb "}) == digest('{"text":"a\\nb"}') == row_key_of({"text": "a\nb"})
    assert row_key_of({"text": "café"}) == row_key_of({"text": "café"})
    assert row_key_of({"b": 1, "a": None}) == digest('{"a":null,"b":1}')
    df = spark.createDataFrame([(" x\r\n\"q\"\\ é\t1 ",), (None,), ("",), ("plain",)], "text string")
    both = df.select(row_key(df, ["text"]).alias("a"), row_key(df, ["text"], composed=True).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    with pytest.raises(Refused):
        row_key_of({"x": float("nan")})


def test_occurrences_number_copies(spark):
    d = made(spark, ["a", "b", "a", "a "])
    assert [r[OCC] for r in d.where("text like 'a%'").orderBy("id").collect()] == [0, 1, 2]


def test_assembly_refuses_a_clash_and_fills(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, text string"), spark.createDataFrame([(1, "y", 2.0)], "id long, text string, score double")
    assert assemble([("a", "train", a), ("b", "test", b)], ["text"], "id").where("score is null").count() == 1
    with pytest.raises(Refused, match="input_schema_conflict"):
        assemble([("a", "train", a), ("b", "test", b.withColumn("text", F.lit(1)))], ["text"], "id")


def test_rekeyed_rows_take_free_occurrences(spark):
    d = made(spark, ["a", "a", "b", "c"]).where("not (text = 'a' and _dw_occurrence = 0)").withColumn("text", F.lit("a"))
    assert sorted(r[OCC] for r in rekey(d, ["text"]).collect()) == [0, 1, 2]


def test_accounting_finds_wrong_steps(spark):
    d = made(spark, ["a", "b", "c"])
    good = filters.metadata_value_filter(d, CTX, "text", ["a"])
    assert not any(conservation(d, good).values())
    assert conservation(d, StepResult(good.output.limit(1), good.events))["lost"] == 1
    assert conservation(d.where("text = 'a'"), StepResult(d, good.events.limit(0)))["from_nowhere"] == 2


def test_groups_across_splits_stay(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "id long, text string")
    d = assemble([("s", "train", a.where("id <> 4")), ("s", "test", a.where("id = 4"))], ["text"], "id")
    r = selection.dedup_exact(d, CTX)
    assert sorted(x["id"] for x in r.output.collect()) == [1, 3, 4] and r.report["spanning_groups"].count() == 1


def test_balancers_refuse(spark):
    d = made(spark, list("abcd"), label=["x", "x", "y", None])
    with pytest.raises(Refused, match="label_has_nulls"):
        selection.label_balancer(d, CTX)
    with pytest.raises(Refused, match="single_class"):
        selection.label_balancer(d.where("label = 'x'"), CTX)
    with pytest.raises(Refused, match="empty_cell"):
        selection.cell_balancer(made(spark, list("abc"), label=["x", "y", "x"], grp=["p", "p", "q"]), CTX, "grp")


def test_sample_and_split_sizes(spark):
    d = made(spark, [f"t{i}" for i in range(101)])
    assert selection.sample(d, CTX, count=7).output.count() == 7
    assert selection.sample(d, CTX, mode="fraction", fraction=0.005).output.count() == 1
    s = selection.split(d, CTX, ("train", "a", "b"), (0.5, 0.3, 0.2), held_out=())
    assert {r[SPLIT]: r["count"] for r in s.output.groupBy(SPLIT).count().collect()} == {"train": 51, "a": 30, "b": 20}


def test_allocation():
    assert selection.largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    assert selection.proportional_allocation({"a": 98, "b": 1, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}


def test_rule_language_nulls(spark):
    d = made(spark, list("abc"), score=[1.0, None, 3.0], label=["x", None, "y"])
    r = labels.rule_label(d, CTX, ["low if score < 2", "odd if label not in ['x']", "rest if score >= 0"], "tag").output.orderBy("id").collect()
    assert [x["tag"] for x in r] == ["low", "odd", "odd"]
    with pytest.raises(Refused):
        labels.rule_label(d, CTX, ["nonsense"], "tag")


def test_patterns(spark):
    d = made(spark, ["ab1 AB2", "none"])
    r = labels.regex_match(d, CTX, "text", r"ab\d$", ignore_case=True).output.orderBy("id").collect()
    assert r[0]["rx_count"] == 1 and r[0]["rx_start"] == 4 and not r[1]["rx_matched"]
    for bad in (r"(?=a)", r"(a)\1", r"a++"):
        with pytest.raises(Refused):
            labels.compile_pattern(bad)
    near = labels.phrase_proximity(labels.regex_match(made(spark, ["key é 123 x"]), CTX, "text", r"\d+").output, CTX, "text", ["key", "x"], "rx_start", "rx_end").output.first()
    assert (near["pp_phrase"], near["pp_distance"], near["pp_side"]) == ("x", 1, "right")


def test_rule_set(spark):
    doc = {"signals": {"n": {"kind": "pattern", "pattern": r"\d+"}, "w": {"kind": "pattern", "pattern": "no \\d+"}}, "vetoes": [{"signal": "n", "by": ["w"]}], "outputs": {"n": {"of": "n", "take": "count"}, "near": {"expression": {"within_n": {"a": "n", "b": "w", "n": 3}}, "take": "fired"}}}
    r = labels.rule_set(made(spark, ["1 no 2", "no 3"]), CTX, doc, "text").output.orderBy("id").collect()
    assert [(x["rs_n"], x["rs_near"], x["rs_vetoed"]) for x in r] == [(1, True, True), (0, False, True)]


def test_truth_table_shadow():
    with pytest.raises(Refused, match="shadowed"):
        labels.truth_table(["a"], [{"label": "x"}, {"a": "1", "label": "y"}])


def test_chats(spark):
    assert chat.parse_chat('[{"role":"human","content":"hi"}]') == ([{"role": "user", "content": "hi"}], None)
    assert chat.parse_chat('[{"role":"user","content":"hi","x":1}]')[1] == "chat_json_not_a_chat"
    assert chat.parse_chat("{")[1] == "chat_json_unparseable" and chat.parse_chat('"hi"', "user_turn")[0]
    d = made(spark, ['[{"from":"gpt","value":"a"}]', "{", "[]"])
    r = chat.chat_json_parser(d, CTX, ["text"])
    assert r.output.count() == 1 and {x["reason_code"] for x in r.events.where("kind = 'dropped'").collect()} == {"chat_json_unparseable", "chat_json_not_a_chat"}
    assert not any(conservation(d, r).values())


def test_edit_size():
    assert generation.edit_size("a b c", "a x c", "words") == 1 and generation.edit_size("abc", "abc", "chars") == 0


def test_recipe_refuses(spark):
    d = made(spark, list("ab"))
    for step in ({"operator": "nope", "version": "1"}, {"operator": "length_band", "version": "1.0.0", "params": {"typo": 1}}, {"operator": "ngram_repetition", "version": "1.0.0", "params": {"n": 99}}):
        with pytest.raises(Refused):
            recipe.run_recipe(spark, d, [step])
    again = {}
    steps = [{"operator": "length_band", "version": "1.0.0", "params": {"min_length": 1}}]
    recipe.run_recipe(spark, d, steps, reuse=again)
    assert recipe.run_recipe(spark, d, steps, reuse=again).output.count() == 2 and len(again) == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"text":"x"}\n\n{"id":2,"text":"y"}\n')
    assert readers.sniff(spark, str(tmp_path / "a.jsonl")) == "jsonl" and readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"id":1}\n[2]\n')
    with pytest.raises(Refused, match="upload_malformed"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "c.csv").write_text('id,text\n1,"a, ""b"""\n2,\n')
    got = readers.read_csv(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert got[0]["text"] == 'a, "b"' and got[1]["text"] == ""
    (tmp_path / "d.csv").write_text("id,text\n1,a,b\n")
    with pytest.raises(Refused, match="upload_malformed"):
        readers.read_csv(spark, str(tmp_path / "d.csv"))
    d = made(spark, ["a", "b"], label=["x", "y"])
    m = writers.write_export(d, "detector", str(tmp_path / "out"))
    assert m["rows"] == {"train": 2} and spark.read.parquet(str(tmp_path / "out/data")).columns[:2] == ["text", "label"]
    writers.write_version(d, str(tmp_path / "v"), ["test"])
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_streaming_gives_the_batch_answer(spark, tmp_path):
    from sievework.streaming.runner import run_stream, transform

    d = made(spark, ["a" * i for i in range(1, 30)])
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    steps = [{"operator": "length_band", "version": "1.0.0", "params": {"min_length": 10}}]
    q = run_stream(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), steps, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == transform(d, steps).count() == 20
    with pytest.raises(Refused):
        transform(d, [{"operator": "dedup_exact", "version": "1.0.0"}])
