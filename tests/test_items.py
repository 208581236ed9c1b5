"""Builders of multiple-choice items, settings, queues, readers and resumable parts."""

import json

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import config, items
from corpuscle.sources import io
from corpuscle.streaming import progress, runner


def rows(df):
    return [(r["id"], r["context"], list(r["choices"]), r["gold"]) for r in df.collect()]


def test_reading_items(spark):
    schema = "pos int, " + ", ".join(f"{f} string" for f in items.READING_FIELDS)
    good = (7, "A passage.", "What?", "one", " two", "three ", "café", "2")
    assert rows(items.reading_items(spark.createDataFrame([good], schema), "pos")) == [("belebele-7", "A passage.\nCâu hỏi: What?\nTrả lời:", [" one", " two", " three", " café"], 1)]
    bad = [(1, "p", "q", "a", "b", "c", "d", "5"), (2, "p", "q", "a", None, "c", "d", "1"), (3, "p", "q", "a", " ", "c", "d", "1")]
    assert items.invalid_reading(spark.createDataFrame([good, *bad], schema)).count() == 2
    for r in bad:
        with pytest.raises(Exception, match="item"):
            rows(items.reading_items(spark.createDataFrame([r], schema), "pos"))


def test_letter_items(spark):
    d = spark.createDataFrame([(0, "x9", "Why?", "a", "b ", "c", "d", "C"), (1, None, "Who?", "a", "b", "c", "d", "A"), (2, "n", "No?", "a", " ", "c", "d", "A"), (3, "n", "No?", "a", "b", "c", "d", "E")], "pos int, sample_id string, q string, option_a string, option_b string, option_c string, option_d string, answer string")
    assert rows(items.letter_items(d, "pos", "set", "q", "Q: ", "\nA:")) == [("set-x9", "Q: Why?\nA:", [" a", " b", " c", " d"], 2), ("set-1", "Q: Who?\nA:", [" a", " b", " c", " d"], 0)]


def test_entailment_items(spark):
    d = spark.createDataFrame([(0, " It rains... ", " it is wet ", 2)], "pos int, premise string, hypothesis string, label int")
    assert rows(items.entailment_items(d, "pos")) == [("xnli-0", "It rains, đúng không?", [" Đúng, it is wet", " Ngoài ra, it is wet", " Không, it is wet"], 2)]


@pytest.mark.parametrize("written", [str, json.dumps, None])
def test_ending_items(spark, written):
    four = ["runs [x] off", "it's [title] over", "sits  down", "sleeps"]
    raw = [(0, "Dogs", "A dog barks.", "THE man", four, "1", 5), (1, "Dogs", "a", None, four[:3], "0", 5), (2, "Dogs", "a", None, four, "4", 5), (3, "Dogs", "a", None, [*four[:3], "[x]"], "0", 5)]
    kind = "string" if written else "array<string>"
    raw = [(*r[:4], written(r[4]) if written else r[4], *r[5:]) for r in raw]
    d = spark.createDataFrame(raw, f"pos int, activity_label string, ctx_a string, ctx_b string, endings {kind}, label string, ind int")
    assert rows(items.ending_items(d, "pos", "hs")) == [("hs-0-5", "Dogs: A dog barks. The man", [" runs off", " it's. over", " sits down", " sleeps"], 1)]


def test_settings():
    assert config.parse_condition("super-nfc") == ("super", "nfc") and config.layers("0,-1,2", 4) == [0, 2, 3] and config.layers("all", 2) == [0, 1]
    assert config.job_tag(["a", "b"]) == "a-b" and len(config.job_tag(["name"] * 99)) < 50 and config.named_paths(["a=x=y"]) == {"a": "x=y"}
    cpt = {"bpe": 4.0, "super": 5.0}
    assert config.training_config(cpt, "super", "bpe", 10 * 64 * 1024, 32) == {"sequence_length": 816, "device_batch": 32, "total_batch": 64 * 816, "base_batch": 65536, "steps": 10}
    assert config.non_embedding_parameters(6, 64, 100) == 12 * 400**2 * 6
    job = config.Job("g", 2, 8, 100)
    assert job.approved({"g": 0.01, "cpu": 0.001, "memory_gib": 0.0001}, 2.0) == pytest.approx(1.28)
    config.check_versions({"x": "1.10.0+cu1"}, {"x": "1.9"})
    plan = {"score": {}, "sets": {"s": {}}, "jobs": {"j": {"model": "m", "tokenizer": "t", "sets": "s", "out": "o"}}}
    run = {"model": "m", "base_tokenizer": "t", "conditions": {"c": {"tokenizer": "t", "seed": 1}}, "train": {}, "score": {}, "streams": {"1": "x"}}
    assert config.check_plan(plan) == plan and config.check_run(run) == run
    refused = [
        lambda: config.parse_condition("other-nfc"), lambda: config.layers("0,0", 4), lambda: config.layers("4", 4), lambda: config.named_paths(["a=x", "a=y"]),
        lambda: config.training_config(cpt, "super", "bpe", 10 * 64 * 1024, 48), lambda: config.training_config(cpt, "super", "bpe", 9, 32), lambda: config.training_config({}, "super", "bpe", 9, 32),
        lambda: job.approved({"g": 0.01, "cpu": 0.001, "memory_gib": 0.0001}, 1.0), lambda: config.check_plan(plan | {"sets": {}}), lambda: config.check_run(run | {"shards": []}),
        lambda: config.check_run(run | {"streams": {"0": "x"}}), lambda: config.check_run(run | {"odd": 1}),
    ]
    for f in refused:
        with pytest.raises(ValueError):
            f()
    with pytest.raises(RuntimeError):
        config.check_versions({"x": "1.8"}, {"x": "1.9"})


def test_queue():
    made, now = {"old"}, [0.0]

    def step(name, cost=1.0, fail=False, makes=True):
        def run(left):
            if fail:
                raise OSError("no disk")
            now[0] += cost
            if makes:
                made.add(name)

        return runner.Step(name, lambda: name in made, run)

    queue = {"a": [step("old"), step("a1")], "b": [step("b1", fail=True)], "c": [step("c1", makes=False)], "d": [step("d1", 10), step("d2")], "e": [step("e1")]}
    out = runner.run_queue(queue, 5.0, lambda: now[0])
    assert out["a"] == {"status": "done", "ran": ["a1"]} and out["b"] == {"status": "failed", "error": "OSError: no disk"} and out["c"]["status"] == "failed"
    assert out["d"] == {"status": "incomplete", "at": "d2"} and out["e"] == {"status": "not started"} and runner.exit_code(out) == 1
    assert runner.exit_code(runner.run_queue({"d": queue["d"], "e": queue["e"]}, 100.0, lambda: now[0])) == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one half\ntwo\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n{"text": "y"}\n', encoding="utf-8")
    assert [r[0] for r in io.corpus_texts(spark, str(tmp_path / "a.txt")).collect()] == ["one half", "two"]
    assert [r[0] for r in io.corpus_texts(spark, str(tmp_path / "b.jsonl")).collect()] == ["x\n\n", "y\n\n"]
    spark.createDataFrame([("t", 1)], "text string, other int").write.parquet(str(tmp_path / "p"))
    assert io.parquet_texts(spark, [str(tmp_path / "p")]).columns == ["text", "file"]
    io.write_shards(spark.createDataFrame([(0, "a"), (1, "b")], "shard int, text string"), str(tmp_path / "s"))
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.is_dir()) == ["shard=0", "shard=1"]
    for name in ("r1/x_d6_s0.json", "r2/x_d8_s0.json"):
        (tmp_path / "runs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / name).write_text('{"step": 1}')
    found = io.run_files(spark, str(tmp_path / "runs"), "step int", r"x_d\d+_s\d+")
    assert sorted(r["key"] for r in found.collect()) == ["x_d6_s0", "x_d8_s0"]
    assert sorted(io.run_folders(spark, str(tmp_path / "runs"), r"/(r\d)/x_d\d_s0\.json")) == ["r1", "r2"]
    (tmp_path / "runs" / "r3").mkdir()
    (tmp_path / "runs" / "r3" / "x_d6_s0.json").write_text('{"step": 2}')
    for f in (lambda: io.run_files(spark, str(tmp_path / "runs"), "step int", r"x_d\d+_s\d+"), lambda: io.run_folders(spark, str(tmp_path / "runs"), r"/r\d/(x_d\d_s0)\.json")):
        with pytest.raises(ValueError):
            f()
    log = spark.createDataFrame([(s,) for s in range(5)], "step int")
    assert progress.truncate_log(log, "step", 3).count() == 3
    assert io.markdown(spark.createDataFrame([("a|b", 0.5, None)], "n string, v double, w int")) == "| n | v | w |\n| - | - | - |\n| a\\|b | 0.5 |  |"
    file = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split"}, {"type": "ByteLevel"}]}}
    def write(change):
        (tmp_path / "t.json").write_text(json.dumps(file | change))
        return io.tokenizer_tables(spark, str(tmp_path / "t.json"))

    vocab, merges = write({})
    assert vocab.count() == 3 and [tuple(r) for r in merges.collect()] == [(0, "a", "b")]
    for change in ({"model": {"type": "WordPiece"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split"}, {"type": "Split"}, {"type": "ByteLevel"}]}}, {"model": file["model"] | {"merges": ["a b c"]}}):
        with pytest.raises(ValueError):
            write(change)


def test_parts_extend_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([(u, k, f"text {u} {k} " + "w" * (5 + k)) for u in range(6) for k in range(4)], "unit long, doc long, text string")
    held = spark.createDataFrame([("text 2 1 " + "w" * 6,)], "t string").select(F.sha2(F.col("t").cast("binary"), 256).alias("digest"))
    read = lambda folder: [(r["part"], tuple(r["units"]), r["docs"], r["skipped"], r["chars"], r["digest"]) for r in progress.read_parts(spark, folder).orderBy("part").collect()]
    short, whole = str(tmp_path / "short"), str(tmp_path / "whole")
    progress.extend_parts(spark, docs, short, 3, "s", 100, 150, held)
    progress.extend_parts(spark, docs, whole, 3, "s", 100, 300, held)
    texts = lambda folder: [r["text"] for part in read(folder) for r in spark.read.parquet(f"{folder}/part={part[0]}").orderBy("pos").collect()]
    first, start = read(short), texts(short)
    assert 1 < len(first) and texts(whole)[: len(start)] == start and len(start) < len(texts(whole))
    # A part that a crash left is written anew; a longer call goes on where the shorter one ended.
    spark.range(3).write.parquet(f"{short}/part={len(first)}")
    progress.extend_parts(spark, docs, short, 3, "s", 100, 300, held)
    assert read(short)[: len(first)] == first and texts(short)[: len(texts(whole))] == texts(whole)[: len(texts(short))]
    assert sum(r[4] for r in read(short)) >= 300 and sum(r[3] for r in read(short)) <= 1
    with pytest.raises(ValueError, match="another seed"):
        progress.extend_parts(spark, docs, short, 4, "s", 100, 300, held)
    with pytest.raises(ValueError, match="holds only"):
        progress.extend_parts(spark, docs.limit(0), str(tmp_path / "big"), 3, "s", 100, 300, held)
    spark.read.parquet(f"{whole}/part=1").limit(1).write.mode("overwrite").parquet(f"{short}/part=0")
    with pytest.raises(ValueError, match="changed"):
        progress.extend_parts(spark, docs, short, 3, "s", 100, 300, held)
    with progress.Lock(spark, whole), pytest.raises(RuntimeError):
        progress.extend_parts(spark, docs, whole, 3, "s", 100, 300, held)
    rows = spark.createDataFrame([(k, "x") for k in range(5)], "i long, v string")
    assert [progress.committed(spark, rows.filter(f"i < {n}"), str(tmp_path / "log"), "i") for n in (3, 3, 5)] == [3, 0, 2]


@pytest.mark.parametrize("cut", [0, 1, 5, 9])
def test_packing_resumes(spark, cut):
    from corpuscle.operators.bpe import pack

    d = spark.createDataFrame([(k, [f"{k}.{j}" for j in range(3 + k % 4)]) for k in range(10)], "pos long, t array<string>")
    want = sorted(map(tuple, pack(d, "pos", "t", "<e>", 2, 3).collect()))
    first, state = progress.pack_resumed(d.filter(f"pos < {cut}"), "pos", "t", "<e>", 2, 3)
    state = json.loads(json.dumps(state))
    second, _ = progress.pack_resumed(d, "pos", "t", "<e>", 2, 3, state)
    assert sorted(map(tuple, first.unionByName(second).collect())) == want
    with pytest.raises(ValueError):
        progress.pack_resumed(d, "pos", "t", "<e>", 2, 1)
