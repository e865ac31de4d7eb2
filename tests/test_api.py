"""The public surface, batch runs, streams, files and retrieval, run to their end on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.api import Engine
from cloakframe.config import EngineConfig, Preferences
from cloakframe.functions import crypto
from cloakframe.operators import batch, rag, state
from cloakframe.operators.rewrite import anonymise, inverted, mask, surrogate_rows
from cloakframe.sources import io
from cloakframe.streaming.sessions import mask_stream

ROWS = [(1, "a", "My name is Ashley Wise, mail ashley@x.org"), (2, "a", "Ashley Wise lives in Springfield, SSN 123-45-6789"), (3, "b", "My name is Ashley Wise"), (4, "b", None), (5, None, "call 555-867-5309"), (6, "b", "nothing"), (6, "b", "nothing")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, s string, text string").withColumns({"pairs": F.lit(1), "confirmed": F.lit("x"), "sanitized_": F.lit(2)})


def test_mask_shares_a_session_and_repeats_itself(rows):
    engine = Engine()
    got, state_ = engine.mask(rows, "s")
    assert got.columns == [*rows.columns, "sanitized"] and got.count() == len(ROWS)
    clean = {r.id: r.sanitized for r in got.collect()}
    pairs = {(r.session, r.original): r.surrogate for r in state_.collect()}
    assert set(pairs) == {("a", "Ashley Wise"), ("a", "ashley@x.org"), ("a", "Springfield"), ("a", "123-45-6789"), ("b", "Ashley Wise"), ("", "555-867-5309")}
    assert pairs["a", "Ashley Wise"] in clean[1] and pairs["a", "Ashley Wise"] in clean[2] and pairs["b", "Ashley Wise"] in clean[3] and pairs["a", "Ashley Wise"] != pairs["b", "Ashley Wise"]
    assert clean[4] is None and clean[6] == "nothing" and "Ashley" not in clean[1] + clean[2] + clean[3]
    again, after = engine.mask(rows, "s", state=state_)
    assert {r.id: r.sanitized for r in again.collect()} == clean and after.count() == state_.count()
    back = engine.unmask(got, "s", "sanitized", state_)
    assert {r.id: r.resolved for r in back.collect()} == {i: t for i, _, t in ROWS}
    assert {r.session for r in engine.flush(state_, "a").collect()} == {"b", ""}
    assert engine.mask(rows.limit(0), "s")[0].count() == 0


def test_unmask_takes_replies_of_services(spark, rows):
    engine = Engine()
    _, state_ = engine.mask(rows, "s")
    name = next(r.surrogate for r in state_.collect() if r.session == "a" and r.original == "Ashley Wise")
    replies = spark.createDataFrame([(1, "a", json.dumps({"content": [{"text": f"Hi {name}!"}]})), (2, "z", "as it is"), (3, "a", None)], "id long, s string, reply string")
    assert {r.id: r.resolved for r in engine.unmask(replies, "s", "reply", state_).collect()} == {1: "Hi Ashley Wise!", 2: "as it is", 3: None}


def test_scan_lists_types_that_are_switched_off(spark):
    df = spark.createDataFrame([("mail a@b.org",), (None,)], "text string")
    engine = Engine(EngineConfig(pii_off=("email",)))
    assert [r.found for r in engine.scan(df).collect()] == [{"a@b.org": "email"}, {}]
    assert engine.mask(df.withColumn("s", F.lit("x")), "s")[0].first().sanitized == "mail a@b.org"


def test_persistent_sessions(spark, rows, tmp_path):
    engine = Engine(EngineConfig(state_dir=str(tmp_path)))
    first = {r.id: r.sanitized for r in engine.mask(rows, "s")[0].collect()}
    # Another engine has another key for its surrogates; those that are known stay.
    other = Engine(EngineConfig(state_dir=str(tmp_path)))
    assert {r.id: r.sanitized for r in other.mask(rows, "s")[0].collect()} == first
    assert {r.resolved for r in other.unmask(spark.createDataFrame([("a", first[1])], "s string, reply string"), "s", "reply").collect()} == {ROWS[0][2]}
    other.flush(other.load(spark), "a")
    assert {r.session for r in engine.load(spark).collect()} == {"b", ""}
    raw = b"".join(p.read_bytes() for p in tmp_path.rglob("*.parquet"))
    assert b"Ashley" not in raw
    (tmp_path / "secret.key").write_bytes(b"z" * 32)
    assert engine.load(spark).count() == 0


def test_turns_with_context(spark):
    config = EngineConfig(salt="t")
    store = rag.index(spark.createDataFrame([(0, "The garden needs water"), (1, "My name is Marcus Ellison and I grow roses"), (2, "Trains leave at noon")], "doc_id long, text string"), config=config)
    held = store.collect()
    assert len(held) == 3 and not any("Marcus" in r.chunk for r in held) and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in held)
    messages = spark.createDataFrame([(1, "s", "When do trains leave, Ashley Wise?"), (2, "s", None)], "id long, s string, text string")
    got = {r.id: r for r in Engine(config.with_options(rag_top_k=1)).turns(messages, "s", "text", chunks=spark.createDataFrame(held, store.schema))[0].collect()}
    assert "Trains leave at noon" in got[1].sent and "Ashley" not in got[1].sent and "Ashley Wise" in got[1].restored and got[2].sent is None


def test_hundreds_of_rows_of_one_session(spark):
    df = spark.range(500).select("id", F.lit("one").alias("s"), F.concat(F.lit("My name is Ashley Wise, mail u"), "id", F.lit("@x.org")).alias("text"))
    got, state_ = Engine().mask(df, "s")
    assert state_.count() == 501 == state_.select("surrogate").distinct().count() and got.filter("sanitized LIKE '%Ashley%' OR sanitized LIKE '%@x.org%'").count() == 0


def test_mask_as_one_projection(spark, rows):
    df = rows.select("id", "s", "text").withColumn("known", F.array(F.struct(F.lit("Ashley Wise").alias("original"), F.lit("Vera Dorn").alias("surrogate"))))
    got = {r.id: r for r in mask(df, "s", known="known").collect()}
    assert "Vera Dorn" in got[1].sanitized and [p.original for p in got[1].pairs] == ["ashley@x.org"] and got[4].sanitized is None
    assert anonymise(rows.select("id", "s", "text"), "s").columns == ["id", "s", "text"]
    asks = spark.createDataFrame([("x", "What restaurants are near 1126 E Apache Blvd, Tempe, AZ?")], "s string, text string")
    r = mask(asks, "s").first()
    assert r.is_service and r.sanitized in [f"What restaurants are near {n} E Apache Blvd, Tempe, AZ?" for n in (1125, 1127)] and [e.type for e in r.confirmed] == []


def test_surrogates_beside_known_ones(spark):
    df = spark.createDataFrame([("s", "PERSON", f"Name {i}") for i in range(300)], "session string, type string, text string")
    config = EngineConfig(salt="k")
    drawn = {r.original: r.surrogate for r in surrogate_rows(df, "session", config).collect()}
    known = spark.createDataFrame([("s", "Old", drawn["Name 7"]), ("t", "Other", drawn["Name 8"])], "session string, original string, surrogate string")
    got = {r.original: r.surrogate for r in surrogate_rows(df, "session", config, known).collect()}
    assert len(got) == 300 and got["Name 7"] != drawn["Name 7"] and {k: v for k, v in got.items() if k != "Name 7"} == {k: v for k, v in drawn.items() if k != "Name 7"}
    pairs = spark.createDataFrame([([("a", "x"), ("b", "y"), ("c", "x")],)], "p array<struct<original:string,surrogate:string>>")
    assert pairs.select(inverted(F.col("p")).alias("m")).first().m == {"x": "c", "y": "b"}


# --- batch runs -----------------------------------------------------------------------------------------


def test_batch_fields_and_reasons(spark):
    q = spark.createDataFrame([(0, "What restaurants are near 12 Oak St, Tempe, AZ for Ashley Wise?"), (1, "Give me the taxes of Wyoming"), (2, None)], "idx long, input string")
    got = {r.idx: r for r in batch.run_batch(q).collect()}
    kept = {(r.value, r.reason) for r in got[0].recognized_not_replaced}
    assert ("12 Oak St, Tempe, AZ", "service_query_fuzzed") in kept and got[0].pii_detail["12 Oak St, Tempe, AZ"].surrogate_status == "fuzzed"
    assert [(r.value, r.reason) for r in got[1].recognized_not_replaced] == [("Wyoming", "topical_geo_filtered")] and got[1].sanitized_input == "Give me the taxes of Wyoming"
    assert got[2].question == "" and got[2].surrogate_map == {} and got[0].final_output == got[0].question and got[0].stage_timings_ms.total_ms > 0
    assert batch.run_batch(q, ("confirmed_pii",)).columns == ["idx", "confirmed_pii"]
    with pytest.raises(ValueError):
        batch.run_batch(q, ("odd",))
    other = lambda text: F.array(F.struct(F.lit("?").alias("text"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("WORD").alias("type"), F.lit(0.5).alias("score"), F.lit("o").alias("source")))
    assert batch.run_batch(q, ("presidio_sanitized_input",), baseline=other).filter("idx = 1").first()[1] == "[WORD] me the taxes of Wyoming"
    scored = batch.text_scores(spark.createDataFrame([("a b", "b c"), (None, "x")], "llm_response string, final_output string"), batch.word_overlap).collect()
    assert scored[0].scores.f1 == 0.5 and scored[1].scores is None


def test_rows_that_fail_have_their_error(spark):
    class Fails:
        def find(self, text):
            if "boom" in text:
                raise RuntimeError("no model")
            return []

    q = spark.createDataFrame([(0, "boom a@b.org"), (1, "a@b.org")], "idx long, input string")
    got = {r.idx: r for r in batch.run_batch(q, recognizer=Fails()).drop("stage_timings_ms").collect()}
    assert got[0].error == "RuntimeError: no model" and got[0].sanitized_input is None and got[0].surrogate_map == {} and got[1].error is None and got[1].final_output == "a@b.org"


def test_a_broken_run_goes_on(spark, tmp_path):
    q = spark.createDataFrame([(i, f"mail u{i}@x.org") for i in range(60)], "idx long, input string")
    path = f"{tmp_path}/answers"
    batch.run_batch(q.filter("idx < 10"), ("question", "sanitized_input")).write.parquet(path)
    got = batch.run_in_steps(spark, q, path, every=25, fields=("question", "sanitized_input"))
    assert sorted(r.idx for r in got.collect()) == list(range(60)) and got.filter("sanitized_input LIKE '%@x.org'").count() == 0
    assert batch.run_in_steps(spark, q, path, fields=("question", "sanitized_input")).count() == 60


def test_services_are_asked_again(spark, tmp_path):
    mark = tmp_path / "calls"
    mark.mkdir()

    def send(prompt):
        n = len(list(mark.iterdir()))
        (mark / str(n)).touch()
        if n < 2:
            raise OSError("busy")
        return prompt.upper()

    df = spark.createDataFrame([("a",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(batch.patiently(send, wait=lambda s: None)(F.col("t"))).collect()] == ["A", None]


# --- streams --------------------------------------------------------------------------------------------


def test_a_stream_of_messages_keeps_its_sessions(spark, tmp_path):
    one = [("a", 0, "My name is Ashley Wise"), ("a", 1, "Ashley Wise again"), ("b", 0, None)]
    two = [("a", 2, "bye, Ashley Wise and Marcus Ellison"), ("b", 1, "mail a@b.org")]
    got = {}
    for k, data in enumerate((one, two)):
        spark.createDataFrame(data, "conv_id string, turn long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("conv_id string, turn long, text string").parquet(f"{tmp_path}/in")
        query = mask_stream(stream, config=EngineConfig(salt="s")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {(r.session, r.turn): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    name = got["a", 0].sanitized.removeprefix("My name is ")
    assert got["a", 1].sanitized == f"{name} again" and got["a", 2].sanitized.startswith(f"bye, {name} and ") and "Marcus" not in got["a", 2].sanitized
    assert got["a", 2].n_pairs == 2 and got["b", 0].sanitized == "" and got["b", 1].n_pairs == 1


# --- files ----------------------------------------------------------------------------------------------


def test_files_of_questions_keys_and_answers(spark, tmp_path):
    names = [str(tmp_path / x) for x in ("q.json", "k.json", "a.json")]
    for name, data in zip(names, ([{"input": "é"}, {"input": "b"}], [{"Question": "é", "Answer-Key": {"name": "Ann"}}, {"Question": "b", "Answer-Key": ""}], [{"question": "é", "surrogate_map": {"Ann": "Vera"}, "error": None}, {"error": "x"}])):
        open(name, "w").write(json.dumps(data, indent=2))
    q, k, a = io.read_evaluation(spark, *names)
    assert [tuple(r) for r in q.orderBy("idx").collect()] == [(0, "é"), (1, "b")]
    assert [r.answer_key for r in k.orderBy("idx").collect()] == ['{"name":"Ann"}', ""]
    assert [(r.surrogate_map, r.error) for r in a.orderBy("idx").collect()] == [({"Ann": "Vera"}, None), (None, "x")]
    assert [r.idx for r in io.remaining(q, a.filter("idx = 0")).collect()] == [1]
    assert json.loads(io.as_array(q).first().value) == [{"input": "é"}, {"input": "b"}]
    open(names[2], "w").write("[]")
    with pytest.raises(ValueError):
        io.read_evaluation(spark, *names)
    io.write_rows(q, f"{tmp_path}/rows")
    assert spark.read.json(f"{tmp_path}/rows").count() == 2
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("two\nlines")
    assert [r.text for r in io.read_texts(spark, f"{tmp_path}/texts").collect()] == ["two\nlines"]
    io.append_vectors(q, f"{tmp_path}/v")
    io.append_vectors(q, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 4


def test_sealed_conversations(spark, tmp_path):
    secret = b"k" * 32
    chat = json.dumps({"id": "c1", "created": "2024-01-01", "rag_mode": True, "messages": [{"role": "user", "content": "x", "timestamp": "t"}] * 3})
    rows = spark.createDataFrame([("c1", chat)], "session string, text string")
    sealed = rows.withColumn("k", crypto.derived_key(secret, F.col("session"))).select(crypto.seal(F.encode("text", "UTF-8"), F.col("k"))).first()[0]
    for name, data in (("c1.bin", bytes(sealed)), ("c2.json", chat.replace("c1", "c2").encode()), ("c3.bin", b"\x00\xff" * 40)):
        (tmp_path / name).write_bytes(data)
    got = [tuple(r) for r in io.summaries(io.opened(io.read_sealed(spark, str(tmp_path)), secret)).collect()]
    assert got == [("c1", "c1", "2024-01-01", 3, True), ("c2", "c2", "2024-01-01", 3, True), ("c3", None, None, 0, False)]


def test_secrets_and_settings(tmp_path):
    path = str(tmp_path / "secret")
    assert crypto.device_secret(path) == crypto.device_secret(path) and crypto.device_secret(None) != crypto.device_secret(None) and (tmp_path / "secret").stat().st_mode & 0o777 == 0o600
    (tmp_path / "s.json").write_text("{broken")
    p = Preferences.load(str(tmp_path / "s.json"))
    assert p.values == Preferences.DEFAULTS
    Preferences({**p.values, "detailed_view": False}).save(str(tmp_path / "s.json"))
    assert Preferences.load(str(tmp_path / "s.json")).values["detailed_view"] is False


# --- retrieval ------------------------------------------------------------------------------------------


def test_nearest_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 5)).astype(float)
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 5), (902, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    q = df.filter("vec_id < 25").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    some = np.linalg.norm(v, axis=1) > 0
    want = {}
    for i in range(25):
        if some[i]:
            s = np.round(unit @ unit[i], 6)
            want |= {(i, rank + 1): (j, s[j]) for rank, j in enumerate(sorted(np.flatnonzero(some), key=lambda j: (-s[j], j))[:4])}
    for most, cells in ((10_000, 1 << 20), (7, 64)):
        monkeypatch.setattr(rag, "MOST_QUERIES", most)
        monkeypatch.setattr(rag, "CELLS", cells)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rag.top_k_each(q, df, 4).collect()}
        assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert rag.top_k_each(q.limit(0), df).count() == 0
    one = rag.top_k(df.filter("vec_id < 300"), data[3][1], 4).collect()
    assert [r.vec_id for r in one] == [want[3, k][0] for k in range(1, 5)]


def test_numbers_of_chunks(spark):
    df = spark.createDataFrame([(5, "x" * 1000), (9000, "short"), (7, ""), (8, None), (9001, "y" * 513)], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.chunk_id) for r in rag.numbered_chunks(df).collect())
    assert got == [(5, 0, "doc_0_0"), (5, 1, "doc_1_1"), (5, 2, "doc_2_2"), (7, 0, "doc_3_0"), (9000, 0, "doc_4_0"), (9001, 0, "doc_5_0"), (9001, 1, "doc_6_1")]
    odd = df.filter("doc_id < 9000").unionByName(df.filter("doc_id = 9000").withColumn("doc_id", F.lit(None).cast("long")))
    assert {(r.doc_id, r.chunk_id) for r in rag.numbered_chunks(odd).collect()} == {(None, "doc_0_0"), (5, "doc_1_0"), (5, "doc_2_1"), (5, "doc_3_2"), (7, "doc_4_0")}


def test_state_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"o{i}", f"s{i}", i) for i in range(30)], state.STATE)
    for n in (1, 2, 3, 4):
        assert state.save(rows.filter(f"seq < {n}"), str(tmp_path), b"k" * 32).count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("state-")) == ["state-3", "state-4"]
    assert state.update(rows, spark.createDataFrame([("a", "new", "s1")], "session string, original string, surrogate string")).filter("surrogate = 's1'").collect()[0].original == "new"
