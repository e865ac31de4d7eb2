"""The privacy engine: cases of detection, rewriting, restoring, state and evaluation."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakframe.config import EngineConfig, expand_types
from cloakframe.functions import crypto, patterns, spanlist, stats
from cloakframe.operators import attack, evaluate, rag, recognizers, resolve, risk, scan, service, state
from cloakframe.operators.rewrite import surrogate_rows
from cloakframe.plans import catalogue

CASES = [
    ("email me at test@example.com", ["email"]), ("SSN is 123-45-6789", ["ssn"]), ("card 4532015112830366", ["credit_card"]), ("card 1234567890123456", []), ("call +1-555-867-5309", ["phone_us"]), ("ring +44 7911 123456", ["phone_uk"]),
    ("host 192.168.1.100 up", ["ip_address"]), ("key ghp_abcdefghijklmnopqrstuvwx", ["api_key"]), ("zip 90210", ["zip_us"]), ("SW1A 1AA", ["postcode_uk"]), ("born 03/14/1990", ["dob"]), ("March 14 1990", ["dob"]), ("The weather is nice today", []), (None, []), ("", []),
]


def test_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: [e.type for e in r.entities] for r in scan.scan(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [types for _, types in CASES]


def test_positions_and_skip_values(spark):
    text = "mail a@b.org or é c@d.org, SSN 123-45-6789"
    df = spark.createDataFrame([(text, ["c@d.org", "x123-45-6789x"])], "text string, skip array<string>")
    whole = scan.scan(df).first().entities
    assert [text[e.start : e.end] for e in whole] == [e.text for e in whole] == ["a@b.org", "c@d.org", "123-45-6789"]
    assert [e.text for e in scan.scan(df, skip="skip").first().entities] == ["a@b.org"]


@pytest.mark.parametrize("text,want", [("What restaurants are near 1126 E Apache Blvd, Tempe, AZ?", True), ("Find an HIV clinic near me", False), ("rehab centers near Austin", False), ("What is the capital of France?", False), (None, False)])
def test_service_queries(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(service.is_service_query(F.col("t"))).first()[0] is want


def test_addresses_move_next_door(spark):
    df = spark.createDataFrame([("to 1126 E Apache Blvd, Tempe, AZ",), ("1 Oak St",)], "t string")
    a, b = [r[0] for r in df.select(service.fuzz_addresses(F.col("t"), F.lit("s"))).collect()]
    assert a.text in ("to 1125 E Apache Blvd, Tempe, AZ", "to 1127 E Apache Blvd, Tempe, AZ")
    assert b.text in ("1 Oak St", "2 Oak St")


@pytest.mark.parametrize("types,want", [(["zip_us", "dob"], {("ZIP + DOB + Gender", False)}), (["zip_us", "dob", "gender_indicator"], {("ZIP + DOB + Gender", True)}), (["PERSON", "ssn"], {("Name + SSN", True)}), (["PERSON", "ORG", "GPE"], {("Name + Employer + City", True)}), ([], set())])
def test_risks(spark, types, want):
    df = spark.createDataFrame([(types,)], "t array<string>")
    assert {(r.combination, r.all_fields_matched) for r in df.select(risk.risks(F.col("t")).alias("r")).first().r} == want


def test_surrogates_are_unique_and_stable(spark):
    df = spark.createDataFrame([("s", "PERSON", f"Name {i}") for i in range(800)], "session string, type string, text string")
    a = {r.original: r.surrogate for r in surrogate_rows(df, "session").collect()}
    assert len(set(a.values())) == 800 and a == {r.original: r.surrogate for r in surrogate_rows(df, "session").collect()}
    known = spark.createDataFrame([("s", "Name 1", "Kept Name")], "session string, original string, surrogate string")
    assert {r.original: r.surrogate for r in surrogate_rows(df, "session", known=known).collect()}["Name 1"] == "Kept Name"


def test_resolve_passes():
    assert resolve.resolve_text("Hi Marcus Ellison!", [("Marcus Ellison", "Ahmed Al-Rashidi")]) == ("Hi Ahmed Al-Rashidi!", [])
    text, log = resolve.resolve_text("Hello Ashley Wise! See Ashley County", [("Ashley Wise", "Jane Doe")])
    assert text == "Hello Jane Doe! See Ashley County" and log == []
    text, log = resolve.resolve_text("Hi Victoria", [("Victoria Mitchell", "Ann Lee")])
    assert text == "Hi Ann" and [x[2] for x in log] == ["fuzzy_hit"]
    text, log = resolve.resolve_text("mail marcus.elison@example.org now", [("marcus.ellison@example.org", "me@x.org")])
    assert "me@x.org" in text and [x[2] for x in log] == ["fuzzy_hit"]
    assert [x[2] for x in resolve.resolve_text("nothing", [("zzzz", "a")])[1]] == ["exact_miss", "fuzzy_miss"]
    assert resolve.resolve_text(None, [("a", "b")]) == (None, [])


def test_likeness_equals_all_windows():
    assert resolve.likeness("abc", "xxabcxx") == 100 and resolve.likeness("", "a") == 0
    assert abs(resolve.likeness("abcd", "xabxdx") - 75) < 1e-9


def test_windows_that_are_left_out_cannot_reach_the_threshold():
    rng = random.Random(3)
    for _ in range(200):
        text, query = ("".join(rng.choice("abcd ") for _ in range(rng.randint(n, 60))) for n in (0, 4))
        query = query[:20]
        n = len(query)
        brute = max(((resolve.likeness(query, text[a : a + 2 * n]), -a) for a in range(0, max(1, len(text) - n + 1), max(1, n // 8))), default=(0, 1)) if text else (0, 1)
        score, a, b = resolve.best_span(text, query, 70)
        assert (score, a) == (brute[0], -brute[1]) if brute[0] >= 70 else score < 70


def test_hkdf_and_sealed_state(spark):
    # RFC 5869, test case 1, with its salt and info given as they are.
    assert crypto.derive_key(b"\x0b" * 22, "\x00\x01\x02\x03\x04\x05\x06\x07\x08\x09\x0a\x0b\x0c", bytes(range(0xF0, 0xFA)), 42).hex().startswith("3cb25f25faacd57a90434f64d0362f2a")
    rows = spark.createDataFrame([("a", "o1", "s1", 1), ("a", "o2", "s2", 2), ("b", "o3", "s3", 1)], state.STATE)
    files = state.sealed(rows, b"k" * 32)
    good = {r.session: [(p.original, p.surrogate) for p in r.pairs] for r in state.unsealed(files, b"k" * 32).collect()}
    assert good == {"a": [("o1", "s1"), ("o2", "s2")], "b": [("o3", "s3")]}
    short = files.select("session", F.expr("substr(sealed, 1, 9)").alias("sealed"))
    assert all(r.pairs == [] for df in (state.unsealed(files, b"x" * 32), state.unsealed(short, b"k" * 32)) for r in df.collect())
    assert {r.session for r in state.flush(rows, ["a"]).collect()} == {"b"}


def test_answer_keys(spark):
    keys = [(0, '{"name": "Ann", "email": ["a@b.org", " "], "odd": "x"}'), (1, '"Bo", \'c@d.org\''), (2, None), (3, "")]
    got = {tuple(r) for r in evaluate.key_values(spark.createDataFrame(keys, "idx long, answer_key string")).select("idx", "type", "value").collect()}
    assert got == {(0, "PERSON", "Ann"), (0, "email", "a@b.org"), (0, "other", "x"), (1, None, "Bo"), (1, None, "c@d.org")}
    with pytest.raises(ValueError):
        evaluate.paired_lengths(spark.range(2), spark.range(3))


def test_t_distribution():
    assert abs(stats.t_test_p(2.0, 10) - 0.07338803477) < 1e-9 and abs(stats.t_test_p(12.706204736, 1) - 0.05) < 1e-8


@pytest.mark.parametrize("reply,want", [('{"recovery_attempts": [{"guessed_original": "a"}]}', ["a"]), ('```json\n{"recovery_attempts": []}\n```', []), ('Sure: {"recovery_attempts": [{"guessed_original": "b"}]} bye', ["b"]), ("garbage", "parse_error"), (None, "error")])
def test_attack_replies(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "r string").select(attack.parse_reply(F.col("r")).alias("p")).first().p
    assert got.overall_assessment == want if isinstance(want, str) else [a.guessed_original for a in got.recovery_attempts] == want


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    got = {}
    for r in rag.chunk_rows(df).collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {1: [text[a : a + 512] for a in range(0, 1000, 410)], 2: ["short"], 4: [""]}


def test_config():
    assert EngineConfig().with_options(salt="x").salt == "x" and "phone_uk" in expand_types(["phone"])
    with pytest.raises(ValueError):
        EngineConfig(state_dir="/no/such/folder")
    with pytest.raises(ValueError):
        EngineConfig().with_options(odd=1)
    assert EngineConfig().salt != EngineConfig().salt


FAST = [q for q in catalogue.ORACLE_SQL if q.startswith(("pattern_", "answers_"))] + ["pii_email_extract", "pii_span_offsets", "pii_claimed_spans", "pii_phone_extract", "text_risks", "cascade_cases", "resolve_cases", "structural_org", "rag_topk_cosine", "engine_mask_twice", "batch_outputs", "surrogate_map", "masked_text", "redacted_text", "customer_mask", "eval_macro", "eval_per_type", "clause_split", "chunk_documents", "attack_by_type"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "customer", "labels", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want, got = con.execute(catalogue.ORACLE_SQL[name]).df(), catalogue.QUERIES[name](spark, folder).toPandas()
    digest = lambda df: sorted(hashlib.md5(repr([None if pd.isna(x) else round(x, 6) if isinstance(x, float) else x for x in row]).encode()).hexdigest() for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert digest(got) == digest(want)


def test_sessions_sealed_in_several_rows_count_once(spark, monkeypatch):
    monkeypatch.setattr(state, "PART", 2)
    con = duckdb.connect()
    con.execute("CREATE VIEW customer AS SELECT * FROM read_parquet('/root/testdata/sf0.001/customer.parquet')")
    got = catalogue.QUERIES["aes_roundtrip"](spark, "/root/testdata/sf0.001").select("session", "n", "n_wrong_secret").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLE_SQL["aes_roundtrip"]).fetchall())


#: Words that end where a letter follows, if letters are those of ASCII alone.
EDGES = [
    "ring +1 (643) 555-2043 einlich st\u00f6d", "3280 zuch st\u00fcndlich", "\u00e912 Baker St", "\u066312 Baker St", "12\u00a0Baker St", "189 einst\u00e4", "5 Baker St, Ulm\u00fc", "\u00e9a@b.org a@b.org\u00e9", "9021\u0663 90210\u00e9 \u00e990210", "DL\u00e9 A1234567 \u00fcDL B7654321",
    "\u00e9192.168.1.100\u00fc", "\u00e44532015112830366", "03/14/1990\u00e9 14 Mar\u00e9 1990", "sex: m\u00e9", "\u00e4she/her", "SW1A 1AA\u00e9", "\u00fc0x52908400098527886E0F7030069857D2E4169EE7", "\u0663021000021 123-45-6789\u00e9", "12 Ba\u017fe \u017ft", "gender:\u00a0male, \u017fex: f",
    "plain 12 Baker St and a@b.org",
]
EDGE_QUERIES = [q for q in catalogue.ORACLE_SQL if q.startswith(("pattern_", "pii_"))] + ["entity_dedup_best", "redacted_text", "service_fuzz", "surrogate_map", "masked_text", "clean_docs_anti", "text_risks"]


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    pd.DataFrame({"doc_id": range(len(EDGES)), "text": EDGES, "lang": "de"}).to_parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    return folder, con


@pytest.mark.parametrize("name", EDGE_QUERIES)
def test_words_of_the_queries_end_where_those_of_the_sql_do(spark, edges, name):
    folder, con = edges
    got = catalogue.QUERIES[name](spark, folder)
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_words_of_the_engine_are_of_unicode():
    assert [(e.type, e.text) for e in spanlist.scan(EDGES[0])] == [("phone_us", "+1 (643) 555-2043")]
    assert [e.type for e in spanlist.scan(EDGES[0], patterns.ASCII_PATTERNS)] == ["address"]


def test_few_chunks_go_to_the_tasks_instead_of_many_queries(spark, monkeypatch):
    texts = [f"{a} {b} words" for a in ("red", "blue", "old", "new", "") for b in ("house", "tree", "river")]
    chunks = rag.embed(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts[:7])], "chunk_id string, chunk string"))
    queries = spark.createDataFrame([(i, texts[i % len(texts)] if i % 9 else "") for i in range(60)], "q long, text string")
    asked, vectors = rag.embed(queries, "text"), chunks.select("chunk_id", "embedding")
    want = rag.top_k_each(asked, vectors, 3, "q", "chunk_id").orderBy("q", "rank").collect()
    sent, blocks = [], rag._blocks
    monkeypatch.setattr(rag, "MOST_QUERIES", 3)
    monkeypatch.setattr(rag, "_blocks", lambda rows: (sent.append(len(b[0])) or b for b in blocks(rows)))
    near = {r.q: r.chunks for r in rag.nearest_chunks(queries, "q", "text", chunks).collect()}
    assert sum(sent) == 7
    assert rag.top_k_of_few(asked, vectors, 3, "q", "chunk_id").orderBy("q", "rank").collect() == want and len(want) == 3 * 53
    named = {f"c{i}": t for i, t in enumerate(texts)}
    assert near == {q: [named[r.chunk_id] for r in want if r.q == q] for q in {r.q for r in want}}


def test_requests_are_looked_for_among_texts_with_an_address(spark):
    plan = catalogue.QUERIES["engine_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    near = next(x for x in plan.splitlines() if "abortion" in x)
    assert near.index("regexp_extract_all") < near.index("abortion")


def test_words_that_start_a_sentence_cost_little(monkeypatch):
    called, named = [], recognizers.Gazetteer._named
    monkeypatch.setattr(recognizers.Gazetteer, "_named", lambda self, parts, text: called.append(parts) or named(self, parts, text))
    text = "Lorem ipsum. Dolor sit.\nAmet, Elitr by Sanct. Ann left. Mr Bo Lund. Tempora, AZ. In Zork. Paris's end. \u00dcber all. A Will"
    got = [(e.type, e.text) for e in recognizers.Gazetteer().find(text)]
    assert len(called) == 8 and got == [("PERSON", "Ann"), ("PERSON", "Bo Lund"), ("GPE", "Tempora"), ("GPE", "Zork"), ("GPE", "Paris")]


def test_requests_are_those_of_the_whole_expression():
    rng = random.Random(5)
    words = "any|best|Find|restaurant|FOOD|near|In|by|close to|weather|WEATHER|for|hiv|std|is there a|d\u0131rections|to|re\u017ftaurant|\u212a|place\u0130|\n|x y z|checK whether|shop|around".split("|")
    whole, sensitive = re.compile(service.SERVICE_REGEX), re.compile(service.SENSITIVE_REGEX)
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))
        low = text.lower()
        slow = any(r.search(text) for r, _, groups in service._GATED if all(any(w in low for w in g) for g in groups))
        assert service.asks_for_service(text) is (slow and not sensitive.search(text))
        if text.isascii():
            assert slow is bool(whole.search(text))


def test_of_between_names_starts_none():
    parts = [("In", 0, 2), ("of", 3, 5), ("Zork", 6, 10)]
    got = recognizers.Gazetteer()._named(parts, "In of Zork")
    assert [next(got, None) for _ in range(3)][-1] is None
