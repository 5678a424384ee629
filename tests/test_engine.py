"""The message engine beyond its queries: filters on results, odd characters, files, sinks, settings and streams."""

from __future__ import annotations

import datetime
import json
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.operators import chat, relational
from quillon.operators.detect import Book, bars, detect, detect_batch, measured, spread, tokenised
from quillon.operators.language import identified
from quillon.plans import queries
from quillon.plans.queries import GOLDEN, GOLDEN_EN, SESSIONS, messages, sessions
from quillon.settings import Settings
from quillon.sources import messages as sources
from quillon.sources import rules
from quillon.streaming import sessions as sessions_of
from quillon.streaming.sessions import chat_stream, detect_stream


def test_filters_on_results_stay_above_the_detection(spark):
    found = detect(messages(spark)).where("primary = 'cancelar' AND confidence > 0.76").where("multi_intent").select("msg_id")
    found._jdf.queryExecution().optimizedPlan()
    again = detect(messages(spark)).where("primary = 'cancelar'").select("msg_id")
    execution = again._jdf.queryExecution()
    began = time.time()
    execution.optimizedPlan()
    assert time.time() - began < 5
    # Words are cut once, in hot messages only: nothing that is asked for needs the tokens of others.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(r[0] for r in found.collect()) == [1, 9]
    assert detect(messages(spark)).select("msg_id", F.explode("trace").alias("h")).where("h.negated").select("msg_id").distinct().collect() == [(6,)]


def test_filters_on_inputs_go_below_the_detection(spark, tmp_path):
    """To the scan, through a repartitioning, and to the folders of a partitioned table."""
    messages(spark).withColumn("day", F.col("msg_id") % 3).write.partitionBy("day").parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    for source in (stored, spread(stored)):
        found = detect(source).where("msg_id < 4 AND day = 1 AND primary = 'cancelar'").select("msg_id", "primary")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "LessThan(msg_id,4)" in plan and "(day#" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
        assert "ReadSchema: struct<msg_id:bigint,text:string>" in plan
        assert [r[0] for r in found.collect()] == [1]


def test_columns_named_like_inner_ones_are_kept(spark):
    rows = spark.createDataFrame([("quero sair", 1, 2, 3, "x", 5)], "text string, stripped int, hits int, `a b` int, primary string, _own0 int")
    got = detect(rows)
    assert got.columns[:5] == ["text", "stripped", "hits", "a b", "_own0"] and got.columns.count("primary") == 1
    assert tuple(got.select("text", "stripped", "hits", "a b", "_own0", "primary").first()) == ("quero sair", 1, 2, 3, 5, "cancelar")


def test_prefilter_lets_every_hit_through():
    """Of patterns with and without a bar outside of groups, words, and words of odd characters."""
    book = Book.of({lang: rules.shipped_rules(lang) for lang in ("pt", "en")})
    for lang in ("pt", "en"):
        search = re.compile(book.prefilter(lang).replace(r"\p{L}\p{N}_", r"\w"))
        for text in (g[0] for g in (GOLDEN if lang == "pt" else GOLDEN_EN) if g[1] or g[2]):
            assert search.search(rules.fold_text(text.lower()))
        assert not search.search("bom dia" if lang == "en" else "good day") and not search.search("xcancelar xsubscribe")
    assert [bars(x) for x in ("a|b", "(a|b)", "[|]", r"a\|b", "(a)(b|c)|d", r"[\]|]x")] == [True, False, False, False, True, False]


def test_places_of_tokens(spark):
    """Places are a running sum: a text of 8,000 words is cut in seconds."""
    text = ("quero  cancelar\t meu plano!\n" * 2000)
    began = time.time()
    got = tokenised(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert time.time() - began < 20 and len([t for t in got["lex"] if t["fold"].strip().isalpha()]) == 8000
    assert all(text[t["idx"] : t["idx"] + len(t["text"])] == t["text"] for t in got["tok"])


@pytest.mark.parametrize("mark", ["\x01", "\x02", "\x01\x02\x03"])
def test_characters_that_mark_matches_are_no_matches(spark, mark):
    rows = spark.createDataFrame([(f"quero cancelar meu plano {mark} xyz",), (f"{mark}quero{mark}sair",)], "text string")
    got = {r["text"][:5]: r for r in detect(rows).select("text", F.col("kept.intent").alias("intents"), F.col("kept.score").alias("scores"), "trace").collect()}
    assert (got["quero"]["intents"], got["quero"]["scores"]) == (["cancelar"], [8.0])
    assert [(h["s"], h["e"]) for h in got["quero"]["trace"]] == [(6, 14), (0, 14), (6, 24)]


def test_null_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, 1, 2), ("quero sair", 3, 4)], "text string, rules int, stripped int")
    got = detect(rows.drop("rules", "stripped")).select("text", "error_code", "primary").collect()
    assert [tuple(r) for r in got] == [(None, "empty", "desconhecido"), ("quero sair", None, "cancelar")]


def test_batches_have_no_gates_but_may_have_a_limit(spark):
    rows = spark.createDataFrame([("a",), ("",)], "text string")
    assert [r[0] for r in detect_batch(rows).select("error_code").collect()] == [None, None]
    assert detect_batch(rows, limit=2).count() == 2
    with pytest.raises(ValueError, match="at most 1 "):
        detect_batch(rows, limit=1)


def test_rule_files(spark, tmp_path):
    raw = json.dumps(rules.shipped_document("en"), indent=1).encode()
    (tmp_path / "en.json").write_bytes(raw)
    loaded = rules.load(spark, str(tmp_path / "en.json"), "xx")
    assert loaded.language == "xx" and loaded.intents == rules.shipped_rules("en").intents and loaded.sha256 != rules.shipped_rules("en").sha256
    assert loaded.by_id("upgrade")["priority"] == 65
    (tmp_path / "bad.json").write_bytes(b"{")
    with pytest.raises(rules.RulesError) as e:
        rules.load(spark, str(tmp_path / "bad.json"))
    assert e.value.path == ""
    found = detect(spark.createDataFrame([("i want to cancel my plan",)], "text string"), sets={"en": rules.load(spark, str(tmp_path / "en.json"))})
    assert found.first()["primary"] == "cancelar"


def test_folders_of_rules_and_profiles(spark, tmp_path):
    for lang in ("pt", "en"):
        (tmp_path / f"{lang}.json").write_text(json.dumps(rules.shipped_document(lang)))
    assert list(rules.load_all(spark, str(tmp_path), ("en", "pt"))) == ["en", "pt"]
    with pytest.raises(Exception, match="xx.json"):
        rules.load_all(spark, str(tmp_path), ("pt", "xx"))
    (tmp_path / "profiles.json").write_text(json.dumps({"languages": {"pt": {"exclusive": ["zig"], "shared": ["plano"]}, "en": {"exclusive": ["zag"], "shared": []}}}))
    markers = rules.load_markers(spark, str(tmp_path / "profiles.json"))
    got = identified(spark.createDataFrame([("zig zig plano",), ("zag",), ("the quero",)], "text string"), markers=markers)
    assert [r[0] for r in got.select("lang.language").collect()] == ["pt", "en", None]


def test_message_files(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("quero sair\n\n   \noi, tudo bem?\n")
    lines = sources.line_messages(spark, str(tmp_path / "lines.txt"))
    assert [(r["text"], r["primary"]) for r in detect(lines).select("text", "primary").collect()] == [("quero sair", "cancelar"), ("oi, tudo bem?", "saudacao")]
    (tmp_path / "batch.json").write_text(json.dumps([g[0] for g in GOLDEN] + [None, ""]))
    assert [r["text"] for r in sources.json_messages(spark, str(tmp_path / "batch.json")).orderBy("pos").collect()] == [g[0] for g in GOLDEN] + [None, ""]
    (tmp_path / "other.json").write_text('{"a": ["x"]}')
    with pytest.raises(Exception, match=sources.NOT_A_LIST):
        sources.json_messages(spark, str(tmp_path / "other.json")).collect()


def test_log_is_appended_and_read(spark, tmp_path):
    path = str(tmp_path / "log")
    assert chat.read_log(spark, path, 5).count() == 0
    turns = chat.chat(sessions(spark))
    chat.append_log(chat.log_rows(turns.where("session_id = 'a'"), F.lit("2024-01-01").cast("timestamp")), path)
    chat.append_log(chat.log_rows(turns.where("session_id = 'b'"), F.lit("2024-01-02").cast("timestamp")), path)
    got = chat.read_log(spark, path, 5).collect()
    assert [(r["session_id"], r["turn_index"], r["role"]) for r in got] == [("b", 4, "bot"), ("b", 3, "user"), ("b", 2, "bot"), ("b", 1, "user"), ("a", 8, "bot")]
    assert [c for c, _ in chat.read_log(spark, path, 1).dtypes] == ["session_id", "turn_index", "role", "text", "primary_intent", "strategy", "created_at"]


def test_turns_without_a_session_are_sessions_of_their_own(spark):
    rows = spark.createDataFrame([(None, 1, "quero cancelar meu plano"), (None, 2, "sim sim")], "session_id string, turn int, text string")
    got = chat.chat(rows).collect()
    assert {len(r["session_id"]) for r in got} == {8} and len({r["session_id"] for r in got}) == 2 and {r["turn_index"] for r in got} == {1}


def sequential(rows, least=0.3):
    """A plain fold: (session, turn) to (turn_index, strategy, reply, pending_step)."""
    states, out = {}, {}
    for session, turn, primary, confidence in sorted(rows, key=lambda r: (r[0], r[1])):
        state = states.setdefault(session, chat.State())
        index = 2 * state.turns + 1
        out[session, turn] = (index, *chat.step(state, primary, confidence >= least, 1000 + turn % 9000, f"d{turn}"))
    return out


def frame_of(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, turn int, primary string, confidence double")
    return df.select("*", F.lit("x").alias("text"), F.lit(False).alias("multi_intent"), (F.col("turn") % 9000 + 1000).alias("protocol"), F.concat(F.lit("d"), F.col("turn").cast("string")).alias("direct"))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_sessions_that_are_cut_equal_a_sequential_fold(spark, batch):
    rng = random.Random(int(batch))
    intents = [*chat.COLLECTORS, "desconhecido", "desconhecido", "desconhecido", "saudacao"]
    rows = [(f"s{k}", t, rng.choice(intents), rng.choice([0.1, 0.3, 0.9])) for k, n in enumerate([1, 2, 900, 3, 1, 2000, 40]) for t in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["session_id"], r["turn"]): (r["turn_index"], r["strategy"], r["reply"], r["pending_step"]) for r in chat.fold(frame_of(spark, rows)).collect()}
        strict = {(r["session_id"], r["turn"]): r["strategy"] for r in chat.fold(frame_of(spark, rows), Settings(min_confidence=0.5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sequential(rows)
    assert strict == {k: v[1] for k, v in sequential(rows, 0.5).items()} and strict != {k: v[1] for k, v in got.items()}
    assert chat.fold(frame_of(spark, rows[:0])).count() == 0


def test_one_session_of_a_million_turns_is_cut_over_tasks(spark):
    """Its ranges are of like size, and composed in them as one after another."""
    intents = [*chat.COLLECTORS, "desconhecido", "desconhecido", "saudacao"]
    turns = spark.range(1_000_000, numPartitions=8).select(F.lit("s").alias("session_id"), F.col("id").cast("int").alias("turn"), F.get(F.array(*map(F.lit, intents)), F.pmod(F.xxhash64("id"), F.lit(len(intents))).cast("int")).alias("primary"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) / 10).alias("confidence"))
    turns = turns.select("*", F.lit("x").alias("text"), F.lit(False).alias("multi_intent"), F.lit(1).alias("protocol"), F.lit("").alias("direct"))
    sizes = sorted(r["count"] for r in chat.dealt(turns, 8).groupBy("part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4] and sum(sizes) == 1_000_000
    held, state = {}, chat.State()
    for r in turns.select("turn", "primary", "confidence").toPandas().sort_values("turn").itertuples():
        held[r.turn] = (2 * state.turns + 1, *[x for k, x in enumerate(chat.step(state, r.primary, r.confidence >= 0.3, 0, "")) if k != 1])
    got = chat.fold(turns).select("turn", "turn_index", "strategy", "pending_step").toPandas()
    assert len(got) == 1_000_000
    assert all(held[t] == (i, s, None if p != p or p is None else int(p)) for t, i, s, p in got.itertuples(index=False))


def test_settings_from_the_environment():
    assert Settings.from_env({}) == Settings()
    got = Settings.from_env({"QUILLON_LANGUAGES": " PT, en,pt ", "QUILLON_MAX_INTENTS": "5", "QUILLON_MIN_CONFIDENCE": "0.5", "OTHER": "x"})
    assert got.languages == ("pt", "en") and got.max_intents == 5 and got.min_confidence == 0.5
    for name, value in (("QUILLON_MAX_INTENTS", "many"), ("QUILLON_LANGUAGES", " , ")):
        with pytest.raises(ValueError, match=name):
            Settings.from_env({name: value})


def streamed(spark, tmp_path, rows, schema, of):
    """What a stream of one file for each turn gives."""
    turns = sorted({r[1] for r in rows})
    for k in turns:
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = of(stream)
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).start()
    try:
        # A query with timeouts by the clock has no last batch, so its rows are waited for.
        for _ in range(300):
            time.sleep(1)
            assert query.exception() is None
            if (tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema(found.schema).parquet(str(tmp_path / "out")).count() >= len(rows):
                break
    finally:
        query.stop()
    return spark.read.parquet(str(tmp_path / "out"))


def test_detection_on_a_stream(spark, tmp_path):
    rows = [(g[0], k % 2) for k, g in enumerate(GOLDEN)]
    got = streamed(spark, tmp_path, rows, "text string, part int", lambda s: detect_stream(s).select("text", "primary"))
    assert {r["text"]: r["primary"] for r in got.collect()} == {g[0]: g[1][0][0] if g[1] else "desconhecido" for g in GOLDEN}


def timed(rows):
    """Turns with times: a minute each."""
    return [(session, turn, text, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=turn)) for session, turn, text in rows]


TIMED = "session_id string, turn int, text string, at timestamp"


def turns_of(df):
    return sorted((r["session_id"], r["turn"], r["turn_index"], r["strategy"], r["pending_step"] or 0) for r in df.collect() if r["session_id"] != "end")


def run_stream(spark, tmp_path, batches, write):
    """Each list of rows is a file and a micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write(stream)
    assert query.awaitTermination(300) and query.exception() is None
    return query


def test_shuffled_turns_on_a_stream_give_the_batch_result(spark, tmp_path):
    """Turns of later micro-batches with smaller numbers are waited for; a replayed batch adds nothing to the log."""
    turns = timed([x[:3] for x in SESSIONS])
    want = turns_of(chat.chat(spark.createDataFrame(turns, TIMED)))
    assert want == sorted((x[0], x[1], x[3], x[4], x[5] or 0) for x in SESSIONS)
    mixed = [turns[2::3], turns[0::3], turns[1::3]]
    end = [("end", 1, "oi", datetime.datetime(2024, 1, 2))]
    path, state = str(tmp_path / "log"), str(tmp_path / "state")
    (tmp_path / "rows").mkdir()

    def write(stream):
        return sessions_of.write_log(chat_stream(stream, lateness="1 hour"), path, state, availableNow=True)

    run_stream(spark, tmp_path, [*mixed, end], write)
    log = chat.read_log(spark, path, 1000).collect()
    assert sorted((r["session_id"], r["turn_index"], r["strategy"]) for r in log if r["role"] == "user") == sorted((x[0], x[2], x[3]) for x in want)
    # As after a failure between the write and the commit: the last batches are done again.
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run_stream(spark, tmp_path, [], write)
    assert sorted(map(tuple, (r[:6] for r in chat.read_log(spark, path, 1000).collect()))) == sorted(map(tuple, (r[:6] for r in log)))


def test_state_on_a_stream_expires_by_event_time(spark, tmp_path):
    """A collector that is pending is forgotten after a pause, and kept over a shorter one."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    first = [("a", 1, "quero cancelar meu plano", at(0)), ("b", 1, "quero cancelar meu plano", at(0))]
    batches = [first, [("b", 2, "zzz qqq", at(30))], [("end", 1, "oi", at(100))], [("end", 2, "oi", at(101))], [("a", 2, "zzz qqq", at(200)), ("end", 3, "oi", at(300))], [("end", 4, "oi", at(400))]]

    def write(stream):
        found = chat_stream(stream, lateness="1 minute", idle=60 * 60 * 1000)
        return found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()

    run_stream(spark, tmp_path, batches, write)
    got = turns_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == [("a", 1, 1, "cancelar", 1), ("a", 2, 1, "desconhecido", 0), ("b", 1, 1, "cancelar", 1), ("b", 2, 3, "cancelar", 2)]


def test_observed_counts_need_no_second_pass(spark, tmp_path):
    from pyspark.sql import Observation

    seen = Observation("detected")
    assert len(measured(detect(messages(spark)), seen).select("primary").collect()) == len(GOLDEN)
    assert seen.get["messages"] == len(GOLDEN) and seen.get["with_intent"] == 9 and seen.get["multi_intent"] == 3 and seen.get["reason_ok"] == len(GOLDEN)
    edges = Observation("edges")
    measured(detect(spark.createDataFrame([("",), ("a",), ("!!!",)], "text string")), edges).count()
    assert {k: v for k, v in edges.get.items() if v} == {"messages": 3, "reason_empty_text": 3, "error_empty": 1, "error_too_short": 1}


def test_intervals_meet_in_stretches(spark):
    rng = random.Random(9)
    spans = [(k % 3, s, s + rng.randrange(0, 200)) for k in range(60) for s in [rng.randrange(1000)]]
    tokens = [(k % 3, k, b, b + rng.randrange(0, 90)) for k in range(300) for b in [rng.randrange(1000)]]
    spans = list(dict.fromkeys(spans))
    found = relational.overlapping(spark.createDataFrame(spans, "doc int, s int, e int"), spark.createDataFrame(tokens, "doc int, i int, begin int, end int"), "doc")
    got = [(r["doc"], r["s"], r["e"], r["i"]) for r in found.collect()]
    assert sorted(got) == sorted((d, s, e, i) for d, s, e in spans for d2, i, b, f in tokens if d == d2 and s < e and b < f and b < e and f > s)


def test_negators_of_several_words(spark):
    rows = spark.createDataFrame([(1, k, w) for k, w in enumerate("in the end not for long in the of it".split())] + [(2, 0, "the")], "doc int, pos int, token string")
    got = relational.negator_ends(rows, "doc", ["in the", "for", "not for long", "of it in"]).where("ends").select("doc", "pos").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 4), (1, 5), (1, 7)]
    near = relational.negated(rows, "doc", ["in the"], ["not"], 2).where("negated").select("pos").collect()
    assert sorted(r[0] for r in near) == [2, 3, 8, 9]


def test_lemmas_are_looked_up_in_a_dictionary(spark):
    dictionary = spark.createDataFrame([("pt", "Erros", "erro"), ("pt", "deu", "dar"), ("en", "app", "x")], "language string, word string, lemma string")
    rows = spark.createDataFrame([(1, "o app deu ERROS"), (2, "nada"), (3, None), (None, "erros")], "id int, text string")
    for few in (1 << 20, 0):
        got = {r["id"]: r["lemmas"] for r in relational.with_lemmas(rows, dictionary, "pt", "id", few=few).collect()}
        assert got == {1: {"deu": "dar", "erros": "erro"}, 2: {}, 3: {}, None: {}}
    found = detect(relational.with_lemmas(rows, dictionary, "pt", "id"), lemmas="lemmas")
    assert found.columns[:3] == ["id", "text", "lemmas"]


def test_pattern_hits_that_share_an_edge_count_as_in_sql(spark, tmp_path):
    """One character between two hits is taken by the first of them."""
    texts = ["of the of the", "of the of the of the", "of the, of the", "of the  of\nthe.", "(of the)(of the)", "of the) of the, of the", "of theof the", "_of the of the", "of the", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = sorted(db.execute(queries.ORACLE_SQL["pattern_hits"]).fetchall())
    assert sorted(map(tuple, queries.pattern_hits(spark, str(tmp_path)).collect())) == want
    assert dict(want)[0] == 1 and dict(want)[2] == 2


def test_chat_detects_each_distinct_text_once(spark, monkeypatch):
    """And answers as if each message were detected by itself, with what is redacted, missing or empty."""
    texts = [*(g[0] for g in GOLDEN), "sim sim", "paguei com 4111 1111 1111 1111", "paguei com 4222 2222 2222 2222", "bearer abc.def", "minha senha é x9", "", "   ", None]
    rng = random.Random(3)
    rows = [(None if k % 50 == 0 else f"s{k % 40}", k, rng.choice(texts)) for k in range(4000)]
    turns = spark.createDataFrame(rows, "session_id string, turn int, text string")
    want = sorted(map(tuple, chat.fold(chat.prepared(turns)).collect()), key=repr)
    detected = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            detected.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(chat, "detect", lambda messages, *settings: detect(messages.mapInArrow(counted, messages.schema), *settings))
    got = chat.chat(turns)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 4000
    # Of redacted texts, of which some are alike; a missing one is empty.
    n = len({r[3] for r in want})
    assert n == len(texts) - 3 and detected.value == n
    chat.log_rows(got, F.current_timestamp()).count()
    assert detected.value == n
