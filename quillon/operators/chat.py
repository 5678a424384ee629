"""Scripted multi-turn flows: one reply strategy per intent, and collectors that keep state between a session's turns.

A session is a fold over its turns in their order, but of a few states only: no collector at work, or one of them at one
of its steps. So a turn is a function from states to states, and functions compose in any grouping: ``fold`` deals turns by
ranges of (session, turn), however long a session is; each range composes its own functions, the driver hands what
the ranges before make of a session to the next (one row a range), and a turn's state is its own prefix applied to that.
Replies are columns of the state. The same step runs on streams in ``quillon.streaming.sessions``. Detection is done
before, as columns. A turn without a session id is a session of its own, with an id made from it; turns of one session and
number are in the order of a hash of their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..settings import Settings
from ..sources.shared import written
from .detect import UNKNOWN, detect, spread

#: The collectors' steps and all replies.
COLLECTORS = {
    "cancelar": (
        "Confirme: deseja cancelar sua assinatura? (sim/não)",
        "Qual o motivo do cancelamento?",
        "Seu protocolo de cancelamento é: CANC-{:04d}. Processado.",
    ),
    "acesso": (
        "Informe seu e-mail ou usuário para iniciar a recuperação.",
        "Enviamos um link de recuperação para seu e-mail. Verifique a caixa de entrada.",
        "Sua senha foi redefinida. Novo acesso liberado.",
    ),
    "alterar_dados": (
        "Qual dado deseja alterar? (nome, e-mail, endereço, documento)",
        "Dado alterado com sucesso.",
    ),
}
REPLIES = {
    "saudacao": "Olá! Como posso ajudar hoje?\nOpções: cancelar, comprar, suporte, upgrade, downgrade, acesso, pagamento, alterar dados, reclamação, dúvida.",
    "comprar": "Temos os planos: Básico (R$ 29/mês), Pro (R$ 79/mês), Enterprise (sob consulta). Qual plano deseja assinar?",
    "upgrade": "Você está no plano Básico. Deseja migrar para Pro (R$ 79/mês) ou Enterprise (sob consulta)?",
    "downgrade": "Deseja migrar para o plano Básico (R$ 29/mês)? A mudança valerá no próximo ciclo de cobrança.",
    "reclamacao": "Registramos sua reclamação e abrimos um protocolo. Um especialista entrará em contato em até 24h. Deseja falar com um atendente agora?",
}
SUPPORT = ("Detectei um problema técnico. Seu ticket: {}. Nossa equipe vai investigar.", "Suporte acionado. Ticket: {}. Em breve entraremos em contato.")
SUPPORT_ERRORS = ("erro", "não carrega", "nao carrega", "não abre", "nao abre")
PAYMENT = ("Identifiquei cobrança duplicada. Iniciando estorno automático. O valor retorna em até 5 dias úteis.", "Para pagamento: PIX, boleto ou cartão. Qual método prefere? Se já pagou, envie o comprovante para agilizar.")
PAYMENT_TWICE = ("duas vezes", "duplicado", "cobrou")
FAQ = {
    "preço": "Planos a partir de R$ 29/mês. Veja detalhes em /comprar.",
    "teste": "Temos 7 dias grátis no plano Pro. Sem compromisso.",
    "cancelar": "Pode cancelar a qualquer momento. Sem multa.",
}
FAQ_NONE = "Não tenho essa informação no momento. Posso transferir para um atendente humano?"
NOT_UNDERSTOOD = 'Não entendi sua mensagem. Vou transferir para um atendente humano. Sua mensagem original: "{}"'
TURN = "session_id string, turn int, turn_index int, text string, primary string, confidence double, multi_intent boolean, strategy string, reply string, reply_format string, pending_step int"


def number_of(text: F.Column) -> F.Column:
    """A number that any engine with md5 makes of a text."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def with_replies(detected: DataFrame) -> DataFrame:
    """``detected`` (text redacted, primary) with ticket, protocol and direct: the reply where no collector is at work."""
    lower = F.lower("text")

    def has(words: tuple[str, ...]) -> F.Column:
        out = F.lit(False)
        for word in words:
            out = out | F.contains(lower, F.lit(word))
        return out

    df = detected.withColumn("ticket", F.format_string("SUP-%04d", F.pmod(number_of(F.col("text")), F.lit(10000))))
    df = df.withColumn("protocol", (F.pmod(number_of(F.concat_ws("/", F.col("session_id").cast("string"), F.col("turn").cast("string"))), F.lit(9000)) + 1000).cast("int"))
    faq = F.lit(FAQ_NONE)
    for key, answer in reversed(FAQ.items()):
        faq = F.when(F.contains(lower, F.lit(key)), answer).otherwise(faq)
    reply = F.concat(F.lit(NOT_UNDERSTOOD.split("{}")[0]), F.col("text"), F.lit(NOT_UNDERSTOOD.split("{}")[1]))
    for intent, said in REPLIES.items():
        reply = F.when(F.col("primary") == intent, said).otherwise(reply)
    support = F.when(has(SUPPORT_ERRORS), F.format_string(SUPPORT[0].replace("{}", "%s"), "ticket")).otherwise(F.format_string(SUPPORT[1].replace("{}", "%s"), "ticket"))
    reply = F.when(F.col("primary") == "suporte", support).when(F.col("primary") == "pagamento", F.when(has(PAYMENT_TWICE), PAYMENT[0]).otherwise(PAYMENT[1])).when(F.col("primary") == "duvida", faq).otherwise(reply)
    return df.withColumn("direct", reply)


@dataclass
class State:
    pending: str | None = None
    step: int = 0
    turns: int = 0


def step(state: State, primary: str, sure: bool, protocol: int, direct: str) -> tuple[str, str, int | None]:
    """(strategy, reply, pending step) of one turn; changes ``state``. Unknown or unsure messages advance a collector,
    another known intent ends it."""
    state.turns += 1
    if state.pending and primary not in (UNKNOWN, state.pending) and sure:
        state.pending, state.step = None, 0
    intent = state.pending or primary
    if intent not in COLLECTORS:
        return intent, direct, None
    said = COLLECTORS[intent]
    state.pending, state.step = intent, state.step + 1 if state.pending else 1
    reply = said[state.step - 1].format(protocol)
    if state.step == len(said):
        state.pending, state.step = None, 0
        return intent, reply, None
    return intent, reply, state.step


def received(messages: DataFrame, *keep: str) -> DataFrame:
    """session_id, turn, text (redacted) and ``keep`` of messages."""
    own = F.substring(F.md5(F.concat_ws("/", F.col("turn").cast("string"), F.col("text"))), 1, 8)
    return messages.select(F.coalesce(F.col("session_id").cast("string"), own).alias("session_id"), F.col("turn").cast("int").alias("turn"), T.redact(F.coalesce("text", F.lit(""))).alias("text"), *keep)


def prepared(messages: DataFrame, settings: Settings = Settings(), *keep: str) -> DataFrame:
    """``received`` messages, each detected by itself and with a direct reply."""
    detected = detect(spread(received(messages, *keep)), settings).select("session_id", "turn", "text", *keep, "primary", "confidence", "multi_intent")
    return with_replies(detected).select("session_id", "turn", "text", *keep, "primary", "confidence", "multi_intent", "protocol", "direct")


def judged(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``received`` messages with primary, confidence and multi_intent.

    Detection takes far more time than a shuffle, and depends on the text alone: each distinct text is detected once, in a
    table of its own, so no later pass over the messages does it again.
    """
    spark = messages.sparkSession
    turns = written(received(spread(messages)), "messages")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = turns.select("text").distinct().repartition(tasks)
    verdicts = written(detect(texts, settings).select("text", "primary", "confidence", "multi_intent"), "verdicts")
    return turns.join(verdicts, "text").select("session_id", "turn", "text", "primary", "confidence", "multi_intent")


def sure(settings: Settings) -> F.Column:
    return F.coalesce(F.col("confidence") >= settings.min_confidence, F.lit(False))


COLUMNS = [x.split()[0] for x in TURN.split(", ")]


#: What a session can be at: nothing, or a collector and how many of its steps are said.
STATES: list[tuple[str | None, int]] = [(None, 0), *((intent, k) for intent, said in COLLECTORS.items() for k in range(1, len(said)))]
#: What a turn can be: unknown, a collector's intent, or another one; each sure or not.
KINDS = [UNKNOWN, *COLLECTORS, ""]
#: Columns of turns that are folded, and what is added to them in their ranges.
FOLDED = "session_id string, turn int, text string, primary string, confidence double, multi_intent boolean, protocol int, direct string"
PLACED = "at long, before long, after long"


def transitions() -> np.ndarray:
    """[kind * 2 + sure][state]: the state after a turn."""
    out = np.zeros((2 * len(KINDS), len(STATES)), np.int64)
    for kind, primary in enumerate(KINDS):
        for is_sure in (0, 1):
            for k, (pending, done) in enumerate(STATES):
                state = State(pending, done)
                step(state, primary or "other", bool(is_sure), 0, "")
                out[2 * kind + is_sure, k] = STATES.index((state.pending, state.step))
    return out


def coded(functions: np.ndarray) -> np.ndarray:
    """Functions from states to states (rows) as one number each."""
    return functions @ len(STATES) ** np.arange(len(STATES))


def decoded(code: int) -> np.ndarray:
    return code // len(STATES) ** np.arange(len(STATES)) % len(STATES)


def prefixes(functions: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Of each row, all functions of its segment up to it, composed; by doubling."""
    out, d = functions.copy(), 1
    while d < len(out):
        same = np.flatnonzero(segment[d:] == segment[:-d])
        if not len(same):
            break
        out[same + d] = np.take_along_axis(out[same + d], out[same], 1)
        d *= 2
    return out


def dealt(turns: DataFrame, partitions: int) -> DataFrame:
    """``turns`` in ranges of (session, turn), each in order, with part: a session may have any number of ranges."""
    order = ["session_id", "turn", "tie", *(c for c in turns.columns if c == "protocol")]
    rows = turns.withColumn("tie", F.xxhash64("text", "primary")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return rows.drop("tie").withColumn("part", F.spark_partition_id())


def composed(ranges: DataFrame) -> DataFrame:
    """``ranges`` and ``PLACED``: each turn's place in its session's part of the range, and the function of the turns before it
    there, with and without it."""
    table, one = transitions(), np.arange(len(STATES))
    schema = f"{', '.join(f'`{c}` {kind}' for c, kind in ranges.dtypes)}, {PLACED}"
    names_out = [*ranges.columns, *(x.split()[0] for x in PLACED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, done = None, one, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # Names of sessions, in order: numbers for them where they change.
            names = batch.column("session_id").to_pylist()
            changed = np.array([True, *(a != b for a, b in zip(names, names[1:]))])
            segment = np.cumsum(changed)
            kind, is_sure = batch.column("kind").to_numpy(), batch.column("sure").to_numpy(zero_copy_only=False)
            f = prefixes(table[2 * kind + is_sure], segment)
            first = np.flatnonzero(changed)
            at = np.arange(len(f)) - first[segment - 1]
            if names[0] == last:
                going = segment == 1
                f[going] = f[going][:, carry]
                at[going] += done
            else:
                carry, done = one, 0
            before = np.roll(f, 1, 0)
            before[first] = one
            before[0] = carry
            last, carry, done = names[-1], f[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at), pa.array(coded(before)), pa.array(coded(f))], names_out)

    kind = F.lit(len(KINDS) - 1)
    for k, primary in enumerate(KINDS[:-1]):
        kind = F.when(F.col("primary") == primary, k).otherwise(kind)
    return ranges.withColumn("kind", kind).mapInArrow(run, schema)


def carried(segments: DataFrame) -> list[tuple[int, str, int, int]]:
    """(part, session, state, turns before) for each range whose first session began in a range before it."""
    of = segments.groupBy("part").agg(F.min("session_id").alias("first"), F.max(F.struct("session_id", "at", "after")).alias("last"))
    out, session, state, turns = [], None, 0, 0
    # One row a range.
    for r in sorted(of.collect(), key=lambda r: r["part"]):
        if r["first"] == session:
            out.append((r["part"], session, state, turns))
        else:
            state, turns = 0, 0
        last = r["last"]
        going = last["session_id"] == r["first"]
        state, turns, session = int(decoded(last["after"])[state if going else 0]), last["at"] + 1 + (turns if going else 0), last["session_id"]
    return out


def replied(turns: DataFrame) -> DataFrame:
    """Rows of ``TURN`` of ``turns`` with state and index."""
    pending, done = (F.get(F.array(*(F.lit(x[k]) for x in STATES)), F.col("state")) for k in (0, 1))
    ended = pending.isNotNull() & ~F.col("primary").isin(UNKNOWN) & (F.col("primary") != pending) & F.col("sure")
    rows = turns.withColumn("held", F.when(~ended, pending)).withColumn("strategy", F.coalesce("held", "primary"))
    rows = rows.withColumn("said", F.when(F.col("strategy").isin(*COLLECTORS), F.when(F.col("held").isNull(), 1).otherwise(done + 1)))
    reply, left = F.col("direct"), F.lit(None).cast("int")
    for intent, texts in COLLECTORS.items():
        text = F.replace(F.get(F.array(*map(F.lit, texts)), F.col("said") - 1), F.lit("{:04d}"), F.format_string("%04d", "protocol"))
        reply = F.when(F.col("strategy") == intent, text).otherwise(reply)
        left = F.when((F.col("strategy") == intent) & (F.col("said") < len(texts)), F.col("said")).otherwise(left)
    return rows.withColumn("reply", reply).withColumn("pending_step", left).withColumn("turn_index", (2 * F.col("index") + 1).cast("int")).withColumn("reply_format", F.lit("text")).select(COLUMNS)


def stated(turns: DataFrame, settings: Settings) -> DataFrame:
    """``turns`` with state, the one that each finds its session at, and index, how many turns are before it."""
    spark = turns.sparkSession
    ranges = dealt(turns.withColumn("sure", sure(settings)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    segments = written(composed(ranges), "turns")
    # At most a row a range.
    begins = spark.createDataFrame(carried(segments), "part int, session_id string, state_in int, turns_in long")
    rows = segments.join(F.broadcast(begins), ["part", "session_id"], "left")
    power = F.element_at(F.array(*(F.lit(len(STATES) ** k) for k in range(len(STATES)))), F.coalesce("state_in", F.lit(0)) + 1)
    state = F.pmod(F.floor(F.col("before") / power), F.lit(len(STATES))).cast("int")
    return rows.withColumn("state", state).withColumn("index", F.coalesce("turns_in", F.lit(0)) + F.col("at"))


def fold(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row of ``TURN`` for each of turns: session_id, turn, text, primary, confidence, multi_intent, protocol, direct."""
    return replied(stated(turns.select(*(F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in FOLDED.split(", "))), settings))


def chat(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row of ``TURN`` for each message of session_id, turn, text."""
    # Direct replies and numbers are made of what is folded, where they are asked for.
    return replied(with_replies(stated(judged(messages, settings), settings)))


def log_rows(turns: DataFrame, created_at: F.Column) -> DataFrame:
    """The conversation log: two rows a turn, of user and bot; texts are redacted already."""
    speakers = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("said"), F.lit(0).alias("k")), F.struct(F.lit("bot").alias("role"), F.col("reply").alias("said"), F.lit(1).alias("k")))
    rows = turns.withColumn("at", created_at).select("session_id", "turn_index", "primary", "strategy", "at", F.explode(speakers).alias("x"))
    return rows.select("session_id", (F.col("turn_index") + F.col("x.k")).alias("turn_index"), F.col("x.role").alias("role"), F.col("x.said").alias("text"), F.col("primary").alias("primary_intent"), "strategy", F.col("at").alias("created_at"))


def latest(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("turn_index"), "session_id").limit(limit)


LOG = "session_id string, turn_index int, role string, text string, primary_intent string, strategy string, created_at timestamp"


def append_log(log: DataFrame, path: str, write: str | None = None) -> None:
    """Adds rows of ``log_rows`` to the log at ``path``, which need not be there yet.

    write: the name of this write, made of letters, digits and dashes. One that is there already is replaced, so that a write
    that is done again adds nothing.
    """
    log.write.mode("overwrite").parquet(f"{path.rstrip('/')}/write={write or uuid.uuid4().hex}")


def read_log(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The latest rows of a log; none if there is no log."""
    try:
        log = spark.read.schema(f"{LOG}, write string").parquet(path).drop("write")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], LOG)
    return latest(log, limit)
