"""Which intents a message expresses: tokens, rule hits, negation, scores, ranking and the trace of it all.

Everything is Column expressions over one row: no shuffle, and the same on streaming sources. A message's language
picks its rules, arrays of structs that the planner folds to constants.

Most messages express little, so work is done where there may be something to find. One pattern for each language, made of
all its rules' words and patterns, tells whether any rule can hit; without it a message is not even cut into tokens. Words
that rules name are numbered once a message, by a hash set and a look-up, and rules are sets of these numbers. Patterns are
constants, compiled once; each marks its matches in the text, and spans are read from what is marked.

Filters on what is detected stay above the detection, those on columns of the messages go below it, to the scan (see
``kept_apart``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..settings import Settings
from ..sources.rules import WORD, RuleSet, java_pattern, limitations, shipped_rules
from .language import identified

UNKNOWN = "desconhecido"
#: A tile of a text: a run of white space, a word (apostrophes inside it stay), or one other character.
TILE = rf"(?s)[{T.WHITE_CLASS}]+|[\p{{L}}\p{{N}}\p{{M}}_]+(?:'[\p{{L}}\p{{N}}\p{{M}}_]+)*|."
#: Tiles of a block, whose places are added up apart.
RUN = 16
OF_WORD = "array<struct<k:int,j:int,id:string,type:string,n:int,w:double,shown:string>>"
OF_ALL = "array<struct<k:int,j:int,id:string,ns:array<int>,shown:array<string>,w:double>>"
OF_PATTERN = "array<struct<k:int,j:int,id:string,w:double,shown:string>>"
INTENT = "array<struct<k:int,id:string,label:string,priority:int,min_score:double>>"
HIT = "struct<k:int,j:int,id:string,type:string,shown:string,w:double,s:int,e:int,text:string,exact:boolean,toks:array<int>>"
#: Sentences of the explanation.
EXPLAIN_UNSUPPORTED = {
    "empty_text": "Mensagem sem conteúdo utilizável para classificação.",
    "insufficient_signal": "Não há sinais linguísticos suficientes para identificar o idioma.",
    "ambiguous_language": "Idioma ambíguo entre candidatos.",
}
EXPLAIN_UNKNOWN = "Nenhum intento identificado com confiança suficiente."


#: Mark a pattern's matches while they are looked for; in texts that have them, OTHER stands for both: no word and no blank either.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
MARKED = OPEN + "$0" + CLOSE
#: What detection adds to a message.
FOUND = ("error_code", "normalised", "lang", "kept", "dropped", "primary", "confidence", "multi_intent", "rank_reason", "explanation", "trace", "tok", "lex", "neg", "matched", "negated", "rules_version")


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def folded(words: list[str]) -> list[str]:
    source, to = T.fold_map(True, True)
    table = {ord(a): to[k] if k < len(to) else None for k, a in enumerate(source)}
    return [w.translate(table) for w in words]


def literal(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def by_language_of(column: str, values: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for lang, value in values.items():
        out = F.when(F.col(column) == lang, value).otherwise(out)
    return out


def by_language(values: dict[str, Column], otherwise: Column) -> Column:
    return by_language_of("lang.language", values, otherwise)


def bars(pattern: str) -> bool:
    """Whether a pattern has an alternation outside of all groups."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    depth = 0
    for char in bare:
        depth += (char == "(") - (char == ")")
        if char == "|" and not depth:
            return True
    return False


@dataclass(frozen=True)
class Book:
    """The rules of all languages as literals; words that any of them names are numbered from 1."""

    sets: dict[str, RuleSet]
    words: tuple[str, ...]

    @staticmethod
    def of(sets: dict[str, RuleSet]) -> Book:
        found: dict[str, None] = {}
        for rules in sets.values():
            for rule in (r for i in rules.intents for r in i["rules"] if r["type"] != "pattern"):
                found |= dict.fromkeys(folded(rule["value"] if isinstance(rule["value"], list) else [rule["value"]]))
            found |= dict.fromkeys(w for x in rules.negators for w in folded(x.split()))
            found |= dict.fromkeys(folded(list(rules.boundaries)))
        return Book(sets, tuple(found))

    def numbers(self, words: list[str]) -> list[int]:
        return [self.words.index(w) + 1 for w in words]

    def number(self, word: Column) -> Column:
        """A word's number, 0 if no rule names it."""
        return F.when(word.isin(*self.words), F.array_position(F.array(*map(F.lit, self.words)), word)).otherwise(0).cast("int") if self.words else F.lit(0)

    def rows(self, lang: str, *kinds: str) -> list[dict]:
        """k, j, id, type, value, w of a language's rules of these kinds; k and j are places among intents and rules."""
        out, j = [], 0
        for k, intent in enumerate(self.sets[lang].intents):
            for at, rule in enumerate(intent["rules"]):
                if rule["type"] in kinds:
                    out.append({"k": k, "j": j, "id": f"{intent['id']}:{at}", "type": rule["type"], "value": rule["value"], "w": float(rule["weight"])})
                j += 1
        return out

    def chosen(self, make: Callable[[str], Column], otherwise: Column) -> Column:
        return by_language({lang: make(lang) for lang in self.sets}, otherwise)

    def word_rules(self) -> Column:
        def rows(lang: str) -> list[dict]:
            return [{**x, "n": self.numbers(folded([x["value"]]))[0], "shown": x["value"]} for x in self.rows(lang, "keyword", "lemma")]

        return self.chosen(lambda lang: literal(rows(lang), OF_WORD), literal([], OF_WORD))

    def all_rules(self) -> Column:
        def rows(lang: str) -> list[dict]:
            return [{**x, "ns": self.numbers(folded(x["value"])), "shown": folded(x["value"])} for x in self.rows(lang, "all")]

        return self.chosen(lambda lang: literal(rows(lang), OF_ALL), literal([], OF_ALL))

    def pattern_rules(self) -> Column:
        return self.chosen(lambda lang: literal([{**x, "shown": x["value"]} for x in self.rows(lang, "pattern")], OF_PATTERN), literal([], OF_PATTERN))

    def intents(self) -> Column:
        def rows(lang: str) -> list[dict]:
            return [{"k": k, "id": x["id"], "label": x["label"], "priority": x["priority"], "min_score": float(x["min_score"])} for k, x in enumerate(self.sets[lang].intents)]

        return self.chosen(lambda lang: literal(rows(lang), INTENT), literal([], INTENT))

    def phrases(self) -> Column:
        kind = "array<array<int>>"
        return self.chosen(lambda lang: literal([self.numbers(folded(x.split())) for x in self.sets[lang].negators], kind), literal([], kind))

    def stops(self) -> Column:
        return self.chosen(lambda lang: literal(self.numbers(folded(list(self.sets[lang].boundaries))), "array<int>"), literal([], "array<int>"))

    def prefilter(self, lang: str) -> str:
        """A pattern that a text has if any rule on its words or patterns hits. The boundary before is shared by all that allow it."""
        words = sorted({w for x in self.rows(lang, "keyword", "lemma", "all") for w in folded(x["value"] if isinstance(x["value"], list) else [x["value"]])})
        plain = [w for w in words if w and re.fullmatch(r"\w+", w)]
        own = [java_pattern(x["value"]) for x in self.rows(lang, "pattern")]
        values = [x["value"] for x in self.rows(lang, "pattern")]
        shared = [p[len(BEFORE) :] for p, v in zip(own, values, strict=True) if not bars(v)]
        apart = [p for p, v in zip(own, values, strict=True) if bars(v)] + [literal_pattern(w) for w in words if w not in plain]
        shared += [f"(?:{'|'.join(plain)})(?!{WORD})"] if plain else []
        apart += [f"{BEFORE}(?:{'|'.join(f'(?:{p})' for p in shared)})"] if shared else []
        return "|".join(f"(?:{p})" for p in apart) if apart else "(?!)"

    def may_hit(self) -> Column:
        def test(lang: str) -> Column:
            pattern = self.prefilter(lang)
            return F.col("searched").rlike(pattern) | ((F.col("flat") != F.col("searched")) & F.col("flat").rlike(pattern))

        return self.chosen(test, F.lit(False))

    def marks(self) -> Column:
        """(j, a, b) of the patterns that the text (a) or its copy without punctuation (b) has: these with matches marked."""
        kind = "array<struct<p:int,a:string,b:string>>"

        def marked(text: str, pattern: str, also: Column) -> Column:
            return F.when(also & F.col(text).rlike(pattern), F.regexp_replace(text, pattern, MARKED))

        def every(lang: str) -> Column:
            other = F.col("flat") != F.col("searched")
            rules = [F.struct(F.lit(p).alias("p"), marked("searched", java_pattern(x["value"]), F.lit(True)).alias("a"), marked("flat", java_pattern(x["value"]), other).alias("b")) for p, x in enumerate(self.rows(lang, "pattern"))]
            return F.filter(F.array(*rules), lambda m: m["a"].isNotNull() | m["b"].isNotNull()).cast(kind) if rules else F.array().cast(kind)

        return F.when(F.col("hot"), self.chosen(every, F.array().cast(kind))).otherwise(F.array().cast(kind))


BEFORE = f"(?<!{WORD})"


def literal_pattern(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def kept_apart(df: DataFrame, plain: list[str], found: list[str]) -> DataFrame:
    """``df``'s columns, with ``found`` in a form that the optimiser neither repeats nor moves a filter through.

    A filter on a detected column would else be pushed below the detection and repeat all that it depends on, level by
    level. Unpivoting one group of columns gives each row once, with new columns that the optimiser can't see through;
    those of ``plain`` are the ones of the input, so filters on them go on to the scan. Unused columns are still pruned.
    """
    names = ", ".join(f"`{c}`" for c in found)
    made = ", ".join(f"`{c}_`" for c in found)
    out = df.sparkSession.sql(f"SELECT * FROM {{df}} UNPIVOT INCLUDE NULLS (({made}) FOR `_group` IN (({names})))", df=df.select(*plain, *found))
    return out.select(*plain, *(F.col(f"{c}_").alias(c) for c in found))


def spread(messages: DataFrame) -> DataFrame:
    """``messages`` dealt over all cores, if their scan has fewer tasks: detection takes far more time a byte than reading."""
    cores = messages.sparkSession.sparkContext.defaultParallelism
    return messages if messages.isStreaming or messages.rdd.getNumPartitions() >= cores else messages.repartition(cores)


def tokenised(df: DataFrame, text: str = "stripped", lemmas: str | None = None, book: Book | None = None, name: str = "") -> DataFrame:
    """``df`` with tok (i, idx, text, fold, ws, brk, lemma, n, ln) and lex, the tokens that count as steps.

    lemmas: a column of map<string, string>, from folded words to lemmas; words it lacks are their own. Without it, lemma is null.
    n, ln: the numbers by which rules know its word and its lemma, 0 if none does.
    name: what the names of the new columns begin with.
    """
    book = book or Book({}, ())
    parts, tiles, tok, lex = (f"{name}{x}" for x in ("parts", "tiles", "tok", "lex"))
    df = df.withColumn(parts, F.regexp_extract_all(F.col(text), F.lit(TILE), F.lit(0)))
    # A tile's place is what the blocks before its own hold, and what is before it in there: cheap for long texts, too.
    add = "0, (a, x) -> a + x"
    blocks = f"sequence(0, cast((size(ls) - 1) div {RUN} as int))"
    place = f"ba[j div {RUN}] + aggregate(slice(ls, cast({RUN} * (j div {RUN}) + 1 as int), j % {RUN}), {add})"
    # One blank before a token is none; what a run of white space has beyond it is a token.
    tile = f"if(startswith(p, ' '), named_struct('p', substr(p, 2), 'o', {place} + 1), named_struct('p', p, 'o', {place}))"
    placed = let(f"transform({blocks}, b -> aggregate(slice(ls, {RUN} * b + 1, {RUN}), {add}))", "bs", let(f"transform({blocks}, b -> aggregate(slice(bs, 1, b), {add}))", "ba", f"filter(transform(ps, (p, j) -> {tile}), t -> t.p <> '')"))
    df = df.withColumn(tiles, F.expr(let(parts, "ps", let("transform(ps, p -> length(p))", "ls", placed))))
    df = df.withColumn(tiles, F.transform(tiles, lambda t: F.struct(t["p"].alias("p"), t["o"].alias("o"), T.fold(t["p"]).alias("f"))))

    def lemma(word: Column) -> Column:
        return F.lit(None).cast("string") if lemmas is None else F.when(F.col(lemmas).isNotNull(), T.fold(F.coalesce(F.element_at(lemmas, word), word)))

    def token(t: Column, i: Column) -> Column:
        fold, blank = t["f"], F.trim(t["f"]) == ""
        line = F.contains(t["p"], F.lit("\n")) | F.contains(t["p"], F.lit("\r"))
        # Marks alone fold to nothing, too, but are no white space.
        white = blank & t["p"].rlike(rf"\A[{T.WHITE_CLASS}]+\z")
        return F.struct(i.alias("i"), t["o"].alias("idx"), t["p"].alias("text"), fold.alias("fold"), (white & ~line).alias("ws"), (t["p"].isin(*".,;:!?") | line).alias("brk"), lemma(fold).alias("lemma"), book.number(fold).alias("n"), (F.lit(0) if lemmas is None else F.coalesce(book.number(lemma(fold)), F.lit(0))).alias("ln"))

    return df.withColumn(tok, F.transform(tiles, token)).withColumn(lex, F.expr(f"filter({tok}, t -> not t.ws)")).drop(parts, tiles)


def spans(marked: str) -> str:
    """SQL: (s, n) of all marked matches that are not empty."""
    before = f"aggregate(slice(ps, 1, j), 0, (a, q) -> a + length(replace(q, '{CLOSE}', '')))"
    return let(f"split({marked}, '{OPEN}')", "ps", f"filter(transform(ps, (p, j) -> named_struct('j', j, 's', {before}, 'n', length(substring_index(p, '{CLOSE}', 1)))), z -> z.j > 0 and z.n > 0)")


def with_hits(df: DataFrame, book: Book) -> DataFrame:
    """``df`` (normalised, searched, flat, stripped, hot, hot_tok, lang) with hits that are not yet negated."""
    df = df.withColumn("marks", book.marks()).withColumn("of_word", book.word_rules()).withColumn("of_all", book.all_rules()).withColumn("of_pattern", book.pattern_rules())
    # Where nothing is collapsed or dropped, places of the normalised text are the text's.
    moved = (F.length("normalised") != F.length("stripped")) | (F.col("normalised") != T.fold(F.col("stripped")))
    df = df.withColumn("imap", F.when((F.size("marks") > 0) & moved, T.index_map(F.col("stripped"))))
    df = df.withColumn("present", F.expr("filter(hot_tok, t -> t.n > 0 or t.ln > 0)"))
    df = df.withColumn("whole", F.expr("filter(of_all, r -> forall(r.ns, n -> exists(present, t -> t.n = n)))"))
    df = df.withColumn("consumed", F.expr("flatten(transform(whole, r -> transform(filter(present, t -> array_contains(r.ns, t.n)), t -> named_struct('k', r.k, 'i', t.i))))"))
    token = "cast(named_struct('k', r.k, 'j', r.j, 'id', r.id, 'type', {type}, 'shown', {shown}, 'w', r.w, 's', t.idx, 'e', t.idx + length(t.text), 'text', t.text, 'exact', true, 'toks', array(t.i)) as " + HIT + ")"
    of_all = "flatten(transform(whole, r -> transform(r.ns, (n, v) -> " + let("filter(present, t -> t.n = n)[0]", "t", token.format(type="'all'", shown="r.shown[v]")) + ")))"
    of_words = "flatten(transform(of_word, r -> transform(filter(present, t -> if(r.type = 'keyword', t.n, t.ln) = r.n and not exists(consumed, c -> c.k = r.k and c.i = t.i)), t -> " + token.format(type="r.type", shown="r.shown") + ")))"
    none = "cast(array() as array<struct<j:int,s:int,n:int>>)"
    both = f"array_distinct(concat(coalesce({spans('m.a')}, {none}), coalesce({spans('m.b')}, {none})))"
    offset = lambda at: f"if(imap is null, {at}, if({at} < size(imap), get(imap, {at}), element_at(imap, -1) + 1))"
    collapsed = lambda at: f"coalesce(imap is not null and substr(normalised, {at} + 1, 1) = ' ' and get(imap, {at} + 1) - get(imap, {at}) > 1, false)"
    placed = f"transform({both}, z -> named_struct('s', {offset('z.s')}, 'e', {offset('(z.s + z.n)')}, 'exact', not ({collapsed('z.s')} or {collapsed('(z.s + z.n - 1)')})))"
    covering = f"transform({placed}, z -> named_struct('s', z.s, 'e', z.e, 'exact', z.exact, 'cover', filter(hot_tok, t -> t.idx < z.e and t.idx + length(t.text) > z.s)))"
    snapped = f"transform({covering}, z -> named_struct('s', coalesce(get(z.cover, 0).idx, z.s), 'e', z.e, 'exact', z.exact and coalesce(get(z.cover, 0).idx = z.s, true), 'toks', transform(z.cover, t -> t.i)))"
    free = f"array_sort(filter({snapped}, z -> not exists(z.toks, i -> exists(consumed, c -> c.k = r.k and c.i = i))), (a, b) -> case when a.s < b.s or (a.s = b.s and a.e < b.e) then -1 when a.s = b.s and a.e = b.e then 0 else 1 end)"
    hit = "cast(named_struct('k', r.k, 'j', r.j, 'id', r.id, 'type', 'pattern', 'shown', r.shown, 'w', r.w, 's', z.s, 'e', z.e, 'text', substr(stripped, z.s + 1, z.e - z.s), 'exact', z.exact, 'toks', z.toks) as " + HIT + ")"
    # In order of place, a hit is dropped if its rule has one there already or has claimed one of its tokens.
    once = f"aggregate({free}, cast(array() as array<{HIT}>), (acc, z) -> if(exists(acc, h -> (h.s = z.s and h.e = z.e) or arrays_overlap(h.toks, z.toks)), acc, array_append(acc, {hit})))"
    of_patterns = f"flatten(transform(marks, m -> {let('of_pattern[m.p]', 'r', once)}))"
    return df.withColumn("raw", F.expr(f"concat({of_all}, {of_words}, {of_patterns})")).drop("marks", "of_word", "of_all", "of_pattern", "imap", "present", "whole", "consumed")


def negator_ends(lex: str) -> str:
    """SQL: places in ``lex`` at which a negator ends (phrases: their words' numbers)."""
    ends = f"exists(phrases, ph -> {lex}[p].n = element_at(ph, -1) and p + 1 >= size(ph) and forall(sequence(1, size(ph)), x -> {lex}[p - size(ph) + x].n = ph[x - 1]))"
    return f"filter(sequence(0, size({lex})), p -> p < size({lex}) and {lex}[p].n > 0 and {ends})"


def with_negation(df: DataFrame, book: Book, window: int) -> DataFrame:
    """``df`` with hits: raw and whether each is negated."""
    df = df.withColumn("phrases", book.phrases()).withColumn("stops", book.stops())
    df = df.withColumn("hot_neg", F.expr(f"if(size(raw) > 0, {negator_ends('hot_lex')}, cast(array() as array<int>))"))
    df = df.withColumn("bar", F.expr("if(size(hot_neg) > 0, filter(sequence(0, size(hot_lex)), p -> p < size(hot_lex) and (hot_lex[p].brk or array_contains(stops, hot_lex[p].n))), cast(array() as array<int>))"))
    # The last negator before the hit counts if it is near enough and no later word bars it.
    start = "if(size(hot_lex) = size(hot_tok), h.toks[0], size(filter(hot_lex, t -> t.i < h.toks[0])))"
    negated = let(start, "at", let("named_struct('n', array_max(filter(hot_neg, p -> p < at)), 'b', array_max(filter(bar, p -> p < at)))", "x", f"coalesce(at - x.n <= {window} and (x.b is null or x.b <= x.n), false)"))
    hits = f"transform(raw, h -> named_struct('k', h.k, 'j', h.j, 'id', h.id, 'type', h.type, 'shown', h.shown, 'w', h.w, 's', h.s, 'e', h.e, 'text', h.text, 'exact', h.exact, 'toks', h.toks, 'negated', size(hot_neg) > 0 and size(h.toks) > 0 and {negated}))"
    return df.withColumn("hits", F.expr(hits)).drop("raw", "bar", "hot_neg", "stops")


def ranked(df: DataFrame, book: Book, settings: Settings) -> DataFrame:
    """``df`` (hits) with kept, dropped, primary, confidence, multi_intent and rank_reason."""
    df = df.withColumn("intents", book.intents())
    # Weights are added in the order of rules.
    rules = "array_sort(array_distinct(transform(own, h -> named_struct('j', h.j, 'type', h.type, 'w', h.w))))"
    credited = "exists(own, h -> h.j = r.j and not h.negated) and (r.type <> 'all' or forall(own, h -> h.j <> r.j or not h.negated))"
    score = let("filter(hits, h -> h.k = k)", "own", f"aggregate(filter({rules}, r -> {credited}), cast(0 as double), (a, r) -> a + r.w)")
    made = "named_struct('less', -sc, 'lower', -it.priority, 'intent', it.id, 'label', it.label, 'score', sc, 'priority', it.priority, 'min_score', it.min_score, 'k', it.k)"
    scores = f"transform(array_distinct(transform(hits, h -> h.k)), k -> {let(score, 'sc', let('intents[k]', 'it', made))})"
    df = df.withColumn("scores", F.expr(f"array_sort({scores})"))
    df = df.withColumn("fit", F.expr("filter(scores, s -> s.score > 0 and s.score >= s.min_score)"))
    df = df.withColumn("top", F.expr("coalesce(round(get(fit, 0).score / (get(fit, 0).score + 1), 4), cast(0 as double))"))
    df = df.withColumn("gated", (F.size("fit") > 0) & (F.col("top") < settings.min_confidence))
    df = df.withColumn("keep", F.expr(f"if(gated, filter(fit, s -> false), slice(fit, 1, {max(1, settings.max_intents)}))"))
    view = "named_struct('intent', s.intent, 'label', s.label, 'score', s.score, 'confidence', round(s.score / (s.score + 1), 4), 'priority', s.priority, 'min_score', s.min_score, 'k', s.k)"
    df = df.withColumn("kept", F.expr(f"transform(keep, s -> {view})")).withColumn("dropped", F.expr(f"transform(filter(scores, s -> not exists(keep, x -> x.k = s.k)), s -> {view})"))
    df = df.withColumn("primary", F.expr(f"coalesce(get(kept, 0).intent, '{UNKNOWN}')")).withColumn("confidence", F.expr("if(size(kept) > 0, top, cast(0 as double))"))
    return df.withColumn("multi_intent", F.expr("size(kept) > 1")).withColumn("rank_reason", F.expr("if(gated, 'low_confidence', 'ok')")).drop("fit", "top", "gated", "keep", "scores", "intents")


def explained(df: DataFrame) -> DataFrame:
    """``df`` with explanation, trace, matched and negated (token numbers)."""
    first = "concat('Mensagem classificada como ', get(kept, 0).label, ' (regras: ', coalesce(nullif(array_join(transform(filter(hits, h -> h.k = get(kept, 0).k and not h.negated), h -> concat(h.type, ' ''', h.shown, '''')), ', '), ''), 'nenhuma regra'), ').')"
    unsupported = F.lit("Idioma não suportado.")
    for reason, said in EXPLAIN_UNSUPPORTED.items():
        unsupported = F.when(F.col("lang.reason") == reason, said).otherwise(unsupported)
    unsupported = F.when(F.col("lang.reason") == "unsupported_script", F.concat(F.lit("Idioma não suportado (escrita "), F.col("lang.script"), F.lit(")."))).otherwise(unsupported)
    df = df.withColumn("explanation", F.when(~F.col("lang.supported"), unsupported).when(F.col("primary") == UNKNOWN, EXPLAIN_UNKNOWN).otherwise(F.expr(first)))
    df = df.withColumn("trace", F.expr("flatten(transform(concat(kept, dropped), x -> filter(hits, h -> h.k = x.k)))"))
    counted = f"filter(hits, h -> primary = '{UNKNOWN}' or exists(kept, x -> x.k = h.k))"
    for name, test in (("matched", "not h.negated"), ("negated", "h.negated")):
        df = df.withColumn(name, F.expr(f"array_sort(array_distinct(flatten(transform(filter({counted}, h -> {test}), h -> h.toks))))"))
    return df


def detect(messages: DataFrame, settings: Settings = Settings(), sets: dict[str, RuleSet] | None = None, text: str = "text", gates: bool = True, require_supported: bool = False, lemmas: str | None = None) -> DataFrame:
    """``messages`` and what each one says.

    lemmas: see ``tokenised``; without it, rules on lemmas are skipped.

    gates: messages that are empty, too short or too long get an error_code and no intents instead of an exception;
    require_supported: so do those in a language that is not supported.

    Null texts are empty. Columns of ``messages`` are kept as they are, whatever their names, but for those that are named
    like a result, which the result replaces.
    """
    sets = sets or {lang: shipped_rules(lang) for lang in settings.languages}
    book = Book.of(sets)
    kept = [c for c in messages.columns if c not in FOUND]
    own = {c: f"_own{k}" for k, c in enumerate(kept)}
    df = messages.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), F.col(text).alias("_text"), *([F.col(lemmas).alias("_lemmas")] if lemmas else []))
    lemmas = "_lemmas" if lemmas else None
    df = df.withColumn("stripped", T.stripped_text(F.coalesce(F.col("_text"), F.lit(""))))
    df = df.withColumn("error_code", T.gate(F.col("_text"), settings.min_text_chars, settings.max_text_chars) if gates else F.lit(None).cast("string"))
    df = identified(df.withColumn("_read", F.when(F.col("error_code").isNull(), F.col("stripped")).otherwise("")), settings, "_read")
    df = df.withColumn("stripped", F.when(F.col("lang.supported"), F.col("_read")).otherwise("")).drop("_read")
    df = df.withColumn("searched", F.translate("normalised", OPEN + CLOSE, OTHER + OTHER)).withColumn("flat", T.without_punctuation(F.col("normalised")))
    df = df.withColumn("hot", F.col("lang.supported") & (book.may_hit() if lemmas is None else book.may_hit() | F.col("_lemmas").isNotNull()))
    df = df.withColumn("hot_text", F.when(F.col("hot"), F.col("stripped")).otherwise("")).withColumn("cold_text", F.when(F.col("hot"), "").otherwise(F.col("stripped")))
    df = tokenised(df, "hot_text", lemmas, book, "hot_")
    df = explained(ranked(with_negation(with_hits(df, book), book, settings.negation_window), book, settings))
    # Tokens of messages without hits, for those who ask for them.
    df = tokenised(df, "cold_text", lemmas, book, "cold_")
    for name in ("tok", "lex"):
        df = df.withColumn(name, F.when(F.col("hot"), F.col(f"hot_{name}")).otherwise(F.col(f"cold_{name}")))
    df = df.withColumn("neg", F.expr(negator_ends("lex")))
    if require_supported:
        df = df.withColumn("error_code", F.when(F.col("error_code").isNull() & ~F.col("lang.supported"), "unsupported_language").otherwise(F.col("error_code")))
    df = df.withColumn("rules_version", book.chosen(lambda lang: F.lit(sets[lang].version), F.lit("")))
    df = kept_apart(df, list(own.values()), list(FOUND))
    return df.select(*(F.col(n).alias(c) for c, n in own.items()), *FOUND)


def detect_batch(messages: DataFrame, settings: Settings = Settings(), limit: int | None = None, **options) -> DataFrame:
    """``detect`` without gates on length. limit: raises ValueError if there are more messages, as an interactive caller may want."""
    if limit is not None and messages.limit(limit + 1).count() > limit:
        raise ValueError(f"a batch has at most {limit} messages")
    return detect(messages, settings, gates=False, **options)


#: A token's columns; names of Spark's lists of stop words.
VIEWED = ("i", "text", "lemma", "is_stop", "is_sentence_start", "matched", "negated")
STOP_LISTS = {"pt": "portuguese", "en": "english"}


def token_view(detected: DataFrame) -> DataFrame:
    """A row a token of ``detect``'s result: ``VIEWED``, and the message's own columns but for those that are named like these.

    Stop words are those of Spark's list for the message's language. A sentence starts at the first token that is more than
    white space, and after a full stop, a question or exclamation mark or a line break, unless one of these follows.
    """
    kept = [c for c in detected.columns[: detected.columns.index("error_code")] if c not in VIEWED]
    stops = {lang: folded(StopWordsRemover.loadDefaultStopWords(name)) for lang, name in STOP_LISTS.items()}
    ender = "(t.text in ('.', '!', '?') or (t.brk and trim(t.fold) = ''))"
    starts = f"filter(sequence(0, size(lex)), p -> p < size(lex) and not {ender.replace('t.', 'lex[p].')} and (p = 0 or {ender.replace('t.', 'lex[p - 1].')}))"
    df = detected.withColumn("_starts", F.expr(f"transform({starts}, p -> lex[p].i)")).withColumn("_lang", F.col("lang.language"))
    rows = df.select(*kept, "_lang", "_starts", "matched", "negated", F.explode("tok").alias("t"))
    stop = by_language_of("_lang", {lang: F.col("t.fold").isin(words) for lang, words in stops.items()}, F.lit(False))
    return rows.select(*kept, "t.i", "t.text", "t.lemma", stop.alias("is_stop"), F.expr("array_contains(_starts, t.i)").alias("is_sentence_start"), F.expr("array_contains(matched, t.i)").alias("matched"), F.expr("array_contains(negated, t.i)").alias("negated"))


#: What ``resulted`` puts into a result, in order.
RESULT = ("language", "language_reason", "primary", "confidence", "multi_intent", "rank_reason", "intents", "dropped", "rules_version", "resources", "explanation")


def resulted(detected: DataFrame, sets: dict[str, RuleSet], lemmas: bool = False) -> DataFrame:
    """``detected`` and result: all of it as JSON, with the resources of each language."""
    views = [F.struct(F.lit(lang).alias("language"), F.lit(x.version).alias("version"), F.lit(len(x.intents)).alias("entries"), F.lit(x.sha256).alias("sha256"), F.array(*map(F.lit, limitations(x, lemmas))).cast("array<string>").alias("limitations")) for lang, x in sets.items()]

    def view(name: str) -> Column:
        return F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in ("intent", "label", "score", "confidence", "priority", "min_score"))))

    of = {"language": F.col("lang.language"), "language_reason": F.col("lang.reason"), "intents": view("kept"), "dropped": view("dropped"), "resources": F.array(*views)}
    return detected.withColumn("result", F.to_json(F.struct(*(of.get(c, F.col(c)).alias(c) for c in RESULT)), {"ignoreNullFields": "false"}))


def measured(detected: DataFrame, name: str | Observation) -> DataFrame:
    """``detected``, observed under ``name``: what it was like is known after one action, or for each micro-batch, without a second pass.

    Counts of messages, of each reason and error, and of those with an intent. The time is the query's own: Spark reports it.
    """
    reasons = ("ok", "insufficient_signal", "ambiguous_language", "unsupported_script", "empty_text")
    errors = ("empty", "too_short", "too_long", "unsupported_language")
    counts = [F.count(F.lit(1)).alias("messages"), F.count_if(F.col("primary") != UNKNOWN).alias("with_intent"), F.count_if("multi_intent").alias("multi_intent")]
    counts += [F.count_if(F.col("lang.reason") == x).alias(f"reason_{x}") for x in reasons] + [F.count_if(F.col("error_code") == x).alias(f"error_{x}") for x in errors]
    return detected.observe(name, *counts)
