"""Rule sets: read, validated, and as tables.

A rule set is a JSON document (language, version, intents with rules, negators, negation_boundaries). ``shipped``
holds the two that come with the engine; ``load`` reads one from any path that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textnorm import WHITE, fold_map
from . import shipped

RULES = "language string, version string, intent_id string, intent_idx int, label string, priority int, min_score double, rule_idx int, rule_id string, type string, value array<string>, weight double"
WORD = r"[\p{L}\p{N}_]"


class RulesError(ValueError):
    def __init__(self, path: str, message: str):
        super().__init__(f"{path or 'document'}: {message}")
        self.path = path


@dataclass(frozen=True)
class RuleSet:
    language: str
    version: str
    intents: tuple[dict, ...]
    negators: tuple[str, ...]
    boundaries: tuple[str, ...]
    sha256: str

    def by_id(self, intent_id: str) -> dict:
        found = [x for x in self.intents if x["id"] == intent_id]
        if not found:
            raise KeyError(f"unknown intent {intent_id}")
        return found[0]


def violations(doc: object) -> Iterator[tuple[str, str]]:
    """(path, message) of all faults of a rule document, in the order in which they are to be reported."""

    def blank(x: object) -> bool:
        return not (isinstance(x, str) and x.strip())

    def positive(x: object) -> bool:
        try:
            return not isinstance(x, bool) and math.isfinite(float(x)) and float(x) > 0
        except (TypeError, ValueError):
            return False

    def compiles(x: str) -> bool:
        try:
            bare = fold_text(x)
            re.compile(bare), re.compile(rf"(?<!\w){bare}(?!\w)")
        except re.error:
            return False
        return True

    def word(x: object) -> bool:
        return not blank(x) and not any(c in WHITE for c in x) and compiles(x)

    if not isinstance(doc, dict):
        yield "", "must be an object"
        return
    if not (isinstance(doc.get("language"), str) and re.fullmatch(r"[a-z]{2}", doc["language"])):
        yield "language", "must be two lower-case letters"
    if not (isinstance(doc.get("version"), str) and re.fullmatch(r"\d+\.\d+\.\d+", doc["version"])):
        yield "version", "must be like 1.0.0"
    intents = doc.get("intents")
    if not isinstance(intents, list) or not intents:
        yield "intents", "must be a list with at least one intent"
        intents = []
    names = set()
    for i, intent in enumerate(intents):
        at = f"intents.{i}"
        if not isinstance(intent, dict):
            yield at, "must be an object"
            continue
        if not (isinstance(intent.get("id"), str) and re.fullmatch(r"[a-z][a-z0-9_]*", intent["id"])):
            yield f"{at}.id", "must be a lower-case name"
        if blank(intent.get("label")):
            yield f"{at}.label", "must not be blank"
        if not isinstance(intent.get("priority"), int) or isinstance(intent.get("priority"), bool):
            yield f"{at}.priority", "must be a whole number"
        if not positive(intent.get("min_score")):
            yield f"{at}.min_score", "must be a positive number"
        rules = intent.get("rules")
        if not isinstance(rules, list) or not rules:
            yield f"{at}.rules", "must be a list with at least one rule"
            rules = []
        seen = set()
        for j, rule in enumerate(rules):
            here = f"{at}.rules.{j}"
            if not isinstance(rule, dict):
                yield here, "must be an object"
                continue
            kind, value = rule.get("type"), rule.get("value")
            if not isinstance(kind, str) or kind not in ("keyword", "lemma", "pattern", "all"):
                yield f"{here}.type", "must be keyword, lemma, pattern or all"
            elif kind == "all":
                if not isinstance(value, list) or len(value) < 2:
                    yield f"{here}.value", "must be a list of two words or more"
                else:
                    yield from ((f"{here}.value.{k}", "must be one word") for k, x in enumerate(value) if not word(x))
            elif kind == "pattern":
                if blank(value) or not compiles(value):
                    yield f"{here}.value", "must be a pattern that compiles, also between word boundaries"
            elif not word(value):
                yield f"{here}.value", "must be one word"
            if not positive(rule.get("weight")):
                yield f"{here}.weight", "must be a positive number"
            key = json.dumps([kind, value])
            if key in seen:
                yield here, "is there twice"
            seen.add(key)
        examples = intent.get("examples")
        if not isinstance(examples, list):
            yield f"{at}.examples", "must be a list"
        else:
            yield from ((f"{at}.examples.{k}", "must not be blank") for k, x in enumerate(examples) if blank(x))
        name = json.dumps(intent.get("id"))
        if name in names:
            yield f"{at}.id", "is there twice"
        names.add(name)
    for key in ("negators", "negation_boundaries"):
        if not isinstance(doc.get(key), list):
            yield key, "must be a list"
        else:
            yield from ((f"{key}.{k}", "must not be blank") for k, x in enumerate(doc[key]) if blank(x))


def fold_text(text: str) -> str:
    """Without combining marks."""
    source, to = fold_map(False, False)
    return text.translate({ord(a): to[k] if k < len(to) else None for k, a in enumerate(source) if a in text})


def shipped_document(language: str) -> dict:
    if language not in shipped.NEGATORS:
        raise KeyError(f"no rules for language {language}")
    intents = [{"id": name, "label": label, "priority": priority, "min_score": least, "rules": [{"type": t, "value": v, "weight": w} for t, v, w in rules], "examples": shipped.EXAMPLES[lang, name]} for lang, name, label, priority, least, rules in shipped.INTENTS if lang == language]
    return {"language": language, "version": shipped.VERSION, "intents": intents, "negators": shipped.NEGATORS[language], "negation_boundaries": shipped.BOUNDARIES[language]}


def rule_set(raw: bytes, language: str | None = None) -> RuleSet:
    """Raises RulesError with the first fault's path."""
    try:
        doc = json.loads(raw)
    except ValueError as e:
        raise RulesError("", str(e)) from None
    for path, message in violations(doc):
        raise RulesError(path, message)
    return RuleSet(language or doc["language"], doc["version"], tuple(doc["intents"]), tuple(doc["negators"]), tuple(doc["negation_boundaries"]), hashlib.sha256(raw).hexdigest())


def shipped_rules(language: str) -> RuleSet:
    return rule_set(json.dumps(shipped_document(language), ensure_ascii=False).encode(), language)


def load(spark: SparkSession, path: str, language: str | None = None) -> RuleSet:
    """From a file of any store that Spark reads; the digest is of its raw bytes."""
    return rule_set(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), language)


def load_all(spark: SparkSession, folder: str, languages: tuple[str, ...]) -> dict[str, RuleSet]:
    """``folder``/<language>.json of each language, in order; the first that is missing or faulty raises."""
    return {lang: load(spark, f"{folder.rstrip('/')}/{lang}.json", lang) for lang in languages}


def load_markers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The words that speak for each language, from a profile file {languages: {language: {exclusive, shared}}}."""
    doc = json.loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return {lang: list(profile["exclusive"]) for lang, profile in doc["languages"].items()}


def limitations(rules: RuleSet, lemmas: bool = False) -> list[str]:
    """What can't be done with a rule set. lemmas: whether messages come with them."""
    asks = any(r["type"] == "lemma" for i in rules.intents for r in i["rules"])
    return [f"rules on lemmas are skipped for {rules.language}"] if asks and not lemmas else []


def report(spark: SparkSession, *sets: RuleSet, lemmas: bool = False) -> DataFrame:
    """What detection has at hand for each language: rules, tokeniser, and what it can't do. lemmas: whether messages come with them."""
    rows = []
    for x in sets:
        rows.append((x.language, x.version, len(x.intents), x.sha256, f"tiles({x.language})", limitations(x, lemmas)))
    return spark.createDataFrame(rows, "language string, version string, entries int, sha256 string, tokeniser string, limitations array<string>")


def rule_rows(rules: RuleSet) -> list[tuple]:
    out = []
    for k, intent in enumerate(rules.intents):
        for j, rule in enumerate(intent["rules"]):
            value = rule["value"] if isinstance(rule["value"], list) else [rule["value"]]
            out.append((rules.language, rules.version, intent["id"], k, intent["label"], intent["priority"], float(intent["min_score"]), j, f"{intent['id']}:{j}", rule["type"], value, float(rule["weight"])))
    return out


def rules_table(spark: SparkSession, *sets: RuleSet) -> DataFrame:
    """One row a rule."""
    return spark.createDataFrame([row for x in sets for row in rule_rows(x)], RULES)


def catalogue(rules: DataFrame) -> DataFrame:
    """One row an intent, with its number of rules."""
    return rules.groupBy("language", "intent_id", "label", "priority", "min_score").agg(F.count("*").alias("rule_count"))


def dump(spark: SparkSession, *sets: RuleSet) -> DataFrame:
    """One row a rule set: all intents with their rules, negators and boundaries."""
    rule = "struct<rule_id:string,type:string,value:array<string>,weight:double>"
    kind = f"language string, version string, sha256 string, intents array<struct<id:string,label:string,priority:int,min_score:double,rules:array<{rule}>,examples:array<string>>>, negators array<string>, boundaries array<string>"
    rows = []
    for x in sets:
        intents = [(i["id"], i["label"], i["priority"], float(i["min_score"]), [(f"{i['id']}:{j}", r["type"], r["value"] if isinstance(r["value"], list) else [r["value"]], float(r["weight"])) for j, r in enumerate(i["rules"])], i["examples"]) for i in x.intents]
        rows.append((x.language, x.version, x.sha256, intents, list(x.negators), list(x.boundaries)))
    return spark.createDataFrame(rows, kind)


def java_pattern(value: str) -> str:
    """A rule's pattern between word boundaries, which reach a whole alternation only if it is in a group of its own."""
    return rf"(?<!{WORD}){fold_text(value)}(?!{WORD})"


def markers_table(spark: SparkSession, languages: tuple[str, ...]) -> DataFrame:
    rows = [(lang, word, kind) for kind, words in (("exclusive", shipped.EXCLUSIVE), ("shared", shipped.SHARED)) for lang in languages for word in words[lang]]
    return spark.createDataFrame(rows, "language string, word string, kind string")
