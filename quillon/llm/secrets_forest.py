"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame operations only.

A candidate is a run of at least ``RUN`` characters of keys and tokens (letters, digits and ``+/_.~-``) that holds a
digit, or what follows a keyword and ``:`` or ``=``. Each is described by its length, transitions between kinds of
characters and common letter pairs, the share that dictionary words cover, its text's path, and the words beside it.
The forest learns these from labelled findings: any table of (before, value, after, path, label). ``findings`` makes
a labelled table of ``per_kind`` rows for each of its kinds from a counter and digests; use your own where there is one.

A fitted forest becomes a Column expression (nested conditions on the features), so that a text's candidates are found,
scored and masked within its row: nothing is shuffled, no row needs a number, and no helper column can clash with one of
the table's. Texts that hold no candidate are passed by one pattern.

Defined cases: null and empty texts have no candidates; a null path is an empty one; repeated rows are scanned
each for itself; U+0001 and U+0002, which mark candidates here, part candidates as blanks do and stay in the text; a
candidate of any length is one finding; context reaches back to the candidate before at most; an empty table gives an
empty result; other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

RUN = 12
CHARS = "A-Za-z0-9+/_.~-"
KEYWORDS = "passw(?:or)?d|passwd|pwd|secret|token|api_?key|access_?key|credential|bearer"
ASSIGNED = rf"(?i:{KEYWORDS})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?"
#: A run with a digit, all of it.
RUNS = rf"(?<![{CHARS}])(?=[{CHARS}]{{{RUN}}})[A-Za-z+/_.~-]*+[0-9]"
#: Group 1 is a keyword and what binds it, group 2 or 3 the candidate.
CANDIDATE = rf"({ASSIGNED})([^\s\"']{{6,}})|({RUNS}[{CHARS}]*+={{0,2}})"
#: What a text with a candidate has.
HINT = rf"{RUNS}|{ASSIGNED}[^\s\"']{{6}}"
START, END = "\u0001", "\u0002"
BESIDE = 48
#: Pieces of a text whose lengths are added up one by one; beyond, by blocks of so many.
SUMMED = 256
#: Words that names, hosts and placeholders are made of; common English letter pairs.
DICTIONARY = "example|password|changeme|placeholder|sample|secret|token|test|user|admin|demo|dummy|your|here|mail|server|host|local|config|version|release|chapter|section|profile|order|invoice|image|index|file|data|name|list|page|item|report|account|service|client|number|string|value|default|public|static|module|package|com|org|net"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
KNOWN = "^(?:AKIA|ASIA|gh[opsu]_|sk_live_|rk_live_|xox[abp]-|AIza|glpat-|eyJ)"


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    chars = F.split(value, "")
    before_end = r"(?i)(?:" + KEYWORDS + r")[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"

    def share(pattern: str) -> Column:
        """Matches of a pattern for each character."""
        return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))

    def flag(column: Column, pattern: str) -> Column:
        return column.rlike(pattern).cast("double")

    found = {
        "length": F.least(F.length(value), F.lit(256)).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "letter_to_digit": share("(?<=[A-Za-z])[0-9]"),
        "digit_to_letter": share("(?<=[0-9])[A-Za-z]"),
        "lower_to_upper": share("(?<=[a-z])[A-Z]"),
        "same_again": share(r"(.)(?=\1)"),
        "common_pairs": share(f"(?i)(?=(?:{PAIRS}))."),
        "vowel_turns": share("(?i)[aeiou][bcdfghjklmnpqrstvwxyz]"),
        "distinct": F.size(F.array_distinct(chars)) / F.greatest(F.length(value), F.lit(1)),
        "separators": share("[-._/~+]"),
        "hex": flag(value, "^[0-9a-fA-F]+$"),
        "upper_or_digit": flag(value, "^[A-Z0-9]+$"),
        "known_prefix": flag(value, KNOWN),
        "uuid": flag(value, "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
        "host": flag(value, r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,8}$"),
        "dictionary": (F.length(value) - F.length(F.regexp_replace(F.lower(value), DICTIONARY, ""))) / F.greatest(F.length(value), F.lit(1)),
        "path_test": flag(path, "(?i)test|spec|mock|example|sample|fixture|docs?/"),
        "path_config": flag(path, r"(?i)\.(?:env|pem|key|cfg|conf|ini|ya?ml|json|tf|properties)$"),
        "path_depth": F.length(F.regexp_replace(path, "[^/]", "")).cast("double"),
        "keyword_before": flag(before, before_end),
        "keyword_near": flag(before, f"(?i)(?:{KEYWORDS})"),
        "assigned": flag(before, r"[:=]\s{0,2}[\"']?$"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "address": flag(before, "@$"),
        "in_url": flag(before, r"(?i)(?:https?://|www\.)\S*$"),
        "digest_near": flag(before, "(?i)(?:sha-?(?:1|256|512)?|md5|checksum|commit|revision|uuid|guid|etag|digest|integrity|build|version)\\W{0,4}$"),
        "placeholder_near": F.concat_ws(" ", before, after).rlike("(?i)example|placeholder|dummy|sample|fake").cast("double"),
    }
    return {name: F.coalesce(column.cast("double"), F.lit(0.0)) for name, column in found.items()}


def findings(spark: SparkSession, per_kind: int = 240) -> DataFrame:
    """before, value, after, path, label: labelled findings, made from a counter and digests of it."""
    kinds = {
        "upper(translate(concat('AKIA', substr(translate(h, '01234567', 'QWRTYUIP'), 1, 16)), '89', '27'))": ("{w}", 1),
        "substr(h, 1, 40)": ("{w} token = \"", 1),
        "substr(h, 3, 18)": ("{w} password=", 1),
        "base64(unhex(h))": ("{w} secret: '", 1),
        "concat('ghp_', substr(translate(base64(unhex(h)), '+/=', 'abc'), 1, 36))": ("{w}", 1),
        "concat('sk_live_', substr(translate(base64(unhex(h)), '+/=', 'xyz'), 1, 24))": ("{w} key ", 1),
        "substr(h, 9, 32)": ("{w} api_key: ", 1),
        "concat(substr(translate(base64(unhex(h)), '+/=', '!#$'), 2, 12), '9')": ("{w} pwd: ", 1),
        "concat('mail', i % 10, '.example', i % 7, '.com')": ("{w} name.' || (i % 99) || '@", 0),
        "concat('www', i % 5, '.server', i % 11, '.net/page/', i)": ("{w} https://", 0),
        "concat(substr(h,1,8),'-',substr(h,9,4),'-4',substr(h,14,3),'-a',substr(h,18,3),'-',substr(h,21,12))": ("{w} uuid: ", 0),
        "h": ("{w} sha256:", 0),
        "substr(h, 1, 40) ": ("{w} commit ", 0),
        "concat(i % 9, '.', i % 20, '.', i % 7, '-release.', 20240000 + i)": ("{w} version ", 0),
        "concat('user_profile_', i, '_data_list')": ("{w}", 0),
        "concat('2024-0', 1 + i % 9, '-1', i % 9, 'T1', i % 9, '.00.00')": ("{w} at ", 0),
        "cast(4000000000000000 + i * 7919 as string)": ("{w} card ", 0),
        "concat('changeme', i % 1000)": ("{w} password=", 0),
        "concat('your_token_here_', i % 50)": ("{w} token = \"", 0),
        "repeat(substr(h, 1, 1), 20 + i % 20) ": ("{w} secret: ", 0),
        "concat('chapter', i % 40, 'section', i % 9, 'thereafter', i % 5)": ("{w}", 0),
        "concat('thandtion', i % 100, 'eringested')": ("{w}", 0),
        "concat(if(i % 2 = 0, 'ghp_', 'sk_live_'), substr(h, 5, 36))": ("{w}", 1),
    }
    words = "array('the', 'and of', 'in that', 'with', 'por la', 'der die', 'le des', 'value', 'see', 'set')"
    paths = "array('', 'src0', 'src/app/config.yml', 'docs/readme.md', 'tests/test_login.py', 'deploy/.env', 'lib/util.py', 'src7')"
    befores, values, afters, labels = [], [], [], []
    for value, (before, label) in kinds.items():
        befores.append("'" + before.replace("'", "''").replace("'' || (i % 99) || ''", "' || (i % 99) || '").replace("{w}", "' || w || ' ") + "'")
        values.append(f"trim({value})")
        afters.append(("'\"'" if before.endswith('"') else "''''" if before.endswith("'") else "''") + " || ' ' || w")
        labels.append(str(label))

    def of_kind(each: list[str]) -> str:
        return "CASE k " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(each)) + " END"

    # All kinds in one pass: a union of them has a task for each kind and core, and a plan that grows with their number.
    rows = spark.range(per_kind).selectExpr("id as i", f"explode(sequence(0, {len(kinds) - 1})) as k")
    rows = rows.selectExpr("i", "k", "sha2(concat('finding-', k, '-', i), 256) as h", f"element_at({words}, cast(1 + pmod(xxhash64(i, k), 10) as int)) as w", f"element_at({paths}, cast(1 + pmod(xxhash64(i, k, 'p'), 8) as int)) as path")
    return rows.selectExpr(f"{of_kind(befores)} as before", f"{of_kind(values)} as value", f"{of_kind(afters)} as after", "path", f"{of_kind(labels)} as label")


#: A leaf is the share of secrets that reach it; else (feature, threshold, what is at most it, what is above).
Tree = float | tuple


@dataclass(frozen=True)
class Forest:
    names: tuple[str, ...]
    trees: tuple[Tree, ...]

    def score(self, of: dict[str, Column] | Column) -> Column:
        """Mean over the trees of the share of secrets in the leaf; of: features by name."""

        def walked(tree: Tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, threshold, low, high = tree
            return F.when(of[name] <= F.lit(threshold), walked(low)).otherwise(walked(high))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + walked(tree)
        return total / F.lit(float(max(1, len(self.trees))))


def grown(node, names: tuple[str, ...]) -> Tree:
    """A fitted node as a ``Tree``."""
    if node.getClass().getSimpleName() == "LeafNode":
        votes = list(node.impurityStats().stats())
        return votes[1] / sum(votes) if len(votes) > 1 and sum(votes) else 0.0
    low, high = grown(node.leftChild(), names), grown(node.rightChild(), names)
    return low if low == high else (names[node.split().featureIndex()], float(node.split().threshold()), low, high)


def training_rows(labelled: DataFrame, most_rows: int) -> DataFrame:
    """label and features of labelled findings, at most ``most_rows`` of them by a hash of their value."""
    rows = labelled.where("label IN (0, 1) AND value IS NOT NULL").select(F.coalesce("before", F.lit("")).alias("before"), "value", F.coalesce("after", F.lit("")).alias("after"), F.coalesce("path", F.lit("")).alias("path"), F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("value", "before", "path", "label")).limit(most_rows)
    of = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    return rows.select("label", *(column.alias(name) for name, column in of.items()))


def train(labelled: DataFrame, trees: int = 16, depth: int = 7, most_rows: int = 20_000) -> Forest:
    """A forest from labelled findings (before, value, after, path, label)."""
    rows = training_rows(labelled, most_rows)
    names = tuple(c for c in rows.columns if c != "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="onethird").fit(VectorAssembler(inputCols=list(names), outputCol="features").transform(rows))
    return Forest(names, tuple(grown(tree._java_obj.rootNode(), names) for tree in model.trees))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    """A text as value and rest, in order: what is before its first candidate (an empty value), then each candidate and what follows it."""
    marked = F.regexp_replace(F.translate(text, START + END, "  "), CANDIDATE, f"$1{START}$2$3{END}")
    return F.transform(F.split(marked, START), lambda p, i: F.struct(F.when(i > 0, F.substring_index(p, END, 1)).otherwise("").alias("value"), F.when(i > 0, F.substring_index(p, END, -1)).otherwise(p).alias("rest")))


def judged(text: Column, path: Column, forest: Forest) -> Column:
    """``pieces`` with score; the first piece has none."""
    path = F.coalesce(path.cast("string"), F.lit(""))

    def scored(all_: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.right(F.coalesce(F.get(all_, i - 1)["rest"], F.lit("")), F.lit(BESIDE))
            of = F.struct(*(column.alias(name) for name, column in features(p["value"], before, F.left(p["rest"], F.lit(BESIDE)), path).items()))
            return F.struct(p["value"].alias("value"), p["rest"].alias("rest"), F.when(i > 0, let(of, forest.score)).alias("score"))

        return F.transform(all_, one)

    return let(pieces(text), scored)


def starts(all_: Column) -> Column:
    """Where each piece begins: lengths are added up in blocks, so that a text with very many pieces takes little longer a piece."""
    zero = F.lit(0).cast("long")

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, zero, lambda a, x: a + x)

    def added(sizes: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / SUMMED).cast("int")), lambda b: total(F.slice(sizes, b * SUMMED + 1, F.lit(SUMMED))))
        before = let(sums, lambda s: F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))))
        return let(before, lambda done: F.transform(sizes, lambda x, i: F.get(done, F.floor(i / SUMMED).cast("int")) + total(F.slice(sizes, F.floor(i / SUMMED).cast("int") * SUMMED + 1, i % SUMMED))))

    return let(F.transform(all_, lambda p: (F.length(p["value"]) + F.length(p["rest"])).cast("long")), added)


def scan(documents: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """doc_id, start (characters before it), length, value_sha256, score, is_secret of each candidate."""
    text = F.col("text").cast("string")
    rows = documents.where(text.rlike(HINT)).select("doc_id", judged(text, F.col(path), forest).alias("pieces"))
    found = rows.select("doc_id", F.explode(F.arrays_zip("pieces", starts(F.col("pieces")).alias("start"))).alias("x")).where("x.pieces.score IS NOT NULL")
    value, score = F.col("x.pieces.value"), F.col("x.pieces.score")
    return found.select("doc_id", F.col("x.start").alias("start"), F.length(value).alias("length"), F.sha2(value, 256).alias("value_sha256"), F.round(score, 6).alias("score"), (score >= 0.5).alias("is_secret"))


def redact(documents: DataFrame, forest: Forest, path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with secrets replaced; n_chars, if there, follows. Texts without secrets stay as they are."""
    text = F.col("text").cast("string")

    def restored(all_: Column) -> Column:
        """What is between candidates from the text itself: a text may hold the characters that mark candidates."""

        def own(at: Column) -> Column:
            return F.transform(all_, lambda p, i: F.struct(p["value"].alias("value"), text.substr((F.get(at, i) + F.length(p["value"]) + 1).cast("int"), F.length(p["rest"])).alias("rest"), p["score"].alias("score")))

        return F.when(text.rlike(f"[{START}{END}]"), let(starts(all_), own)).otherwise(all_)

    def masked(all_: Column) -> Column:
        new = F.array_join(F.transform(restored(all_), lambda p: F.concat(F.when(p["score"] >= 0.5, mark).otherwise(p["value"]), p["rest"])), "")
        return F.when(F.exists(all_, lambda p: p["score"] >= 0.5), new)

    # Null unless something is masked.
    new = F.when(text.rlike(HINT), let(judged(text, F.col(path), forest), masked))
    out = documents.select(F.struct(*documents.columns).alias("row"), new.alias("new"))
    kept = {c: F.col("row")[c] for c in documents.columns}
    kept["text"] = F.coalesce("new", kept["text"])
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new")).otherwise(kept["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return out.select(*(column.alias(c) for c, column in kept.items()))


def op1_secrets_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(findings(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_secrets_forest": op1_secrets_forest}
