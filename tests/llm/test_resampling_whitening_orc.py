"""Resampling, whitening and token files against plain versions, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import importance_resampling as resampling
from quillon.llm import kernel, token_orc, whitening
from quillon.llm.workspace import shared_dir

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def buckets(text):
    words = LETTERS.findall(lowered(text))
    return words, [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def plain_resampling(rows, target):
    found = [(i, *buckets(t)) for i, t in rows]
    raw, aim = [0] * 10000, [0] * 10000
    for _, _, b in found:
        for x in b:
            raw[x] += 1
    for t in target:
        for x in buckets(t)[1]:
            aim[x] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + 10000) / ((s + 1) * (sum(aim) + 10000)))) for s, t in zip(raw, aim, strict=True)]
    scored = []
    for i, words, b in found:
        weight = math.floor(sum(gain[x] for x in b) / len(b)) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(words), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted(((x[0], x[2], x[3], x[4], rank.get(id(x))) for x in scored), key=repr)


def said(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "ünder", "x9", "the", "of", "word", "ß"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(k, said(rng, rng.choice([0, 1, 2, 19, 20, 21, 60, 300]))) for k in range(120)]
    return [*out, (200, None), (201, ""), (202, " \t\n--"), (203, "a" * 700 + " b " + "é" * 400), (None, said(rng, 30)), (300, said(rng, 25)), (300, said(rng, 26)), (301, "one\x00two_three-FOUR 5"), (302, said(rng, 9000))]


@pytest.fixture(scope="module")
def target():
    rng = random.Random(12)
    return [*(said(rng, 15) + " target words" for _ in range(9)), None, ""]


def frame(spark, rows):
    # Columns whose names operators use themselves.
    return spark.createDataFrame([(i, t, "x", 1, b"") for i, t in rows], "doc_id long, text string, part string, rank int, stream binary").repartition(5)


def test_resampling_equals_a_plain_version(spark, rows, target):
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resampled(frame(spark, rows), items).collect()), key=repr)
    assert got == plain_resampling(rows, target)
    assert sum(r[4] is not None for r in got) > 5


def test_resampling_without_documents_or_target(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, item_id long, text string")
    assert resampling.resampled(empty, empty).count() == 0
    got = sorted((tuple(r) for r in resampling.resampled(frame(spark, rows[:40]), empty).collect()), key=repr)
    assert got == plain_resampling(rows[:40], [])


def test_repeated_rows_rank_side_by_side(spark):
    text = said(random.Random(1), 30)
    got = [tuple(r) for r in resampling.resampled(frame(spark, [(5, text)] * 40), spark.createDataFrame([(1, text)], "item_id long, text string")).collect()]
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 11)) and len({r[:4] for r in got}) == 1 and len(got) == 40


def test_long_texts_are_read_in_slices(monkeypatch):
    rng = random.Random(4)
    texts = [said(rng, 2000), "x" * 500 + " " + said(rng, 50), "", "--", " ".join("yz" * rng.randrange(1, 90) for _ in range(60))]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        n, offsets, stream = resampling.piece_stream(kernel.Texts(raw, np.array([0, len(raw)]), 0))
        words, of = buckets(text)
        assert n.tolist() == [len(words)] and stream.tolist() == of
        for size in (7, 64, 1000):
            monkeypatch.setattr(resampling, "SLICE", size)
            m, at, again = resampling.long_stream(raw)
            assert m.tolist() == n.tolist() and at.tolist() == offsets.tolist() and sorted(again.tolist()) == sorted(of)


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    n, total = len(x), [int(v) for v in x.sum(0)]
    y = x - x.mean(0)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    return n, exact, y @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * np.logspace(0, -2, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, component int").repartition(4)
    got = whitening.whitened(df).collect()
    n, exact, white, explained = plain_whitening(vectors)
    assert len(got) == 300 * 8 and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == set(range(300))
    of = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, 9):
        mine = np.array([of[k, c]["whitened"] for k in range(300)])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.allclose(sign * mine, white[:, c - 1], atol=1e-7)
        assert abs(of[0, c]["explained"] / explained[c - 1] - 1) < 1e-9
    assert all(of[k, 1]["deviation"] == exact[k] for k in range(300))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, []), (2, [])], kind)).count() == 0
    # A direction that does not vary is no component; repeated and null ids are rows like others.
    rows = [(None, [0.1, 0.3, 1.0]), (7, [0.4, -0.2, 1.0]), (7, [0.4, -0.2, 1.0]), (8, [-0.3, 0.9, 1.0])]
    got = whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert got[0]["identity_error"] < 1e-9
    # A shorter vector ends in zeros.
    short = whitening.whitened(spark.createDataFrame([(1, [0.5]), (2, [0.25, 1.0]), (3, [0.0, 0.5])], kind)).collect()
    full = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.25, 1.0]), (3, [0.0, 0.5])], kind)).collect()
    assert {(r["vec_id"], r["component"], r["deviation"]) for r in short} == {(r["vec_id"], r["component"], r["deviation"]) for r in full}


def test_whitening_of_huge_components(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0]), (4, [4e12, 1.0])]
    got = {r["vec_id"]: r for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1]["deviation"] == whitening.LONG and got[1]["n"] == 4 and got[1]["identity_error"] < 1e-6
    x = [[int(min(max(1024 * c, -(2.0**62)), 2.0**62)) + 100000 for c in v] for _, v in rows]
    total = [sum(col) for col in zip(*x, strict=True)]
    assert whitening.sums(whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == (4, total)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 17])
def test_jacobi_keeps_small_eigenvalues_accurate(n):
    rng = np.random.default_rng(n)
    scale = np.logspace(0, -7, n)
    core = np.eye(n) + 0.3 * (lambda m: (m + m.T) / 2)(rng.uniform(-1, 1, (n, n))) / n
    matrix = scale[:, None] * core * scale
    values, axes = whitening.jacobi(matrix)
    assert np.all(np.diff(values) <= 0) and np.allclose(axes.T @ axes, np.eye(n), atol=1e-12)
    assert np.allclose(matrix @ axes, axes * values, atol=1e-14)
    # Of the scaled matrix's inverse, the small eigenvalues are the large ones.
    inverse = np.linalg.eigvalsh((1 / scale)[:, None] * np.linalg.inv(core) * (1 / scale))
    assert np.allclose(np.sort(values)[: (n + 1) // 2], np.sort(1 / inverse)[: (n + 1) // 2], rtol=1e-8)
    pairs = [(a, b) for p, q in whitening.rounds(n) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def plain_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_are_a_round_trip(spark, rows, tmp_path, monkeypatch):
    # Pieces far shorter than some documents; set before workers start.
    path, once = str(tmp_path / "ids"), [r for r in rows if r[0] not in (None, 300)]
    token_orc.write(frame(spark, once), path, str(public_tokenizers.path("word_bpe_49k.json")))
    want, start = [], 0
    for i, ids in sorted(plain_ids(once)):
        want.append((i, start, len(ids), digest(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_orc.digests(spark, path).collect()) == want
    assert max(len(r["ids"]) for r in token_orc.read(spark, path).collect()) <= token_orc.PIECE < max(x[2] for x in want)
    of = {r["doc_id"]: list(r["ids"]) for r in token_orc.read(spark, path, [5, 7, 999]).collect()}
    assert of == {i: ids for i, ids in plain_ids(once) if i in (5, 7)}


def test_token_files_with_repeated_and_missing_ids(spark, rows, tmp_path):
    path = str(tmp_path / "ids")
    token_orc.write(frame(spark, [*rows, rows[3], rows[3]]), path, str(public_tokenizers.path("word_bpe_49k.json")))
    got = sorted((tuple(r) for r in token_orc.digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)]).tolist()[:-1]
    assert [-1 if r[0] is None else r[0] for r in got] == sorted(-1 if i is None else i for i, _ in [*rows, rows[3], rows[3]])
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(ids), digest(ids)) for i, ids in plain_ids([*rows, rows[3], rows[3]]))
    token_orc.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), str(public_tokenizers.path("word_bpe_49k.json")))
    assert token_orc.digests(spark, str(tmp_path / "none")).count() == 0


def test_checksums_of_parts():
    raw = random.Random(2).randbytes(9000)
    for cuts in ([], [1], [100, 100, 4096], [8999]):
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        assert token_orc.joined((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(raw)


def scanned(df) -> int:
    """Rows that a plan's scan has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size() or "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_files_have_indexes_and_bloom_filters(spark, tmp_path):
    """Even ids over several index entries: a filter on an id inside the range of one reads that entry, or none if absent."""
    path = str(tmp_path / "ids")
    rows = spark.range(0, 40000, 2).select(F_id(), F_text()).coalesce(1)
    token_orc.write(rows, path, str(public_tokenizers.path("word_bpe_49k.json")))
    files = [f for f in spark.read.orc(path).inputFiles() if f.endswith(".orc")]
    jvm = spark._jvm
    kinds = set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == token_orc.STRIDE
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        kinds |= {footer.getStreams(k).getKind().toString() for k in range(footer.getStreamsCount())}
        assert {footer.getColumns(k).getKind().toString() for k in range(1, 8)} <= {"DIRECT_V2", "DIRECT"}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    one = token_orc.read(spark, path, [20000])
    assert "PushedFilters: [In(doc_id, [20000])]" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,20000)" in one._jdf.queryExecution().toString()
    assert one.count() == 1 and 0 < scanned(one) <= token_orc.STRIDE
    assert sum(scanned(token_orc.read(spark, path, [k])) > 0 for k in range(10001, 10101, 2)) <= 5


def F_id():
    from pyspark.sql import functions as F

    return F.col("id").alias("doc_id")


def F_text():
    from pyspark.sql import functions as F

    return F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")
